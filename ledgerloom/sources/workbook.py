"""Workbooks: sheets of DataFrames written as XLSX files, by a Python data source.

A row is a line of a sheet of a workbook. Rows are dealt by workbook, so that each is written by one task, line by line,
straight into the compressed file; a sheet that is full goes on in another one. Tasks write under temporary names; the
commit renames what they wrote, and an abort, or a task that fails, deletes it, so that there is a whole workbook or none.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerloom.functions import fields, text

#: The most lines of a sheet, a fixed value of the format, and the most characters of its name and of a cell.
LINES, NAME, CELL = 1_048_576, 31, 32_767
FORMAT = "ledgerloom_workbook"
SCHEMA = "workbook string, place int, sheet string, cells array<string>"
_NO_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def letters(k: int) -> str:
    """The name of column k, from 0 on: A to Z, AA and so on."""
    out = ""
    while k >= 0:
        k, rest = divmod(k, 26)
        out, k = chr(65 + rest) + out, k - 1
    return out


def _cell(at: str, value: str | None) -> str:
    """A cell from its packed form: a letter for its kind (n: number, s: text) and its value."""
    if value is None:
        return ""
    if value[0] == "n":
        return f'<c r="{at}"><v>{value[1:]}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub("", value[1:CELL + 1]))}</t></is></c>'


class Book:
    """An XLSX file that is written line by line to a stream."""

    def __init__(self, stream, most: int = LINES) -> None:  # noqa: ANN001
        self.pack, self.most = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), most
        self.names: list[str] = []
        self.sheet = self.head = None

    def open(self, name: str, head: list[str]) -> None:
        self.close()
        self.head, self.base, self.part = head, name, 1
        self._open()

    def _open(self) -> None:
        n, name = 1, self.base if self.part == 1 else f"{self.base[: NAME - 6]} {self.part}"
        while name.lower() in map(str.lower, self.names):
            n, name = n + 1, f"{self.base[: NAME - 6]}~{n}"
        self.names.append(name)
        self.sheet, self.lines = self.pack.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True), 0
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self._line([f"s{x}" for x in self.head])

    def _line(self, cells: list[str | None]) -> None:
        self.lines += 1
        self.sheet.write(f'<row r="{self.lines}">{"".join(_cell(f"{letters(k)}{self.lines}", x) for k, x in enumerate(cells))}</row>'.encode())

    def line(self, cells: list[str | None]) -> None:
        if self.lines >= self.most:
            self.close()
            self.part += 1
            self._open()
        self._line(cells)

    def close(self) -> None:
        if self.sheet is not None:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def finish(self) -> None:
        self.close()
        every = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name={quoteattr(x)} sheetId="{k}" r:id="rId{k}"/>' for k, x in zip(every, self.names))
        links = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in every)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in every)
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACK}/relationships">{links}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        }
        for name, xml in parts.items():
            self.pack.writestr(name, _HEAD + xml)
        self.pack.close()


def _files(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    books: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.heads, self.most = options["path"], json.loads(options["heads"]), int(options.get("lines", LINES))

    def write(self, rows: Iterator) -> Written:
        store, base = _files(self.folder)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, str]] = []
        book = stream = None
        sheet: tuple | None = None
        try:
            for workbook, place, name, cells in rows:
                if book is None or workbook != done[-1][1]:
                    if book is not None:
                        book.finish()
                        stream.close()
                    done.append((f"{base}/.{uuid.uuid4().hex}.part", workbook))
                    stream = store.open_output_stream(done[-1][0])
                    book, sheet = Book(stream, self.most), None
                if (place, name) != sheet:
                    sheet = (place, name)
                    book.open(name, self.heads[place])
                if cells is not None:
                    book.line(cells)
            if book is not None:
                book.finish()
                stream.close()
        except BaseException:
            for part, _ in done:
                if store.get_file_info(part).type.name == "File":
                    store.delete_file(part)
            raise
        return Written([(part, f"{base}/{workbook}.xlsx") for part, workbook in done])

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _files(self.folder)
        for part, book in (x for m in messages if m is not None for x in m.books):
            store.move(part, book)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _files(self.folder)
        for part, _ in (x for m in messages if m is not None for x in m.books):
            store.delete_file(part)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def _packed(column: Column, kind: str) -> Column:
    """A cell as text with a letter for its kind: numbers stay numbers, booleans are Yes and No, all else is text."""
    number = kind.startswith("decimal") or kind in ("double", "float", "bigint", "int", "smallint", "tinyint")
    finite = column.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308) if kind in ("double", "float") else F.lit(True)
    value = F.when(finite, F.concat(F.lit("n"), column.cast("string"))) if number else F.concat(F.lit("s"), text.cell(column, kind))
    return F.when(column.isNotNull(), value)


def lines(sheets: dict[str, DataFrame], by: Column | str, order: list[str] | None = None) -> tuple[DataFrame, list[list[str]]]:
    """The rows of all sheets as lines of workbooks, and the heads of the sheets. `by` names the workbook of a row; each workbook
    has every sheet, those without rows too. order: columns that lines are sorted by, where a sheet has them."""
    parts, heads, books = [], [], []
    for place, (name, sheet) in enumerate(sheets.items()):
        shown = [c for c in sheet.columns if c != by]
        kinds = dict(sheet.dtypes)
        key = F.array(*[F.lpad(F.col(c).cast("string"), 20, "0") if kinds[c] in ("int", "bigint") else F.col(c).cast("string") for c in order or [] if c in sheet.columns], F.lit(""))
        title = fields.sheet_name(F.lit(name))
        book = F.regexp_replace((F.col(by) if isinstance(by, str) else by).cast("string"), r"[^\w.\-]", "_").alias("workbook")
        parts.append(sheet.select(book, F.lit(place).alias("place"), title.alias("sheet"), key.alias("key"), F.array(*[_packed(F.col(c), kinds[c]) for c in shown]).alias("cells")))
        books.append(parts[-1].select("workbook").distinct())
        heads.append(shown)
    every = reduce(DataFrame.unionByName, books).distinct()
    empty = [every.select("workbook", F.lit(k).alias("place"), fields.sheet_name(F.lit(name)).alias("sheet"), F.array(F.lit("")).alias("key"), F.lit(None).cast("array<string>").alias("cells")) for k, name in enumerate(sheets)]
    return reduce(DataFrame.unionByName, [*parts, *empty]), heads


def write(spark: SparkSession, sheets: dict[str, DataFrame], folder: str, by: Column | str, order: list[str] | None = None, most: int = LINES) -> None:
    """Write a workbook for each value of `by`, with the sheets in their order, to folder: `<value>.xlsx`. A workbook is one file,
    so one task writes it; batches are many, and go to as many tasks. Rows without a value of `by` are in no workbook."""
    spark.dataSource.register(Workbooks)
    rows, heads = lines(sheets, by, order)
    dealt = rows.where("workbook is not null").repartition("workbook").sortWithinPartitions("workbook", "place", F.col("cells").isNotNull(), "key", "cells")
    dealt.select("workbook", "place", "sheet", "cells").write.format(FORMAT).mode("append").options(path=folder, heads=json.dumps(heads), lines=str(most)).save()
