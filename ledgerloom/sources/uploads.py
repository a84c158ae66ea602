"""Uploaded files as rows: what is a PDF and small enough."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MOST_BYTES = 50 * 1024 * 1024
#: The first bytes of a PDF file, a fixed value of the format.
SIGN = b"%PDF"
FORMAT = "ledgerloom_uploads"
#: Files of a task.
FILES = 1000


@dataclass
class Files(InputPartition):
    found: list[tuple[str, int]]


class Reader(DataSourceReader):
    """Lists a folder once; tasks open files and read four bytes of each, and more only where a digest is asked for."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.most = options["path"], int(options.get("most", MOST_BYTES))
        self.digest, self.files = options.get("digest", "false") == "true", int(options.get("files", FILES))

    def _store(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = self._store()
        every = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file and x.base_name[0] not in "._")
        return [Files(every[k : k + self.files]) for k in range(0, len(every), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for path, length in partition.found:
            small, sign, sha = length <= self.most, None, None
            if small:
                with store.open_input_file(path) as held:
                    sign = held.read(len(SIGN))
                    if self.digest and sign == SIGN:
                        state = hashlib.sha256(sign)
                        while part := held.read(1 << 20):
                            state.update(part)
                        sha = state.hexdigest()
            status = "rejected: too large" if not small else "accepted" if sign == SIGN else "rejected: no PDF"
            yield path, path.rsplit("/", 1)[-1], length, sha, status


class Uploads(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, file_name string, length long, sha256 string, status string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)


def pdf_files(spark: SparkSession, folder: str, most: int = MOST_BYTES, digest: bool = False) -> DataFrame:
    """(path, file_name, length, sha256, status) of every file of a folder and its subfolders, but for those whose names begin with
    a point or a line, which are not yet whole: accepted, or why not. Sizes are
    judged from the listing, and of a file that is small enough four bytes are read, whatever its length; accepted files
    are read as a whole, a piece after the other, only where their digest is asked for (else it is null)."""
    spark.dataSource.register(Uploads)
    return spark.read.format(FORMAT).options(path=folder, most=str(most), digest=str(digest).lower()).load()


def better_text(native: str = "native_text", read: str = "ocr_text", least: int = 80):  # noqa: ANN201
    """(needs, text): whether a page's own text is so short that it must be read from its image, and the text that is kept: the
    read one only where it says more."""
    count = lambda c: F.length(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^A-Za-z0-9]", ""))
    needs = count(native) < least
    return needs, F.when(needs & (count(read) > count(native)), F.col(read)).otherwise(F.col(native))
