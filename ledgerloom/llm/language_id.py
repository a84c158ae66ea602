"""Language identification by compression.

Each language has a zstandard raw-content dictionary, cut from a bounded sample of its labelled texts. A text is
encoded with every dictionary, block by block; the language whose dictionary gives the fewest bytes wins, and a text
for which the runner-up comes too close is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import in_blocks

#: Samples for each language, and the characters taken from each: together the bound of a dictionary.
SAMPLES, SAMPLE_CHARS = 128, 512
#: Bytes that are encoded at once.
BLOCK = 2048
#: A search that takes matches from three bytes on: shorter ones than the usual levels, as words are short.
SEARCH = {"strategy": zstandard.STRATEGY_LAZY, "min_match": 3, "window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 4, "target_length": 16}
#: Share of the runner-up's bytes by which the winner must be smaller.
MARGIN = 0.002
UNKNOWN = "und"
#: Letters alone: no digits, fractions or numerals of any script.
_LETTER = regex.compile(r"\p{L}")


def dictionaries(docs: DataFrame, training: Column | None = None, samples: int = SAMPLES, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """lang to dictionary, from the rows of docs with text and lang for which `training` holds.

    Texts fall into `samples` buckets by hash; the one with the smallest hash in each gives a stretch of `chars`
    characters from a place that its hash names. So the sample is fixed by the texts, spread over all of them, and its
    size is bounded whatever the input.
    """
    rows = docs.where("text is not null and lang is not null and text <> ''")
    rows = (rows if training is None else rows.where(training)).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    least = rows.select("lang", F.pmod("h", F.lit(samples)).alias("bucket"), "h").groupBy("lang", "bucket").agg(F.min("h").alias("h")).select("lang", "h")
    first = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - chars, F.lit(0)).cast("long") + 1).cast("int") + 1
    stretch = F.substring(F.col("text"), first, F.lit(chars))
    # `least` has at most `samples` rows for each language, so it is safe to broadcast and its texts' stretches to collect.
    found = rows.join(F.broadcast(least), ["lang", "h"]).select("lang", "h", stretch.alias("part")).groupBy("lang", "h").agg(F.min("part").alias("part")).orderBy("lang", "h").collect()
    parts: dict[str, list[bytes]] = {}
    for r in found:
        parts.setdefault(r["lang"], []).append(r["part"].lower().encode("utf-8"))
    return {lang: b"\n".join(x) for lang, x in parts.items()}


class Judge:
    """Chooses among languages by the dictionaries of lower-case text that they have."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.encoders = []
        params = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=0, write_checksum=0, write_dict_id=0)
        for lang in sorted(dictionaries):
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            self.encoders.append((lang, zstandard.ZstdCompressor(compression_params=params, dict_data=content).compress))

    def sizes(self, text: bytes) -> list[tuple[int, str]]:
        """(bytes, lang), smallest first, ties in order of lang."""
        blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
        return sorted((sum(len(encode(x)) for x in blocks), lang) for lang, encode in self.encoders)

    def __call__(self, text: bytes) -> tuple[str, float]:
        """The language and the margin to the runner-up as a share of its bytes: 1 without one."""
        lower = text.decode("utf-8").lower()
        if not self.encoders or not _LETTER.search(lower):
            return UNKNOWN, 0.0
        best = self.sizes(lower.encode("utf-8"))
        return best[0][1], 1.0 if len(best) < 2 else 1 - best[0][0] / best[1][0]


_judges: dict[tuple, Judge] = {}


def judge(shared) -> Judge:  # noqa: ANN001
    key = tuple(sorted(shared.value.items()))
    if key not in _judges:
        _judges.clear()
        _judges[key] = Judge(shared.value)
    return _judges[key]


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with __lang and __margin (double, 0 to 1) for every row. Whole texts count; a null text, or one without a
    letter, gives `und` and 0, as do all where there is no dictionary; ties go to the language that sorts first."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge(shared)
        for batch in in_blocks(batches, "__bytes"):
            found = [decide(x.as_py() or b"") for x in batch.column("__bytes")]
            keep = [c for c in batch.schema.names if c != "__bytes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*keep, "__lang", "__margin"])

    rows = docs.withColumn("__bytes", F.col("text").cast("binary"))
    out = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__margin", T.DoubleType())])
    return rows.mapInArrow(run, out)


def rejected(margin: float = MARGIN) -> Column:
    """Whether a predicted row has no language, or one by too narrow a margin."""
    return (F.col("__lang") == UNKNOWN) | (F.col("__margin") < margin)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def languages(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs; rows held out, or without a doc_id, teach nothing.

    score is the margin to the runner-up, 0 to 1. A null text, or one without a letter, is `und`, as all are where nothing
    is labelled; repeated rows get the same answer each; texts of any length count as wholes; an empty table gives no rows;
    other columns are ignored, whatever their names. Dictionaries are bounded for each language, so they grow with the
    number of distinct values of lang, of which there must be few.
    """
    known = dictionaries(docs, F.coalesce(~held_out(), F.lit(False)))
    found = predict(docs.select("doc_id", "text"), known)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__margin").alias("score"), rejected(margin).alias("rejected"))


def identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose language is recognised, columns as they were; what is learnt comes from all labelled rows."""
    return predict(docs, dictionaries(docs)).where(~rejected(margin)).select(*docs.columns)
