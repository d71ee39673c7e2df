"""Text search through an index.

A postings table names, for every three letters that stand together in a searched
column, the rows that have them. A term's own letters then leave few candidate rows,
and the exact test decides about these, so the answer is that of a whole scan. Row
groups of the index are sorted by letters: a search reads those of its term only.

The index may lag behind: postings of texts that changed only bring a candidate too
many, but new texts must be appended before they can be found.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialweave.operators.filters import INLINE_KEYS, text_search
from dialweave.operators.sketches import is_small, narrowed

#: Letters of a posting. Shorter terms are searched by scan.
LETTERS = 3
#: Groups of letters of one term that are looked up, a bit each; the exact test sees to the rest of a longer term.
LOOKED_UP = 60

#: Of these the rarest are combined. Where even the rarest has more postings than WORTH, a scan is cheaper.
COMBINED, WORTH = 4, 10_000_000


def postings(rows: DataFrame, pk: str, columns: list[str]) -> DataFrame:
    """(field, letters, key) of every row; NULL and shorter texts have none."""
    # a table of few files would be cut into letters by as few tasks
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(pk).alias("key"), F.array(*columns).alias("texts")).repartition(parts, "key")
    texts = F.array(*[F.struct(F.lit(c).alias("field"), F.lower(F.col("texts")[i]).alias("text")) for i, c in enumerate(columns)])
    named = dealt.select("key", F.inline(texts)).where(F.length("text") >= LETTERS)
    starts = F.sequence(F.lit(1), F.length("text") - (LETTERS - 1))
    # one at a time: functions over arrays of text are not compiled, and take several times as long
    posted = named.select("field", "key", "text", F.explode(starts).alias("start"))
    letters = F.substring("text", F.col("start"), F.lit(LETTERS))
    first = F.instr("text", letters) == F.col("start")
    return posted.where(first).select("field", letters.alias("letters"), "key")


def _code(letters: Column) -> Column:
    """The letters as one number in the order of their text: 21 bits hold a letter."""
    each = [F.ascii(F.substring(letters, F.lit(i), F.lit(1))).cast("long") for i in range(1, LETTERS + 1)]
    return reduce(lambda code, letter: F.shiftleft(code, 21).bitwiseOR(letter), each)


def write_postings(rows: DataFrame, pk: str, columns: list[str], path: str, mode: str = "append") -> None:
    """Write or extend an index. Ranges are cut by letters and key, so common letters fill several.

    A number sorts by its digits; texts that are mostly equal would be compared one with another.
    """
    found = postings(rows, pk, columns).withColumn("code", _code(F.col("letters"))).repartitionByRange("code", "key")
    found.sortWithinPartitions("code").drop("code").write.mode(mode).parquet(path)


def read_postings(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    return spark.read.schema(f"field string, letters string, key {key_type}").parquet(path)


def term_letters(term: str, literal: bool = False) -> list[str]:
    """Groups of letters every match has; none if the term is too short, or escapes a wildcard."""
    if "\\" in term and not literal:
        return []
    parts = [term.lower()] if literal else re.split("[%_]", term.lower())
    found = {p[i : i + LETTERS] for p in parts for i in range(len(p) - LETTERS + 1)}
    return sorted(found)[:LOOKED_UP]


def rarest(index: DataFrame, columns: list[str], letters: list[str]) -> tuple[list[str], int]:
    """The COMBINED rarest groups of letters, and the postings of the rarest; runs a job of at most LOOKED_UP counts."""
    hits = index.where(F.col("field").isin(columns) & F.col("letters").isin(letters))
    counts = dict(hits.groupBy("letters").count().collect())
    first = sorted(letters, key=lambda group: (counts.get(group, 0), group))[:COMBINED]
    return first, counts.get(first[0], 0)


def candidates(index: DataFrame, columns: list[str], letters: list[str]) -> DataFrame:
    """Keys of rows that have all groups of letters in one of the columns."""
    place = (F.array_position(F.array(*map(F.lit, letters)), F.col("letters")) - 1).cast("int")
    seen = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("seen")
    hits = index.where(F.col("field").isin(columns) & F.col("letters").isin(letters))
    full = hits.groupBy("field", "key").agg(seen).where(F.col("seen") == (1 << len(letters)) - 1)
    return full.select("key").distinct()


def indexed_search(
    df: DataFrame, pk: str, columns: list[str], term: str | None, index: DataFrame, literal: bool = False
) -> DataFrame:
    """What ``text_search`` finds, looking at candidates only.

    Up to INLINE_KEYS candidates become a filter on the key that reaches the scan; up to
    the size of a small batch, a sketch; a term that leaves more is searched by scan.
    Common letters cost little: they are counted, and only the rarest few are combined.
    Looking up runs jobs.
    """
    letters = term_letters(term, literal) if term else []
    letters, least = rarest(index, columns, letters) if letters else ([], 0)
    if letters and least <= WORTH:
        found = candidates(index, columns, letters)
        keys = [r[0] for r in found.limit(INLINE_KEYS + 1).collect()]
        if len(keys) <= INLINE_KEYS:
            df = df.where(F.col(pk).isin(keys)) if keys else df.where(F.lit(False))
        elif is_small(found):
            df = narrowed(df, pk, found, "key")
    return text_search(df, columns, term, literal)
