"""Document fingerprints by winnowing.

All runs of GRAM code points are hashed by a rolling polynomial; of every WINDOW
neighbouring hashes the smallest is kept, the rightmost where equal, with its
position. Any passage of GRAM + WINDOW - 1 code points (99) that two texts share
leaves a hash in both fingerprints, and none shorter than GRAM does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.llm.words import mixed

GRAM, WINDOW = 24, 76
#: A kept entry is a 40-bit hash and the position (modulo 2 ** 24).
PLACE_BITS = 24
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class Winnower:
    def __init__(self, gram: int = GRAM, window: int = WINDOW):
        self.gram, self.window = gram, window
        self.powers = self.back = np.ones(1, np.uint64)

    def _grown(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))
            factors = np.full(size, _BASE, np.uint64)
            factors[0] = 1
            self.powers = np.multiply.accumulate(factors)
            factors[1:] = _BACK
            self.back = np.multiply.accumulate(factors)

    def entries(self, text: str) -> np.ndarray:
        """hash << 24 | position of the kept grams, in order of position."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if not len(points):
            return points
        k = min(self.gram, len(points))
        self._grown(len(points) + 1)
        ahead = np.concatenate([[np.uint64(0)], np.cumsum((points + np.uint64(1)) * self.powers[: len(points)])])
        n = len(points) - k + 1
        hashes = mixed((ahead[k:] - ahead[:n]) * self.back[:n] + np.uint64(k))
        low = np.uint64((1 << PLACE_BITS) - 1)
        place = np.arange(n, dtype=np.uint64) & low
        # the smaller of two equal hashes is then the one further right
        least = (hashes & ~low) | (low - place)
        width, window = 1, min(self.window, n)
        while width < window:
            step = min(width, window - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        kept = least[np.concatenate([[True], least[1:] != least[:-1]])]
        return (kept & ~low) | (low - (kept & low))


def written(entries: np.ndarray) -> str:
    """16 hexadecimal digits an entry: ten of the hash, six of the position."""
    return entries.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes against all hashes of two fingerprints; two empty ones are alike."""
    a, b = np.unique(a >> np.uint64(PLACE_BITS)), np.unique(b >> np.uint64(PLACE_BITS))
    if not len(a) and not len(b):
        return 1.0
    met = len(np.intersect1d(a, b, assume_unique=True))
    return met / (len(a) + len(b) - met)


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order within their bucket, each bucket closed by the first row of the next."""
    winnow = Winnower()
    held = None
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "guard", "doc_id", "text"))
        for bucket, guard, doc_id, text in zip(*columns):
            own = winnow.entries(text)
            if held is not None and held[0] == bucket:
                _, before_id, before, entries = held
                cut = len(before) // 2
                edited = before[: len(before) - cut] + text[:cut]
                after = winnow.entries(edited)
                rows.append(
                    (
                        before_id,
                        len(before),
                        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        written(entries),
                        written(after),
                        likeness(entries, after),
                        likeness(entries, own),
                    )
                )
            held = None if guard else (bucket, doc_id, text, own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_OUT)], schema=_OUT
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text), with the fingerprint of its text and of the edited text.

    Edited is the text whose last floor(n_chars / 2) code points are replaced by the
    first as many of the next document by doc_id (after the last: the first). Rows
    with one doc_id follow one another by text; rows without doc_id come first. A
    null text is empty; its fingerprint is the empty string. A single row is its own
    next. Other columns are ignored; an empty table gives an empty result.

    Documents are dealt out by ranges of doc_id, once; the first of each range is
    dealt to the range before as well, so that every row meets its next one.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(cuts, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")
        return pa.array(found.astype(np.int32))

    placed = rows.withColumn("bucket", range_of("doc_id"))
    # a row for each range: its smallest doc_id, null before all
    firsts = (
        placed.groupBy("bucket")
        .agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first"))
        .orderBy("bucket")
        .collect()
    )
    before = {r["bucket"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    starts = {r["bucket"]: r["first"] for r in firsts}
    if not firsts:
        before, starts = {0: 0}, {0: 0}
    known = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    ahead = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    is_first = F.coalesce("doc_id", F.lit(-(1 << 63))) == known[F.col("bucket")]
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guard"))
    other = F.struct(ahead[F.col("bucket")].alias("bucket"), F.lit(1).alias("guard"))
    dealt = placed.withColumn("at", F.explode(F.when(is_first, F.array(own, other)).otherwise(F.array(own))))
    return (
        dealt.select("at.bucket", "at.guard", "doc_id", "text")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "guard", F.asc_nulls_first("doc_id"), "text")
        .mapInArrow(
            _walked,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double",
        )
    )
