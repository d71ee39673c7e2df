"""Near-duplicate documents by circulant MinHash.

All coordinates of a signature come from two permutations of one universe: the
first scatters the shingles, the second ranks them, shifted circularly by one
place for each further coordinate. Coordinates are cut into bands; documents
that share a band are compared on their full shingle sets, and linked when
100 * intersection >= percent * union.

Rows with the same set are one class from the start, so copies cost one row.
Within a band's bucket every class is compared with the most central one, and
after that only with classes of other components that neither the count of shingles
which nobody else has, nor their distances to that centre, nor the parities of their
shingles rule out; a pair meets in the first band that it shares, and no bucket is
expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.llm.graph import components
from dialweave.llm.batches import parts
from dialweave.llm.words import Words, mixed, shingle_sets
from dialweave.session import freeze

UNIVERSE_BITS = 20
SEED = 20_240_501
#: 64-bit words of a set's parities.
PARITY_WORDS = 16


class Circulant:
    """Signatures of `bands * rows` coordinates, folded to one hash a band."""

    def __init__(self, bands: int, rows: int):
        draw = np.random.Generator(np.random.PCG64(SEED))
        size = 1 << UNIVERSE_BITS
        self.bands, self.rows = bands, rows
        self.scatter = draw.permutation(size).astype(np.uint32)
        ranks = draw.permutation(size).astype(np.uint32)
        width = bands * rows
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: width - 1]]), width)
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.scatter[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
        least = None
        for i in range(0, len(at), 2048):
            part = self.shifted[at[i : i + 2048]].min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least

    def folded(self, shingles: np.ndarray) -> np.ndarray:
        ranks = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        total = self.salt
        for i in range(self.rows):
            total = mixed(total + ranks[:, i] + np.uint64(1))
        return total.view(np.int64)


def _class_of(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, known = Circulant(bands, rows), Words()
        for batch in parts(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), words, known)
            full = [s for s in sets if len(s)]
            folded = np.concatenate([make.folded(s) for s in full]) if full else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([bands if len(s) else 0 for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(folded)),
                ],
                ["doc_id", "n_shingles", "cid", "bands"],
            )

    return run


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each of 64 * PARITY_WORDS places holds an odd number of the shingles, as bits.

    Two sets differ in at least as many shingles as their parities in bits.
    """
    places = 64 * PARITY_WORDS
    odd = np.bincount((mixed(shingles) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in parts(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), words, known)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["cid", "shingles", "odd"],
            )

    return run


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 6
) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A pair at the threshold shares a band with probability 1 - (1 - s^rows)^bands:
    0.999995 at 0.80, 0.99999999 at 0.85. component_id is the smallest doc_id
    reachable over links, itself included; kept says that it is the row's own.

    Null and empty texts have no shingles and link with nothing. A row with a null
    doc_id links with nothing either; its component_id is null and it is kept.
    Rows repeating a doc_id are each placed by their own text. Other columns of
    `docs` are ignored, whatever their names; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = freeze(
        texts.mapInArrow(
            _sign(words, bands, rows), "doc_id long, n_shingles long, cid long, bands array<long>"
        )
    )
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("cid").agg(F.min("doc_id").alias("rep"))
    # one row a class: that of its smallest doc_id
    reps = real.join(classes, "cid").where("doc_id = rep")

    entries = reps.select("cid", "rep", "n_shingles", F.posexplode("bands").alias("place", "band"))
    shared = entries.groupBy("band").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi")
    mates = freeze(entries.join(shared.select("band"), "band").select("band", "place", "cid", "rep", "n_shingles"))

    wanted = mates.select(F.col("rep").alias("doc_id")).distinct()
    sets = freeze(texts.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(_full_sets(words), "cid long, shingles array<long>, odd array<long>"))
    # shingles of one class alone: they bound what the class can share with any other
    only = (
        sets.select("cid", F.explode("shingles").alias("s"))
        .groupBy("s")
        .agg(F.min("cid").alias("cid"), F.max("cid").alias("hi"))
        .where("cid = hi")
        .groupBy("cid")
        .agg(F.count("*").alias("alone"))
    )
    mates = freeze(
        mates.select("band", "place", "cid", "n_shingles")
        .join(only, "cid", "left")
        .select("band", "place", "cid", F.col("n_shingles").alias("n"), F.coalesce("alone", F.lit(0)).alias("alone"))
    )

    def compared(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
        other = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
        met = F.size(F.array_intersect("x", "y"))
        return (
            pairs.join(one, "b")
            .join(other, "a")
            .select("a", "b", met.alias("met"), (F.size("x") + F.size("y") - met).alias("either"))
        )

    linked = F.col("met") * 100 >= F.col("either") * percent

    # 1. each class against the most central of its bucket: the one with the least share of own shingles
    centre = mates.groupBy("band").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "cid")).alias("c"))
    centred = mates.join(centre.select("band", F.col("c.cid").alias("centre")), "band")
    star = centred.select(F.col("cid").alias("a"), F.col("centre").alias("b")).where("a <> b")
    measured = freeze(compared(star.distinct()))
    star_links = measured.where(linked).select("a", "b")
    first = freeze(components(star_links))

    # 2. what is still apart, unless own shingles, distances to the centre or parities prove that it must stay so
    far = measured.select(
        F.col("a").alias("cid"), F.col("b").alias("centre"), (1 - F.col("met") / F.col("either")).alias("far")
    )
    placed = (
        centred.join(far, ["cid", "centre"], "left")
        .join(first.withColumnRenamed("node", "cid"), "cid", "left")
        .select("band", "place", "cid", "n", "alone", F.coalesce("far", F.lit(0.0)).alias("far"), F.coalesce("root", "cid").alias("root"))
    )
    apart = placed.groupBy("band").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("alone").alias("least")
    ).where("lo <> hi")
    open_ = placed.join(apart.select("band", "least"), "band").where(
        _can_reach(F.col("n"), F.col("alone"), F.col("n"), F.col("least"), percent, known_size=False)
    )
    open_ = freeze(
        open_.join(sets.select("cid", "odd"), "cid")
        .join(reps.select("cid", "bands"), "cid")
        .select("band", F.slice("bands", 1, F.col("place")).alias("before"), "cid", "n", "alone", "far", "root", "odd")
    )
    left = open_.select([F.col(c).alias(f"l_{c}") for c in open_.columns])
    right = open_.select([F.col(c).alias(f"r_{c}") for c in open_.columns])
    cross = left.join(
        right,
        (F.col("l_band") == F.col("r_band"))
        & (F.col("l_root") < F.col("r_root"))
        # one less the similarity of sets is a distance: two that link are about as far from a third
        & (F.abs(F.col("l_far") - F.col("r_far")) <= 1 - percent / 100 + 1e-9)
        & _can_reach(F.col("l_n"), F.col("l_alone"), F.col("r_n"), F.col("r_alone"), percent)
        & _parities_allow(percent)
        # only in the first band that the two share
        & ~F.arrays_overlap("l_before", "r_before"),
    ).select(F.col("l_cid").alias("a"), F.col("r_cid").alias("b"))
    links = star_links.union(compared(cross.distinct()).where(linked).select("a", "b"))

    # components by class, then the smallest doc_id of each
    rooted = components(links).withColumnRenamed("node", "cid")
    by_class = freeze(classes.join(rooted, "cid", "left").select("cid", "rep", F.coalesce("root", "cid").alias("root")))
    smallest = by_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = by_class.join(smallest, "root").select("cid", "component_id")
    return (
        signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cid")).alias("cid"))
        .join(named, "cid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without near copies: of each linked group the document with the smallest doc_id stays.

    Rows that repeat both doc_id and text are one document; rows without a doc_id
    stay as they are. Columns are those of `docs`.
    """
    kept = near_duplicates(docs, words, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    once = rows.join(kept, F.col("_id") == F.col("_kept"), "left_semi").dropDuplicates(["_id", "_text"])
    return once.union(rows.where("_id IS NULL")).select("_row.*")


def _parities_allow(percent: int):
    """Whether two sets l and r can reach the threshold although they differ wherever their parities do."""
    differ = sum(F.bit_count(F.col("l_odd")[i].bitwiseXOR(F.col("r_odd")[i])) for i in range(PARITY_WORDS))
    both = F.col("l_n") + F.col("r_n")
    return (both - differ) * 100 >= (both + differ) * percent


def _can_reach(n, alone, m, alone_there, percent: int, known_size: bool = True):
    """Whether two sets can still reach the threshold, given the shingles that each has alone.

    They share at most the rest of either, and differ by at least what both have alone.
    """
    most = F.least(n - alone, m - alone_there) if known_size else n - alone
    least_union = F.greatest(n + m - most, most + alone + alone_there) if known_size else most + alone + alone_there
    return most * 100 >= least_union * percent
