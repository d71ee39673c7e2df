"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its NEAREST reference points in order of closeness. Two
vectors are compared when they share SHARED or more of them. Lists are kept for
sets of SHARED pivots rather than for single ones: a list holds the vectors that
have all its pivots, which is the count over single lists carried out ahead, and
it stays short where single lists would hold a fixed part of all vectors.

Lists whose first pivots agree make a cell. A vector is sent to its cells once each,
in 16 bits a component, and the lists are made and their pairs compared there, in
blocks. No pair leaves a cell but those too close to the least cosine to be told by
16 bits; of the others only counts and trees of linked vectors go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.llm.graph import components
from dialweave.llm.tables import new_folder, remove, written
from dialweave.operators.sketches import narrowed
from dialweave.session import freeze

#: Reference points, chosen from a bounded sample of the vectors; every vector is indexed.
PIVOTS, SAMPLE = 256, 4096
NEAREST, SHARED = 8, 3
#: Cosine below which two reference points lie apart.
APART = 0.8


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A row a vector; shorter ones are padded with zeros, null ones and null components are not numbers."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.zeros((len(column), width))
    rows[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    rows[column.is_null().to_numpy(zero_copy_only=False)] = np.nan
    return rows


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can link, and these as unit vectors."""
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    scaled = rows[good] / np.abs(rows[good]).max(axis=1, keepdims=True)
    return good, scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _class_ids(rows: np.ndarray) -> np.ndarray:
    """A hash for each row, the same for equal ones."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows + 0.0], np.uint64).view(np.int64)


def spread(sample: np.ndarray) -> np.ndarray:
    """The reference points, as unit vectors: the first of `sample` that lie apart.

    A dense group gets one or a few however many of the vectors it holds. With a share
    of them as large as its own, its members would be told apart by noise.
    """
    rows = sample / np.abs(sample).max(axis=1, keepdims=True)
    rows /= np.sqrt((rows**2).sum(axis=1, keepdims=True))
    chosen, n = np.zeros((min(PIVOTS, len(rows)), rows.shape[1])), 0
    for row in rows:
        if n < len(chosen) and (chosen[:n] @ row < APART).all():
            chosen[n] = row
            n += 1
    return chosen[:n]


def _nearest(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots; equally near ones by number, whatever rows are asked together."""
    return np.argsort(-np.round(units @ pivots.T, 12), axis=1, kind="stable")[:, :NEAREST]


def _indexed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"), width)
            good, _ = _unit(rows)
            cids = np.zeros(len(rows), np.int64)
            cids[good] = _class_ids(rows[good])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cids, mask=~good)], ["vec_id", "cid"])

    return run


def _exact(width: int):
    """Class and unit vector of the rows that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"), width)
            good, units = _unit(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_class_ids(rows[good])), pa.array([u.tobytes() for u in units], pa.binary())], ["cid", "vector"]
            )

    return run


#: Steps of a component of a unit vector on its way to a cell.
STEPS = 32767
#: Vectors of a list that are compared before its next pivot is looked at; compared at a time.
LIST, TILE = 1024, 1024
#: Vectors of a cell that a task holds at once; a larger cell is dealt by its second pivot.
CELL = 1 << 18


class Cells:
    """Which cell the lists of two first pivots belong to. Pivots are numbered by how rare they are."""

    def __init__(self, pivots: np.ndarray, sample: np.ndarray, rows: int):
        self.width = pivots.shape[1]
        near = _nearest(sample, pivots)
        self.nearest = near.shape[1]
        self.shared = min(SHARED, self.nearest)
        # cells of rare pivots come first, so that the frequent ones hold what is left
        order = np.argsort(np.bincount(near.ravel(), minlength=len(pivots)), kind="stable")
        self.pivots = pivots[order]
        firsts = self.ranks(sample)[:, : self.nearest - self.shared + 1]
        expected = np.bincount(firsts.ravel(), minlength=len(pivots)) * (rows / max(1, len(sample)))
        self.kind = "<u1" if len(pivots) <= 256 else "<u2"
        self.parts = np.maximum(1, np.ceil(expected / CELL)).astype(np.int64)
        #: What 16 bits and products of single precision may put a cosine off by.
        self.off = math.sqrt(self.width) / STEPS + self.width / STEPS**2 + (self.width + 16) * 2.0**-23

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first * len(self.pivots) + second % self.parts[first]

    def ranks(self, units: np.ndarray) -> np.ndarray:
        return np.sort(_nearest(units, self.pivots), axis=1)

    def pairs(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that each row of ranks belongs to, by cell."""
        last = self.nearest - self.shared
        if self.shared == 1:
            met = self.of(ranks, 0)
        else:
            two = [(i, j) for i in range(last + 1) for j in range(i + 1, last + 2)]
            met = np.stack([self.of(ranks[:, i], ranks[:, j]) for i, j in two], axis=1)
        met = np.sort(met, axis=1)
        new = np.ones(met.shape, bool)
        new[:, 1:] = met[:, 1:] != met[:, :-1]
        row, place = np.nonzero(new)
        cell = met[row, place]
        order = np.argsort(cell, kind="stable")
        return row[order], cell[order]


def _dealt(cells: Cells):
    """A row for each cell that vectors of a batch belong to: their classes, rows, ranks of pivots and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"), cells.width)
            good, units = _unit(rows)
            cids, first, count = np.unique(_class_ids(rows[good]), return_index=True, return_counts=True)
            units = units[first]
            ranks = cells.ranks(units)
            row, cell = cells.pairs(ranks)
            columns = [cids, count.astype(np.int64), ranks.astype(cells.kind), np.rint(units * STEPS).astype("<i2")]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            held = [row[i:j] for i, j in zip(starts, [*starts[1:], len(cell)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[starts], pa.int64()), *(pa.array([c[h].tobytes() for h in held], pa.binary()) for c in columns)], _PIECE
            )

    return run


_PIECE = ["cell", "cids", "counts", "ranks", "components"]
_LINKED = ["a", "b", "others", "sure"]


class Cell:
    """Vectors of a cell, and what is found of their links."""

    def __init__(self, cells: Cells, cell: int, pieces: list[tuple[bytes, ...]], least: float):
        self.cells, self.cell, self.least = cells, cell, least
        cids, counts, ranks, parts = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*pieces), ("<i8", "<i8", cells.kind, "<i2")))
        ranks, parts = ranks.reshape(len(cids), -1), parts.reshape(len(cids), -1)
        self.cids, first, inverse = np.unique(cids, return_index=True, return_inverse=True)
        rows = np.bincount(inverse, weights=counts).astype(np.int64)
        # those with the same pivots stand together
        order = np.lexsort(ranks[first].T[::-1])
        first = first[order]
        self.cids, self.rows, self.ranks, self.parts = self.cids[order], rows[order], ranks[first].astype(np.int64), parts[first]
        n = len(self.cids)
        self.held = np.zeros((n, -(-len(cells.pivots) // 64)), np.uint64)
        for r in self.ranks.T:
            self.held[np.arange(n), r >> 6] |= np.uint64(1) << (r & 63).astype(np.uint64)
        self.others, self.root = np.zeros(n, np.int64), np.arange(n)
        self.unsure: list[np.ndarray] = []

    def compare(self) -> None:
        pivot = self.cell // len(self.cells.pivots)
        all_, at = np.arange(len(self.cids)), np.argmax(self.ranks == pivot, axis=1)
        if self.cells.shared == 1 or (self.cells.parts[pivot] == 1 and len(all_) <= LIST):
            self._list(all_, [pivot])
        else:
            self._lists(all_, at, [pivot])

    def _lists(self, rows: np.ndarray, at: np.ndarray, pivots: list[int]) -> None:
        """Lists of the vectors `rows`, which have `pivots`, the last one at place `at`."""
        found = []
        for place in range(len(pivots), self.cells.nearest - self.cells.shared + len(pivots) + 1):
            behind = rows[at < place]
            pivot = self.ranks[behind, place]
            if len(pivots) == 1:
                here = self.cells.of(pivots[0], pivot) == self.cell
                behind, pivot = behind[here], pivot[here]
            found.append((pivot, behind, np.full(len(behind), place)))
        pivot, behind, place = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort([behind, pivot])
        pivot, behind, place = pivot[order], behind[order], place[order]
        cuts = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1], [True]])) if len(pivot) else []
        for i, j in zip(cuts, cuts[1:]):
            if j - i <= LIST or len(pivots) + 1 == self.cells.shared:
                self._list(behind[i:j], [*pivots, int(pivot[i])])
            else:
                self._lists(behind[i:j], place[i:j], [*pivots, int(pivot[i])])

    def _list(self, rows: np.ndarray, pivots: list[int]) -> None:
        """Pairs of the vectors `rows` whose first shared pivots are `pivots`: these are compared in no other list."""
        if len(rows) < 2:
            return
        before = np.zeros(self.held.shape[1], np.uint64)
        for r in set(range(pivots[-1])) - set(pivots):
            before[r >> 6] |= np.uint64(1) << np.uint64(r & 63)
        held = self.held[rows]
        early = held & before
        parts = self.parts[rows].astype(np.float32)
        may, sure = (np.float32((self.least + d) * STEPS**2) for d in (-self.cells.off, self.cells.off))
        tiles = range(0, len(rows), TILE)
        common = [np.bitwise_and.reduce(early[i : i + TILE], axis=0) for i in tiles]
        for x, i in enumerate(tiles):
            for y, j in list(enumerate(tiles))[x:]:
                if (common[x] & common[y]).any():  # every pair belongs to an earlier list
                    continue
                product = parts[i : i + TILE] @ parts[j : j + TILE].T
                a, b = np.nonzero(product >= may)
                if i == j:
                    a, b = a[a < b], b[a < b]
                if not len(a):
                    continue
                cosine = product[a, b]
                a, b = a + i, b + j
                mine = ~(early[a] & early[b]).any(axis=1)
                a, b, cosine = a[mine], b[mine], cosine[mine]
                enough = np.bitwise_count(held[a] & held[b]).sum(axis=1) >= self.cells.shared
                a, b, told = rows[a[enough]], rows[b[enough]], cosine[enough] >= sure
                if not told.all():
                    self.unsure.append(np.stack([self.cids[a[~told]], self.cids[b[~told]]]))
                self._linked(a[told], b[told])

    def _linked(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.others, a, self.rows[b])
        np.add.at(self.others, b, self.rows[a])
        while len(a):
            one, two = self._root(a), self._root(b)
            apart = one != two
            a, b, one, two = a[apart], b[apart], one[apart], two[apart]
            np.minimum.at(self.root, np.maximum(one, two), np.minimum(one, two))

    def _root(self, nodes: np.ndarray) -> np.ndarray:
        root = self.root[nodes]
        while ((above := self.root[root]) != root).any():
            root = above
        self.root[nodes] = root
        return root

    def found(self) -> pa.RecordBatch:
        """Linked classes with another they are linked to, through others, and the rows they link with; and pairs not told."""
        linked = np.flatnonzero(self.others)
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *self.unsure], axis=1)
        columns = [
            np.concatenate([self.cids[linked], a]),
            np.concatenate([self.cids[self._root(linked)], b]),
            np.concatenate([self.others[linked], np.zeros(len(a), np.int64)]),
            np.arange(len(linked) + len(a)) < len(linked),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _LINKED)


def _met(cells: Cells, least: float):
    """What is found in each cell; the pieces of one follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []

        def done() -> pa.RecordBatch:
            cell = Cell(cells, now, pieces, least)
            cell.compare()
            return cell.found()

        for batch in batches:
            for at, *piece in zip(*(batch.column(c).to_pylist() for c in _PIECE)):
                if at != now and pieces:
                    yield done()
                    pieces = []
                now = at
                pieces.append(tuple(piece))
        if pieces:
            yield done()

    return run


def _products(a: pa.Array, b: pa.Array) -> pa.Array:
    """Scalar products of unit vectors: their cosines."""
    x = np.frombuffer(b"".join(a.to_pylist())).reshape(len(a), -1) if len(a) else np.zeros((0, 1))
    y = np.frombuffer(b"".join(b.to_pylist())).reshape(len(b), -1) if len(b) else np.zeros((0, 1))
    return pa.array((x * y).sum(axis=1), pa.float64())


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """One row for each row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Linked are vectors whose cosine, in double precision, is at least `least`.
    n_links counts the other vectors linked directly, equal ones included;
    component_id is the smallest vec_id reachable, itself included.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing. Shorter vectors count as padded with zeros. Equal vectors are one
    class and cost one entry. A row with a null vec_id is linked and counted, but
    names no component; alone in one, its component_id is null and it is kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    width = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 1)
    real = rows.where(
        F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    # distinct vectors make better reference points than copies; only those drawn are sent
    hashed = real.select(F.xxhash64("embedding").alias("h"), "embedding")
    names = hashed.select("h").distinct().orderBy(F.hash("h"), "h").limit(SAMPLE)
    drawn = hashed.join(F.broadcast(names), "h").groupBy("h").agg(F.first("embedding").alias("embedding"))
    sample = drawn.orderBy(F.hash("h"), "h").limit(SAMPLE).toArrow().column("embedding").combine_chunks()

    indexed = freeze(rows.mapInArrow(_indexed(width), "vec_id long, cid long"))
    sized = freeze(indexed.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("rows"), F.min("vec_id").alias("rep")))
    asked = _matrix(sample, width) if len(sample) else np.ones((1, width))
    cells = Cells(spread(asked), _unit(asked)[1], sized.count())
    folder = new_folder(spark, "vectors")
    dealt = rows.select("embedding").mapInArrow(_dealt(cells), "cell long, cids binary, counts binary, ranks binary, components binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = written(
        dealt.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_met(cells, least), "a long, b long, others long, sure boolean"),
        f"{folder}/met",
    )
    # Spark deletes the shuffle's files once the driver's collector has found them without use
    spark._jvm.java.lang.System.gc()

    # what 16 bits don't tell
    unsure = met.where("NOT sure").select("a", "b")
    names = unsure.select(F.col("a").alias("cid")).union(unsure.select("b")).distinct()
    exact = narrowed(rows.select("embedding").mapInArrow(_exact(width), "cid long, vector binary"), "cid", names, "cid")
    exact = exact.join(names, "cid").dropDuplicates(["cid"])
    by_a = exact.select(F.col("cid").alias("a"), F.col("vector").alias("x"))
    by_b = exact.select(F.col("cid").alias("b"), F.col("vector").alias("y"))
    cosine = F.arrow_udf(_products, "double")
    told = freeze(unsure.join(by_a, "a").join(by_b, "b").where(cosine("x", "y") >= least).select("a", "b"))
    both = told.union(told.select("b", "a"))
    others = both.join(sized.select(F.col("cid").alias("b"), "rows"), "b").select("a", F.col("rows").alias("others"))
    count = met.where("sure").select("a", "others").union(others).groupBy(F.col("a").alias("cid")).agg(F.sum("others").alias("others"))
    rooted = components(met.where("sure").select("a", "b").union(told)).withColumnRenamed("node", "cid")
    classes = freeze(
        sized.join(rooted, "cid", "left")
        .join(count, "cid", "left")
        .select("cid", "rep", F.coalesce("root", "cid").alias("root"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    remove(spark, folder)
    named = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    return (
        indexed.select("vec_id", "cid")
        .join(classes.join(named, "root").select("cid", "n_links", "component_id"), "cid", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
