"""Exact search for the highest inner products, a block of vectors at a time.

Vectors are ordered so that like ones follow one another and cut into shards, a
shard into blocks of neighbours. A block keeps the largest and smallest value of
each component. From these a query has an upper bound for every block: the sum over
its components of the largest product. It scores blocks through their vectors in
descending order of the bound and stops where the bound falls below the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialweave.llm.tables import new_folder, remove, renewed, written
from dialweave.llm.vectors import SAMPLE, _matrix, spread
from dialweave.session import freeze

#: Vectors of a block; of a shard, at most, and the bytes of its values.
BLOCK, SHARD, SHARD_BYTES = 64, 4096, 1 << 23
#: Shards that a task bounds or scores queries against, or takes queries from.
TOGETHER = 64
#: Components that decide where a vector stands in the order, at most.
GUIDES = 256
#: A component of at most so much in size is stored in two bytes.
SMALL = 32_767
#: The score of no vector, and the largest one, both of which can be negated.
_NONE, _MOST = -np.iinfo(np.int64).max, np.iinfo(np.int64).max - 1


def quantised(rows: np.ndarray) -> np.ndarray:
    """floor(256 * x), still as doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows * 256.0), -np.finfo(float).max, np.finfo(float).max)


def _placed(pivots: np.ndarray):
    """Each vector with its nearest reference point and its closeness to that."""
    guides = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "width", "wide", "pivot", "near", "value"]
        for batch in batches:
            out: list[tuple] = []
            for vec_id, value in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                row = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64)
                whole = quantised(row)
                wide = int(len(whole) > 0 and np.abs(whole).max() > SMALL)
                head = np.zeros(guides)
                head[: min(guides, len(row))] = row[:guides]
                largest = np.abs(head).max() if guides else 0
                head = head / largest if largest else head
                near = pivots @ (head / (np.sqrt((head**2).sum()) or 1.0))
                pivot = int(near.argmax())
                out.append((vec_id, len(row), wide, pivot, -float(near[pivot]), whole.astype("<f8" if wide else "<i2").tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    return run


class Shard:
    """Neighbouring vectors of one width, in blocks."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, wide: bool):
        self.ids, self.values, self.wide = ids, values, wide
        cuts = np.arange(0, len(ids), BLOCK)
        self.least = np.minimum.reduceat(ids, cuts)
        self.high = np.maximum.reduceat(values, cuts, axis=0).astype(np.float64)
        self.low = np.minimum.reduceat(values, cuts, axis=0).astype(np.float64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products, a row a query and a column a block (or shard)."""
    w = min(queries.shape[1], low.shape[1])
    q = queries[:, :w].astype(np.float64)
    return np.maximum(q, 0) @ high[:, :w].T + np.minimum(q, 0) @ low[:, :w].T


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products by whole numbers, held to the range of a long."""
    w = min(queries.shape[1], rows.shape[1])
    whole = lambda x: np.array([[int(v) for v in r[:w]] for r in x], object).reshape(len(x), w)
    a, b = whole(queries), whole(rows)
    return np.array([[max(-_MOST, min(_MOST, sum(int(s) * int(t) for s, t in zip(p, q)))) for q in b] for p in a], np.int64).reshape(len(a), len(b))


def search(shard: Shard, ids: np.ndarray, queries: np.ndarray, wide: bool, k: int, score: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, vec_id) of each query after `shard`; `score` and `other` hold those so far."""
    score, other = score.copy(), other.copy()
    if wide or shard.wide:
        # sums may leave the whole numbers that doubles hold, so nothing is bounded
        found = exact_scores(queries, shard.values)
        return _merged(score, other, np.where(shard.ids == ids[:, None], _NONE, found), np.broadcast_to(shard.ids, found.shape), k)
    w = min(queries.shape[1], shard.values.shape[1])
    most = bounds(queries, shard.low, shard.high)
    order = np.argsort(-most, axis=1, kind="stable")
    active = np.arange(len(queries))
    for turn in range(order.shape[1]):
        block = order[active, turn]
        bound = most[active, block]
        # later blocks are bounded no higher; one that just reaches the k-th score may hold a smaller vec_id
        open_ = (score[active, -1] == _NONE) | (bound >= score[active, -1])
        active, block, bound = active[open_], block[open_], bound[open_]
        if not len(active):
            break
        worth = (score[active, -1] == _NONE) | (bound > score[active, -1]) | (shard.least[block] < other[active, -1])
        asked, block = active[worth], block[worth]
        # queries that are at one block meet it together
        for b in np.unique(block):
            who = asked[block == b]
            here = slice(b * BLOCK, (b + 1) * BLOCK)
            found = (queries[who, :w].astype(np.float64) @ shard.values[here, :w].astype(np.float64).T).astype(np.int64)
            found[shard.ids[here] == ids[who][:, None]] = _NONE
            score[who], other[who] = _merged(score[who], other[who], found, np.broadcast_to(shard.ids[here], found.shape), k)
    return score, other


def _merged(score: np.ndarray, other: np.ndarray, found: np.ndarray, found_ids: np.ndarray, k: int):
    score = np.concatenate([score, found], axis=1)
    other = np.concatenate([other, found_ids], axis=1)
    order = np.lexsort((other, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(other, order, 1)


def _none(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)


_SHARDS = pa.schema(
    [(n, pa.int64()) for n in ("shard", "width", "wide", "n", "asked", "least")]
    + [(n, pa.binary()) for n in ("ids", "vectors", "low", "high", "query_ids", "queries", "scores", "others")]
)
_SHARD_TYPES = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in _SHARDS)


def _kind(wide: int) -> str:
    return "<f8" if wide else "<i2"


def _sharded(divisor: int, k: int):
    """A row a shard, with its queries and their best within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        raw: list[bytes] = []
        kind: tuple[int, int] = (0, 0)

        def done() -> pa.RecordBatch:
            nonlocal name
            width, wide = kind
            shard = Shard(np.array(ids, np.int64), np.frombuffer(b"".join(raw), _kind(wide)).reshape(len(ids), width), bool(wide))
            at = np.flatnonzero(shard.ids % divisor == 0)
            score, other = search(shard, shard.ids[at], shard.values[at], bool(wide), k, *_none(len(at), k))
            values = dict(
                shard=name, width=width, wide=wide, n=len(ids), asked=len(at), least=int(shard.ids.min()), ids=shard.ids.tobytes(),
                vectors=b"".join(raw), low=shard.low.min(axis=0).tobytes(), high=shard.high.max(axis=0).tobytes(),
                query_ids=shard.ids[at].tobytes(), queries=shard.values[at].tobytes(), scores=score.tobytes(), others=other.tobytes(),
            )
            name += 1
            ids.clear()
            raw.clear()
            return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in _SHARDS], schema=_SHARDS)

        for batch in batches:
            for vec_id, width, wide, value in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "width", "wide", "value"))):
                if ids and (kind != (width, wide) or len(ids) >= SHARD or (len(ids) + 1) * len(value) > SHARD_BYTES):
                    yield done()
                kind = (width, wide)
                ids.append(vec_id)
                raw.append(value)
        if ids:
            yield done()

    return run


def _queries(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """query ids, vectors, and the best scores and vec_ids within the query's own shard."""
    ids = np.frombuffer(row["query_ids"], np.int64)
    vectors = np.frombuffer(row["queries"], _kind(row["wide"])).reshape(len(ids), row["width"])
    return ids, vectors, np.frombuffer(row["scores"], np.int64).reshape(-1, k), np.frombuffer(row["others"], np.int64).reshape(-1, k)


def _worthwhile(k: int):
    """Pairs (queries of a shard, other shard) where a bound reaches a k-th score."""

    def run(asking: pa.Table, asked: pa.Table) -> pa.Table:
        one, two = [], []
        shards = asked.to_pylist()
        edges = [(np.frombuffer(s["low"]), np.frombuffer(s["high"])) for s in shards]
        for row in asking.to_pylist():
            _, vectors, scores, others = _queries(row, k)
            least, least_id = scores[:, -1], others[:, -1]
            for shard, (low, high) in zip(shards, edges):
                if shard["shard"] == row["shard"]:
                    continue
                if row["wide"] or shard["wide"]:
                    reach = True
                else:
                    most = bounds(vectors, low[None], high[None])[:, 0]
                    reach = ((least == _NONE) | (most > least) | ((most == least) & (shard["least"] < least_id))).any()
                if reach:
                    one.append(row["shard"])
                    two.append(shard["shard"])
        return pa.table({"asking": pa.array(one, pa.int64()), "shard": pa.array(two, pa.int64())})

    return run


_FOUND = "asking long, place int, query_id long, vec_id long, score long"


def _found(asking: int, ids: np.ndarray, score: np.ndarray, other: np.ndarray, new: np.ndarray) -> pa.Table:
    place, rank = np.nonzero(new)
    return pa.table(
        {
            "asking": np.full(len(place), asking, np.int64),
            "place": place.astype(np.int32),
            "query_id": ids[place],
            "vec_id": other[place, rank],
            "score": score[place, rank],
        }
    )


def _scored(k: int):
    """What the queries of some shards find in one other shard."""

    def run(asking: pa.Table, shards: pa.Table) -> pa.Table:
        empty = np.zeros((0, 1), np.int64)
        out = [_found(0, np.zeros(0, np.int64), empty, empty, empty != 0)]
        if shards.num_rows:
            row = shards.slice(0, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], np.int64)
            shard = Shard(ids, np.frombuffer(row["vectors"], _kind(row["wide"])).reshape(len(ids), row["width"]), bool(row["wide"]))
            for i in range(asking.num_rows):
                query = asking.slice(i, 1).to_pylist()[0]
                query_ids, vectors, scores, others = _queries(query, k)
                # the k-th so far stands in all places: what is better comes before it
                score, other = np.repeat(scores[:, -1:], k, axis=1), np.repeat(others[:, -1:], k, axis=1)
                score, other = search(shard, query_ids, vectors, bool(query["wide"]), k, score, other)
                new = (score != _NONE) & ((score != scores[:, -1:]) | (other != others[:, -1:]))
                out.append(_found(query["asking"], query_ids, score, other, new))
        return pa.concat_tables(out)

    return run


def _own(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, score, other = _queries(row, k)
                yield from _found(row["shard"], ids, score, other, score != _NONE).to_batches()

    return run


def top_k(vectors: DataFrame, divisor: int = 50, k: int = 5) -> DataFrame:
    """The `k` highest inner products of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows of `vectors` (vec_id, embedding) whose vec_id `divisor` divides;
    candidates are all rows but those with the query's vec_id. Each component x counts as
    floor(256 * x). Ties go to the smaller vec_id; a query has fewer rows where there are
    fewer candidates. The result is exact: only blocks whose bound lies below the k-th
    score, or at it with larger vec_ids only, are left out.

    Vectors that are null or hold null or non-finite components, and rows without a
    vec_id, take no part. Vectors of other lengths count as filled up with zeros; an empty
    one scores 0. Rows that repeat a vec_id are queries, and candidates, of their own. Scores
    are held to the range of a long. Other columns are ignored; an empty table gives none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    spark = vectors.sparkSession
    folder = new_folder(spark, "topk")
    # the order decides what is left out, not what is found
    head = F.slice("embedding", 1, GUIDES).alias("embedding")
    drawn = rows.where(F.exists(F.slice("embedding", 1, GUIDES), lambda x: x != 0)).select(F.xxhash64("embedding").alias("h"), head)
    sample = drawn.groupBy("h").agg(F.min("embedding").alias("embedding")).orderBy(F.hash("h"), "h").limit(SAMPLE)
    sample = sample.toArrow().column("embedding").combine_chunks()
    width = max(map(len, sample), default=1) if len(sample) else 1
    pivots = spread(_matrix(sample, width)) if len(sample) else np.zeros((1, 1))
    order = ["width", "wide", "pivot", "near", "vec_id"]
    placed = rows.mapInArrow(_placed(pivots), "vec_id long, width long, wide int, pivot int, near double, value binary")
    shards = written(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sharded(divisor, k), _SHARD_TYPES), f"{folder}/shards"
    )
    own_rows = shards.where("asked > 0").select("shard", "width", "wide", "query_ids", "queries", "scores", "others")
    parts = max(1, -(-shards.count() // TOGETHER))
    some = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    # a grid of tasks: some shards' queries against some shards' edges
    asking = own_rows.withColumn("part", some("shard")).withColumn("page", every)
    edges = shards.select("shard", "wide", "least", "low", "high").withColumn("page", some("shard")).withColumn("part", every)
    cells = written(
        asking.groupBy("part", "page").cogroup(renewed(edges).groupBy("part", "page")).applyInArrow(_worthwhile(k), "asking long, shard long"),
        f"{folder}/cells",
    ).withColumn("part", some("asking"))
    queries = own_rows.withColumnRenamed("shard", "asking")
    left = cells.join(queries, "asking")
    right = cells.select("shard", "part").distinct().join(shards.select("shard", "width", "wide", "ids", "vectors"), "shard")
    across = left.groupBy("shard", "part").cogroup(renewed(right).groupBy("shard", "part")).applyInArrow(_scored(k), _FOUND)
    best = _best(own_rows.mapInArrow(_own(k), _FOUND).union(across), k)
    result = freeze(best)
    remove(spark, folder)
    return result


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("asking", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
