"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis).

Every document draws an exponential variable whose rate is its quality weight;
within a source the smallest keys come first. A source whose target exceeds its
size gives whole epochs first; what remains is filled in key order from the
prefix sums, and the document at the end of it is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialweave.llm.prefix import sums_before
from dialweave.session import freeze

WORD = r"[^\x20\x09-\x0D]+"
#: Runs of characters that are neither letters nor white space.
MARKS = r"[^\p{L}\s]+"
SEED = 1_107


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def prose_weight(text: str = "text") -> Column:
    """Quality weight in (0, 1]: words against words and marks; 1 without marks."""
    marks = F.coalesce(F.regexp_count(F.col(text), F.lit(MARKS)), F.lit(0))
    return (n_words(text) + 1) / (n_words(text) + marks + 1)


def exponential_key(weight: Column) -> Column:
    """Exponential variable with rate `weight`, fixed by doc_id (by the text where it is null)."""
    drawn = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit(SEED))
    uniform = (F.shiftrightunsigned(drawn, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / weight


def source_targets(sources: DataFrame, cycle: tuple[int, ...], epochs: int) -> DataFrame:
    """(source_key, source_size) with `target` and `share`: the total shared by weight, none above epochs * size.

    Weights repeat along the sources by code point, null last. Sources whose cap
    lies under the common level get their cap; the others share the rest by weight.
    One row a source: the windows run over the list of sources, not over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source_key")))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy("level", "source_key")
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    above = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = (
        sources.withColumn("weight", F.element_at(weights, (place - 1) % len(cycle) + 1))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(total))
        .withColumn("spent", F.coalesce(F.sum("cap").over(below), F.lit(0)))
        .withColumn("open", F.sum("weight").over(above))
        # at the level of this source, would more be left to share?
        .withColumn("full", F.col("spent") + F.col("level") * F.col("open") <= F.col("all"))
    )
    rest = F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(total)
    sharing = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(total)
    return leveled.select(
        "source_key",
        "source_size",
        F.when(F.col("full"), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), rest * F.col("weight") / sharing))
        .alias("target"),
    )


def mixture(
    docs: DataFrame,
    cycle: tuple[int, ...] = (1, 2, 3),
    epochs: int = 3,
    weight: Column | None = None,
) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, source): doc_id, source, size, order_key, source_size, target, taken.

    size counts words of the whole text (null: 0). taken is what the mix takes, in
    words: whole epochs of the document and its share of the last, partial one. The
    taken words of a source equal its target, rounded. Rows that repeat a document
    stand one after the other, so one of them may close the target and the next take
    less. Null sources are one source, the last; a null doc_id is keyed by its text.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    weight = prose_weight() if weight is None else weight
    rows = freeze(docs.select(*_ordered(weight)).withColumn("row", F.monotonically_increasing_id()))
    placed = _placed(rows, "size", ["order_key", "doc_id", "row"], cycle, epochs)
    return placed.withColumn("taken", F.col("whole") * F.col("size") + F.col("last")).select(
        "doc_id", "source", "size", "order_key", "source_size", "target", F.col("taken").cast("long").alias("taken")
    )


def mixed_documents(
    docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), epochs: int = 3, weight: Column | None = None
) -> DataFrame:
    """`docs`, each row as often as the mixture takes it, and as it is.

    Documents stay whole: the part of a document that closes a source's target
    counts as one copy from one half on. A document without words is not taken.
    Columns are those of `docs`.
    """
    weight = prose_weight() if weight is None else weight
    whole = docs.select(F.struct("*").alias("row"), *_ordered(weight))
    # the sums need no texts: they run over a narrow frame of their own
    taken = _taken(docs.select(*_ordered(weight)), cycle, epochs)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    repeated = whole.join(taken, _alike()).withColumn("copies", copies).where("copies > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def _ordered(weight: Column) -> list[Column]:
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        # sorts by code point, null last
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("source_key"),
        n_words().alias("size"),
        exponential_key(weight).alias("order_key"),
    ]


def _alike() -> Column:
    return (
        (F.col("source_key") == F.col("k_source"))
        & (F.col("order_key") == F.col("k_order"))
        & F.col("doc_id").eqNullSafe(F.col("k_doc"))
        & (F.col("size") == F.col("k_size"))
    )


def _placed(rows: DataFrame, amount: str, order: list[str], cycle: tuple[int, ...], epochs: int) -> DataFrame:
    """`rows` with their source's size and target, its whole epochs, and their share (last) of the partial one."""
    sources = rows.groupBy("source_key").agg(F.sum(amount).alias("source_size"))
    targets = source_targets(sources, cycle, epochs)
    placed = sums_before(rows, amount, order, "source_key").join(targets, "source_key")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col(amount), part - F.col("before")))
    return placed.withColumn("whole", whole).withColumn("last", last)


def _taken(rows: DataFrame, cycle: tuple[int, ...], epochs: int) -> DataFrame:
    """Words taken of each row with these keys; rows with the same keys are treated alike."""
    alike = rows.groupBy("source_key", "order_key", "doc_id", "size").agg(F.count("*").alias("rows"))
    alike = alike.withColumn("words", F.col("rows") * F.col("size"))
    return _placed(alike, "words", ["order_key", "doc_id", "size"], cycle, epochs).select(
        F.col("source_key").alias("k_source"),
        F.col("order_key").alias("k_order"),
        F.col("doc_id").alias("k_doc"),
        F.col("size").alias("k_size"),
        (F.col("whole") * F.col("size") + F.floor(F.col("last") / F.col("rows"))).cast("long").alias("taken"),
    )
