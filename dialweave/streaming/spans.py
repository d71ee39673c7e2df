"""What micro-batches write: parts in spans of batches, visible once they are announced.

A batch writes its parts (history, changes, ...) into folders named after it and then a
line in the manifest. Readers take the announced spans and nothing else, so they see a
batch whole or not at all. A fold rewrites neighbouring spans as one and announces it;
the wider span stands for those inside it from then on, in one step for all parts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "first long, last long, parts array<string>"


class Span(NamedTuple):
    first: int
    last: int
    parts: tuple[str, ...] = ()

    @property
    def folder(self) -> str:
        return f"{self.first}-{self.last}"


class Spans:
    """The spans under one folder. ``schemas`` has the columns of each part."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root, schemas

    def announced(self) -> list[Span]:
        """All spans ever announced: one line for each batch and fold."""
        if not self._exists("manifest"):
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/*").collect()
        return sorted(Span(r["first"], r["last"], tuple(r["parts"])) for r in rows)

    def live(self) -> list[Span]:
        """The widest spans, in order; what lies within one of them is folded into it."""
        spans: list[Span] = []
        for span in sorted(self.announced(), key=lambda s: (s.first, -s.last)):
            if not spans or span.last > spans[-1].last:
                spans.append(span)
        return spans

    def holds(self, batch: int) -> bool:
        return any(s.first <= batch <= s.last for s in self.live())

    def write(self, part: str, rows: DataFrame, span: Span) -> None:
        """A repeated batch overwrites what it had written; nobody has read that."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{part}/{span.folder}")

    def announce(self, span: Span) -> None:
        line = self.spark.createDataFrame([(span.first, span.last, list(span.parts))], _MANIFEST)
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{span.folder}")

    def read(self, part: str, spans: list[Span] | None = None) -> DataFrame:
        """The part as the announced spans have it, or the given ones."""
        spans = self.live() if spans is None else spans
        paths = [f"{self.root}/{part}/{s.folder}" for s in spans if part in s.parts]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[part])
        return self.spark.read.schema(self.schemas[part]).parquet(*paths)

    def fold(self, how: dict[str, Callable[[DataFrame], DataFrame]], keep: int = 0) -> Span | None:
        """Rewrite all live spans but the ``keep`` newest as one; ``how`` says how a part's rows are put together.

        A fold that dies is not announced, and can be run again. Batches that arrive
        meanwhile are announced beside it.
        """
        spans = self.live()
        spans = spans[: len(spans) - keep]
        if len(spans) < 2:
            return None
        parts = tuple(sorted({p for s in spans for p in s.parts}))
        whole = Span(spans[0].first, spans[-1].last, parts)
        for part in parts:
            self.write(part, how[part](self.read(part, spans)), whole)
        self.announce(whole)
        return whole

    def prune(self) -> list[str]:
        """Delete folders whose rows a wider span has; call it when no reader is at them any more."""
        live = set(self.live())
        gone = []
        for span in self.announced():
            if span not in live:
                for part in (*span.parts, "manifest"):
                    self._delete(f"{part}/{span.folder}")
                gone.append(span.folder)
        return gone

    def _path(self, part: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, part: str) -> bool:
        files, path = self._path(part)
        return files.exists(path)

    def _delete(self, part: str) -> None:
        files, path = self._path(part)
        files.delete(path, True)


def numbered(rows: DataFrame, batch: int) -> DataFrame:
    return rows.withColumn("batch", F.lit(batch).cast("long"))
