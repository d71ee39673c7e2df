"""Spelling variants: words one edit apart, by dynamic programming over a sorted list.

Two words that are one edit apart agree up to the edit and after it, so they share
the first half of the shorter word, or else the second. Words are listed twice, as
they are and reversed, sorted by length class and that half. Over such a list the
edit matrix has one row for each distinct prefix: words that follow one another
share the rows of their common prefix (LCP), three cells wide each, and a range of
words whose common prefix is more than one edit away is not looked into.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.llm.tables import new_folder, remove, renewed, written
from dialweave.session import freeze

#: Words of at least LEAST code points that occur TWICE or more are grouped; a form is TIMES as frequent.
LEAST, TWICE, TIMES = 7, 2, 10
#: One in NOISE runs loses a code point.
NOISE = 31
#: [A-Za-zÀ-ÿ]+ of a text in UTF-8 whose A-Z are lower-case.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 200_000
#: Words, and cells of a word matrix, of one stretch of the list; rows of the edit matrix extended at a time.
STRETCH, CELLS, ROWS = 16_384, 1 << 20, 1 << 19


def _counted(least: int, noise: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            words = pa.array(list(total), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_py()
                if not raw:
                    continue
                start = b"null:" if doc_id is None else b"%d:" % doc_id
                for word, n in Counter(RUN.findall(raw.lower())).items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(start + word)
                    if h % noise == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    if len(word) - word.count(b"\xc3") >= least:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield passed()
                    total.clear()
        if total:
            yield passed()

    return run


def vocabulary(docs: DataFrame, least: int = LEAST, noise: int = NOISE) -> DataFrame:
    """(word, n) of `docs` (doc_id, text): the words of `least` code points or more, and how often they occur."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_counted(least, noise), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, a row a word, filled up with 0."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def one_edit_apart(listed: list[str], groups: np.ndarray, asked: list[str], asked_groups: np.ndarray, half: int, size: int):
    """Places (in `listed`, in `asked`) of words of one group that are one edit apart.

    `listed` is sorted within groups (numbers that ascend) and holds words of `size` code points,
    `asked` words of as many or one more; the first `half` code points of a group are the same.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if not listed or not asked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = _codes(listed, size), _codes(asked, size + 2)
    longer = np.array([len(w) > size for w in asked])
    # code points that a word shares with the one before it
    differs = x[1:] != x[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), size)
    lcp = np.concatenate([[-1], np.where(groups[1:] == groups[:-1], lcp, -1)])
    # at each depth the ranges of words with one prefix: where they start, and their children
    starts = [np.flatnonzero(lcp < d) for d in range(half, size + 1)]
    first = [np.searchsorted(below, here) for here, below in zip(starts, starts[1:])]
    count = [np.diff(np.append(f, len(below))) for f, below in zip(first, starts[1:])]
    # every asked word begins at its group's range, with the halves equal: cells left of, on and right of the diagonal
    roots = np.searchsorted(groups[starts[0]], asked_groups)
    inside = roots < len(starts[0])
    inside[inside] = groups[starts[0]][roots[inside]] == asked_groups[inside]
    who = np.flatnonzero(inside)
    cells = np.tile(np.array([1, 0, 1], np.int8), (len(who), 1))
    waiting = [(half, roots[who], who, cells)]
    while waiting:
        depth, node, who, cells = waiting.pop()
        if depth == size:
            far = np.where(longer[who], cells[:, 2], cells[:, 1])
            near = far == 1
            found.append((starts[-1][node[near]], who[near]))
            continue
        level = depth - half
        children = count[level][node]
        total = np.cumsum(children)
        if len(node) > 1 and total[-1] > ROWS:
            cut = int(np.clip(np.searchsorted(total, total[-1] // 2), 1, len(node) - 1))
            waiting += [(depth, node[cut:], who[cut:], cells[cut:]), (depth, node[:cut], who[:cut], cells[:cut])]
            continue
        back = np.repeat(np.arange(len(node)), children)
        child = np.arange(len(back)) - np.repeat(total - children, children) + first[level][node][back]
        letter = x[starts[level + 1][child], depth]
        who, old = who[back], cells[back]
        left = np.minimum(old[:, 0] + (y[who, depth - 1] != letter), old[:, 1] + 1)
        on = np.minimum(np.minimum(old[:, 1] + (y[who, depth] != letter), old[:, 2] + 1), left + 1)
        right = np.minimum(old[:, 2] + (y[who, depth + 1] != letter), on + 1)
        new = np.stack([left, on, right], axis=1).astype(np.int8)
        alive = new.min(axis=1) <= 1
        if alive.any():
            waiting.append((depth + 1, child[alive], who[alive], np.minimum(new[alive], 2)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _near(side: int, size: int, listed: list[str], groups: np.ndarray, asked: list[str], asked_groups: np.ndarray):
    """Places of near words, each pair of words in one of its two lists only."""
    front = size // 2
    half = size - front if side else front
    i, j = one_edit_apart(listed, groups, asked, asked_groups, half, size)
    if side and len(i):
        # reversed words: their first half agrees already, so this pair stands in the other list
        tail = np.arange(front)
        x, y = _codes(listed, size), _codes(asked, size + 1)
        ends = np.array([len(w) for w in asked])[j]
        apart = (x[i][:, size - front + tail] != y[j[:, None], ends[:, None] - front + tail]).any(axis=1)
        i, j = i[apart], j[apart]
    return i, j


class _Stretch:
    """Rows of the sorted list: words, their counts, length class and group."""

    names = ("side", "size", "half", "s", "n")

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def pairs(self) -> tuple[list[str], list[str], list[int]]:
        out: tuple[list[str], list[str], list[int]] = ([], [], [])
        start = 0
        while start < len(self.rows):
            kind = self.rows[start][:2]
            end = start + 1
            while end < len(self.rows) and self.rows[end][:2] == kind:
                end += 1
            part = self.rows[start:end]
            group = np.cumsum([0, *(a[2] != b[2] for a, b in zip(part, part[1:]))])
            short = np.array([len(r[3]) == kind[1] for r in part])
            listed = [r for r, s in zip(part, short) if s]
            add_pairs(out, kind[0], kind[1], [r[3:] for r in listed], group[short], [r[3:] for r in part], group)
            start = end
        return out


def add_pairs(out, side: int, size: int, listed: list[tuple], groups: np.ndarray, asked: list[tuple], asked_groups: np.ndarray) -> None:
    """Append (word, near word, its count): both ways where the lengths differ, else from the asked word."""
    i, j = _near(side, size, [w for w, _ in listed], groups, [w for w, _ in asked], asked_groups)
    for a, b in zip(i.tolist(), j.tolist()):
        (short, n), (word, m) = listed[a], asked[b]
        out[0].append(word)
        out[1].append(short)
        out[2].append(n)
        if len(word) > size:
            out[0].append(short)
            out[1].append(word)
            out[2].append(m)


_FOUND = pa.schema(
    [
        ("word", pa.string()),
        ("near", pa.string()),
        ("near_n", pa.int64()),
        ("stretch", pa.int64()),
        ("side", pa.int64()),
        ("size", pa.int64()),
        ("half", pa.string()),
        ("s", pa.string()),
        ("n", pa.int64()),
    ]
)
_TYPES = "word string, near string, near_n long, stretch long, side long, size long, half string, s string, n long"


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND
    )


def _turned(side: int, words: list[str]) -> list[str]:
    return [w[::-1] for w in words] if side else words


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within stretches of the sorted list, and the words of groups that a stretch may hold in part."""
    name = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []

    def done(part: list[tuple], groups: tuple) -> Iterator[pa.RecordBatch]:
        stretch = _Stretch()
        # pairs are found in the list's spelling and written in the words' own
        for side in (0, 1):
            stretch.rows = [r for r in part if r[0] == side]
            word, near, near_n = stretch.pairs()
            yield _batch(word=_turned(side, word), near=_turned(side, near), near_n=near_n)
        cut = [r for r in part if r[:3] in groups]
        if cut:
            yield _batch(stretch=[name] * len(cut), **{c: [r[i] for r in cut] for i, c in enumerate(_Stretch.names)})

    def close(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rows, name, opened
        end, last = len(rows), rows[-1][:3]
        if not whole:
            # rather between two groups, unless the last one is large
            at = end
            while at and rows[at - 1][:3] == last:
                at -= 1
            if at > STRETCH // 4:
                end = at
        part, rows = rows[:end], rows[end:]
        split = {opened, part[-1][:3]} if whole or not rows else {opened}
        yield from done(part, tuple(g for g in split if g))
        opened = part[-1][:3] if not rows else None
        name += 1

    #: the group that may have begun in an earlier stretch or task
    opened: tuple | None = None
    begun, held = False, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _Stretch.names)):
            if not begun:
                begun, opened = True, row[:3]
            rows.append(row)
            held += row[1] + 3
            if len(rows) >= STRETCH or held >= CELLS:
                yield from close(False)
                held = sum(r[1] + 3 for r in rows)
    if rows:
        yield from close(True)


def _across(first: pa.Table, second: pa.Table) -> pa.Table:
    """Pairs of a word listed in one stretch and a word asked from another."""
    out: tuple[list[str], list[str], list[int]] = ([], [], [])
    side = 0
    if first.num_rows and second.num_rows:
        side, size = first.column("side")[0].as_py(), first.column("size")[0].as_py()
        listed = sorted((s, n) for s, n in zip(first.column("s").to_pylist(), first.column("n").to_pylist()) if len(s) == size)
        asked = list(zip(second.column("s").to_pylist(), second.column("n").to_pylist()))
        add_pairs(out, side, size, listed, np.zeros(len(listed), np.int64), asked, np.zeros(len(asked), np.int64))
    return pa.table({"word": pa.array(_turned(side, out[0]), pa.string()), "near": pa.array(_turned(side, out[1]), pa.string()), "near_n": pa.array(out[2], pa.int64())})


def _within_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop pairs of stretches whose common prefixes are more than one edit apart."""

    def shared(a: str, b: str) -> str:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return a[:n]

    def reach(x: str, y: str) -> bool:
        cells = (1, 0, 1)
        for i in range(min(len(x), len(y) - 1)):
            left = min(cells[0] + (not i or y[i - 1] != x[i]), cells[1] + 1)
            on = min(cells[1] + (y[i] != x[i]), cells[2] + 1, left + 1)
            cells = (left, on, min(cells[2] + (y[i + 1] != x[i]), on + 1))
            if min(cells) > 1:
                return False
        return True

    for batch in batches:
        ends = (batch.column(c).to_pylist() for c in ("lo", "hi", "other_lo", "other_hi"))
        keep = [reach(shared(a, b), shared(c, d)) for a, b, c, d in zip(*ends)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for each two words of `words` (word, n; distinct) one edit apart, both ways.

    Words of fewer than two code points are not compared. A group of words that share
    a half may have any size: what does not fit one stretch of the sorted list is
    compared stretch by stretch.
    """
    length, forms = F.length("word"), []
    for side in (0, 1):
        s = F.reverse("word") if side else F.col("word")
        for shorter in (0, 1):
            size = length - shorter
            half = (size - F.floor(size / 2)) if side else F.floor(size / 2)
            forms.append(
                F.struct(
                    F.lit(side).cast("long").alias("side"),
                    size.cast("long").alias("size"),
                    F.substring(s, F.lit(1), half.cast("int")).alias("half"),
                    s.alias("s"),
                    F.col("n").cast("long").alias("n"),
                )
            )
    rows = words.where(length >= 2).select(F.explode(F.array(*forms)).alias("r")).select("r.*").where("size >= 2")
    order = ["side", "size", "half", "s"]
    spark = words.sparkSession
    folder = new_folder(spark, "spelling")
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stretches, _TYPES), f"{folder}/found")
    group = ["side", "size", "half"]
    cut = found.where("stretch IS NOT NULL").select("stretch", *order, "n")
    held = written(cut.groupBy(*group, "stretch").agg(F.min("s").alias("lo"), F.max("s").alias("hi")), f"{folder}/held")
    other = held.select(*group, *[F.col(c).alias(f"other_{c}") for c in ("stretch", "lo", "hi")])
    met = held.join(other, group).where("stretch <> other_stretch")
    met = written(met.mapInArrow(_within_reach, met.schema).select(*group, "stretch", "other_stretch"), f"{folder}/met")
    listed = met.join(cut, [*group, "stretch"])
    asked = met.join(cut.withColumnRenamed("stretch", "other_stretch"), [*group, "other_stretch"])
    by = [*group, "stretch", "other_stretch"]
    between = listed.groupBy(*by).cogroup(renewed(asked).groupBy(*by)).applyInArrow(_across, "word string, near string, near_n long")
    pairs = freeze(found.where("word IS NOT NULL").select("word", "near", "near_n").union(between))
    remove(spark, folder)
    return pairs


def spelling_variants(docs: DataFrame, least: int = LEAST, twice: int = TWICE, times: int = TIMES, noise: int = NOISE) -> DataFrame:
    """One row for each word of `docs` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; one in
    `noise`, by a checksum of the row's doc_id and the run, loses a code point. Kept
    are words of `least` code points that occur `twice` or more. n_near counts the
    words one inserted, deleted or replaced code point away; the form is the most
    frequent of them (ties: the first by code point) if it is `times` as frequent, else
    null, and form_n its count; root is where the forms lead, the word itself if nowhere.

    A null text has no words; a null doc_id is spelled null in the checksum. Repeated
    rows count again; other columns are ignored, whatever their names; an empty table
    gives no words. Words may be of any length.
    """
    known = freeze(vocabulary(docs, least, noise).where(F.col("n") >= twice))
    best = near_words(known).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b")
    )
    is_form = -F.col("b.less") >= times * F.col("n")
    judged = freeze(
        known.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("b.near")).alias("form"),
            F.when(is_form, -F.col("b.less")).alias("form_n"),
        )
    )
    # a form is more frequent than its word, so following forms ends; each round doubles the steps
    roots = freeze(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = freeze(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
