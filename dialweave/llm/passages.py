"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles. The Cartesian tree over their hashes
groups all passages of a least width by their smallest token: node c stands for the
passages that lie between the nearest smaller tokens on either side and hold c. The
width is that of a run of equal tokens which any two alike passages must share, so
one function finds them all: both texts have a window about the same token of the
run, and the tokens around it are the same. These, as runs laid at four places so that
every wide enough run holds one, are what windows meet by.

In a group of windows that meet, all pairs of different texts are compared. In a large
one windows first meet a few of them in turn; those alike to one are settled, and each
of the others is compared with all of the group that a passage about it may share enough
with, also where one settles it but another may reach beyond. So every passage alike to another is found, whatever stands
first in its group.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialweave.llm.words import BLOCK, Words, grams, mixed
from dialweave.session import freeze, shared_dir

SHINGLE = 5
#: Words of the shortest passage.
WORDS = 50
FUNCTIONS = 1
PERCENT = 80
#: Windows in a group that are all compared with one another; in larger groups by rounds.
GROUP = 32
#: Windows of a larger group that are compared with all of it before its tokens are.
ROUNDS = 3


def sure_run(width: int, percent: int) -> int:
    """Length of a run of equal tokens in any two passages of `width` tokens and more, alike by `percent`, that edits tell apart.

    Each of b breaks, a word replaced, put in or taken out, or parts moved, leaves out
    SHINGLE - 1 tokens or more on either side. So passages alike have that many in
    common, in b + 1 runs.
    """
    least, lost = 2 * percent * width / (100 + percent), SHINGLE - 1
    found, b = math.ceil(least), 1
    while percent < 100 and b <= 2 * width:
        common = math.ceil(max(least, 2 * b * lost * percent / (100 - percent)))
        found = min(found, -(-common // (b + 1)))
        b += 1
    return max(1, found)


def ranked(values: np.ndarray) -> np.ndarray:
    """The lower half of each value with its place below, so that equal ones rank by place."""
    return (values << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)


def least_places(ranks: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every run of `width`."""
    n, have = len(ranks) - width + 1, 1
    while have < width:
        step = min(have, width - have)
        ranks = np.minimum(ranks[:-step], ranks[step:])
        have += step
    return (ranks[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def wide_nodes(ranks: np.ndarray, width: int, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, c, last) of every node c of the Cartesian tree whose span holds `width` values or more.

    A node spans `width` values exactly if it is the least of some run of that width;
    first and last are the ends of all such runs. Only runs that begin `inside` count.
    """
    places = least_places(ranks, width)
    begins = np.arange(len(places)) if inside is None else np.flatnonzero(inside)
    least = places[begins]
    opens = np.ones(len(least), bool)
    opens[1:] = least[1:] != least[:-1]
    starts = np.flatnonzero(opens)
    ends = np.concatenate([starts[1:], [len(least)]])[: len(starts)] - 1
    return begins[starts], least[starts], begins[ends] + width - 1


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of every node of the Cartesian tree whose span [l, r] has `width` values or more.

    Where the runs a node is least of stop short of all that hold it, the run that ends
    them names the smaller neighbour; where not, that neighbour is such a node too.
    """
    if len(values) < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    ranks = ranked(values)
    left, c, right = wide_nodes(ranks, width)
    full_left, full_right = left == c - width + 1, right == c + width - 1
    last = len(values) - 1
    # nearest smaller node on either side
    stack: list[int] = []
    v = ranks[c].tolist()
    before, after = [-1] * len(c), [len(c)] * len(c)
    for i, x in enumerate(v):
        while stack and v[stack[-1]] > x:
            after[stack.pop()] = i
        before[i] = stack[-1] if stack else -1
        stack.append(i)
    padded = np.concatenate([c, [last + 1, -1]])
    left[full_left] = padded[np.array(before)[full_left]] + 1
    right[full_right] = padded[np.array(after)[full_right]] - 1
    return left, c, right


class Runs:
    """Hashes of runs of tokens by a rolling polynomial."""

    base = 0x9E3779B97F4A7C15

    def __init__(self, tokens: np.ndarray):
        factors = np.full(len(tokens) + 1, self.base, np.uint64)
        factors[0] = 1
        powers = np.multiply.accumulate(factors)
        factors[1:] = pow(self.base, -1, 1 << 64)
        self.back = np.multiply.accumulate(factors)
        self.ahead = np.concatenate([[np.uint64(0)], np.cumsum(tokens * powers[:-1])])

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.ahead[start + length] - self.ahead[start]) * self.back[start])


#: Places at which a run lies about the smallest token.
PLACES = 4


def _surrounds(runs: Runs, c: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> list[np.ndarray]:
    """Hash of the run at each place, 32 bits, 0 where it would leave the text [begin, end).

    A passage of `width` tokens around c holds the run that begins the largest
    multiple of a quarter of it before c.
    """
    step = width // PLACES
    length = (PLACES - 1) * step + 1
    found = []
    for i in range(PLACES):
        start = c - i * step
        inside = (start >= begin) & (start + length <= end)
        hashes = np.zeros(len(c), np.uint64)
        hashes[inside] = runs.of(start[inside], length) >> np.uint64(32) | np.uint64(1)
        found.append(hashes)
    return found


#: `part` is 0, or -1; `place` the token's; two runs share a number.
_WINDOW = ["part", "key", "cid", "place", *[f"runs_{i}" for i in range(PLACES // 2)]]


def text_windows(words: Words, texts: list[bytes], width: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Number of words of each text; and for each function text, key, at, ahead, behind and runs of the windows.

    A passage of `width` tokens that holds the smallest token reaches less than `width`
    to either side, and longer ones hold other nodes: windows end there.
    """
    hashes, cuts = words.of_all(texts)
    sizes = np.diff(cuts)
    reach = width + SHINGLE - 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(owner) - reach + 1] == owner[reach - 1 :] if len(owner) >= reach else np.zeros(0, bool)
    if not inside.any():
        return sizes, []
    tokens = grams(hashes, SHINGLE)
    runs = Runs(tokens)
    found = []
    for f, salt in enumerate(mixed(np.arange(101, 101 + FUNCTIONS, dtype=np.uint64))):
        values = mixed(tokens ^ salt)
        first, c, last = wide_nodes(ranked(values), width, inside)
        text = owner[c]
        around = [] if f else _surrounds(runs, c, cuts[text], cuts[text + 1] - SHINGLE + 1, width)
        found.append([text, values[c], c - cuts[text], c - first, last - c, *around])
    return sizes, found


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Texts of a batch with their cids, as many at a time as make up a block."""
    cids, texts, size = [], [], 0
    for cid, text in zip(batch.column("cid").to_pylist(), batch.column("text")):
        cids.append(cid)
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= BLOCK:
            yield np.array(cids, np.int64), texts
            cids, texts, size = [], [], 0
    if texts:
        yield np.array(cids, np.int64), texts


def _inner(text: np.ndarray, key: np.ndarray, at: np.ndarray, run: np.ndarray, near: int) -> np.ndarray:
    """Windows within a stretch that repeats itself: those before and behind have the same token and run, and are near.

    One of them in every `near` tokens is left in, and the first and the last of the
    stretch: a passage that reaches beyond it holds the run of one of these, another one
    of those between.
    """
    same = (text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (at[1:] - at[:-1] <= near) & (run[1:] == run[:-1])
    inner = np.zeros(len(key), bool)
    inner[1:-1] = same[1:] & same[:-1] & (at[1:-1] // near == at[:-2] // near)
    return inner


def _windows(words_least: int, width: int):
    """Windows of each text long enough, and a row of part -1 whose `place` is its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        length = (PLACES - 1) * (width // PLACES) + 1
        # those left in are at most two times as far apart, so the shortest passage holds a whole run of one
        near = max(1, (words_least - SHINGLE + 1 - length) // 2)
        for batch in batches:
            for cids, texts in _groups(batch):
                sizes, found = text_windows(words, texts, width)
                long = sizes >= words_least
                none = np.zeros(long.sum(), np.int64)
                rows = [[none - 1, none, cids[long], sizes[long], none, none]]
                for text, key, at, _, _, *around in found:
                    # a stretch of one word has the same run at one place of many windows, and others at its ends
                    around = [np.where(_inner(text, key, at, run, near), np.uint64(0), run) for run in around]
                    kept = long[text] & (np.bitwise_or.reduce(around) != 0)
                    text, key, at, *around = (x[kept] for x in (text, key, at, *around))
                    two = [(a | b << np.uint64(32)).view(np.int64) for a, b in zip(around[::2], around[1::2])]
                    rows.append([np.zeros(len(key), np.int64), key.view(np.int64), cids[text], at, *two])
                columns = [np.concatenate(x).astype(np.int64) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], _WINDOW)

    return run


#: Windows that a task holds before it sends them on; parts for each task that groups them.
HELD, PARTS = 1 << 17, 4


def _packs(rows: np.ndarray, by: np.ndarray, parts: int) -> list[pa.Array]:
    """Numbers of parts, and the rows of each in one value; rows with the same number in `by` are in one part."""
    part = (mixed(by.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    numbers, starts = np.unique(part[order], return_index=True)
    packs = [rows[x].tobytes() for x in np.split(order, starts[1:])] if len(starts) else []
    return [pa.array(numbers, pa.int64()), pa.array(packs, pa.binary())]


def _unpacked(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    """The rows of each part; those of one follow each other."""
    now, pieces = None, []
    for batch in batches:
        for part, pack in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist()):
            if part != now and pieces:
                yield np.frombuffer(b"".join(pieces), np.int64).reshape(-1, columns)
                pieces = []
            now = part
            pieces.append(pack)
    if pieces:
        yield np.frombuffer(b"".join(pieces), np.int64).reshape(-1, columns)


def _packed(words_least: int, width: int, parts: int):
    """Windows in a few rows (part, packed), those of one key in one part, and the lengths of a text in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            by = np.where(rows[:, 0] < 0, rows[:, 2], rows[:, 1])
            return pa.RecordBatch.from_arrays(_packs(rows, by, parts), ["part", "packed"])

        for batch in _windows(words_least, width)(batches):
            held.append(np.stack([batch.column(c).to_numpy() for c in _WINDOW], axis=1))
            if sum(map(len, held)) >= HELD:
                yield sent()
        if held:
            yield sent()

    return run


def _segments(values: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of equal sorted values that are of two texts at least; texts are sorted within."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)
    first, end = edges[:-1], edges[1:]
    two = cid[first] != cid[end - 1]
    return first[two], end[two]


def _spread(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places of all stretches."""
    sizes = end - first
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def grouped_windows(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the windows of a part have in common.

    That are texts and their numbers of words; pairs of windows (texts, diagonal, place in the first) of groups of
    `most` at most; windows (token, text, place) of larger ones, and the group.
    """
    sizes = np.unique(rows[rows[:, 0] < 0][:, 2:4], axis=0)
    rows = rows[rows[:, 0] == 0]
    rows = rows[np.lexsort([rows[:, 3], rows[:, 2], rows[:, 1]])]
    # equal texts have the same windows
    rows = rows[np.concatenate([[True], (rows[1:, 1:4] != rows[:-1, 1:4]).any(axis=1)])] if len(rows) else rows
    rows = rows[_spread(*_segments(rows[:, 1], rows[:, 2]))]
    halves = rows[:, 4:].copy().view("<u4").astype(np.uint64)
    window, place = np.nonzero(halves)
    # a run holds the window's token, so with its key 32 bits of the run tell it
    named = halves[window, place] << np.uint64(3) | place.astype(np.uint64)
    group = mixed(mixed(named) + rows[window, 1].view(np.uint64)).view(np.int64)
    order = np.lexsort([window, group])
    window, group = window[order], group[order]
    first, end = _segments(group, rows[window, 2])
    large = end - first > most
    found = _spread(first[large], end[large])
    crowds = np.stack([*rows[window[found], 1:4].T, group[found]], axis=1)
    pairs = [np.zeros((0, 2), np.int64)]
    for n in range(2, most + 1 if not large.all() else 0):
        if n > int((end - first)[~large].max(initial=0)):
            break
        members = window[first[end - first == n][:, None] + np.arange(n)]
        one, two = np.triu_indices(n, 1)
        pairs.append(np.stack([members[:, one].ravel(), members[:, two].ravel()], axis=1))
    # a pair shares several runs; windows are in the order of their texts
    a, b = np.unique(np.concatenate(pairs), axis=0).T
    a, b = a[rows[a, 2] != rows[b, 2]], b[rows[a, 2] != rows[b, 2]]
    return sizes, np.stack([rows[a, 2], rows[b, 2], rows[a, 3] - rows[b, 3], rows[a, 3]], axis=1), crowds


#: `kind` -1 is a text and its length, 0 the packed pairs of a part, 1 a window of a large group and its token as part.
_GROUPED = [*((c, pa.int64()) for c in ("kind", "cid", "part", "at", "key")), ("packed", pa.binary())]
_GROUPED_TYPES = "kind long, cid long, part long, at long, key long, packed binary"


def _grouped(most: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _unpacked(batches, len(_WINDOW)):
            sizes, pairs, crowds = grouped_windows(rows, most)
            numbers, packs = _packs(pairs, pairs[:, 0] + mixed(pairs[:, 1].view(np.uint64)).view(np.int64), parts)
            for kind, n, columns in (
                (-1, len(sizes), {"cid": sizes[:, 0], "at": sizes[:, 1]}),
                (0, len(numbers), {"part": numbers, "packed": packs}),
                (1, len(crowds), dict(zip(("part", "cid", "at", "key"), crowds.T))),
            ):
                columns["kind"] = np.full(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[c]) if c in columns else pa.nulls(n, t) for c, t in _GROUPED], [c for c, _ in _GROUPED]
                )

    return run


def _stretches(reach: int):
    """Places on one diagonal whose surroundings overlap are one stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _unpacked(batches, 4):
            a, b, diagonal, at = rows[np.lexsort(rows.T[::-1])].T
            opens = np.ones(len(a), bool)
            opens[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] - at[:-1] > 2 * reach)
            starts = np.flatnonzero(opens)
            begin, end = at[starts], at[np.concatenate([starts[1:], [len(a)]]) - 1]
            a, b, diagonal = a[starts], b[starts], diagonal[starts]
            ends = [np.maximum(0, begin - reach), end + reach, np.maximum(0, begin - diagonal - reach), end - diagonal + reach]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, diagonal, *ends)], _PAIR)

    return run


_PAIR = ["a", "b", "diagonal", "first", "last", "b_first", "b_last"]


def _cut_out(width: int):
    """Tokens of stretches that reach `width` + GAP to either side of the places of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("cid", "doc_id", "text", "stretches"))
            for cid, doc, text, stretches in zip(*columns):
                # the upper halves are enough to compare two stretches
                tokens = (grams(words.of(text or b""), SHINGLE) >> np.uint64(32)).astype("<u4")
                for s in stretches:
                    cut = tokens[s["first"] : s["last"] + 1]
                    # an alike passage holds one of the places, so it begins at the last one or less than its width before the first
                    begin, end = (GAP + 1 if s["first"] else 0), s["last"] - width - GAP - s["first"]
                    out.append((cid, doc, s["first"], s["last"], least_distinct(cut, width, begin, end), cut.tobytes()))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], _CUT)

    return run


_CUT = ["cid", "doc_id", "first", "last", "distinct", "tokens"]


@lru_cache(4)
def _needs(width: int, least: float) -> np.ndarray:
    """Tokens of the other's that the run from each place to each place `width` or more behind has at least, if alike to one."""
    places = np.arange(BLOCKED)
    size = places[width:] - places[:-width, None]
    need = np.maximum(least * size, least / (1 + least) * (size + width)) - SLACK
    return np.where(size >= width, need, np.inf)


class Stretches:
    """Two stretches, and how many tokens before each place of the one stand in the other, where it repeats none."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x.tolist(), y.tolist()
        self.one, self.two = set(self.x), set(self.y)
        self.common = len(self.one & self.two)

    @cached_property
    def x_inside(self) -> np.ndarray:
        return np.fromiter(map(self.two.__contains__, self.x), bool, len(self.x))

    @cached_property
    def y_inside(self) -> np.ndarray:
        return np.fromiter(map(self.one.__contains__, self.y), bool, len(self.y))

    @cached_property
    def x_held(self) -> list[int] | None:
        return [0, *np.cumsum(self.x_inside).tolist()] if len(self.one) == len(self.x) else None

    @cached_property
    def y_held(self) -> list[int] | None:
        return [0, *np.cumsum(self.y_inside).tolist()] if len(self.two) == len(self.y) else None

    def similarity(self, a: int, b: int, c: int, d: int) -> float:
        """Of the sets of x[a:b] and y[c:d]."""
        one, two = set(self.x[a:b]), set(self.y[c:d])
        met = len(one & two)
        return met / (len(one) + len(two) - met)

    def may_be_alike(self, a: int, b: int, c: int, d: int, least: float) -> bool:
        """Whether the tokens that stand in the other stretch are enough."""
        if self.x_held is not None and self.x_held[b] - self.x_held[a] < least * (b - a) - SLACK:
            return False
        return self.y_held is None or self.y_held[d] - self.y_held[c] >= least * (d - c) - SLACK

    def may_hold(self, width: int, least: float) -> bool:
        """Whether each has a run of `width` tokens or more with as many of the other's as one alike has.

        That is `least` of its own, and of what both have together.
        """
        both = self.x_held is not None and self.y_held is not None
        for held in (self.x_held, self.y_held):
            if held is None:
                continue
            at = np.array(held, float)
            over = at - least * np.arange(len(held))
            if not (over[width:] >= np.minimum.accumulate(over[:-width]) - SLACK).any():
                return False
            if both and len(held) <= BLOCKED and not (at[width:] - at[:-width, None] >= _needs(width, least)[: len(held) - width, : len(held) - width]).any():
                return False
        return True


#: For sums of shares, which are rounded; tokens up to which all runs of a stretch are looked at.
SLACK, BLOCKED = 1e-6, 250


def least_distinct(tokens: np.ndarray, width: int, begin: int = 0, end: int | None = None) -> int:
    """Distinct tokens of that run of `width`, of those that begin from `begin` to `end`, that has the fewest."""
    if len(tokens) < width or len(set(tokens.tolist())) == len(tokens):
        return width
    order = np.argsort(tokens, kind="stable")
    again = np.flatnonzero(tokens[order[1:]] == tokens[order[:-1]])
    before, place = order[again], order[again + 1]
    near = place - before < width
    # a repeated token counts once less in the runs that hold both
    fewer = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(fewer, np.maximum(0, place[near] - width + 1), 1)
    np.add.at(fewer, before[near] + 1, -1)
    last = len(tokens) - width
    return width - int(np.cumsum(fewer)[begin : (last if end is None else min(last, end)) + 1].max())


#: Tokens that differ between two equal ones within a passage: those of two words replaced.
GAP = 2 * SHINGLE


#: Words that passages may be moved against each other by edits before; equal tokens that make a run.
APART, RUN = 6, 3
#: Runs of a chain that are looked through at a time.
CHAIN = 400


def _chains(x: np.ndarray, y: np.ndarray, shift: int, common: float) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of equal tokens (first, end, shift) in a row, on diagonals near `shift`, with GAP tokens at most between them; none if all have less than `common` tokens."""
    low, high = max(0, -shift - APART), min(len(x), len(y) - shift + APART)
    if high - low < RUN:
        return
    width = high - low
    # y about each diagonal, or what no token is
    at = low + shift - APART
    near = np.full(width + 2 * APART, -1, np.int64)
    near[max(0, -at) : max(0, len(y) - at)] = y[max(0, at) : max(0, at + len(near))]
    equal = np.zeros((2 * APART + 1, width + 2), bool)
    np.equal(as_strided(near, (2 * APART + 1, width), 2 * near.strides), x[low:high], out=equal[:, 1:-1])
    flat = equal.ravel()
    edges = (flat[1:] != flat[:-1]).nonzero()[0]
    begin, stop = edges[::2], edges[1::2]
    wide = stop - begin >= RUN
    if (stop - begin)[wide].sum() < common:
        return
    diagonal, first = np.divmod(begin[wide], width + 2)
    first += low
    runs = list(zip(first.tolist(), (first + stop[wide] - begin[wide]).tolist(), (diagonal + shift - APART).tolist()))
    chain: list[tuple[int, int, int]] = []
    end = behind = 0
    for i, j, s in sorted(runs):
        if chain and i - end <= GAP and i + s - behind <= GAP and i + s >= chain[0][0] + chain[0][2] and j > end:
            chain.append((i, j, s))
            end, behind = j, max(behind, j + s)
        elif chain and j <= end:
            continue
        else:
            if chain:
                yield chain
            chain, end, behind = [(i, j, s)], j, j + s
    if chain:
        yield chain


def _widened(two: Stretches, i: int, j: int, k: int, l: int, width: int, least: float) -> tuple[int, int, int, int, float] | None:
    """Passages x[i:j] and y[k:l], with as many of the tokens beside them as make up the width, if they are alike."""
    more = max(0, width - (j - i), width - (l - k))
    best = None
    if more > (1 - least) * width + RUN:
        return None
    for before in range(more + 1):
        a, b, c, d = i - before, j + more - before, k - before, l + more - before
        if a < 0 or c < 0 or b > len(two.x) or d > len(two.y) or not two.may_be_alike(a, b, c, d, least):
            continue
        alike = two.similarity(a, b, c, d)
        if alike >= least and (best is None or alike > best[4]):
            best = (a, b - 1, c, d - 1, alike)
    return best


def _alike_runs(two: Stretches, chain: list[tuple[int, int, int]], width: int, least: float) -> list[tuple[int, int, int, int, float]]:
    """The longest alike passages that begin and end with runs of a chain, leaving out what is within longer ones."""
    whole = (chain[0][0], max(j for _, j, _ in chain), chain[0][0] + chain[0][2], max(j + s for _, j, s in chain))
    if part := _widened(two, *whole, width, least):
        return [part]
    if len(chain) == 1:
        return []
    runs = np.array(chain)
    first, end = runs[:, 0], np.maximum.accumulate(runs[:, 1])
    b_first, b_end = (runs[:, 0] + runs[:, 2]), np.maximum.accumulate(runs[:, 1] + runs[:, 2])
    common = np.cumsum(runs[:, 1] - runs[:, 0])
    # what runs shorter than RUN have in common is not counted yet
    met = common[None, :] - (common - (runs[:, 1] - runs[:, 0]))[:, None]
    a, b = end[None, :] - first[:, None], b_end[None, :] - b_first[:, None]
    alone = np.maximum(a, width) + np.maximum(b, width)
    may = np.triu((met + 2 * RUN) / np.maximum(alone - met - 2 * RUN, 1) >= least)
    begins, ends = np.nonzero(may)
    found: list[tuple[int, int, int, int, float]] = []
    taken = np.zeros(len(runs), bool)
    for at in np.argsort(-a[begins, ends], kind="stable"):
        p, q = int(begins[at]), int(ends[at])
        if taken[p : q + 1].any():
            continue
        part = _widened(two, int(first[p]), int(end[q]), int(b_first[p]), int(b_end[q]), width, least)
        if part:
            found.append(part)
            taken[p : q + 1] = True
    return sorted(found)


def moved_parts(
    x: np.ndarray, y: np.ndarray, width: int, least: float, shift: int = 0, two: Stretches | None = None
) -> list[tuple[int, int, int, int, float]]:
    """(first, last, first, last, similarity) of alike passages whose equal tokens stand in the same order, about the diagonal `shift`."""
    found = []
    two = two or Stretches(x, y)
    # alike passages have no less in common, but for runs shorter than RUN
    common = 2 * least / (1 + least) * width - 2 * RUN
    for chain in _chains(x, y, shift, common):
        if sum(j - i for i, j, _ in chain) < common:
            continue
        for at in range(0, max(1, len(chain) - CHAIN // 2), CHAIN // 2):
            found += _alike_runs(two, chain[at : at + CHAIN], width, least)
    return found


def loose_parts(x: np.ndarray, y: np.ndarray, width: int, least: float, two: Stretches) -> list[tuple[int, int, int, int, float]]:
    """As `moved_parts`, where the common tokens stand in any order or are repeated."""

    def parts(inside: np.ndarray) -> list[tuple[int, int]]:
        held = inside.nonzero()[0]
        if not len(held):
            return []
        cuts = (held[1:] - held[:-1] > GAP + 1).nonzero()[0]
        return list(zip([int(held[0]), *held[cuts + 1].tolist()], [*(held[cuts] + 1).tolist(), int(held[-1]) + 1]))

    found = []
    theirs = parts(two.y_inside)
    for mine in parts(two.x_inside):
        for other in theirs:
            part = _widened(two, *mine, *other, width, least)
            if part:
                found.append(part)
    return found


def straight_parts(x: np.ndarray, y: np.ndarray, width: int, least: float, shift: int, two: Stretches) -> list[tuple[int, int, int, int, float]]:
    """As `moved_parts`, on the diagonal `shift` alone; none where tokens beside a part may belong to it as well."""
    low, high = max(0, -shift), min(len(x), len(y) - shift)
    equal = (x[low:high] == y[low + shift : high + shift]).nonzero()[0] + low if high > low else np.zeros(0, np.int64)
    if not len(equal):
        return []
    found, reach = [], 2 * GAP + SHINGLE
    cuts = (equal[1:] - equal[:-1] > GAP + 1).nonzero()[0] + 1
    for begin, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(equal)]):
        i, j = int(equal[begin]), int(equal[stop - 1]) + 1
        if j - i < width and stop - begin + 2 * RUN < 2 * least / (1 + least) * width:
            continue
        alike = 1.0 if stop - begin == j - i else two.similarity(i, j, i + shift, j + shift)
        if j - i < width or alike < least:
            return []
        k, l = i + shift, j + shift
        for beside, theirs in ((two.x[max(0, i - reach) : i], two.y[max(0, k - reach) : k]), (two.x[j : j + reach], two.y[l : l + reach])):
            if not set(beside).isdisjoint(theirs):
                return []
        found.append((i, j - 1, k, l - 1, alike))
    return found


def alike_parts(x: np.ndarray, y: np.ndarray, width: int, least: float, shift: int, distinct: int) -> list[tuple[int, int, int, int, float]]:
    """(first, last, first, last, similarity) of the alike passages of two stretches; any two have `distinct` different tokens or more together."""
    if min(len(x), len(y)) < width:
        return []
    two = Stretches(x, y)
    if two.common < least * distinct - SLACK:
        return []
    if straight := straight_parts(x, y, width, least, shift, two):
        return straight
    if not two.may_hold(width, least):
        return []
    return moved_parts(x, y, width, least, shift, two) or loose_parts(x, y, width, least, two)


def _verified(width: int, least: float):
    """Passages of two stretches; `shift` takes places in the one to those in the other, `at` and `b_at` are those of a token both have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in _LAID)
            for a, at, a_doc, b, b_at, b_doc, first, b_first, shift, distinct, x, y in zip(*columns):
                for i, j, k, l, alike in alike_parts(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), width, least, shift, distinct):
                    out.append((a, at, a_doc, b, b_at, b_doc, first + i, first + j, b_first + k, b_first + l, alike))
            kinds = [pa.int64()] * 10 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], _ALIKE)

    return run


_LAID = ["a", "at", "a_doc", "b", "b_at", "b_doc", "first", "b_first", "shift", "distinct", "x", "y"]
_ALIKE = ["a", "at", "a_doc", "b", "b_at", "b_doc", "first", "last", "b_first", "b_last", "similarity"]
_ALIKE_TYPES = ", ".join(f"{c} {'double' if c == 'similarity' else 'long'}" for c in _ALIKE)


def _written(df: DataFrame, folder: str) -> DataFrame:
    """`df` from a compressed table in the shared folder; a checkpoint would take several times the disk.

    The shuffle files behind it go as well: Spark deletes them once the driver's
    collector has found them without use.
    """
    df.write.option("compression", "zstd").parquet(folder)
    df.sparkSession._jvm.java.lang.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _by_part(packed: DataFrame, tasks: int) -> DataFrame:
    return packed.repartition(tasks, "part").sortWithinPartitions("part")


def _of_both(least: float) -> Column:
    """Distinct tokens that alike passages have together at least, as they have `least` of these in common."""
    return F.greatest(F.col("x_distinct"), F.col("y_distinct"), (F.col("x_distinct") + F.col("y_distinct")) / F.lit(1 + least)).alias("distinct")


class Crowd:
    """Windows about one token, and the alike passages of those of large groups.

    `rows` are cid, place, doc_id, first place and distinct tokens of the context, its tokens, and the groups of each window.
    """

    def __init__(self, rows: list[tuple], width: int, least: float):
        self.width, self.least = width, least
        # nulls first; the smallest doc_id is met first
        rows = sorted(rows, key=lambda r: (r[2] is not None, r[2], r[0], r[1]))
        self.rows = rows
        self.cid, self.at, self.first, self.distinct = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 3, 4))
        self.tokens = [np.frombuffer(r[5], "<u4") for r in rows]
        self.sets = [np.unique(t) for t in self.tokens]
        self.spans: dict[int, Passages] = {}
        self.spans_size = 0
        self.apart: set[tuple[int, int]] = set()
        self.known: dict[tuple[int, int], tuple] = {}
        self.covered: tuple[int, int] | None = None
        contexts: dict[bytes, int] = {}
        self.context = [contexts.setdefault(r[5], len(contexts)) for r in rows]
        self.parts: dict[tuple, list[tuple[int, int, int, int, float]]] = {}
        self.found: list[tuple] = []

    def settle(self) -> list[tuple]:
        groups: dict[int, list[int]] = {}
        for i, r in enumerate(self.rows):
            for key in r[6]:
                groups.setdefault(key, []).append(i)
        for _, members in sorted(groups.items()):
            self._settle(np.array(members))
        return self.found

    def _settle(self, members: np.ndarray) -> None:
        """In each of ROUNDS rounds a window of a text that did not lead yet, the one that repeats itself most, then of the
        smallest doc_id, leads the group and is compared with those left in it. Windows alike to a leader are settled, and so
        is such a leader; each of those left in the end is compared with all of the group, once it is settled with those
        that have tokens of its context beyond the passages found.
        """
        group = Group(self, members)
        left, may_lead = np.ones(len(members), bool), np.ones(len(members), bool)
        reached: dict[int, tuple[int, int]] = {}
        for n in range(ROUNDS + 1):
            if not left.any():
                return
            if n == ROUNDS:
                leads = np.flatnonzero(left).tolist()
            else:
                free = np.flatnonzero(may_lead)
                leads = [int(free[np.argmin(group.distinct[free])])] if len(free) else []
                may_lead &= group.cid != group.cid[leads[0]] if leads else True
            for one in leads:
                self.covered = reached.get(one)
                for other in _may_be_alike(group, one, left if n < ROUNDS else None):
                    mine, theirs = self._compared(int(members[one]), int(members[other]))
                    left[one] &= mine is None
                    left[other] &= theirs is None
                    for window, span in ((one, mine), (other, theirs)) if n == ROUNDS else ():
                        if span:
                            known = reached.get(window, span)
                            reached[window] = min(span[0], known[0]), max(span[1], known[1])
                    self.covered = reached.get(one)

    def _compared(self, b: int, a: int) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
        """First and last token of the alike passages that hold the places of two windows, if any; the passages are kept."""
        if (b, a) not in self.known:
            distinct = max(self.distinct[a], self.distinct[b], (self.distinct[a] + self.distinct[b]) / (1 + self.least))
            first, b_first = int(self.first[a]), int(self.first[b])
            shift = int(self.at[b] - self.at[a]) - b_first + first
            # many copies have the same contexts
            same = self.context[a], self.context[b], shift, distinct
            if (parts := self.parts.get(same)) is None:
                parts = self.parts[same] = alike_parts(self.tokens[a], self.tokens[b], self.width, self.least, shift, distinct)
            at, b_at = int(self.at[a]) - first, int(self.at[b]) - b_first
            theirs, mine = [(k, l) for _, _, k, l, _ in parts if k <= b_at <= l], [(i, j) for i, j, *_ in parts if i <= at <= j]
            held = tuple((min(x)[0], max(y for _, y in x)) if x else None for x in (theirs, mine))
            self.known[b, a], self.known[a, b] = held, held[::-1]
            one, two = self.rows[a][:3], self.rows[b][:3]
            self.found += [(*one, *two, first + i, first + j, b_first + k, b_first + l, alike) for i, j, k, l, alike in parts]
        return self.known[b, a]

    def repeats(self, i: int) -> bool:
        return len(self.sets[i]) < len(self.tokens[i])

    def passages(self, i: int) -> Passages:
        """Of a context that repeats itself."""
        if (known := self.spans.get(self.context[i])) is None:
            known = Passages(self.tokens[i], self.sets[i], self.width)
            self.spans_size += known.held.nbytes
            if self.spans_size > REMEMBERED:
                self.spans.clear()
                self.spans_size = known.held.nbytes
            self.spans[self.context[i]] = known
        return known

    def best(self, i: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct tokens of passages of a context, and most of them that such have of those `inside`; -1 for less than alike ones."""
        if self.repeats(i):
            passages = self.passages(i)
            return passages.numbers, passages.best(inside[None], self.least)[0]
        begin, end, starts, numbers = _runs(len(self.tokens[i]), self.width)
        if not len(numbers):
            return numbers, np.zeros(0)
        before = np.zeros(len(self.tokens[i]) + 1)
        np.cumsum(inside[np.searchsorted(self.sets[i], self.tokens[i])], out=before[1:])
        best = np.maximum.reduceat(before[end] - before[begin], starts)
        return numbers, np.where(best < self.least * numbers - SLACK, -1, best)

    def may_share(self, i: int, mine: np.ndarray, j: int, theirs: np.ndarray) -> bool:
        """Whether passages of two contexts may share enough, of which `mine` and `theirs` are the tokens that the other has."""
        same = self.context[i], self.context[j]
        if same in self.apart:
            return False
        both = self.least / (1 + self.least)
        (one, best), (two, other) = self.best(i, mine), self.best(j, theirs)
        if (np.minimum(best[:, None], other) >= both * (one[:, None] + two) - ROUNDED).any():
            return True
        if len(self.apart) >= KEPT:
            self.apart.clear()
        self.apart |= {same, same[::-1]}
        return False


@lru_cache(256)
def _runs(n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all runs of `width` of n places or more, by their length; where each length begins, and the lengths."""
    lengths = np.arange(width, n + 1)
    counts = n + 1 - lengths
    starts = np.cumsum(counts) - counts
    length = np.repeat(lengths, counts)
    begin = np.arange(len(length)) - np.repeat(starts, counts)
    return begin, begin + length, starts, lengths


#: Pairs of contexts remembered as not alike; it only saves looking at them again.
KEPT = 500_000

#: Bytes of passages that a crowd remembers; it only saves making them again.
REMEMBERED = 1 << 26


class Passages:
    """Which of its distinct tokens are in each passage of a context, those with the same ones once, by their number."""

    def __init__(self, tokens: np.ndarray, names: np.ndarray, width: int):
        edges = np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]).nonzero()[0]
        at = np.searchsorted(names, tokens[edges[:-1]])
        before = np.zeros((len(edges), len(names)), np.int16)
        before[np.arange(1, len(edges)), at] = 1
        before = np.cumsum(before, axis=0, dtype=np.int16)
        one, two = np.nonzero(edges[None, 1:] - edges[:-1, None] >= width)
        held = before[two + 1] > before[one]
        sizes = held.sum(axis=1)
        order = np.argsort(sizes, kind="stable")
        self.held, self.sizes = held[order].astype(np.float32), sizes[order]
        self.starts = np.concatenate([[True], self.sizes[1:] != self.sizes[:-1]]).nonzero()[0] if len(sizes) else np.zeros(0, np.int64)
        self.numbers = self.sizes[self.starts]

    def best(self, inside: np.ndarray, least: float) -> np.ndarray:
        """Most tokens that passages of each number of tokens have of the rows of `inside`, if these may be alike; else -1."""
        if not len(self.starts):
            return np.full((len(inside), 0), -1.0)
        met = inside @ self.held.T
        met[met < least * self.sizes - SLACK] = -1
        return np.maximum.reduceat(met, self.starts, axis=1)


class Group:
    """Windows of a crowd that share a run, by the tokens of their contexts."""

    def __init__(self, crowd: Crowd, members: np.ndarray):
        self.crowd, self.members = crowd, members
        self.cid, self.distinct = crowd.cid[members], crowd.distinct[members]
        sets = [crowd.sets[m] for m in members.tolist()]
        self.ends = np.cumsum([len(x) for x in sets])
        _, self.number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), np.diff(self.ends, prepend=0))
        self.holders = np.split(owner[np.argsort(self.number, kind="stable")], np.cumsum(counts)[:-1])

    def numbers(self, one: int) -> np.ndarray:
        return self.number[(self.ends[one - 1] if one else 0) : self.ends[one]]

    def shared(self, one: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows that hold tokens of a window, and the place of the token in its set, for each both have."""
        lists = [self.holders[n] for n in self.numbers(one).tolist()]
        return np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _may_be_alike(group: Group, one: int, among: np.ndarray | None) -> Iterator[int]:
    """Windows of other texts of a group that may be alike to a window: each passage of its context shares too little with others.

    Of two alike passages of c and d distinct tokens, at least `least` / (1 + `least`) of c + d are in both.
    """
    crowd, width, least = group.crowd, group.crowd.width, group.crowd.least
    both = least / (1 + least)
    other, place = group.shared(one)
    mine, theirs = group.distinct[one], group.distinct
    need = np.maximum(least * np.maximum(mine, theirs), both * (mine + theirs)) - SLACK
    may = (np.bincount(other, minlength=len(theirs)) >= need) & (group.cid != group.cid[one])
    found = np.flatnonzero(may if among is None else may & among)
    own = int(group.members[one])
    tokens, names = crowd.tokens[own], crowd.sets[own]
    mark = np.zeros(len(group.holders), np.float32)
    mark[group.numbers(one)] = 1
    # in parts, since each takes a row for every passage
    for at in range(0, len(found), PART):
        some = found[at : at + PART]
        row = np.full(len(theirs), -1)
        row[some] = np.arange(len(some))
        inside = row[other] >= 0
        held = np.zeros((len(some), len(names)), np.float32)
        held[row[other[inside]], place[inside]] = 1
        least_of = both * theirs[some] - ROUNDED
        if crowd.repeats(own):
            passages = crowd.passages(own)
            enough = (passages.best(held, least) - both * passages.numbers >= least_of[:, None]).any(axis=1)
        else:
            enough = _over(held[:, np.searchsorted(names, tokens)], width, both) >= least_of
        order = np.searchsorted(names, tokens)
        for n in enough.nonzero()[0].tolist():
            if crowd.covered and not (held[n, order[: crowd.covered[0]]].any() or held[n, order[crowd.covered[1] + 1 :]].any()):
                continue
            # most of those that meet a leader are alike
            if among is not None or crowd.may_share(own, held[n], int(group.members[some[n]]), mark[group.numbers(int(some[n]))]):
                yield int(some[n])


def _over(inside: np.ndarray, width: int, both: float) -> np.ndarray:
    """Most that a passage of `width` tokens or more has inside beyond `both` of its tokens, where none is repeated."""
    before = np.zeros((len(inside), inside.shape[1] + 1), np.float32)
    np.cumsum(inside, axis=1, out=before[:, 1:])
    before -= np.float32(both) * np.arange(before.shape[1], dtype=np.float32)
    return (before[:, width:] - np.minimum.accumulate(before[:, :-width], axis=1)).max(axis=1, initial=-np.inf)


#: Windows that are held against all passages of one at a time; for counts of single precision.
PART, ROUNDED = 256, 1e-3


def _settled(width: int, least: float):
    """Alike passages of windows of large groups; those about one token follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            out = Crowd(rows, width, least).settle()
            kinds = [pa.int64()] * 10 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], _ALIKE)

        for batch in batches:
            for token, *row in zip(*(batch.column(c).to_pylist() for c in _CROWD)):
                if token != now and rows:
                    yield done()
                    rows = []
                now = token
                rows.append(tuple(row))
        if rows:
            yield done()

    return run


_CROWD = ["token", "cid", "at", "doc_id", "first", "distinct", "tokens", "keys"]


def repeated_passages(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Passages of `docs` (doc_id, text) that stand, nearly alike, in another document.

    A row for each document and passage: doc_id, start_word, end_word (exclusive),
    n_words, other_doc_id (the smallest doc_id met there), similarity of the shingle
    sets, percent at least. Passages of one document that touch are one row. Every
    passage of `words` words or more is found that is alike to one of another document
    and told apart from it by words replaced, put in or taken out, or by parts moved. Where
    more than GROUP places have the same run of words, the ends, other_doc_id and
    similarity are those of the documents compared, which every alike one is settled by.

    Words are those between white space, lower-cased A-Z. Null, empty and short texts
    have no passage. Documents with the same text of `words` words or more repeat each
    other as a whole. Rows without a doc_id take part, with null in its place; rows
    that repeat a doc_id and its text are one document. Other columns are ignored; an
    empty table gives an empty result.
    """
    width = words - SHINGLE + 1
    run = sure_run(width, percent)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("cid"),
        F.col("text").cast("binary").alias("text"),
    ).where("text IS NOT NULL")
    members = freeze(texts.select("cid", "doc_id").distinct())
    sizes = members.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))

    # written, so that the shuffles of one step are gone before the next
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}"
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reach = width + GAP
    packed = texts.select("cid", "text").mapInArrow(_packed(words, run, PARTS * files), "part long, packed binary")
    grouped = _written(_by_part(packed, files).mapInArrow(_grouped(GROUP, PARTS * files), _GROUPED_TYPES), f"{folder}/grouped")
    lengths = freeze(grouped.where("kind = -1").select("cid", F.col("at").alias("size")))
    pairs = _written(
        _by_part(grouped.where("kind = 0").select("part", "packed"), files).mapInArrow(_stretches(reach), ", ".join(f"{c} long" for c in _PAIR)),
        f"{folder}/pairs",
    )
    many = grouped.where("kind = 1").select(F.col("part").alias("token"), "cid", "at", "key")
    many = many.groupBy("token", "cid", "at").agg(F.collect_list("key").alias("keys"))
    many = many.withColumns({"first": F.expr(f"greatest(0, at - {reach})"), "last": F.expr(f"at + {reach}")})
    sides = pairs.select(F.col("a").alias("cid"), "first", "last").union(pairs.select("b", "b_first", "b_last"))
    sides = sides.union(many.select("cid", "first", "last")).distinct()
    asked = (
        sides.groupBy("cid")
        .agg(F.collect_list(F.struct("first", "last")).alias("stretches"))
        .join(sizes.select("cid", F.col("doc_id").alias("keeper")), "cid")
    )
    sources = texts.join(asked, "cid").where(F.col("doc_id").eqNullSafe(F.col("keeper"))).select("cid", "doc_id", "text", "stretches")
    cut = _written(
        sources.mapInArrow(_cut_out(width), "cid long, doc_id long, first long, last long, distinct long, tokens binary").dropDuplicates(["cid", "first", "last"]),
        f"{folder}/cut",
    )
    crowds = many.join(cut, ["cid", "first", "last"]).select(*_CROWD)
    rounds = _written(
        crowds.repartition(files, "token").sortWithinPartitions("token").mapInArrow(_settled(width, percent / 100), _ALIKE_TYPES),
        f"{folder}/rounds",
    )
    mine = cut.select(F.col("cid").alias("a"), F.col("doc_id").alias("a_doc"), "first", "last", F.col("distinct").alias("x_distinct"), F.col("tokens").alias("x"))
    theirs = cut.select(
        F.col("cid").alias("b"),
        F.col("doc_id").alias("b_doc"),
        F.col("first").alias("b_first"),
        F.col("last").alias("b_last"),
        F.col("distinct").alias("y_distinct"),
        F.col("tokens").alias("y"),
    )
    alike = _written(
        pairs.join(mine, ["a", "first", "last"])
        .join(theirs, ["b", "b_first", "b_last"])
        .select(
            *(F.lit(0).cast("long").alias(c) if c in ("at", "b_at") else c for c in _LAID[:8]),
            F.expr("first - b_first - diagonal").alias("shift"),
            _of_both(percent / 100),
            "x",
            "y",
        )
        .repartition(files)
        .mapInArrow(_verified(width, percent / 100), _ALIKE_TYPES),
        f"{folder}/alike",
    )
    for name in ("grouped", "pairs", "cut"):
        _remove(spark, f"{folder}/{name}")
    found = alike.union(rounds)
    spans = found.select(F.col("a").alias("cid"), "first", "last", F.col("b_doc").alias("other"), "similarity").union(
        found.select("b", "b_first", "b_last", "a_doc", "similarity")
    )
    named = freeze(
        spans.groupBy("cid", "first", "last")
        .agg(F.min("other").alias("other_doc_id"), F.max("similarity").alias("similarity"))
        .withColumn("end", F.col("last") + SHINGLE)
        .select("cid", F.col("first").alias("start"), "end", "other_doc_id", "similarity")
    )
    _remove(spark, folder)
    copies = sizes.where("rows > 1").join(lengths, "cid").select(
        "cid",
        F.lit(0).cast("long").alias("start"),
        F.col("size").alias("end"),
        F.col("doc_id").alias("other_doc_id"),
        F.lit(1.0).alias("similarity"),
    )
    everywhere = named.union(copies)
    order = Window.partitionBy("cid").orderBy("start", "end")
    starts = F.when(F.col("start") <= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    merged = (
        everywhere.withColumn("starts", starts)
        .withColumn("part", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("cid", "part")
        .agg(
            F.min("start").alias("start_word"),
            F.max("end").alias("end_word"),
            F.min("other_doc_id").alias("other_doc_id"),
            F.max("similarity").alias("similarity"),
        )
    )
    return members.join(merged, "cid").select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id", "similarity"
    )
