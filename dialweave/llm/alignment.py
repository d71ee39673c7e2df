"""Alignment of the tokens that two tokenizers cut one text into.

Both sides' tokens lie on the bytes of the text. By `pandas.merge_asof`, keyed by
document, each token start finds the token of the other side that covers it; the
two directions together give every overlap. Where tokens of both sides end at one
byte, a group ends, and the two tokens are linked.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.llm.batches import parts
from dialweave.llm.tables import new_folder, remove, renewed, written
from dialweave.session import freeze

#: Text bytes aligned at a time, and those that share one list of linked ids; a longer text is taken alone.
BLOCK, LIST = 1 << 20, 1 << 25
#: Linked id pairs after which a list is closed.
LISTED = 1 << 20
#: Lead bytes up to this one begin characters that every version of Unicode sorts alike.
STEADY = 0xC8
#: How byte-level tokenizers of this kind cut a text into words; a fixed value of the format.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokens:
    """Byte-level tokens of a space and the text, by a definition for the `tokenizers` library.

    Where the definition's merges follow its ids, `tiktoken` makes the same tokens of
    the same words several times faster; texts of characters that the two libraries'
    tables might sort differently go through `tokenizers`.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(definition)
        self.full.encode_special_tokens = True
        spec = json.loads(definition)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in keep)
        letters = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = spec["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            # a special token is no text; its own characters never stand for bytes here
            self.bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        cut = spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        ordered = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        self.fast = None
        if plain and ordered and not spec.get("normalizer") and not spec["model"].get("ignore_merges"):
            import tiktoken

            ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
            if len(ranks) == 256 + len(merges):
                self.fast = tiktoken.Encoding("aligned", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, spaced: str, raw: bytes) -> list[int]:
        if self.fast and np.frombuffer(raw, np.uint8).max() <= STEADY:
            return self.fast.encode_ordinary(spaced)
        return self.full.encode(spaced, add_special_tokens=False).ids


class PieceTokens:
    """Tokens of a `sentencepiece` model, which puts a space before the text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class Tokens:
    """The tokens of some texts on one side, laid out one text after the other."""

    def __init__(self, per_text: list[list[int]], lengths: np.ndarray):
        self.counts = np.array([len(x) for x in per_text], np.int64)
        self.ids = np.fromiter(chain.from_iterable(per_text), np.int64, int(self.counts.sum()))
        self.ends = np.cumsum(lengths[self.ids])
        self.starts = self.ends - lengths[self.ids]
        self.texts = np.repeat(np.arange(len(per_text)), self.counts)


def covering(of: Tokens, by: Tokens) -> np.ndarray:
    """For each token of one side, the other side's token that covers its start."""
    left = pd.DataFrame({"at": of.starts, "text": of.texts})
    right = pd.DataFrame({"at": by.starts, "text": by.texts, "token": np.arange(len(by.starts))})
    return pd.merge_asof(left, right, on="at", by="text")["token"].to_numpy()


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (a, b) that share bytes, each once."""
    of_a, of_b = covering(a, b), covering(b, a)
    # a start that both sides have was found from either side
    later = a.starts[of_b] != b.starts
    first = np.concatenate([np.arange(len(of_a)), of_b[later]])
    second = np.concatenate([of_a, np.flatnonzero(later)])
    return first, second


class Aligner:
    def __init__(self, definition: str, model: bytes):
        self.a, self.b = ByteTokens(definition), PieceTokens(model)
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        #: how an id is written: a token of a within a group and at its end, then those of b
        self.marks = [f"{i}{end}" for side, ends in ((self.a, ",|"), (self.b, ",;")) for i in range(len(side.bytes)) for end in ends]

    def tokens(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        spaced = [" " + t for t in texts]
        raw = [t.encode() for t in spaced]
        a = [self.a.ids(s, r) if t else [] for t, s, r in zip(texts, spaced, raw)]
        b = iter(self.b.ids([t for t in texts if t]))
        b = [next(b) if t else [] for t in texts]
        for i, whole in enumerate(raw):
            sides = ((self.a, a[i]), (self.b, b[i]))
            if any(b"".join(map(side.bytes.__getitem__, ids)) != whole for side, ids in sides):
                a[i], b[i] = [], []
        return Tokens(a, self.lengths[0]), Tokens(b, self.lengths[1])

    def written(self, a: Tokens, b: Tokens, ends_a: np.ndarray, ends_b: np.ndarray) -> list[str]:
        """Of each text its groups, as `a1,a2|b1;a3|b2,b3`."""
        closed_a, closed_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        closed_a[ends_a] = closed_b[ends_b] = 1
        group_a, group_b = np.cumsum(closed_a) - closed_a, np.cumsum(closed_b) - closed_b
        marks = np.empty(len(a.ids) + len(b.ids), np.int64)
        # a group's tokens of a, then those of b
        marks[np.arange(len(a.ids)) + np.concatenate([[0], ends_b + 1])[group_a]] = 2 * a.ids + closed_a
        marks[np.arange(len(b.ids)) + (ends_a + 1)[group_b]] = 2 * (len(self.a.bytes) + b.ids) + closed_b
        cuts = np.concatenate([[0], np.cumsum(a.counts + b.counts)]).tolist()
        marks = marks.tolist()
        return ["".join(map(self.marks.__getitem__, marks[i:j]))[:-1] for i, j in zip(cuts, cuts[1:])]


class _Linked:
    """Numbers for pairs of ids, in order of appearance, and how often each is linked."""

    def __init__(self) -> None:
        self.pairs, self.numbers, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray) -> np.ndarray:
        unique, at, times = np.unique(pairs, return_inverse=True, return_counts=True)
        place = np.searchsorted(self.pairs, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.pairs)
        known[inside] = self.pairs[place[inside]] == unique[inside]
        number = np.empty(len(unique), np.int64)
        number[known] = self.numbers[place[known]]
        number[~known] = np.arange(len(self.counts), len(self.counts) + (~known).sum())
        self.pairs = np.insert(self.pairs, place[~known], unique[~known])
        self.numbers = np.insert(self.numbers, place[~known], number[~known])
        self.counts = np.concatenate([self.counts, np.zeros((~known).sum(), np.int64)])
        self.counts[number] += times
        return number[at]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of about BLOCK bytes."""
    for part in parts(batches, "text", BLOCK):
        yield part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]


_DONE = pa.schema(
    [
        ("list", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("groups_sha256", pa.string()),
        ("links", pa.binary()),
        ("number", pa.int64()),
        ("a_id", pa.int64()),
        ("b_id", pa.int64()),
        ("n", pa.int64()),
    ]
)
_TYPES = "list long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, number long, a_id long, b_id long, n long"


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _DONE], schema=_DONE
    )


def _aligned(definition: str, model: bytes):
    """A row for each document, with its links as numbers; at the end of a list, a row for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, linked, held = Aligner(definition, model), _Linked(), 0
        name = TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            order = np.argsort(linked.numbers)
            pairs = linked.pairs[order]
            return _rows(list=[name] * len(pairs), number=np.arange(len(pairs)), a_id=pairs >> 32, b_id=pairs & 0xFFFFFFFF, n=linked.counts)

        for doc_ids, texts in _slices(batches):
            a, b = aligner.tokens(texts)
            first, second = overlaps(a, b)
            together = a.ends[first] == b.ends[second]
            order = np.argsort(first[together], kind="stable")
            ends_a, ends_b = first[together][order], second[together][order]
            groups = np.bincount(a.texts[ends_a], minlength=len(texts))
            numbers = linked.add(a.ids[ends_a] << 32 | b.ids[ends_b]).astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(groups)])
            said = aligner.written(a, b, ends_a, ends_b)
            yield _rows(
                list=[name] * len(texts),
                doc_id=doc_ids,
                n_a=a.counts,
                n_b=b.counts,
                n_groups=groups,
                groups_sha256=[hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said],
                links=[pa.compress(numbers[i:j].tobytes(), "zstd", asbytes=True) for i, j in zip(cuts, cuts[1:])],
            )
            held += sum(map(len, texts))
            if held >= LIST or len(linked.counts) >= LISTED:
                yield close()
                linked, held, name = _Linked(), 0, name + 1
        if held or len(linked.counts):
            yield close()

    return run


def _counted(docs: pa.Table, listed: pa.Table) -> pa.Table:
    """Documents of one list, their links looked up in it."""
    known = max(listed.column("number").to_pylist(), default=-1) + 1
    count, best = np.zeros(known, np.int64), np.zeros(known, np.int64)
    at = listed.column("number").to_numpy()
    count[at], best[at] = listed.column("count").to_numpy(), listed.column("best").to_numpy()
    n_best, total = [], []
    for n, links in zip(docs.column("n_groups").to_pylist(), docs.column("links").to_pylist()):
        numbers = np.frombuffer(pa.decompress(links, 4 * n, "zstd", asbytes=True), "<u4") if n else np.zeros(0, "<u4")
        n_best.append(int(best[numbers].sum()))
        total.append(int(count[numbers].sum()))
    return pa.table(
        {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")}
        | {"n_links": docs.column("n_groups"), "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        | {"groups_sha256": docs.column("groups_sha256")}
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sources(tokenizer: str, model: str) -> tuple[str, bytes]:
    """Both files are read by the driver and sent along."""
    with open(tokenizer, encoding="utf-8") as a, open(model, "rb") as b:
        return a.read(), b.read()


def alignments(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): how the tokens of two tokenizers meet.

    `tokenizer` is the path of a byte-level definition for the `tokenizers` library (A),
    `model` that of a `sentencepiece` model (B). Returns doc_id, n_a, n_b (tokens of a
    space and the text), n_groups, n_links (pairs of tokens that end at one byte: the last
    ones of each group), n_best, count_sum, groups_sha256. The count of a pair of ids is
    how many links of all documents hold it; n_best counts the links whose count is the
    highest of their B id, ties included, and count_sum adds up the counts of all links.

    Texts that are null or empty, or that either side's tokens do not spell out byte for
    byte, have no tokens: zeros, and '' in place of the digest. Special tokens' strings
    are ordinary text. Repeated rows and rows without a doc_id are documents of their
    own; other columns are ignored, whatever their names; an empty table gives none.

    Links are kept as numbers into a list of id pairs that the documents of about LIST
    bytes share, so that the count of a pair is asked for once a list, not once a link.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "alignment")
    done = written(_texts(docs).mapInArrow(_aligned(*_sources(tokenizer, model)), _TYPES), f"{folder}/done")
    listed = done.where("number IS NOT NULL").select("list", "number", "a_id", "b_id", "n")
    counts = written(listed.groupBy("a_id", "b_id").agg(F.sum("n").alias("count")), f"{folder}/counts")
    highest = counts.groupBy("b_id").agg(F.max("count").alias("highest"))
    judged = counts.join(highest, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    known = listed.join(judged, ["a_id", "b_id"]).select("list", "number", "count", "best")
    rows = done.where("number IS NULL").select("list", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    result = freeze(
        rows.groupBy("list")
        .cogroup(renewed(known).groupBy("list"))
        .applyInArrow(
            _counted,
            "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
        )
    )
    remove(spark, folder)
    return result


def token_overlaps(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """All overlaps: doc_id, a_token, b_token (places from 0), a_id, b_id, first_byte, last_byte, together.

    Bytes are those of a space and the text, from 0; `together` says that both tokens
    end there. Rules for texts without tokens as in `alignments`; they have no row.
    """
    definition, proto = _sources(tokenizer, model)
    names = ["doc_id", "a_token", "b_token", "a_id", "b_id", "first_byte", "last_byte", "together"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(definition, proto)
        for doc_ids, texts in _slices(batches):
            a, b = aligner.tokens(texts)
            i, j = overlaps(a, b)
            text = a.texts[i]
            before = np.concatenate([[0], np.cumsum(np.bincount(a.texts, weights=a.ends - a.starts, minlength=len(texts)))]).astype(np.int64)
            columns = [
                pa.array([doc_ids[t] for t in text.tolist()], pa.int64()),
                i - np.concatenate([[0], np.cumsum(a.counts)])[text],
                j - np.concatenate([[0], np.cumsum(b.counts)])[text],
                a.ids[i],
                b.ids[j],
                np.maximum(a.starts[i], b.starts[j]) - before[text],
                np.minimum(a.ends[i], b.ends[j]) - 1 - before[text],
                a.ends[i] == b.ends[j],
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    kinds = ", ".join(f"{n} long" for n in names[:-1])
    return _texts(docs).mapInArrow(run, f"{kinds}, together boolean")
