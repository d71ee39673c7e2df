"""Packing documents into training sequences along a space-filling curve.

A document's vector counts its tokens through a fixed random projection of the
vocabulary to a few dimensions; the projected points are ordered by their
place on the Hilbert curve, so that documents of like vocabulary follow one
another. Sequences are cut from the stream of documents in that order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialweave.llm.batches import parts
from dialweave.llm.prefix import sums_before
from dialweave.session import freeze

DIMENSIONS, BITS = 4, 10
SEED = 77
#: A character that ends a word within this module; texts that hold it go the other way.
END = "\x00"
#: White space to some libraries only, a letter whose small form is two characters, and END.
ODD = "\x1c\x1d\x1e\x1f\x85\u0130" + END
#: Lead bytes up to this one begin characters that every version of Unicode folds and sorts alike.
STEADY = 0xC8
#: How definitions of the known shape cut a folded text; fixed values of the format.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for steady characters: letters first, which is the most frequent case; numbers are the digits and these six.
PIECES = re.compile(r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
KNOWN_SHAPE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def hilbert_place(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (integers below 2 ** bits, one column a dimension) on the Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            high = (x[i] >> b & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | x[i] >> b & 1
    return place


class WordIds:
    """Ids of a text by a word-level definition for the `tokenizers` library, as little-endian 16- or 32-bit numbers.

    Where the definition's merges follow its ids, `tiktoken` makes the same ids several
    times faster: a byte and END are one symbol there, put together before any merge, as
    the definition's word ends are. Texts that the two might fold or cut differently, and
    definitions of another kind, go through `tokenizers` as a whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(definition)
        self.kind = "<u2" if self.full.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        spec = json.loads(definition)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.quick = self._by_ranks(spec)

    @staticmethod
    def _by_ranks(spec: dict):
        model = spec["model"]
        ending, vocabulary = model.get("end_of_word_suffix"), model.get("vocab", {})
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        shape = {"normalizer": spec.get("normalizer"), "pre_tokenizer": spec.get("pre_tokenizer")}
        if shape != KNOWN_SHAPE or not ending or model.get("ignore_merges"):
            return None
        if any(vocabulary.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
        ranks = {}
        for token, number in vocabulary.items():
            bare = token.removesuffix(ending)
            if number < 512 + len(merges) and bare and all(c in back for c in bare):
                ranks[bytes(back[c] for c in bare) + END.encode() * (bare != token)] = number
        if len(ranks) != 512 + len(merges):
            return None
        words = f"[^{END}]+{END}"
        return tiktoken.Encoding("words", pat_str=words, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        steady = self.quick and np.frombuffer(text.encode(), np.uint8).max() <= STEADY
        if steady and not any(c in text for c in ODD) and not any(t in text for t in self.added):
            ids = self.quick(END.join(PIECES.findall(text.lower())) + END)
        else:
            ids = self.full.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()


def _tokenized(definition: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(definition)
        end = np.array([end_id], words.kind).tobytes()
        size = max(words.full.get_vocab_size(with_added_tokens=True), end_id + 1)
        draw = np.random.Generator(np.random.PCG64(SEED))
        project = draw.standard_normal((size, DIMENSIONS), dtype=np.float32)
        # merged early are the common tokens: they weigh less
        project *= (np.log1p(np.arange(size)) / np.log1p(size)).astype(np.float32)[:, None]
        for batch in parts(batches, "text"):
            packed, counts, points = [], [], []
            for text in batch.column("text").to_pylist():
                ids = words.of(text or "") + end
                numbers = np.frombuffer(ids, words.kind)
                points.append(project[numbers].sum(axis=0) / np.sqrt(len(numbers)))
                counts.append(len(ids) // np.dtype(words.kind).itemsize)
                packed.append(pa.compress(ids, "zstd", asbytes=True))
            grid = (np.tanh(np.array(points).reshape(-1, DIMENSIONS) / 2) + 1) / 2 * (1 << BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(packed, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(hilbert_place(np.clip(grid, 0, (1 << BITS) - 1), BITS), pa.int64()),
                ],
                ["doc_id", "packed", "doc_tokens", "place"],
            )

    return run


def _cut(kind: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.dtype(kind).itemsize
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "packed", "doc_tokens", "before"))
            for doc_id, packed, n, before in zip(*columns):
                ids = np.frombuffer(pa.decompress(packed, n * step, "zstd", asbytes=True), kind).astype("<u4")
                start = 0
                while start < n:
                    offset = (before + start) % length
                    took = min(n - start, length - offset)
                    for name, value in zip(
                        rows, (doc_id, start, took, ids[start : start + took].tobytes(), n, (before + start) // length, offset)
                    ):
                        rows[name].append(value)
                    start += took
            kinds = [pa.binary() if name == "ids" else pa.int64() for name in rows]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))

    return run


def packed_sequences(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of `docs` (doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a definition for the `tokenizers` library that drops
    white space; it is read by the driver and sent along. Each document is its ids
    and `end_id`, cut wherever a sequence is full, so every sequence but the last
    has `length` ids and needs no padding. ids are little-endian unsigned 32-bit.

    A null or empty text is `end_id` alone. Rows that repeat a doc_id, or have none,
    are packed one by one; equal texts lie next to each other on the curve. Other
    columns are ignored, whatever their names; an empty table gives no pieces.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    kind = WordIds(definition).kind
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokenized = freeze(
        texts.mapInArrow(
            _tokenized(definition, end_id), "doc_id long, packed binary, doc_tokens long, place long"
        ).withColumn("row", F.monotonically_increasing_id())
    )
    placed = sums_before(tokenized.select("row", "doc_id", "doc_tokens", "place"), "doc_tokens", ["place", "doc_id", "row"])
    return (
        tokenized.join(placed.select("row", "before"), "row")
        .select("doc_id", "packed", "doc_tokens", "before")
        .mapInArrow(
            _cut(kind, length),
            "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
        )
    )
