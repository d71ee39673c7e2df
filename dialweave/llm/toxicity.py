"""Toxicity by a counterfactually regularised linear classifier.

Features are the distinct words of a text. Besides the usual loss, training
pays for every labelled sentence that names a group: the named group is swapped
for others of its kind and for a neutral word, and the squared change of the
score is penalised. A group's name can then not carry weight of its own, and
neutral mentions of a group are not taken for insults.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialweave.llm.batches import cuts, parts
from dialweave.llm.words import REMEMBERED, WordHashes

#: Labelled rows that the model may learn from, at most, half of them toxic.
SAMPLE = 12_000
#: Words that the fit considers: those whose counts differ most between the classes.
CANDIDATES = 3_000
#: Weight of the counterfactual term, and of the L1 term that drops words.
SWAP, SPARSE = 4.0, 1e-4
ROUNDS = 400
#: Weight of the toxic rows together, whatever their share of a sample: the fit is alike at every size.
SHARE = 0.5

#: Words that name a group, by kind; each kind ends with its neutral word.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("female", "male", "transgender", "human"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "local"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"),
    ("black", "white", "asian", "latino", "african", "european", "local"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "local"),
    ("immigrants", "refugees", "foreigners", "natives", "people"),
    ("disabled", "deaf", "blind", "elderly", "young", "local"),
    ("frauen", "männer", "leute"),
    ("femmes", "hommes", "gens"),
    ("mujeres", "hombres", "gente"),
)

_FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
_ENDS = bytes(10 if chr(b) in ".!?\n\r" else b for b in range(256))


def bag(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_FOLD).split())


def _others() -> dict[bytes, list[bytes]]:
    found: dict[bytes, list[bytes]] = {}
    for kind in IDENTITY_TERMS:
        terms = [t.encode() for t in kind]
        for term in terms[:-1]:
            found.setdefault(term, []).extend(t for t in terms if t != term)
    return found


def _featured(batches):
    known, others = WordHashes(), _others()
    signed = lambda word: known[word] - (1 << 63)
    for batch in parts(batches, "text"):
        words, old, new = [], [], []
        for text in batch.column("text").to_pylist():
            words.append(sorted(map(signed, bag(text))))
            swaps = []
            for sentence in (text or b"").translate(_ENDS).split(b"\n"):
                said = bag(sentence)
                swaps += [(t, o) for t in said & others.keys() for o in others[t] if o not in said]
            old.append([signed(t) for t, _ in swaps])
            new.append([signed(o) for _, o in swaps])
        many = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(words, many), pa.array(old, many), pa.array(new, many)],
            ["toxic", "words", "old", "new"],
        )


@dataclass
class Model:
    bias: float = -20.0
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, values: list[float]) -> float:
        # fsum does not depend on the order of the words
        z = math.fsum([self.bias, *values])
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


class _Weights(dict):
    """Weight of a word."""

    def __init__(self, model: Model):
        self.by_hash = model.weights

    def __missing__(self, word: bytes) -> float:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.by_hash.get(xxhash.xxh3_64_intdigest(word) - (1 << 63), 0.0)
        return value


def fit(toxic: np.ndarray, words: list[np.ndarray], swaps: np.ndarray, swap: float = SWAP) -> Model:
    """Minimise log loss + swap * mean squared score change + L1, by accelerated proximal steps.

    `swaps` holds a row (old word, new word) for each swap in a labelled sentence.
    The classes weigh SHARE and 1 - SHARE, however many rows of them there are.
    """
    y = np.asarray(toxic, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(bias=4.0 if len(y) and y[0] else -4.0)
    row = np.repeat(np.arange(len(y)), [len(w) for w in words])
    vocabulary, at = np.unique(np.concatenate(words), return_inverse=True)
    seen = np.bincount(at, minlength=len(vocabulary))
    bad = np.bincount(at, weights=y[row], minlength=len(vocabulary))
    gap = np.abs((bad + 0.5) / (y.sum() + 1) - (seen - bad + 0.5) / (len(y) - y.sum() + 1))
    # the standard error of the gap puts rare words on the scale of common ones
    gap = gap / np.sqrt((seen + 1) * (len(y) + 1 - seen)) * len(y)
    gap[seen < 3] = 0
    gap[np.isin(vocabulary, swaps.ravel())] = np.inf
    chosen = np.sort(np.argsort(-gap, kind="stable")[:CANDIDATES])
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    at = place[at]
    row, at = row[at >= 0], at[at >= 0]
    # swapped words that the sample lacks keep weight 0
    index = {v: i for i, v in enumerate(vocabulary[chosen].tolist())}
    pairs = np.array([(index.get(a, -1), index.get(b, -1)) for a, b in swaps.tolist()], np.int64).reshape(-1, 2)
    pairs, times = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0))
    penalty = swap * times / max(times.sum(), 1)
    n, d = len(y), len(chosen)
    weight = np.where(y > 0, SHARE / y.mean(), (1 - SHARE) / (1 - y.mean()))
    # each weight has its own step: the loss lies under a parabola that curves so much along it
    width = (np.bincount(row, minlength=n) + 1.0) * weight
    curve = np.append(np.bincount(at, weights=width[row], minlength=d), width.sum()) / (4 * n)
    for side in range(2) if len(pairs) else ():
        curve += 4 * np.bincount(pairs[:, side] % (d + 1), weights=penalty, minlength=d + 1)
    step = 1 / curve
    w = ahead = np.zeros(d + 1)
    for k in range(ROUNDS):
        z = np.bincount(row, weights=ahead[at], minlength=n) + ahead[d]
        off = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        slope = np.append(np.bincount(at, weights=off[row], minlength=d), off.sum())
        if len(pairs):
            padded = np.append(ahead[:d], 0.0)
            change = 2 * penalty * (padded[pairs[:, 1]] - padded[pairs[:, 0]])
            moved = np.bincount(pairs[:, 1] % (d + 1), weights=change, minlength=d + 1)
            moved -= np.bincount(pairs[:, 0] % (d + 1), weights=change, minlength=d + 1)
            slope[:d] += moved[:d]
        stepped = ahead - step * slope
        stepped[:d] = np.sign(stepped[:d]) * np.maximum(np.abs(stepped[:d]) - step[:d] * SPARSE, 0)
        ahead = stepped + k / (k + 3) * (stepped - w)
        w = stepped
    kept = np.flatnonzero(w[:d])
    return Model(float(w[d]), {int(v): float(x) for v, x in zip(vocabulary[chosen][kept], w[kept])})


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swap: float = SWAP) -> Model:
    """Model learned from labels (doc_id, toxic) whose doc_id is not held out.

    At most `sample` labelled rows, half of each class, are drawn by a hash of
    their doc_id; that bounds the broadcast and what the driver gathers.
    """
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = [
        usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for c in (0, 1)
    ]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    labelled = texts.join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").select("text", "toxic")
    rows = labelled.mapInArrow(_featured, "toxic int, words array<long>, old array<long>, new array<long>").toArrow()
    words = [np.array(w, np.int64) for w in rows.column("words").to_pylist()]
    # the fit must not depend on the order in which partitions arrive
    order = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i].tobytes(), rows.column("toxic")[i].as_py()))
    pairs = [
        pair
        for old, new in zip(rows.column("old").to_pylist(), rows.column("new").to_pylist())
        for pair in zip(old, new)
    ]
    toxic = np.array(rows.column("toxic").to_pylist(), np.int64)
    return fit(toxic[order], [words[i] for i in order], np.array(pairs, np.int64).reshape(-1, 2), swap)


def score_column(model: Model, text: str = "text") -> Column:
    """Score in (0, 1) of a text column, whole texts; a null text counts as empty."""

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = _Weights(model)
        for texts in columns:
            scores = [
                model.score([w for w in map(weights.__getitem__, bag(t)) if w])
                for start, length in cuts(texts)
                for t in texts.slice(start, length).to_pylist()
            ]
            yield pa.array(scores, pa.float64())

    return score(F.col(text).cast("binary"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Only the text decides a score. Null and empty texts get the score of no words.
    A null doc_id is not held out. Without labels of both classes every score lies
    on the side of the only class seen, or at 0 where none is. Repeated rows are
    scored alike; other columns are ignored, whatever their names.
    """
    model = learn(docs, labels, sample)
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
