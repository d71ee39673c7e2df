"""Passages with words replaced, taken out or put in, at similarities from 0.8 on, against the similarity itself."""

from __future__ import annotations

import random

import numpy as np

from dialweave.llm import passages


def shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def edited(draw: random.Random, words: list[str], kinds: list[str]) -> list[str]:
    words = list(words)
    for n, kind in enumerate(kinds):
        at = draw.randrange(8, len(words) - 8)
        if kind == "replace":
            words[at] = f"edited{n}"
        elif kind == "delete":
            del words[at]
        else:
            words.insert(at, f"edited{n}")
    return words


def test_edited_passages_are_found(spark):
    draw = random.Random(5)
    prose = lambda n: [f"w{draw.randrange(20_000)}" for _ in range(n)]
    rows, alike = [], {}
    for n in range(160):
        passage = prose(draw.choice([60, 70, 90, 120]))
        kinds = [draw.choice(["replace", "delete", "insert"]) for _ in range(draw.choice([1, 1, 2, 3]))]
        other = edited(draw, passage, kinds)
        one, two = shingles(passage), shingles(other)
        if len(one & two) >= 0.8 * len(one | two):
            alike[n] = (75, 75 + len(passage))
        rows += [(2 * n, " ".join(prose(75) + passage + prose(60))), (2 * n + 1, " ".join(prose(40) + other + prose(100)))]
    clean = [(10_000 + i, " ".join(prose(200))) for i in range(60)]
    got = passages.repeated_passages(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()
    assert all(r["doc_id"] < 10_000 and r["other_doc_id"] == r["doc_id"] ^ 1 for r in got)
    spans = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in got}
    found = [n for n in alike if 2 * n in spans and 2 * n + 1 in spans]
    assert len(alike) > 80 and len(found) >= 0.9 * len(alike)
    # spans lie within the planted ones, but for a shingle or two, and hold a passage of the least length;
    # what an edit cuts off behind such a part may be too short to be one itself
    for n in found:
        (start, end), (first, last) = spans[2 * n], alike[n]
        assert start >= first - 12 and end <= last + 12, (n, (start, end), (first, last))
        assert min(end, last) - max(start, first) >= passages.WORDS - 1, (n, (start, end), (first, last))


def test_moved_parts_are_trimmed_to_the_passage():
    draw = np.random.default_rng(2)
    passage, noise = draw.integers(0, 1 << 32, 60, np.uint64).astype("<u4"), lambda n: draw.integers(0, 1 << 32, n, np.uint64).astype("<u4")
    x = np.concatenate([noise(10), passage, noise(12)])
    y = np.concatenate([noise(10), passage[:30], noise(2), passage[30:], noise(10)])
    assert passages.moved_parts(x, y, 46, 0.8) == [(10, 69, 10, 71, 60 / 62)]
    assert passages.moved_parts(x, noise(len(x)), 46, 0.8) == []
    assert passages.moved_parts(x[:0], y[:0], 46, 0.8) == []
