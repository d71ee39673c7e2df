"""Every passage that is alike to one of another document is found, whatever stands first in its group."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from dialweave.llm import passages


def shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def edited(draw: random.Random, words: list[str], kind: str) -> list[str]:
    words, at = list(words), draw.randrange(len(words))
    if kind == "replace":
        words[at] = "edited"
    elif kind == "delete":
        del words[at]
    elif kind == "insert":
        words.insert(at, "edited")
    elif kind == "move":
        words = words[at:] + words[:at]
    return words


def found(spark, rows):
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {(r["doc_id"], r["other_doc_id"]) for r in got}, got


def test_all_edited_passages_are_found(spark):
    draw = random.Random(11)
    prose = lambda n: [f"w{draw.randrange(20_000)}" for _ in range(n)]
    rows, alike = [], []
    for n in range(200):
        one = prose(draw.choice([50, 51, 53, 60, 80, 110]))
        two = edited(draw, one, ["replace", "delete", "insert", "move"][n % 4])
        if len(one) > 100:
            two = edited(draw, two, draw.choice(["replace", "delete", "insert"]))
        if len(two) >= 50 and len(shingles(one) & shingles(two)) >= 0.8 * len(shingles(one) | shingles(two)):
            alike.append(n)
        rows += [(2 * n, " ".join(prose(75) + one + prose(60))), (2 * n + 1, " ".join(prose(40) + two + prose(100)))]
    pairs, _ = found(spark, rows)
    assert all(a == b ^ 1 for a, b in pairs)
    assert len(alike) > 150 and {(2 * n + i, 2 * n + 1 - i) for n in alike for i in (0, 1)} <= pairs


def test_a_text_with_a_part_of_a_passage_hides_no_others(spark):
    draw = random.Random(12)
    prose = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    rows = []
    for n in range(0, 120, 3):
        passage = prose(60)
        rows.append((n, " ".join(prose(30) + passage[:40] + prose(30) + passage[20:] + prose(30))))
        rows += [(n + i, " ".join(prose(20 + i) + passage + prose(30))) for i in (1, 2)]
    pairs, _ = found(spark, rows)
    assert pairs == {(n + i, n + 3 - i) for n in range(0, 120, 3) for i in (1, 2)}


def test_large_groups_are_settled_by_rounds(spark, monkeypatch):
    draw = random.Random(13)
    prose = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    line, rows = prose(30), []
    for n in range(0, 60, 2):  # all have the line; neighbours have what stands about it as well
        before, behind = prose(20), prose(20)
        rows += [(n + i, " ".join(prose(30) + before + line + behind + prose(30))) for i in (0, 1)]
    rows += [(100 + i, " ".join(prose(40) + line + prose(40))) for i in range(20)]
    for group in (passages.GROUP, 10**9):
        monkeypatch.setattr(passages, "GROUP", group)
        pairs, _ = found(spark, rows)
        assert pairs == {(n + i, n + 1 - i) for n in range(0, 60, 2) for i in (0, 1)}


def test_stretches_that_repeat_themselves(spark):
    draw = random.Random(14)
    prose = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    texts = [prose(10) + ["again"] * n + prose(10) for n in (60, 200, 50, 45)] + [prose(30) + ["a", "b", "c"] * n + prose(9) for n in (20, 90)]
    _, got = found(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    spans = {(r["doc_id"], r["start_word"], r["end_word"]) for r in got}
    assert spans == {(0, 10, 70), (1, 10, 210), (2, 10, 60), (4, 30, 90), (5, 30, 300)}


def test_the_sure_run():
    assert passages.sure_run(46, 80) == 21 and passages.sure_run(46, 100) == 46
    draw = np.random.default_rng(3)
    for _ in range(300):
        size, breaks = int(draw.integers(46, 300)), int(draw.integers(1, 6))
        cuts = np.sort(draw.choice(size + 1, breaks, replace=False))
        inner = np.diff([0, *cuts, size])
        runs = np.maximum(0, inner - 4)  # parts of `inner` words that are moved apart have so many tokens
        lost = size - 4 - runs.sum()
        if runs.sum() >= 0.8 * (runs.sum() + 2 * lost) and size - 4 >= 46:
            assert runs.max() >= 21


def test_few_windows_of_a_repeated_word_meet(spark):
    draw = random.Random(15)
    prose = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], 0
    for one, two in [(40, 40), (40, 80), (45, 40), (20, 21), (300, 90)]:
        for before in (True, False):  # what is common stands before or behind the stretch
            word, part = f"r{pairs}", prose(35)
            for i, n in enumerate((one, two)):
                stretch = part + [word] * n if before else [word] * n + part
                rows.append((2 * pairs + i, " ".join(prose(20) + stretch + prose(20))))
            pairs += 1
    got, _ = found(spark, rows)
    assert got == {(n, n ^ 1) for n in range(2 * pairs)}
    text = " ".join(prose(60) + ["again"] * 40 + prose(60)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["cid", "text"])
    windows = next(passages._windows(50, 21)(iter([batch]))).to_pydict()
    runs = [r for place in (0, 1) for r in windows[f"runs_{place}"]]
    halves = [h for r in runs for h in (("low", r & 0xFFFFFFFF), ("high", (r >> 32) & 0xFFFFFFFF)) if h[1]]
    assert 4 < max(Counter(halves).values()) < 12


def test_a_text_that_meets_itself_in_a_group_is_settled_by_another(spark, monkeypatch):
    draw = random.Random(16)
    prose = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    rows = [(i, " ".join(prose(20) + ["again"] * 400 + prose(20))) for i in (0, 1)]  # many windows of few texts make a group
    left, make = [], passages._may_be_alike
    monkeypatch.setattr(passages, "_may_be_alike", lambda *a: left.append(1) or make(*a))
    _, got = found(spark, rows)
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == {(0, 20, 420), (1, 20, 420)}
    assert not left  # none has to meet every other


def test_the_least_distinct_passage_holds_the_place():
    tokens = np.concatenate([np.arange(70), np.full(46, 99)]).astype("<u4")
    assert passages.least_distinct(tokens, 46) == 1
    assert passages.least_distinct(tokens, 46, 0, 24) == 46 and passages.least_distinct(tokens, 46, 0, 30) == 41


def test_bounds_never_turn_alike_stretches_down():
    draw = np.random.default_rng(17)
    for _ in range(400):
        part = draw.integers(0, 10**6, int(draw.integers(46, 90))).astype("<u4")
        other = part.copy()
        other[draw.choice(len(part), int(draw.integers(0, 6)), replace=False)] = draw.integers(10**7, 10**8)
        x, y = (np.concatenate([draw.integers(10**8, 10**9, 20).astype("<u4"), p, draw.integers(10**8, 10**9, 15).astype("<u4")]) for p in (part, other))
        two = passages.Stretches(x, y)
        if two.similarity(20, 20 + len(part), 20, 20 + len(part)) >= 0.8:
            assert two.may_be_alike(20, 20 + len(part), 20, 20 + len(part), 0.8) and two.may_hold(46, 0.8)
    apart = np.concatenate([np.arange(25), np.arange(1000, 1080)]).astype("<u4")
    assert not passages.Stretches(apart, np.concatenate([np.arange(25), np.arange(2000, 2080)]).astype("<u4")).may_hold(46, 0.8)
