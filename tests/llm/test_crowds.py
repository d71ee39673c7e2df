"""Windows of large groups: each alike to another is settled, and few are compared that are not."""

from __future__ import annotations

import random

import numpy as np

from dialweave.llm import passages
from dialweave.llm.words import Words, grams

WIDTH, REACH = 46, 46 + passages.GAP


def crowd(texts: list[list[str]], at: int) -> passages.Crowd:
    """One group of a window of each text, at the word `at` of the line that all have."""
    rows = []
    for n, words in enumerate(texts):
        tokens = (grams(Words().of(" ".join(words).encode()), passages.SHINGLE) >> np.uint64(32)).astype("<u4")
        place = words.index("line0") + at
        first = max(0, place - REACH)
        cut = tokens[first : place + REACH + 1]
        distinct = passages.least_distinct(cut, WIDTH, passages.GAP + 1 if first else 0, place - first)
        rows.append((n, place, None if n == 3 else n, first, distinct, cut.tobytes(), [7]))
    return passages.Crowd(rows, WIDTH, 0.8)


def texts() -> list[list[str]]:
    draw = random.Random(21)
    prose = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    line, out = [f"line{i}" for i in range(30)], []
    for _ in range(30):  # neighbours are alike about the line, with a word replaced now and then
        before, behind = prose(12), prose(12)
        out += [prose(40) + before + line + behind + prose(40), prose(50) + before[:-1] + prose(draw.randrange(2)) + line + behind + prose(40)]
    part, word = prose(9), lambda: [f"r{draw.randrange(8)}"] * draw.choice([10, 20, 30])
    out += [prose(40) + part + line + prose(40) for _ in range(60)]  # too little in common
    out += [prose(30) + word() + word() + line + word() + word() + prose(30) for _ in range(120)]  # repeated words beside it
    return out


def test_windows_of_a_large_group_against_all_pairs(monkeypatch):
    compared, compare = [], passages.alike_parts
    monkeypatch.setattr(passages, "alike_parts", lambda *a: compared.append(1) or compare(*a))
    one = crowd(texts(), 4)
    met = one.settle()
    by_rounds, total = len(compared), len(one.rows) * (len(one.rows) - 1) // 2
    held = lambda parts, at, b_at: any(i <= at <= j and k <= b_at <= l for i, j, k, l, _ in parts)
    alike = set()
    for i in range(len(one.rows)):
        for j in range(i):
            distinct = max(one.distinct[i], one.distinct[j], (one.distinct[i] + one.distinct[j]) / 1.8)
            at, b_at = (int(one.at[x] - one.first[x]) for x in (i, j))
            if held(compare(one.tokens[i], one.tokens[j], WIDTH, 0.8, b_at - at, distinct), at, b_at):
                alike |= {int(one.cid[i]), int(one.cid[j])}
    found = {r[0] for r in met} | {r[3] for r in met}
    assert len(alike) > 60 and alike <= found
    assert all(r[10] >= 0.8 and r[7] - r[6] >= WIDTH - 1 and r[9] - r[8] >= WIDTH - 1 for r in met)
    assert by_rounds < total / 40
    assert {r[2] for r in met if r[0] == 3} | {r[5] for r in met if r[3] == 3} == {None}


def test_windows_in_several_groups_are_compared_once():
    one = crowd(texts()[:8], 4)
    one.rows = [(*r[:6], [7, 8, 9]) for r in one.rows]
    met = one.settle()
    assert len(met) == len(set(met)) == len(crowd(texts()[:8], 4).settle())
