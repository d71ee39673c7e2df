"""Cells of pivot lists: all pairs that share enough pivots are compared, each once, and none is sent on."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dialweave.llm import vectors


def grouped(draw, n: int) -> np.ndarray:
    """Vectors of a dense group, of pairs near the least cosine, copies and others."""
    middle = draw.standard_normal(16)
    group = middle + 0.12 * draw.standard_normal((n, 16))
    apart = draw.standard_normal((n, 16))
    pairs = apart + np.sqrt(1 / 0.95**2 - 1) * draw.standard_normal((n, 16))
    return np.concatenate([group, apart, pairs, group[:5], group[:5]])


def by_force(x: np.ndarray, cells: vectors.Cells, least: float) -> tuple[list[int], list[int]]:
    """Links of each row, and the first row that each reaches."""
    units = vectors._unit(x)[1]
    held = np.zeros((len(x), len(cells.pivots)))
    np.put_along_axis(held, cells.ranks(units), 1, axis=1)
    cosine = (units[:, None, :] * units[None, :, :]).sum(axis=2)
    linked = (cosine >= least) & (held @ held.T >= cells.shared)
    reach = linked | np.eye(len(x), dtype=bool)
    while ((more := (reach.astype(float) @ reach) > 0) != reach).any():
        reach = more
    return (linked.sum(axis=1) - 1).tolist(), reach.argmax(axis=1).tolist()


def met(cells: vectors.Cells, x: np.ndarray, least: float) -> list[dict]:
    pieces = defaultdict(list)
    for part in np.array_split(x, 4):
        batch = pa.RecordBatch.from_arrays([pa.array(part.tolist(), pa.list_(pa.float64()))], ["embedding"])
        for b in vectors._dealt(cells)(iter([batch])):
            for at, *piece in zip(*(b.column(c).to_pylist() for c in vectors._PIECE)):
                pieces[at].append(tuple(piece))
    rows = []
    for at, held in pieces.items():
        cell = vectors.Cell(cells, at, held, least)
        cell.compare()
        rows += cell.found().to_pylist()
    return rows


@pytest.mark.parametrize("size, cell, shared", [(1024, 1 << 18, 3), (8, 1 << 18, 3), (8, 40, 3), (8, 40, 4), (16, 60, 2), (8, 40, 1)])
def test_cells_equal_brute_force(monkeypatch, size, cell, shared):
    draw = np.random.default_rng(3)
    for name, value in (("LIST", size), ("TILE", size), ("CELL", cell), ("SHARED", shared), ("PIVOTS", 40)):
        monkeypatch.setattr(vectors, name, value)
    x = grouped(draw, 150)
    sample = x[draw.permutation(len(x))[:200]]
    cells = vectors.Cells(vectors.spread(sample), vectors._unit(sample)[1], len(x))
    assert (cells.parts > 1).any() == (cell < 1000)
    rows = met(cells, x, 0.95)
    links, first = by_force(x, cells, 0.95)
    assert max(links) > 100
    ids = vectors._class_ids(x)
    copies = {c: int(n) for c, n in zip(*np.unique(ids, return_counts=True))}
    exact = {int(c): u for c, u in zip(ids, vectors._unit(x)[1])}
    got, root = defaultdict(int), {int(c): int(c) for c in ids}

    def reached(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    for r in rows:
        if r["sure"]:
            got[r["a"]] += r["others"]
        elif (exact[r["a"]] * exact[r["b"]]).sum() < 0.95:
            continue
        else:
            got[r["a"]] += copies[r["b"]]
            got[r["b"]] += copies[r["a"]]
        root[reached(r["a"])] = reached(r["b"])
    assert [copies[c] - 1 + got[c] for c in ids.tolist()] == links
    of = defaultdict(set)
    for c, f in zip(ids.tolist(), first):
        of[reached(c)].add(f)
    assert all(len(f) == 1 for f in of.values()) and len(of) == len(set(first))


def test_pairs_of_a_dense_group_stay_in_their_cells(spark, monkeypatch):
    draw = np.random.default_rng(5)
    x = draw.standard_normal(32) + 0.1 * draw.standard_normal((700, 32))
    sent, write = [], vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, folder: sent.append(write(df, folder)) or sent[-1])
    seen, gone = [], vectors.remove
    monkeypatch.setattr(vectors, "remove", lambda *a: seen.append(sent[0].count()) or gone(*a))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(df).collect()
    assert sum(r["n_links"] for r in got) > 300 * len(x) and {r["component_id"] for r in got} == {0}
    assert seen[0] < 20 * len(x)


def test_rows_of_lists_as_a_matrix():
    column = pa.array([[1.0, 2.0], None, [], [3.0, None], [4.0, 5.0, 6.0]], pa.list_(pa.float64()))
    rows = vectors._matrix(column.slice(0, 4), 3)
    assert rows[0].tolist() == [1, 2, 0] and np.isnan(rows[1]).all() and rows[2].tolist() == [0, 0, 0]
    assert rows[3][0] == 3 and np.isnan(rows[3][1]) and vectors._matrix(column.slice(4), 3).tolist() == [[4, 5, 6]]
