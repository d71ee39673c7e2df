"""The pipeline on a small corpus, and its stages on awkward rows."""

from __future__ import annotations

import random

import corpus_pipeline
import __spark_entry__ as contract

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def test_stages_hold_their_promises(spark, tmp_path):
    draw = random.Random(8)
    prose = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        text = prose(60)
        if i % 6 == 0:
            text[3] = "nitwit"
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0))
    rows += [(500 + i, rows[7][1] + " end", "en", "s0", 0) for i in range(4)]
    rows += [(600, "write to jo.doe@mail.example.org " + " ".join(prose(40)), "en", "s1", 0)]
    rows += [(700, None, None, None, None), (None, " ".join(prose(30)), None, "s2", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in found} for name, found in kept.items()}
    insulted = {i for i in range(240) if i % 6 == 0}
    assert len(ids["toxicity"] & insulted) <= 4 and {r[0] for r in rows} - insulted - ids["toxicity"] == set()
    assert ids["toxicity"] - ids["near_duplicates"] == {500, 501, 502, 503}
    assert len(kept["private_data"]) == len(kept["near_duplicates"])
    assert not any("jo.doe@" in (r["text"] or "") for r in kept["private_data"])
    assert all(r["n_chars"] in (None, len(r["text"] or "")) for r in kept["private_data"])
    assert ids["mixing"] <= ids["private_data"]
    pieces = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names if n[2].isdigit()] == list(range(1, 14))
    assert "pipeline" in contract.queries()
