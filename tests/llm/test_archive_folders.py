"""Archives in folders named as Spark names them, and payloads far larger than a chunk."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from dialweave.llm import archives


def test_folders_by_every_local_name(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 3000), (2, "u", "a" * 3000)], "page_id long, url string, html string")
    for name in (f"{tmp_path}/plain", f"file:{tmp_path}/one", f"file://{tmp_path}/two"):
        manifest = archives.write_archives(pages, name)
        kinds = {r["page_id"]: r["record_type"] for r in archives.read_archives(manifest, name).collect()}
        assert kinds == {1: "revisit", 2: "response"}
    assert {p.name for p in tmp_path.iterdir()} == {"plain", "one", "two"}
    with pytest.raises(ValueError, match="from the root"):
        archives._store("relative/folder")


def test_a_payload_of_many_chunks(spark, tmp_path):
    """A record of 48 MB is cut, written and read by chunks; its digest is that of the whole."""
    size = 48 << 20
    html = F.repeat(F.lit("0123456789abcde\n"), size // 16)
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") < 2, html).alias("html"))
    manifest = archives.write_archives(pages, str(tmp_path))
    rows = archives.read_archives(manifest, str(tmp_path))
    widest = rows.agg(F.max(F.octet_length("data")), F.count("*")).first()
    assert widest[0] <= archives.CHUNK and widest[1] >= size // archives.CHUNK
    last = {r["page_id"]: r for r in rows.where("last").drop("data").collect()}
    whole = hashlib.sha1(b"0123456789abcde\n" * (size // 16)).hexdigest()
    assert (last[1]["digest"], last[1]["payload_bytes"], last[0]["refers_to"]) == (whole, size, 1)
    assert last[2]["payload_bytes"] == 0
