"""License scan by diagonal voting.

Every run of three words of a text that is made of template words meets the
template positions with the same run; a meeting votes for the diagonal
(position in the text less position in the template). Neighbouring diagonals
merge into one span, which is verified by how much of the template it covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialweave.session import freeze

#: Phrases that count wherever their words stand one after the other.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Openings of license notices, and short references to them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction"),
    ("mit", "released under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

GRAM = 3
#: Diagonals this far apart or less belong to one span: so many words more or less between two runs.
APART = 4
#: Words of a template that a span must cover: 80 %, or this many of a long one.
ENOUGH = 14

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text lower-cased A-Z."""
    return (text or b"").translate(_FOLD).split()


def _vocabulary(templates) -> dict[bytes, int]:
    words = sorted({w for _, t in (*templates, *PHRASES) for w in t.encode().split()})
    return {w: i for i, w in enumerate(words, 1)}


def _grams(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and numbers of the runs whose words are all known; the number tells the words."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(GRAM):
        number = number * base + ids[i : i + n]
        known &= ids[i : i + n] > 0
    at = np.flatnonzero(known)
    return at, number[at]


def _read(templates):
    vocabulary = _vocabulary(templates)
    base = len(vocabulary) + 1
    phrases = [(label, [vocabulary[w] for w in p.encode().split()]) for label, p in PHRASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ids = np.array([vocabulary.get(w, 0) for w in words], np.int64)
                starts, labels = [], []
                for label, phrase in phrases:
                    n = len(ids) - len(phrase) + 1
                    if n > 0:
                        met = np.logical_and.reduce([ids[i : i + n] == w for i, w in enumerate(phrase)])
                        if met.any():
                            starts.append(np.flatnonzero(met))
                            labels.append(label)
                places = np.concatenate(starts) if starts else None
                at, number = _grams(ids, base)
                rows.append(
                    (
                        len(words),
                        0 if places is None else len(places),
                        None if places is None else int(places.min()),
                        None if places is None else int(places.max()),
                        sorted(set(labels)),
                        at,
                        number,
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] + [pa.list_(pa.int64())] * 2
            names = ["n_words", "n_base", "first_word", "last_word", "base", "at", "gram"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]],
                ["doc_id", *names],
            )

    return run


def license_labels(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): counts and places of the phrases, labels, score.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans. labels adds to the phrases' labels those of the templates found;
    spans lists them with label, first and last word and coverage. score is the best
    coverage of a template, 1 where a phrase stands, 0 where nothing is found.

    Null and empty texts have no words and no labels. Rows that repeat a doc_id, or
    have none, are scanned one by one. Other columns are ignored, whatever their
    names; an empty table gives an empty result. The table of templates is fixed and
    small, and is the only thing broadcast.
    """
    spark = docs.sparkSession
    vocabulary = _vocabulary(templates)
    runs = []
    for t, (label, words) in enumerate(templates):
        ids = np.array([vocabulary[w] for w in words.encode().split()], np.int64)
        need = min(ENOUGH, -(-8 * len(ids) // 10))
        runs += [(int(g), t, label, len(ids), need, int(p)) for p, g in zip(*_grams(ids, len(vocabulary) + 1))]
    table = spark.createDataFrame(runs, "gram long, template int, label string, size int, need int, place long")

    read = freeze(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        .mapInArrow(
            _read(templates),
            "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
            "at array<long>, gram array<long>",
        )
        .withColumn("row", F.monotonically_increasing_id())
    )
    met = read.select("row", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("row", "x.at", "x.gram")
    votes = (
        met.join(F.broadcast(table), "gram")
        .groupBy("row", "template", "label", "size", "need", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.min("at").alias("start"), F.max("at").alias("end"))
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > APART).cast("int"), F.lit(1))
    merged = (
        votes.withColumn("opens", opens)
        .withColumn("span", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "template", "label", "size", "need", "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
            F.min("start").alias("start"),
            (F.max("end") + GRAM - 1).alias("end"),
        )
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + GRAM - 1))))
    )
    spans = (
        merged.withColumn("covered", covered)
        # in one place, not scattered: no longer than twice the template
        .where((F.col("covered") >= F.col("need")) & (F.col("end") - F.col("start") < 2 * F.col("size")))
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("start", "end", "label", (F.col("covered") / F.col("size")).alias("coverage")))
            ).alias("spans"),
            F.collect_set("label").alias("added"),
            F.max(F.col("covered") / F.col("size")).alias("best"),
        )
    )
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("added", none))))
    return read.drop("at", "gram").join(spans, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "spans",
    )
