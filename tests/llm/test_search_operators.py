"""Token alignment, exact top-k search and spelling variants against plain computations, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from dialweave.llm import alignment, spelling, topk
from dialweave.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, list string, n_a int, word string"


@pytest.fixture
def small_parts(monkeypatch):
    """Limits so low that small inputs cross them."""
    monkeypatch.setattr(alignment, "BLOCK", 500)
    monkeypatch.setattr(alignment, "LIST", 2_000)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    monkeypatch.setattr(spelling, "STRETCH", 12)
    monkeypatch.setattr(spelling, "ROWS", 30)
    monkeypatch.setattr(spelling, "COUNTED", 50)


# --- token alignment


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def spelled(text: str, a, b) -> tuple[list, list]:
    """(id, bytes) of both sides, from the libraries alone."""
    letters = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(letters.values()))}
    one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        two.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(t for _, t in one) != whole or b"".join(t for _, t in two) != whole:
        return [], []
    return one, two


def ranges(tokens: list) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def aligned_by_hand(rows: list[tuple]) -> list[tuple]:
    a, b = tokenizers()
    docs, count = [], Counter()
    for doc_id, text in rows:
        one, two = (ranges(s) for s in spelled(text, a, b)) if text else ([], [])
        links = [(i, j) for i, _, e in one for j, _, f in two if e == f]
        ends = sorted({e for *_, e in one} & {f for *_, f in two})
        said, start = [], 0
        for end in ends:
            said.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (one, two)))
            start = end
        count.update(links)
        docs.append((doc_id, len(one), len(two), len(ends), links, ";".join(said)))
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [
        (d, n_a, n_b, g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else "")
        for d, n_a, n_b, g, links, said in docs
    ]


TEXTS = [
    "It's a plain sentence, with numbers 12345 and  two spaces.",
    "naïve café — “quoted” 你好世界 \U0001f600 абв",
    "tabs\tand\nlines\r\n\n  trailing   ",
    " starts with a space",
    "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁ stands for a space there",
    "",
    None,
    "a" * 3000,
    "\x00\x01 control �",
    "It's a plain sentence, with numbers 12345 and  two spaces.",
]


def key(row) -> tuple:
    return tuple((x is None, x) for x in row)


def test_alignment_equals_brute_force(spark, small_parts):
    draw = random.Random(5)
    words = ["alignment", "of", "tokens", "über", "straße", "don't", "x=1;", "3.14", "WORD", "ñandú"]
    rows = list(enumerate(TEXTS)) + [(None, "no number"), (3, "a number twice")]
    rows += [(100 + i, " ".join(draw.choices(words, k=draw.randrange(1, 60)))) for i in range(40)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).repartition(3)
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    got = alignment.alignments(docs, *paths)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(aligned_by_hand(rows), key=key)
    assert alignment.alignments(docs.limit(0), *paths).collect() == []


def test_overlaps_are_all_pairs_that_share_bytes(spark, small_parts):
    a, b = tokenizers()
    rows = [(i, t) for i, t in enumerate(TEXTS) if t and len(t) < 100]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    got = alignment.token_overlaps(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    expected = []
    for doc_id, text in rows:
        one, two = map(ranges, spelled(text, a, b))
        for i, (x, s, e) in enumerate(one):
            for j, (y, t, f) in enumerate(two):
                if max(s, t) < min(e, f):
                    expected.append((doc_id, i, j, x, y, max(s, t), min(e, f) - 1, e == f))
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_both_libraries_make_the_same_byte_tokens():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        side = alignment.ByteTokens(file.read())
    assert side.fast is not None
    draw = random.Random(6)
    for _ in range(300):
        text = " " + "".join(draw.choice("ab cdE'st12.,\n\téß  !-") for _ in range(draw.randrange(1, 80)))
        assert side.ids(text, text.encode()) == side.full.encode(text, add_special_tokens=False).ids


# --- exact top-k search


def best_by_hand(rows: list[tuple], divisor: int, k: int) -> list[tuple]:
    whole = [
        (i, [int(np.floor(x * 256.0)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, q in whole:
        if i % divisor == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, small_parts):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(150)]
    # ties: a third of all rows are one vector, and another is its double
    rows += [(1000 + i, [0.5, 0.25, 0.0, -0.5, 0.125, 1.0]) for i in range(80)]
    rows += [(2000, [1.0, 0.5, 0.0, -1.0, 0.25, 2.0]), (2005, [0.0] * 6), (2010, []), (2015, [1.0]), (2020, [0.1] * 9)]
    rows += [(2025, None), (2030, [1.0, None, 0.0]), (2035, [float("nan")] * 6), (2040, [float("inf"), 0.0]), (None, [1.0] * 6)]
    schema = "vec_id long, embedding array<double>, rank string, score string, shard int"
    vectors = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], schema).repartition(4)
    got = topk.top_k(vectors, divisor=5, k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best_by_hand(rows, 5, 4)
    assert topk.top_k(vectors.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0], "", "", 0), (7, [2.0], "", "", 0)], schema)
    assert list(map(tuple, topk.top_k(few).collect())) == [(0, 1, 7, 256 * 512)]


def test_top_k_of_large_components_and_one_long_vector(spark):
    rows = [(0, [1e6, 2e6]), (1, [3e5, -1.0]), (2, [1e300, 1.0]), (3, [0.5, 0.5]), (50, [0.25] * 30_000), (4, [1.0] * 30_000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = lambda s: max(-topk._MOST, min(topk._MOST, s))
    expected = best_by_hand([r for r in rows if r[0] != 2], 50, 5)
    got = sorted(map(tuple, topk.top_k(vectors).where("vec_id <> 2").collect()))
    assert [(q, v, s) for q, _, v, s in got] == [(q, v, held(s)) for q, _, v, s in expected]
    top = topk.top_k(vectors).where("query_id = 0 AND rank = 1").first()
    assert (top["vec_id"], top["score"]) == (2, topk._MOST)


def test_repeated_queries_are_queries_of_their_own(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(vectors).collect()] == [(0, 1, 1, 65536)] * 2


def test_blocks_below_the_kth_score_are_left_out():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(8, 16)) * 500
    values = np.concatenate([c + draw.normal(size=(topk.BLOCK, 16)) * 20 for c in centres]).astype("<i2")
    shard = topk.Shard(np.arange(len(values)), values, False)
    met = []
    before = topk._merged
    topk._merged = lambda s, o, f, i, k: met.append(f.size) or before(s, o, f, i, k)
    try:
        score, other = topk.search(shard, np.array([0]), values[:1], False, 5, *topk._none(1, 5))
    finally:
        topk._merged = before
    assert sum(met) < len(values) / 2
    exact = values[1:].astype(int) @ values[0].astype(int)
    assert score[0].tolist() == sorted(exact.tolist(), reverse=True)[:5]


def test_top_k_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = con.execute(contract.oracle_sql()["op12_block_top_k"]).fetchall()
    assert sorted(map(tuple, contract.queries()["op12_block_top_k"](spark, SF).collect())) == sorted(expected)


# --- spelling variants


def words_by_hand(rows: list[tuple], least: int, noise: int, twice: int) -> dict[str, int]:
    count: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= twice}


def near_by_hand(words) -> dict[str, set[str]]:
    letters = sorted(set("".join(words)))
    out = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for c in letters for d in (0, 1) if i + d <= len(w)}
        out[w] = (edits & set(words)) - {w}
    return out


def variants_by_hand(rows: list[tuple], least: int, noise: int, twice: int = 2, times: int = 10) -> list[tuple]:
    words = words_by_hand(rows, least, noise, twice)
    near = near_by_hand(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= times * n:
            form[w] = best

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


@pytest.mark.parametrize("letters, least, noise", [("abc", 3, 3), ("abé×Z", 4, 5)])
def test_spelling_equals_brute_force(spark, small_parts, letters, least, noise):
    draw = random.Random(len(letters))
    known = ["".join(draw.choice(letters) for _ in range(draw.randrange(least - 1, 9))) for _ in range(120)]
    rows = [(i, draw.choice([" ", "-", "1", "\n"]).join(draw.choices(known[: 5 + i], k=60))) for i in range(60)]
    rows += [(None, known[0] + " " + known[1]), (7, None), (8, ""), (9, "!! 12"), (10, "A" * 40_000 + " " + "A" * 40_001), (10, "A" * 40_000 + " " + "A" * 40_001)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).repartition(3)
    got = spelling.spelling_variants(docs, least=least, noise=noise)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    long = lambda rows: [r for r in rows if len(r[0]) > 1000]
    # the two long words are one edit apart; brute force would try all their edits
    assert sorted(r[:1] for r in long(map(tuple, got.collect()))) == sorted((w,) for w in words_by_hand(rows, least, noise, 2) if len(w) > 1000)
    short = [(d, t) for d, t in rows if len(t or "") < 40_000]
    assert sorted(r for r in map(tuple, got.where(F.length("word") < 1000).collect())) == variants_by_hand(short, least, noise)
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


def test_forms_are_followed_to_the_last(spark):
    counts = {"chainlinked": 30_000, "chainlinke": 2_000, "chainlink": 150, "chainlin": 12, "otherword": 3}
    rows = [(i, " ".join([w] * (n // 2))) for i, (w, n) in enumerate(2 * list(counts.items()))]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=1 << 40).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"]) for r in got} == {
        "chainlinked": (None, "chainlinked", 30_000),
        "chainlinke": ("chainlinked", "chainlinked", 2_000),
        "chainlink": ("chainlinke", "chainlinked", 150),
        "chainlin": ("chainlink", "chainlinked", 12),
        "otherword": (None, "otherword", 2),
    }


def test_a_group_larger_than_a_stretch_is_compared_whole(spark, small_parts):
    """A third of all words share their first half and length."""
    draw = random.Random(2)
    words = {"samehalf" + "".join(draw.choice("abc") for _ in range(8)): draw.randrange(1, 9) for _ in range(150)}
    words |= {"".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 12))): 1 for _ in range(300)}
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    near = near_by_hand(words)
    assert sorted((r["word"], r["near"], r["near_n"]) for r in got) == sorted((w, x, words[x]) for w in words for x in near[w])


def test_words_asked_may_be_one_longer():
    listed = sorted({"stem" + "".join(p) for p in ("abcd", "abce", "wxyz", "wxzz", "qrst", "uvuv")})
    i, j = spelling.one_edit_apart(listed, np.zeros(len(listed), int), ["stemabcf", "stemwxyzz"], np.zeros(2, int), 4, 8)
    assert sorted((listed[a], int(b)) for a, b in zip(i, j)) == [("stemabcd", 0), ("stemabce", 0), ("stemwxyz", 1), ("stemwxzz", 1)]


def test_variants_query_on_the_smallest_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, contract.queries()["op13_spelling_variants"](spark, SF).collect()))
    assert got == variants_by_hand(rows, 7, 31)


def test_alignment_query_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = contract.queries()["op11_token_alignment"](spark, SF)
    assert got.count() == docs.count()
    assert got.agg(F.sum("n_links")).first()[0] == got.agg(F.sum("n_groups")).first()[0] > 0


def test_no_table_is_left_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("dialweave.llm.tables.shared_dir", lambda s: str(tmp_path))
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    topk.top_k(vectors).collect()
    assert [p for p in tmp_path.rglob("*.parquet")] == []


def test_batches_of_texts_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None]), pa.array(["a" * 10, None, "b"])], ["doc_id", "text"])
    assert [x for ids, texts in alignment._slices(iter([batch])) for x in zip(ids, texts)] == [(1, "a" * 10), (2, ""), (None, "b")]


# --- mixing


def test_repeated_rows_fill_their_target(spark):
    """A thousand equal rows share what a target leaves, word by word."""
    from dialweave.llm import mixing

    rows = [(1, "a b c", "s")] * 1000 + [(2, "a b c d e", "t")] * 1000 + [(i, "x y", "t") for i in range(10, 20)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in sums) == [1000, 1010]
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in sums)
    assert got.where("taken > 3 * size OR taken < 0").count() == 0
