"""Token counts, importance resampling and vector codes next to their plain versions."""

import math
import random

import brute
import numpy as np
import pytest
from test_corpus import SCHEMA, awkward, by_doc, prose

from loomgraph.llm import bpe, resample, token_count, vector_codes
from loomgraph.llm.common import table
from loomgraph.llm.queries import ORACLE, QUERIES, vocabulary_path

FOLDER = "/root/testdata/sf0.001"
ODD = ["<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "don't DON'T we'll  \n\n x \t\r\n", "\x00\x1c\x85  　x", "é ü 漢字 🙂" * 50, "x" * 5000, "ab" * 4000 + " 1234567890" * 30,
       " ", "\n", "́e", "𝔘𝔫𝔦", "a b", "'s's'S", "…—“”", "٣٤ ²³ Ⅷ"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary_path())


def extended(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, 3, None, "k", None, 7, 5, 1, "z") for i, t in rows], SCHEMA).repartition(3)


def test_token_counts(spark, library):
    rows = [*awkward(), *[(900 + k, t) for k, t in enumerate(ODD)], (7, "again"), (7, "again"), (None, "no id")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.report(extended(spark, rows), vocabulary_path()).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def test_token_counts_of_random_strings(library):
    with open(vocabulary_path(), "rb") as f:
        counts = token_count.Counts(f.read())
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x180)] + ["<|endoftext|>", " ", "  ", "'re", " ", "漢", "🙂", "the", "ing"]
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 16)))
        assert counts.of(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_token_counts_when_words_are_forgotten(monkeypatch, spark, library):
    rows = [(k, prose(k, 40)) for k in range(12)]
    want = {i: (len(library.encode(t, add_special_tokens=False).ids),) for i, t in rows}
    assert by_doc(token_count.count(extended(spark, rows), vocabulary_path()), ["n_tokens"]) == want
    with open(vocabulary_path(), "rb") as f:
        counts = token_count.Counts(f.read())
    for i, t in rows:
        assert counts.of(t) == want[i][0]
        counts.clear()


TARGET = [prose(8, 80), prose(9, 50), None, "", "Mixed CASE 12 words, é 漢字!"]


def target(spark):
    return spark.createDataFrame([(k, t, k) for k, t in enumerate(TARGET)], "item_id int, text string, doc_id int")


def test_resampling(spark):
    rows = awkward()
    got = by_doc(resample.report(extended(spark, rows), target(spark)), ["n_features", "weight", "score", "rank"])
    assert got == brute.resampled(rows, TARGET)
    assert len({r for *_, r in got.values() if r}) > 2


def test_resampling_in_segments(spark, monkeypatch):
    text = ("A1-b2 é漢 " * 300 + "x" * 100 + "\x7f,.;" * 20).encode()
    whole = np.concatenate([b for _, b in resample.feature_buckets(text)])
    monkeypatch.setattr(resample, "SEGMENT", 37)
    parts = list(resample.feature_buckets(text))
    assert len(parts) > 20 and sorted(np.concatenate([b for _, b in parts])) == sorted(whole)


def test_resampling_with_repeated_and_missing_ids(spark):
    texts = [(k % 40, prose(k % 40, 30)) for k in range(80)] + [(None, prose(3, 30))] * 3 + [(100, "too short")]
    got = resample.report(spark.createDataFrame(texts, "doc_id bigint, text string"), target(spark)).collect()
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert len(got) == 84 and [r["rank"] for r in drawn] == list(range(1, 21))
    order = sorted((r for r in got if r.doc_id is not None and r.n_features > 20), key=lambda r: (-r.score, r.doc_id))
    assert [(r.score, r.doc_id) for r in drawn] == [(r.score, r.doc_id) for r in order[:20]]
    assert all(r.score is None and r["rank"] is None and r.n_features == 59 for r in got if r.doc_id is None)


def test_bracket_is_widened_until_it_holds_the_cutoff(spark, monkeypatch):
    monkeypatch.setattr(resample, "SKETCH_ERROR", 1e-4)
    scores = spark.range(1000).selectExpr("id as doc_id", "cast(id % 7 as bigint) as score").cache()
    held = sorted((r.score for r in scores.collect()), reverse=True)
    for k in (1, 143, 500, 999, 1000):
        low, high, above = resample.bracket(scores, 1000, k)
        assert low <= held[k - 1] <= high and above == sum(s > high for s in held) < k


def test_few_documents_draw_nothing(spark):
    docs = spark.createDataFrame([(1, prose(1, 30)), (2, prose(2, 30)), (3, None)], "doc_id bigint, text string")
    assert [r["rank"] for r in resample.report(docs, target(spark).limit(0)).collect()] == [None] * 3


def vectors(n, size, seed=3):
    rng = random.Random(seed)
    hot = [rng.uniform(-0.5, 0.5) for _ in range(size)]
    rows = [(k, hot if k % 3 == 0 else [rng.choice([rng.uniform(-0.6, 0.6), 0.25, -0.001]) for _ in range(size)], k % 4 if k % 5 else None) for k in range(n)]
    bad = [(500, None, 1), (501, [], 1), (502, [math.nan] + hot[1:], 1), (503, [math.inf] + hot[1:], None), (504, [None] + hot[1:], 2), (3, hot, 2), (3, hot, 2), (None, hot, None)]
    return rows + bad


VECTORS = "vec_id bigint, embedding array<double>, label int, vector string, error int, code string"


@pytest.mark.parametrize("n, size, entries", [(40, 8, 256), (300, 12, 16), (1, 4, 256)])
def test_vector_codes(spark, monkeypatch, n, size, entries):
    monkeypatch.setattr(vector_codes, "ENTRIES", entries)
    monkeypatch.setattr(vector_codes, "LEAVES", 7)
    rows = vectors(n, size)
    got = vector_codes.report(spark.createDataFrame([(*r, "v", 1, "c") for r in rows], VECTORS).repartition(4)).collect()
    want, books = brute.codes(rows, entries=entries)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(want, key=str)
    assert {r.codebooks_sha256 for r in got} == {brute.sha(",".join(str(x) for part in books for e in part for x in e))}


def test_vector_codes_of_large_components_and_odd_lengths(spark):
    rows = [(k, [30000.0 * ((k * j) % 5 - 2) for j in range(8)], 0) for k in range(20)]
    got = vector_codes.report(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(brute.codes([(i, v, x) for i, v, x in rows])[0])
    odd = [(1, [0.5, 0.25, 1.0, 2.0, 3.0], 0), (2, [0.5, 0.25, 1.0, 2.0, 3.0], 0), (3, [1.0], 0), (4, [1e9] * 5, 0)]
    rows, books = vector_codes.prepared(spark.createDataFrame(odd, "vec_id int, embedding array<double>, label int"))
    coded = vector_codes.encode(rows, vector_codes.train(rows, books))
    assert {r.vec_id: r.vector for r in vector_codes.decode(coded, books, 5).collect()} == {1: odd[0][1], 2: odd[1][1]}


def test_nearest_equals_plain_distances():
    rng = np.random.default_rng(0)
    for high in (3, 1000, 1 << 26):
        parts = np.unique(rng.integers(-high, high, (700, 5)), axis=0)
        book = rng.integers(-high, high, (33, 5))
        plain = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        entry, distance = vector_codes.nearest(parts, book)
        assert (entry == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_count.report(none, vocabulary_path()).count() == 0
    assert resample.report(none, target(spark)).count() == 0
    assert vector_codes.report(spark.createDataFrame([], VECTORS)).count() == 0


def test_counts_equal_the_encoder(spark):
    docs = table(spark, FOLDER, "documents")
    sizes = {r.doc_id: r.n_tokens for r in bpe.report(docs, vocabulary_path()).collect()}
    assert {r.doc_id: r.n_tokens for r in token_count.count(docs, vocabulary_path()).collect()} == sizes


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_vector_codes"])
def test_query_equals_check_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(con.execute(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall(), key=str)
