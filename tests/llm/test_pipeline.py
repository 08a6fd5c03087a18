"""The pipeline stage by stage next to plain versions, on the smallest tables and on awkward rows."""

import brute
import pytest
from test_corpus import SCHEMA, awkward

import corpus_pipeline
from loomgraph.functions.scale import cut_lineage
from loomgraph.llm import quality
from loomgraph.llm.common import table
from loomgraph.llm.queries import ORACLE, QUERIES, vocabulary_path

FOLDER = "/root/testdata/sf0.001"


def check_stages(spark, docs):
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    docs = cut_lineage(stages["quality_rules"](spark, docs, FOLDER))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns
    assert kept == {r.doc_id: rows[r.doc_id] for r in quality.verdicts(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect() if r.kept}

    docs = cut_lineage(stages["near_duplicates"](spark, docs, FOLDER))
    assert docs.columns == columns
    rows = {i: kept[i] for i, (_, c) in brute.near(kept.items(), 5).items() if c == i}
    assert {r.doc_id: r.text for r in docs.collect()} == rows

    docs = cut_lineage(stages["decontamination"](spark, docs, FOLDER))
    assert docs.columns == columns
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    leaked = {d for d, *_ in brute.overlaps([x for x in rows.items() if len(x[1]) < 4000], items)}
    left = {r.doc_id: r.text for r in docs.collect()}
    assert not leaked & left.keys() and left.keys() <= rows.keys()
    assert {d for d in rows.keys() - left.keys() if len(rows[d]) < 4000} == leaked

    docs = cut_lineage(stages["personal_data"](spark, docs, FOLDER))
    assert docs.columns == columns
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert clean.keys() == left.keys()
    for i, t in clean.items():
        assert brute.personal(t)[:4] == (0, 0, 0, 0)
        if brute.personal(left[i])[:4] == (0, 0, 0, 0):
            assert t == left[i]

    out = cut_lineage(stages["tokens"](spark, docs, FOLDER))
    tool = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary_path())
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in out.collect()}
    assert got == {i: (tool.encode(t, add_special_tokens=False).ids, brute.sha(t)) for i, t in clean.items()}
    return got


def test_stages_on_the_smallest_tables(spark):
    want = check_stages(spark, table(spark, FOLDER, "documents"))
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()} == want


def test_stages_on_awkward_rows(spark):
    rows = [(i, t, None, "s", 1, 3, None, "k", None, 7, 5, 1, "z") for i, t in awkward() if len(t or "") < 100_000]
    check_stages(spark, spark.createDataFrame(rows, SCHEMA))


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER))
    assert docs.count() == 0


# The others are compared with plain versions in test_corpus.
@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_html_text", "op5_personal_data", "op6_secrets", "op10_benchmark_overlaps"])
def test_query_equals_check_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(con.execute(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall())
