"""The pipeline against its stages done plainly, and its registration."""

import plain
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import queries
from riskloom.llm.bpe import codec, default_path
from riskloom.llm.langid import LETTER

DATA = "/root/testdata/sf0.001"


def test_pipeline_against_plain(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs = [(d, t) for d, t in docs if t and LETTER.search(t)]
    near = plain.jaccard(docs)
    docs = [(d, t) for d, t in docs if near[d][1] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = plain.decontaminate(docs, items)
    docs = [(d, t) for d, t in docs if not hit[d][3]]
    assert set(got) == {d for d, _ in docs}
    c = codec(default_path())
    for d, t in docs:
        if not plain.secret_base(t):
            assert bytes(got[d].ids) == c.encode(t)


def test_stages_keep_columns_and_bite(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(900, "password = abcdef1234567 in the text of that and this", "en", "s", 50), (901, "12 34", "en", "s", 5), (902, None, "en", "s", 0), (903, "漢字仮名交文", "en", "s", 6), (904, "Ελληνικά είναι εδώ", "en", "s", 18)], docs.schema)
    docs = docs.unionAll(more)
    for c in ("score", "lang_pred", "spans", "redacted", "contaminated", "_row", "row", "component_id", "met", "n", "w"):  # names the operators use
        docs = docs.withColumn(c, F.lit(c))
    docs = docs.withColumn("odd name", F.lit(1))
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, DATA)
        assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.where("doc_id >= 900").collect()}
    assert set(rows) == {900} and "abcdef1234567" not in rows[900].text and rows[900].n_chars == len(rows[900].text)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_registration(spark):
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in queries.QUERIES)] == []
    assert "pipeline" in queries.QUERIES and set(queries.ORACLES) <= set(queries.QUERIES)
    out = queries.QUERIES["op9_url_filter"](spark, DATA)
    assert out.where(F.col("verdict").isNull()).count() == 0
