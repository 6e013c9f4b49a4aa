"""Searches by levels find the first rows of an exhaustive search, and read part of the postings."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import index, levels, search
from fathom.plans import catalog

WORDS = [f"w{k}" for k in range(40)]


def _index(spark, n, seed=4):
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, 41)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 60), p=chance / chance.sum()).tolist())) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # ties beyond any limit
    docs = spark.createDataFrame([(i, f"s{i % 3}", "", None, {"lang": "en" if i % 2 else "de"}) for i, _ in rows], "doc_id long, source string, title string, published_at timestamp, metadata map<string,string>")
    texts = spark.createDataFrame([(f"c{i:06d}", i, 0, len(t), t) for i, t in rows], "chunk string, doc_id long, start int, end int, text string").withColumn("title", F.lit(""))
    return index.of(docs, texts)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    ix = _index(spark, 1500)
    ix = index.write(spark, f"file://{tmp_path_factory.mktemp('ix')}", ix.documents, ix.chunks.withColumn("title", F.lit("")).drop("part"), buckets=3)
    return ix, levels.build(spark, f"file://{tmp_path_factory.mktemp('lv')}", ix)


def _exhaustive(ix, tokens, limit, every, filters):
    hits = search.lexical(ix, ("and" if every else "or", *tokens), filters).withColumn("relevance", F.round("relevance", levels.PLACES))
    return [(r.chunk, r.doc_id, r.relevance) for r in hits.orderBy(F.col("relevance").desc(), "chunk").limit(limit).collect()]


@pytest.mark.parametrize("tokens, limit, every", [
    (["w0", "w1", "w2"], 10, False), (["w0", "w30", "w39"], 25, False), (["w0", "w1"], 5, True), (["w0", "w35", "w2"], 10, True), (["w7", "w7", "w1"], 10, False), (["w3"], 1, False),
    (["w0", "absent"], 10, False), (["w0", "absent"], 10, True), (["absent"], 10, False), (["w38", "w39"], 5000, False), (["w0", "w1"], 0, False),
])
@pytest.mark.parametrize("filters", [None, search.Filters(source_ids=("s1",), metadata={"lang": "en"})])
def test_same_rows_as_an_exhaustive_search(built, tokens, limit, every, filters):
    ix, lv = built
    found = levels.top(lv, tokens, limit, every, ix.documents, filters)
    got, want = [(r.chunk, r.doc_id, r.relevance) for r in found.hits.collect()], _exhaustive(ix, tokens, limit, every, filters)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-11)
    assert found.read.count() == found.read.select("token", "chunk").distinct().count()  # nothing is read twice


def test_no_chunks(spark, tmp_path):
    ix = _index(spark, 4)
    lv = levels.build(spark, f"file://{tmp_path}/lv", index.of(ix.documents.limit(0), ix.chunks.limit(0).withColumn("title", F.lit(""))))
    assert levels.top(lv, ["w0"], 5).hits.count() == 0


def test_common_words_read_under_half_of_their_postings_and_equal_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    ix, lv = catalog.indexed(spark, sf_dir), catalog.levelled(spark, sf_dir)
    tokens = list(catalog.COMMON_QUERY[1:])
    found = levels.top(lv, tokens, 10)
    assert found.read.count() < ix.of_tokens(ix.postings, tokens).count() / 2
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    for name in ("bounded_search", "bounded_search_filtered"):
        want = con.execute(catalog.oracle_sql()[name]).fetchall()
        assert [tuple(r) for r in catalog.queries()[name](spark, sf_dir).collect()] == want and want
