"""Postings are made where their document was dealt: texts are exchanged, and no row for each posting."""

from collections import Counter

from pyspark.sql import functions as F

from fathom.functions.text import tokens_of
from fathom.operators import changes, index

TEXTS = ["b a b", "", "...", "芯片订单 x", "Straße ﬁnal a a a", "a " * 300]


def _chunks(spark, n):
    rows = [(f"c{i:03d}:{k}", i, 0, len(t), t, f"T{i}", "s") for i in range(n) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "chunk string, doc_id long, start int, end int, text string, title string, source string")


def test_postings_are_counts_of_tokens(spark):
    rows = _chunks(spark, 3)
    found = {(r.chunk, r.token): (r.tf, r.dl, r.doc_id) for r in index.postings(rows, ["chunk", "doc_id"], F.col("text")).collect()}
    want = {(r.chunk, t): (n, len(tokens_of(r.text)), r.doc_id) for r in rows.collect() for t, n in Counter(tokens_of(r.text)).items()}
    assert found == want


def test_a_documents_postings_are_written_in_one_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PER_PLACE", 10, raising=False)
    rows = _chunks(spark, 40)
    ix = index.write(spark, f"file://{tmp_path}/ix", rows.select("doc_id", "source", "title").distinct(), rows, buckets=2)
    files = ix.postings.select("doc_id", "bucket", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("doc_id", "bucket").count().agg(F.max("count")).first()[0] == 1
    assert 2 < files.select("file").distinct().count() <= 8  # four places, two buckets
    text = F.concat_ws(" ", "title", "text")
    assert ix.postings.count() == index.postings(rows, ["chunk"], text).count() and ix.corpus.first().n_chunks == rows.count()


def test_texts_of_a_batch_meet_what_is_held_once(spark):
    held = spark.createDataFrame([(1, "m", "c"), (2, "m", "c"), (3, "m", "c")], "k long, mark string, content string")
    batch = spark.createDataFrame([(1, "m", "c", "t1"), (2, "n", "c", "t2"), (3, "n", "d", "t3"), (4, None, None, "t4")], "k long, mark string, content string, body string")
    found = changes.actions(held, batch, "k", "mark", "content", ("body",))
    assert sorted(map(tuple, found.collect())) == [(1, "t1", "unchanged", False), (2, "t2", "updated", False), (3, "t3", "updated", True), (4, "t4", "created", True)]
