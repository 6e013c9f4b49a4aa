"""The hub as a whole: ingest, search, vectors, snapshots and the synchronisation of folders."""

import datetime
import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import hub as hubs
from fathom.operators import evaluation, index, search, windows
from fathom.plans import planner
from fathom.sources import connector, versions
from fathom.sources.policy import Policy
from fathom.streaming import sync

NOW = "2026-09-30 00:00:00"


def batch(spark, *docs):
    rows = [json.dumps({"source": "a", "title": "t", "url": "", "metadata": {}, "pages": [], **d}) for d in docs]
    return spark.createDataFrame([(x,) for x in rows], "v string").select(F.from_json("v", hubs.INPUT).alias("d")).select("d.*")


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    found = hubs.Hub(spark, f"file://{tmp_path_factory.mktemp('hub')}/h", "http://hub")
    found.upsert_sources(spark.createDataFrame([("a", "A", "local", True), ("b", "B", "local", True), ("off", "O", "local", False)], hubs.SOURCES))
    body = "芯片订单增长。完全相同的测试文本。"
    docs = [{"source": s, "external_id": "1", "title": "芯片订单", "body": body, "published_at": "2026-09-01T00:00:00Z", "metadata": {"company": s}} for s in ("a", "b", "off")]
    long = {"external_id": "long", "title": "long", "body": "abcd\n\n" + "word " * 600, "pages": [{"page": 1, "start": 0, "end": 4}, {"page": 2, "start": 6, "end": 3006}], "url": "https://x.example/"}
    assert found.ingest(batch(spark, *docs, long)) == {"created": 4, "updated": 0, "unchanged": 0}
    return found


def ids(rows):
    return [(r.source_id, r.score) for r in rows.collect()]


def test_search_under_policy_and_filters(spark, home):
    rows, totals = home.search("芯片订单", Policy(), NOW)
    assert [s for s, _ in ids(rows)] and {s for s, _ in ids(rows)} == {"a", "b"} and (totals.first().total, totals.first().matched_chunks) == (2, 2)
    rows, totals = home.search("芯片订单", Policy(1, {"a": 0.0, "b": 2.0}), NOW)
    assert [s for s, _ in ids(rows)] == ["b"] and (totals.first().total, totals.first().matched_chunks) == (1, 2)
    fresh = home.search("芯片订单", Policy(1, {}, 0.5, 29.0), NOW)[0].first()
    assert fresh.score_details.recency_multiplier == pytest.approx(1.25) and fresh.url == f"http://hub/api/documents/{fresh.id}" and fresh.snippet.startswith("芯片")
    for given, want in (({"metadata": {"company": "b"}}, {"b"}), ({"since": "2026-09-01"}, {"a", "b"}), ({"until": "2026-09-01"}, set()), ({"source_ids": ["a"]}, {"a"}), ({"source_ids": ["off"]}, set())):
        assert {s for s, _ in ids(home.search("芯片订单", filters=search.Filters.of(given))[0])} == want
    assert home.search("2026-08-12")[0].count() == 0 and home.search('"芯片" OR (')[0].count() == 2
    page = home.search("word")[0].first()
    assert page.citation.page == 2 and page.url == "https://x.example/"
    assert search.compact(home.search("word")[0]).columns == ["id", "title", "url"]
    assert search.eligible_sources(home.table("sources"), {"a": 0.0}) == ("b",)


def test_fetch_and_recheck(spark, home):
    hit = home.search("word")[0].first()
    assert home.fetch(hit.id).first().external_id == "long" and home.fetch("none").count() == 0
    off = home.table("documents").where("source = 'off'").first().doc_id
    assert home.fetch(off).count() == 0
    told = spark.createDataFrame([(hit.id, hit.citation.start, hit.citation.end, hit.snippet), (hit.id, 0, 3, "xyz"), (off, 0, 2, "芯片"), ("gone", 0, 1, "x")], "doc_id string, start int, end int, snippet string")
    assert {(r.doc_id, r.start, r.end) for r in home.stale(told).collect()} == {(hit.id, 0, 3), (off, 0, 2), ("gone", 0, 1)}


def test_updates_carry_over_what_is_as_before(spark, tmp_path):
    home = hubs.Hub(spark, f"file://{tmp_path}/h")
    home.upsert_sources(spark.createDataFrame([("a", "A", "local", True)], hubs.SOURCES))
    one, two = {"external_id": "1", "body": "alpha beta", "metadata": {"x": "1", "y": "2"}}, {"external_id": "2", "body": "gamma"}
    home.ingest(batch(spark, one, two))
    assert home.embed(lambda texts: [[float(len(t)), 1.0] for t in texts], "m") == 2 and home.embed(lambda texts: 1 / 0, "m") == 0
    assert home.ingest(batch(spark, {**one, "metadata": {"y": "2", "x": "1"}}, two)) == {"created": 0, "updated": 0, "unchanged": 2}
    assert home.ingest(batch(spark, {**one, "metadata": {"x": "3"}}, {**two, "body": "delta delta"})) == {"created": 0, "updated": 2, "unchanged": 0}
    assert home.table("vectors").count() == 1 and home.coverage("m").first().asDict() | {} == {**home.coverage("m").first().asDict(), "chunks": 2, "fresh": 1, "pending": 1, "documents": 2, "sources": 1, "documents_embedded": 1}
    assert {r.token: (r.n_with, r.total) for r in home.table("tokens").collect()} == {"t": (2, 2), "alpha": (1, 1), "beta": (1, 1), "delta": (1, 2)}
    assert home.search("gamma")[0].count() == 0 and home.search("delta")[0].count() == 1 and home.table("corpus").first().n_tokens == 6
    before = home.version()
    for bad in ({"external_id": "3", "body": " "}, {"external_id": "3", "body": "x", "url": "ftp://x"}, {"external_id": "3", "body": "x", "pages": [{"page": 1, "start": 0, "end": 9}]}, {"source": "no", "external_id": "3", "body": "x"}):
        with pytest.raises(ValueError, match="invalid documents"):
            home.ingest(batch(spark, {"external_id": "4", "body": "good"}, bad))
    with pytest.raises(ValueError):
        home.ingest(batch(spark, one, one))
    assert home.version() == before and home.table("documents").count() == 2
    found, _ = home.search("delta", query_vector=[5.0, 1.0], model="m", minimum=0.999)
    assert found.count() == 1 and found.first().score_details.relevance == pytest.approx(0.4)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, home.folder, {}, after=before - 1)
    home.delete(home.table("documents").where("external_id = '2'"))
    assert home.search("delta")[0].count() == 0 and home.table("tokens").where("token = 'delta'").count() == 0
    assert home.export(f"file://{tmp_path}/copy") == 1 and hubs.Hub(spark, f"file://{tmp_path}/copy").table("documents").count() == 1


def test_a_folder_is_synchronised(spark, tmp_path):
    home, root, states = hubs.Hub(spark, f"file://{tmp_path}/h"), tmp_path / "in+put", f"file://{tmp_path}/state"
    root.mkdir()
    at = datetime.datetime(2030, 1, 1)
    turn = lambda minutes, **more: sync.cycle(home, str(root), "s", states, at + datetime.timedelta(minutes=minutes), settle_seconds=60, retry_seconds=60, most_attempts=2, **more)
    put = lambda name, text: ((root / name).write_text(text, encoding="utf-8"), os.utime(root / name, (1.7e9, 1.7e9 + put.n)), setattr(put, "n", put.n + 1))
    put.n = 0
    put("a_2026-08-12.txt", "alpha"), put("b.json", json.dumps([{"title": "x", "body": "one"}, {"title": "y", "body": "two"}])), put("c.json", "{")
    first = turn(0)
    assert (first["created"], first["failed"], first["error"]) == (3, 1, None)
    dated = home.table("documents").where("title = 'a_2026-08-12'").first()
    assert dated.published_at == datetime.datetime(2026, 8, 12) and dated.metadata["date_source"] == "filename_date_utc_midnight"
    again = turn(0.5)
    assert (again["skipped"], again["waiting"], again["created"]) == (2, 1, 0)
    put("a_2026-08-12.txt", "alpha changed"), (root / "b.json").unlink()
    third = turn(2)
    assert (third["updated"], third["missing"], third["failed"]) == (1, 1, 1) and home.table("documents").count() == 3
    state = {r.path: (r.state, r.attempts) for r in sync.state_of(home, states).collect()}
    assert state == {"a_2026-08-12.txt": ("ok", 0), "b.json": ("missing", 0), "c.json": ("failed", 2)}
    put("c.json", json.dumps({"body": "mended"})), (root / "new.txt").write_text("n"), os.utime(root / "new.txt", (at.timestamp(), at.timestamp() + 86400))
    last = turn(3, encode=lambda texts: 1 / 0, model="m")
    assert (last["created"], last["settling"], last["semantic"]) == (1, 1, "retry_next_cycle")
    page, total = sync.file_page(sync.state_of(home, states), "ok", 1)
    assert total == 2 and page.count() == 1
    assert sync.cycle(home, str(tmp_path / "none"), "s", states, at)["error"] == "scan_incomplete" and sync.state_of(home, states).where("state = 'missing'").count() == 1
    assert sync.alive(at, 30, at + datetime.timedelta(seconds=170)) and not sync.alive(at, 30, at + datetime.timedelta(seconds=200)) and not sync.alive(None, 30, at)
    stop = threading.Event()
    assert sync.watch(lambda: stop.set() or {"n": 1}, 0.01, stop) == {"n": 1}
    with pytest.raises(ZeroDivisionError):
        sync.watch(lambda: 1 / 0, 0.01, threading.Event(), once=True)


def test_streamed_states_are_those_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(6)), i, datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=i), str(rng.integers(2)), bool(rng.random() < 0.4)) for i in range(200)]
    schema = "path long, event_id long, ts timestamp, sha string, ok boolean"
    for k in range(2):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = sync.stream_state(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    newest = spark.read.parquet(f"{tmp_path}/out").groupBy("path").agg(F.max_by(F.struct("sha", "state", "attempts", "skipped"), "n").alias("x")).select("path", "x.*")
    want = sync.last_states(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, want.withColumn("path", F.col("path").cast("string")).collect()))


def test_connector_and_pushed_batches(spark):
    spark.dataSource.register(connector.Documents)
    rows = spark.read.format("fathom_documents").option("adapter", "tests.test_hub:share").option("parts", "2").load()
    assert sorted(r.external_id for r in rows.collect()) == ["0", "1", "2", "3"]
    good = connector.pushed(spark, json.dumps({"source_id": "s", "documents": [{"external_id": "1", "title": "t", "body": "b", "published_at": "2026-09-01T00:00:00Z"}]}))
    assert good.first().source == "s" and good.first().published_at == datetime.datetime(2026, 9, 1)
    for bad in ({"documents": []}, {"source_id": "s", "documents": [{"external_id": "1", "color": "x"}]}):
        with pytest.raises(ValueError):
            connector.pushed(spark, json.dumps(bad))


def share(part, parts):
    return ({"source": "s", "external_id": str(i), "title": "t", "body": "b"} for i in range(part, 4, parts))


def test_long_texts_are_encoded_whole(spark):
    seen = []
    embed = lambda parts: (seen.extend(parts), np.array([[len(p), 1.0] for p in parts]))[1]
    found = windows.encode(["x " * 1000, "y"], str.split, embed, size=512, overlap=32)
    assert [len(p) for p in seen] == [512, 512, 40, 1] and np.linalg.norm(found, axis=1) == pytest.approx([1, 1])
    rows = windows.encoded(spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string"), "text", lambda t: t.split() or [""], lambda parts: np.ones((len(parts), 2)))
    assert [len(r.embedding) for r in rows.orderBy("id").collect()] == [2, 2]


def test_postings_in_buckets(spark, tmp_path):
    chunks = spark.createDataFrame([(f"{i}", i, "t", " ".join(f"w{k % 5}" for k in range(i + 1)), "s") for i in range(20)], "chunk string, doc_id long, title string, text string, source string")
    docs = chunks.select("doc_id", "title", "source")
    ix, plain = index.write(spark, f"file://{tmp_path}/ix", docs, chunks, buckets=4), index.of(docs, chunks)
    for query in ("w3", ("or", "w1", "w4"), ("and", "w1", "w2", "t"), ("or", ("and", "w0", "w4"), "w1")):
        told = lambda x: sorted((r.chunk, round(r.relevance, 9)) for r in search.lexical(x, query).collect())
        assert told(ix) == told(plain) and told(ix)
    assert sorted(r.text for r in ix.texts(spark.createDataFrame([("3",), ("7",)], "chunk string"), "text").collect()) == ["w0 w1 w2 w3", "w0 w1 w2 w3 w4 w0 w1 w2"]


def test_reports_and_aliases(spark, tmp_path):
    report = spark.createDataFrame([("a", "a", ["a", "b"], True), ("b", "c", ["c", "b"], False)], "expected string, first string, found array<string>, cited boolean")
    assert evaluation.acceptance(report).first() == (2, 1, 2, 1)
    assert evaluation.inputs_fingerprint(a=1, b={"x": 1, "y": 2}) == evaluation.inputs_fingerprint(b={"y": 2, "x": 1}, a=1) != evaluation.inputs_fingerprint(a=2)
    path = tmp_path / "aliases.json"
    path.write_text(json.dumps({"entities": [["Nova", "NV"]]}))
    assert planner.load_aliases(str(path)) == (("Nova", "NV"),)
    for bad in ([["one"]], [["a", "b"], ["B", "c"]], [["a", " "]]):
        path.write_text(json.dumps({"entities": bad}))
        with pytest.raises(ValueError):
            planner.load_aliases(str(path))
