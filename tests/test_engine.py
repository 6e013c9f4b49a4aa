import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fathom.functions import scoring, text
from fathom.operators import changes, index, search, stages
from fathom.plans import catalog, planner
from fathom.sources import files, policy
from fathom.streaming import sync

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, text.search_tokens(F.lit("Straße HBM4, 芯片订单"))) == ["strasse", "hbm4", "芯片", "片订", "订单", "芯", "片", "订", "单"]
    assert text.tokens_of("Straße 芯片") == ["strasse", "芯片", "芯", "片"]
    question = "What is the HBM demand for Micron in 2025?"
    assert text.lexical_query_tokens(question) == ["hbm", "demand", "micron", "2025"] == one(spark, text.query_tokens(F.lit(question)))
    assert text.lexical_query_tokens("芯") == ["芯"]


def test_small_functions(spark):
    assert one(spark, text.estimated_tokens(F.lit("abcd芯片"))) == 3 and one(spark, text.han_characters(F.lit("abcd芯片"))) == 2
    assert one(spark, text.filename_date(F.lit("Call_2026-08-12_English.pdf"))) == datetime.date(2026, 8, 12)
    assert one(spark, text.filename_date(F.lit("Report_20_Aug_2026.pdf"))) == datetime.date(2026, 8, 20)
    for bad in ("Report_2026-99-40.pdf", "2026-01-02 2026-01-03", "none"):
        assert one(spark, text.filename_date(F.lit(bad))) is None
    assert one(spark, text.metadata_lines(F.lit("company = a\nx=1=2\ncompany=b"))) == {"company": "b", "x": "1=2"}
    for bad in ("abc", "a=1\n=2"):
        with pytest.raises(Exception, match="key=value"):
            one(spark, text.metadata_lines(F.lit(bad)))
    assert [one(spark, text.valid_url(F.lit(u))) for u in ("https://a.example/x", "ftp://a", "http://u:p@h/", "http://a b")] == [True, False, False, False]
    assert one(spark, scoring.softplus(F.lit(0.0))) == pytest.approx(0.6931, abs=1e-4)


def test_chunks_follow_pages(spark):
    body = "abcd\n\n" + "x" * 3000
    docs = spark.createDataFrame([(1, body, [(1, 0, 4), (2, 6, 3006)]), (2, None, None), (3, "　", None)], "doc_id int, body string, pages array<struct<page:int,start:int,end:int>>")
    rows = index.chunks(docs, pages="pages", keep=["doc_id"]).orderBy("doc_id", "start").collect()
    assert [(r.start, r.end, r.page) for r in rows] == [(0, 4, 1), (6, 1406, 2), (1246, 2646, 2), (2486, 3006, 2)]
    assert all(r.text == body[r.start : r.end] for r in rows)


def test_fusion_order(spark):
    lists = spark.createDataFrame([("l", "a", 100.0), ("l", "b", 50.0), ("d", "c", 0.9), ("d", "b", 0.8), ("d", "b", 0.1)], "list_id string, item string, score double")
    assert [r.item for r in search.fuse(lists).orderBy(F.desc("score"), "item").collect()] == ["b", "a", "c"]
    assert {r.item: round(r.score, 4) for r in search.fuse(lists, "normalised").collect()} == {"a": 1.0, "b": round(0.5 + 0.8 / 0.9, 4), "c": 1.0}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (1, "b", 2)], "query int, item string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "z", 0)], "query int, item string, grade int")
    rows = search.metrics(ranked, qrels, 2).collect()
    assert [(r.query, r.recall, r.mrr) for r in rows] == [(1, 0.5, 0.5)]


def test_only_satisfied_branches_score_and_empty_matches_nothing(spark):
    chunks = spark.createDataFrame([(1, "a c", "t"), (2, "a b", "t"), (3, "d", "t"), (4, "d", "t"), (5, "d", "t")], "doc_id int, text string, title string")
    chunks = chunks.withColumn("chunk", F.col("doc_id").cast("string"))
    ix = index.of(chunks.select("doc_id", "title", F.lit("s").alias("source")), chunks)
    rows = {r.doc_id: r.relevance for r in search.lexical(ix, ("or", ("and", "a", "b"), "c")).collect()}
    only_c = {r.doc_id: r.relevance for r in search.lexical(ix, "c").collect()}
    assert set(rows) == {1, 2} and rows[1] == pytest.approx(only_c[1])
    assert {r.doc_id: r.relevance for r in search.lexical(ix, ("or", "c", "c")).collect()}[1] == pytest.approx(2 * only_c[1])
    assert {r.doc_id for r in search.lexical(ix, ("and", "a", "b")).collect()} == {2}
    assert search.lexical(ix, None).count() == 0 and search.lexical(ix, "c", search.Filters(eligible=())).count() == 0
    assert search.Filters.of({"source_ids": ["s"]}).source_ids == ("s",)
    with pytest.raises(ValueError, match="unknown filters: colour"):
        search.Filters.of({"colour": "red"})


def test_planner(spark):
    plan = planner.plan_query("What is the HBM demand for Micron in 2026-08-12?")
    assert plan.dates == ("2026-08-12",) and plan.entities == (("Micron",),) and plan.anchors == (planner.ANCHORS[0],)
    assert one(spark, plan.accepts_title(F.lit("Micron call 2026-08-12"))) and not one(spark, plan.accepts_title(F.lit("Other 2026-08-12")))
    assert planner.plan_query("2026-08-12").expression is None
    assert planner.plan_query("2026年8月12日 Micron").dates == ("2026-08-12",)
    assert planner.plan_query("the and of").expression is None and planner.plan_query("core free cash flow").expression == planner._spoken(planner.CONCEPTS[0])
    assert planner.plan_query("microns", (("micron", "MU"),)).entities == () and planner.plan_query("MU?", (("micron", "MU"),)).entities == (("micron", "MU"),)
    assert planner.rewrite("芯片 supply") == ["芯片 supply chip chips supply supplies"] and planner.rewrite("nothing here") == []


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", "a"), (2, "b", "b"), (3, "c", "c")], "id int, mark string, content string")
    new = spark.createDataFrame([(1, "a", "a"), (2, "B", "b"), (4, "d", "d")], "id int, mark string, content string")
    assert {r.id: (r.action, r.reindex) for r in changes.actions(old, new, "id", "mark", "content").collect()} == {1: ("unchanged", False), 2: ("updated", False), 4: ("created", True)}
    assert {r.id: r.state for r in changes.drift(old, new, "id", "mark").collect()} == {2: "changed", 3: "missing_right", 4: "missing_left"}
    assert {r.id for r in changes.upsert(old, new, "id").collect()} == {1, 2, 3, 4}
    old, new = spark.createDataFrame([(1, None, None)], "id int, mark string, content string"), spark.createDataFrame([(1, None, None, 1), (2, "x", "x", 1), (2, "y", "y", 2)], "id int, mark string, content string, place int")
    new = changes.last_of(new, "id", "place")
    assert {r.id: (r.action, r.reindex) for r in changes.actions(old, new, "id", "mark", "content").collect()} == {1: ("unchanged", False), 2: ("created", True)}
    assert {r.id: r.state for r in changes.drift(old, new, "id", "mark").collect()} == {2: "missing_left"} and new.where("id = 2").first().mark == "y"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Grüße\r\nx", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"title": "t", "body": "one"}, {"title": "u", "body": "two"}]))
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.eml").write_text("Subject: s\nFrom: f@example.com\nContent-Type: text/html\n\n<p>x</p><script>y</script>z")
    (tmp_path / "e.txt").write_bytes(b"\xff")
    (tmp_path / "f.eml").write_bytes(b"Subject: s\nContent-Type: text/plain; charset=no-such\n\nx\xff")
    (tmp_path / "g.json").write_text("[" * 100_000)
    (tmp_path / "h.jsonl").write_text(json.dumps({"title": "u", "body": "line\u2028sep"}, ensure_ascii=False) + "\n", encoding="utf-8")
    (tmp_path / "i.json").write_text(json.dumps({"title": 3, "body": "x"}))
    (tmp_path / "j.txt").write_text("x" * 5000)
    (tmp_path / "k.html").write_text("<style>a{}</style><p>a &amp; b<br>c<ul><li>d</ul>")
    rows = files.read_files(spark, str(tmp_path), most_bytes=150_000).collect()
    good = sorted((r.title, r.body) for r in rows if not r.error)
    assert good == [("a", "Grüße\nx"), ("j", "x" * 5000), ("k", "a & b\nc\nd"), ("s", "xz"), ("t", "one"), ("u", "line\u2028sep"), ("u", "two")]
    errors = {r.path.rpartition("/")[2]: r.error for r in rows if r.error}
    assert set(errors) == {"c.json", "e.txt", "f.eml", "g.json", "i.json"} and errors["e.txt"] == "not_utf8" and errors["i.json"] == "bad_record"
    small = files.read_files(spark, str(tmp_path), most_bytes=4000).collect()
    assert {r.path.rpartition("/")[2] for r in small if r.error == "too_large"} == {"j.txt", "g.json"}
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("x.PDF", "y")
    (tmp_path / "m.zip").write_bytes(b"no archive")
    (tmp_path / "n.txt.part").write_text("half")
    found = {r.path.rpartition("/")[2]: (r.state, r.pdf_members) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert len(found) == 14 and found["l.zip"] == ("ok", 1) and found["m.zip"] == ("corrupt", 0) and found["n.txt.part"] == ("partial", 0) and found["a.txt"] == ("ok", 0)
    assert files._look("a.txt", 5, b"1234")[0] == "changed_while_reading"


def test_sync(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    seen = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "9")], "path string, sha string").withColumn("modified", F.lit("2025-12-01").cast("timestamp"))
    kept = spark.createDataFrame([("a", "1", "ok", 0), ("b", "1", "ok", 0), ("d", "1", "ok", 0), ("e", "9", "failed", 3)], "path string, sha string, state string, attempts int").withColumn("next_retry", F.lit(None).cast("timestamp"))
    assert {r.path: r.action for r in sync.decide(seen, kept, now).collect()} == {"a": "skipped", "b": "process", "c": "process", "d": "missing", "e": "waiting"}
    assert sync.decide(seen, kept, now, retry_failed=True).where("path = 'e'").first().action == "process"
    assert one(spark, sync.backoff(F.lit(3), 60)) == 240 and one(spark, sync.backoff(F.lit(40), 60)) == 3600


def _retrieval(spark):
    chunks = spark.createDataFrame([("1:0", 1, "s", "alpha beta", "t"), ("1:1", 1, "s", "alpha", "t"), ("2:0", 2, "s", "beta beta", "t"), ("3:0", 3, "z", "gamma", "t")], "chunk string, doc_id int, source string, text string, title string")
    vectors = spark.createDataFrame([("1:0", [1.0, 0.0]), ("3:0", [0.6, 0.8]), ("2:0", [0.0, 0.0]), ("9:0", [1.0, 0.0])], "chunk string, embedding array<double>")
    return index.of(chunks.select("doc_id", "source", "title").distinct(), chunks), vectors


def test_stages(spark):
    chunks, vectors = _retrieval(spark)
    ids = lambda stage, **more: [r.doc_id for r in stages.staged(chunks, vectors, "alpha beta", stage, embed=lambda q: [1.0, 0.0], **more).collect()]
    assert ids("lexical") == [1, 2] and ids("dense") == [1, 3] and ids("rrf", limit=1) == [1]
    assert set(ids("hybrid")) == {1, 2, 3} and ids("dense", filters=search.Filters(source_ids=("z",))) == [3]
    assert ids("rerank", rerank=lambda q, t: [float("gamma" in x) for x in t])[0] == 3
    for bad in (lambda q, t: [1.0], lambda q, t: [float("nan")] * len(t), lambda q, t: 1 / 0):
        assert ids("rerank", rerank=bad) == ids("rrf")
    for odd in ([], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]):
        with pytest.raises(ValueError):
            stages.staged(chunks, vectors, "alpha", "dense", embed=lambda q, odd=odd: odd)
    assert ids("lexical", filters=search.Filters(eligible=())) == []
    for more in ({"stage": "other"}, {"stage": "rrf", "limit": 0}, {"stage": "rrf", "candidates": 2000}, {"stage": "dense", "embed": None}):
        with pytest.raises(ValueError):
            stages.staged(chunks, vectors, "a", **more)
    assert stages.phrasings("q", lambda q: ["v", "q", "w", "x"]) == ["q", "v", "w"] and stages.phrasings("q", lambda q: [" "]) == ["q"] == stages.phrasings("q", lambda q: 1 / 0)


def test_blend(spark):
    hits = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "chunk string, relevance double")
    near = spark.createDataFrame([("b", -0.5), ("c", 0.9), ("d", 0.1)], "chunk string, similarity double")
    assert {r.chunk: round(r.relevance, 6) for r in search.blend(hits, near, "chunk", 0.84).collect()} == {"a": 0.4, "b": 0.2, "c": 0.54}
    assert {r.chunk for r in search.blend(hits.where("false"), near, "chunk", 0.84).collect()} == {"c"}


def test_policy_is_compared_and_set(spark, tmp_path):
    folder, sources = str(tmp_path / "policy"), spark.createDataFrame([("s",)], "source string")
    assert policy.read(spark, folder) == policy.Policy()
    first = policy.update(spark, folder, 0, policy.Policy(weights={"s": 2.0}), sources)
    assert first.version == 1 and policy.read(spark, folder) == first
    with pytest.raises(policy.PolicyConflict):
        policy.update(spark, folder, 0, policy.Policy())
    with pytest.raises(ValueError, match="unknown sources: x"):
        policy.update(spark, folder, 1, policy.Policy(weights={"x": 1.0}), sources)
    with pytest.raises(ValueError):
        policy.Policy(weights={"s": -1.0})


def test_files_are_owned_and_taken_whole(spark):
    held = spark.createDataFrame([("r", "a", ["1", "2"])], "root string, path string, document_ids array<string>")
    claims = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "b", "3")], "root string, path string, document_id string")
    assert [(r.path, r.document_id) for r in changes.owned_elsewhere(claims, held).collect()] == [("b", "2")]
    records = spark.createDataFrame([("a", ""), ("a", "bad"), ("b", None)], "path string, error string")
    assert [r.path for r in changes.whole_files(records).collect()] == ["b"]


def test_vectors_dates_and_citations(spark):
    assert one(spark, scoring.unit(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    for bad in ([0.0], [float("nan")], [float("inf")], [None]):
        assert one(spark, scoring.unit(F.array(*(F.lit(x).cast("double") for x in bad)))) is None
    assert one(spark, scoring.unit(F.array().cast("array<double>"))) is None
    same = one(spark, scoring.parity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))))
    assert same.same_ids and not same.same_order
    noon = datetime.datetime(2026, 8, 12, 12)
    for stated in ("2026-08-12T12:00:00Z", "2026-08-12T14:00:00+02:00", "2026-08-12 12:00:00", "Wed, 12 Aug 2026 12:00:00 GMT", "12 Aug 2026 14:00 +0200 (CEST)"):
        assert one(spark, F.date_format(text.utc_timestamp(F.lit(stated)), "yyyy-MM-dd HH:mm:ss")) == str(noon)
    assert one(spark, text.utc_timestamp(F.lit("soon"))) is None
    assert one(spark, text.cited(F.lit("abcdef"), F.lit(2), F.lit(4), F.lit("cd")))


def test_queries_run_without_the_corpus_operators(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    plan = catalog.policy_search(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "In(token" in plan and "text" not in plan.split("ReadSchema", 1)[1]
