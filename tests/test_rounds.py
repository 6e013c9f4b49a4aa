import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from fathom import hub as hubs
from fathom.operators import evaluation
from fathom.sources import inbox, listings, versions
from fathom.streaming import retries, sync

LISTED = "root string, path string, sha string, modified timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, old)


def test_a_file_is_retried_by_its_timer_without_a_new_listing(rocks, tmp_path):
    spark, root = rocks, str(tmp_path / "root")
    os.mkdir(root)
    past, out = datetime.datetime(2026, 1, 1), f"{tmp_path}/out"
    (tmp_path / "root" / "good").write_text("x")

    def attempt(root, path):
        with open(f"{root}/{path}.tried", "a") as f:
            f.write("x")
        with open(f"{root}/{path}") as f:  # a file that is not there is a failure
            return f.read() == "x"

    spark.createDataFrame([(root, n, "1", past) for n in ("good", "bad", "late")], LISTED).coalesce(1).write.parquet(f"{tmp_path}/in/0")

    def start():
        told = retries.retrying(spark.readStream.schema(LISTED).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), attempt, 0, 1, 3)
        return told.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()

    def rows():
        return {(r.path, r.sha, r.state, r.attempts) for r in spark.read.schema("path string, sha string, state string, attempts int").parquet(out).collect()} if os.path.exists(out) else set()

    def until(done):
        end = time.time() + 90
        while not done(rows()):
            if query.exception() is not None or time.time() > end:
                query.stop()
                raise AssertionError(rows())
            time.sleep(0.3)

    query = start()
    until(lambda x: ("late", "1", "retrying", 1) in x)
    query.stop()
    (tmp_path / "root" / "late").write_text("x")  # mended while nobody runs; timers are in the checkpoint
    query = start()
    until(lambda x: ("bad", "1", "failed", 3) in x and ("late", "1", "ok", 0) in x)
    spark.createDataFrame([(root, n, "1", past) for n in ("good", "bad")], LISTED).coalesce(1).write.parquet(f"{tmp_path}/in/1")  # nothing new
    (tmp_path / "root" / "bad").write_text("x")
    spark.createDataFrame([(root, "bad", "2", past)], LISTED).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    until(lambda x: ("bad", "2", "ok", 0) in x)
    query.stop()
    assert (tmp_path / "root" / "good.tried").read_text() == "x"  # once

    # the same through decide and after, a listing for each look
    state, now, seen = spark.createDataFrame([], "path string, sha string, state string, attempts int, next_retry timestamp"), past, set()
    observed = spark.createDataFrame([("bad", "1", past)], "path string, sha string, modified timestamp")
    for _ in range(4):
        now += datetime.timedelta(seconds=10)
        decided = sync.decide(observed, state, F.lit(now))
        new = sync.after(decided, observed.select("path", F.lit(False).alias("ok")), F.lit(now), 1, 3).collect()
        state = spark.createDataFrame(new, state.schema) if new else state
        seen |= {(r.path, r.sha, r.state, r.attempts) for r in new}
    assert seen == {x for x in rows() if x[:2] == ("bad", "1")}


def test_listings_are_whole_and_keep_to_their_roots(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b b"
    (a / "x" / "y").mkdir(parents=True), b.mkdir()
    (a / "1.txt").write_text("1"), (a / "x" / "2.txt").write_text("22"), (a / "x" / "y" / "3 é.txt").write_text("3"), (b / "4.txt").write_text("4")
    os.symlink(b / "4.txt", a / "out.txt"), os.symlink(b, a / "folder"), os.symlink(a / "1.txt", a / "in.txt")
    rows = listings.listed(spark, [str(a), f"file://{b}", str(tmp_path / "none")]).collect()
    assert sorted((r.path or "", r.length, r.error) for r in rows) == [("", None, "scan_incomplete"), ("1.txt", 1, None), ("4.txt", 1, None), ("in.txt", 1, None), ("out.txt", 1, "outside_root"), ("x/2.txt", 2, None), ("x/y/3 é.txt", 1, None)]
    listed = spark.createDataFrame([r for r in rows if r.error is None], listings.SCHEMA)
    (a / "x" / "2.txt").write_text("33"), os.utime(a / "x" / "2.txt", (1, 1)), (b / "4.txt").unlink()
    told = {r.path: (bytes(r.content) if r.content is not None else None, r.problem) for r in listings.contents(listed, 1).collect()}
    assert told == {"1.txt": (b"1", None), "in.txt": (b"1", None), "x/2.txt": (None, "too_large"), "x/y/3 é.txt": (b"3", None), "4.txt": (None, "not_read_FileNotFoundError")}
    assert {r.problem for r in listings.contents(listed.where("path = 'x/2.txt'"), 9).collect()} == {"changed_while_reading"}


def test_a_stream_of_listings_drives_rounds_over_several_roots(spark, tmp_path):
    home, states = hubs.Hub(spark, f"file://{tmp_path}/h"), f"file://{tmp_path}/state"
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    put = lambda path, text: (path.write_text(text), os.utime(path, (put.n, put.n)), setattr(put, "n", put.n + 1))
    put.n = 1.7e9
    put(a / "1.txt", "alpha"), put(a / "bad.json", "{"), put(b / "2.json", json.dumps([{"body": "one"}, {"body": "two"}]))
    roots, reports = [sync.Root(str(a), "sa"), sync.Root(str(b), "sb", prefix="b:")], []

    def run():
        query = sync.follow(home, roots, states, f"{tmp_path}/cp", settle_seconds=0, retry_seconds=0.001, most_attempts=2, told=lambda n, found: reports.append(found))
        query.awaitTermination()
        return reports[-1]

    first = run()
    assert (first["sa"]["created"], first["sa"]["failed"], first["sb"]["created"], first["sb"]["error"]) == (1, 1, 2, None)
    assert first["sa"]["errors"] == {"not_parsed_JSONDecodeError": 1}
    put(a / "1.txt", "alpha changed"), b.rename(tmp_path / "offline")
    second = run()  # starts from the checkpoint
    assert (second["sa"]["updated"], second["sb"]["error"]) == (1, "scan_incomplete") and len(reports) == 2
    kept = {(r.source, r.path): (r.state, r.attempts, r.error) for r in sync.state_of(home, states).collect()}
    assert kept == {("sa", "1.txt"): ("ok", 0, ""), ("sa", "bad.json"): ("failed", 2, "not_parsed_JSONDecodeError"), ("sb", "2.json"): ("ok", 0, "")}
    assert home.table("documents").count() == 3 and home.search("changed")[0].count() == 1


def docs_of(spark, *rows):
    return spark.createDataFrame([("s", key, "t", body, None, "", {"k": "v"}, []) for key, body in rows], hubs.INPUT)


def test_a_batch_is_written_whole_or_not_at_all(spark, tmp_path):
    folder, home = f"{tmp_path}/in box", hubs.Hub(spark, f"file://{tmp_path}/h")
    home.upsert_sources(spark.createDataFrame([("s", "S", "api", True)], hubs.SOURCES))
    inbox.write(docs_of(spark, ("1", "alpha"), ("2", "beta")).repartition(2), folder)
    broken = docs_of(spark, ("3", "gamma"), ("4", "delta"), ("5", "x")).repartitionByRange(3, "external_id").withColumn("body", F.when(F.col("external_id") == "5", F.raise_error(F.lit("injected"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="injected"):
        inbox.write(broken, folder)
    assert inbox.batch(spark, folder, 2) is None and inbox.batch(spark, folder, 1).count() == 2
    files = lambda: sorted(p.name for p in (tmp_path / "in box").rglob("*.parquet"))
    inbox.write(docs_of(spark, ("1", "alpha"), ("6", " ")), folder), inbox.write(docs_of(spark, ("1", "alpha two"), ("2", "beta")).withColumn("more", F.lit(1)), folder), inbox.write(docs_of(spark).limit(0), folder)
    assert [(r["number"], r["created"], r["updated"], r["unchanged"], r["error"]) for r in inbox.drain(home, folder)] == [(1, 2, 0, 0, None), (2, 0, 0, 0, "invalid documents: body"), (3, 0, 1, 1, None), (4, 0, 0, 0, None)]
    assert inbox.drain(home, folder) == [] and {r.body for r in home.table("documents").collect()} == {"alpha two", "beta"}
    # a task that ran twice: both files lie there, the one that was committed counts
    rows, writer = docs_of(spark, ("9", "once")).toArrow().to_batches(), inbox._Writer(folder)
    before = files()
    first, again = writer.write(iter(rows)), writer.write(iter(rows))
    assert len(files()) == len(before) + 2 and first.name != again.name
    writer.commit([again])
    assert inbox.batch(spark, folder, 5).count() == 1 and inbox.drain(home, folder)[0]["created"] == 1
    other = inbox._Writer(folder)
    other.abort([other.write(iter(rows)), None])
    assert len(files()) == len(before) + 2
    with pytest.raises(Exception, match="appended"):
        docs_of(spark).write.format("fathom_batches").mode("overwrite").save(folder)


def test_an_evaluation_goes_on_where_it_broke_off(spark, tmp_path):
    cases = spark.createDataFrame([(f"c{i:02}", f"q{i}") for i in range(9)], "case string, query string")
    ledger, calls, whole = f"file://{tmp_path}/ledger", [], f"file://{tmp_path}/whole"

    def measure(rows, least=99):
        names = sorted(r.case for r in rows.collect())
        calls.append(names)
        if len(calls) == least:
            raise KeyboardInterrupt
        return rows.where("case <> 'c04'").select("case", F.length("query").alias("n"))  # a case may have no result

    with pytest.raises(KeyboardInterrupt):
        evaluation.evaluated(spark, ledger, cases, lambda rows: measure(rows, 2), {"model": "m"}, 3)
    assert versions.tables(spark, ledger)[1]["finished"].count() == 3 and len(calls) == 2
    for changed, inputs in ((cases, {"model": "n"}), (cases.withColumn("query", F.when(F.col("case") == "c08", "z").otherwise(F.col("query"))), {"model": "m"})):
        with pytest.raises(evaluation.Changed):
            evaluation.evaluated(spark, ledger, changed, measure, inputs, 3)
    assert len(calls) == 2
    found = evaluation.evaluated(spark, ledger, cases.orderBy(F.desc("case")), measure, {"model": "m"}, 4)
    assert calls[2:] == [["c03", "c04", "c05", "c06"], ["c07", "c08"]] and evaluation.sessions(spark, ledger) == 2
    assert sorted(found.collect()) == sorted(evaluation.evaluated(spark, whole, cases, measure, {"model": "m"}).collect()) and found.count() == 8
    calls.clear()
    assert evaluation.evaluated(spark, ledger, cases, measure, {"model": "m"}).count() == 8 and calls == []
    with pytest.raises(ValueError, match="different names"):
        evaluation.evaluated(spark, f"file://{tmp_path}/x", cases.union(cases), measure, {})
