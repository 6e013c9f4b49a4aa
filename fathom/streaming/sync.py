"""File synchronisation as keyed state: settling, skipping, retrying with backoff, failing, missing."""

from __future__ import annotations

import datetime
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathom import hub as hubs
from fathom.functions.text import document_id, filename_date, utc_timestamp
from fathom.operators import changes, search
from fathom.sources import files, listings, versions

LONGEST = 3600.0
#: Bytes and files that a task reads in a round.
TASK_BYTES, TASK_FILES = 64 << 20, 1000
STATE = "root string, source string, path string, sha string, content string, state string, attempts int, next_retry timestamp, error string, document_ids array<string>, seen timestamp"


def backoff(attempts: Column, retry_seconds: float) -> Column:
    """Seconds until the next attempt: doubling from retry_seconds, up to an hour."""
    return F.least(F.lit(LONGEST), F.lit(float(retry_seconds)) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(12)).cast("double")))


def decide(observed: DataFrame, state: DataFrame, now: Column, settle_seconds: float = 0.0, retry_failed: bool = False) -> DataFrame:
    """What a cycle does with each listed file, from the listing (path, sha, modified) and the kept state
    (path, sha, state, attempts, next_retry): settling, skipped, waiting, or process; files that are
    kept but not listed are missing, and nothing of them is deleted. sha is whatever tells that a file has changed.
    Attempts are those already made on this content; a manual retry begins anew.
    """
    old = state.select("path", F.col("sha").alias("old_sha"), F.col("state").alias("old_state"), "attempts", "next_retry")
    rows = observed.select("path", "sha", "modified", F.lit(True).alias("listed")).join(old, "path", "full_outer")
    same = F.coalesce(F.col("sha") == F.col("old_sha"), F.lit(False))
    waits = F.lit(not retry_failed) & same & ((F.col("old_state") == "failed") | ((F.col("old_state") == "retrying") & (F.col("next_retry") > now)))
    action = (
        F.when(F.col("listed").isNull(), "missing").when(waits, "waiting").when(F.col("modified") > now - F.make_interval(secs=F.lit(settle_seconds)), "settling")
        .when(same & (F.col("old_state") == "ok"), "skipped").otherwise("process")
    )
    return rows.select("path", "sha", action.alias("action"), F.when(same & F.lit(not retry_failed), F.coalesce("attempts", F.lit(0))).otherwise(0).alias("attempts"))


def after(decided: DataFrame, outcomes: DataFrame, now: Column, retry_seconds: float, most_attempts: int) -> DataFrame:
    """(path, sha, state, attempts, next_retry) of processed files from their decisions and outcomes (path, ok)."""
    rows = decided.where("action = 'process'").join(outcomes.select("path", "ok"), "path")
    attempts = F.when(F.col("ok"), 0).otherwise(F.col("attempts") + 1)
    state = F.when(F.col("ok"), "ok").when(F.col("tried") >= most_attempts, "failed").otherwise("retrying")
    retry = F.when(~F.col("ok"), now + F.make_interval(secs=backoff(F.col("tried"), retry_seconds)))
    return rows.withColumn("tried", attempts).select("path", "sha", state.alias("state"), F.col("tried").alias("attempts"), retry.alias("next_retry"))


def last_states(observations: DataFrame, limit: int = 3) -> DataFrame:
    """(path, sha, state, attempts, skipped) after all observations (path, event_id, ts, sha, ok) in the order of ts and event_id.

    A file that is ok is skipped while its content stays; failures count as long as they are of one content.
    """
    w = Window.partitionBy("path").orderBy("ts", "event_id")
    rows = observations.withColumn("content", F.sum((~F.col("sha").eqNullSafe(F.lag("sha").over(w))).cast("long")).over(w))
    of = w.partitionBy("path", "content").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    # once a content has been taken in, later looks at it are skips whatever they find
    rows = rows.withColumn("done", F.coalesce(F.max("ok").over(of), F.lit(False)))
    last = rows.groupBy("path", "content").agg(F.first("sha").alias("sha"), F.max("ok").alias("ok"), F.count_if(~F.col("ok") & ~F.col("done")).alias("failures"), F.count_if("done").alias("skips"))
    found = last.groupBy("path").agg(F.max_by(F.struct("sha", "ok", "failures"), "content").alias("last"), F.sum("skips").alias("skipped"))
    attempts = F.when(F.col("last.ok"), 0).otherwise(F.col("last.failures")).cast("long")
    return found.select("path", "last.sha", F.when(F.col("last.ok"), "ok").when(attempts >= limit, "failed").otherwise("retrying").alias("state"), attempts.alias("attempts"), "skipped")


def _step(limit: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sha, name, attempts, skipped = state.get if state.exists else ("", "new", 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for seen, ok in zip(rows["sha"], rows["ok"], strict=True):
            if seen == sha and name == "ok":
                skipped += 1
                continue
            attempts = 0 if ok else 1 if seen != sha else attempts + 1
            sha, name = seen, "ok" if ok else "failed" if attempts >= limit else "retrying"
        attempts, skipped = int(attempts), int(skipped)
        state.update((sha, name, attempts, skipped))
        yield pd.DataFrame([(key[0], sha, name, attempts, skipped)], columns=["path", "sha", "state", "attempts", "skipped"])

    return run


def stream_state(observations: DataFrame, limit: int = 3) -> DataFrame:
    """last_states over a stream: one update row for each file and batch."""
    return observations.withColumn("path", F.col("path").cast("string")).groupBy("path").applyInPandasWithState(
        _step(limit), "path string, sha string, state string, attempts long, skipped long", "sha string, state string, attempts long, skipped long", "update", GroupStateTimeout.NoTimeout
    )


def state_of(hub: hubs.Hub, folder: str) -> DataFrame:
    found = versions.tables(hub.spark, folder)[1].get("files")
    return found if found is not None else hub.spark.createDataFrame([], STATE)


def file_page(state: DataFrame, name: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of tracked files in one state, or any, and how many there are."""
    rows = state.where(F.col("state") == name) if name else state
    return search.page(rows, ["source", "path"], limit, offset), rows.count()


def _documents(hub: hubs.Hub, parsed: DataFrame, source: str, prefix: str, bindings: dict[str, tuple[str, str]]) -> DataFrame:
    """Parsed records as documents of a source. What is known of a document's metadata stays, with the file's name, warnings and the date's origin."""
    bound = F.create_map(*(F.lit(x) for path, (external, name) in bindings.items() for x in (path, f"{external}\n{name}")))[F.col("path")] if bindings else F.lit(None).cast("string")
    name = F.coalesce(F.substring_index(bound, "\n", -1), F.element_at(F.split("path", "/"), -1))
    rows = parsed.withColumn("source", F.lit(source)).withColumn("file_name", name).withColumn("external_id", F.coalesce(F.substring_index(bound, "\n", 1), F.concat(F.lit(prefix), "path", F.lit("#"), F.col("record").cast("string"))))
    rows = rows.withColumn("doc_id", document_id(F.col("source"), F.col("external_id"))).withColumn("stated", utc_timestamp(F.col("published_at"))).withColumn("named", filename_date(F.col("file_name")).cast("timestamp"))
    prior = hub.table("documents").select("doc_id", F.col("metadata").alias("prior"))
    origin = F.when(F.col("stated").isNotNull(), "document").when(F.col("named").isNotNull(), "filename_date_utc_midnight").otherwise("unknown")
    own = F.create_map(F.lit("file_name"), F.left(F.col("file_name"), F.lit(1000)), F.lit("parser_warnings"), F.left(F.coalesce("warning", F.lit("")), F.lit(1000)), F.lit("date_source"), origin)
    none = F.create_map().cast("map<string,string>")
    metadata = F.map_concat(F.map_filter(F.coalesce("prior", none), lambda k, v: ~k.isin("file_name", "parser_warnings", "date_source")), own)
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("file_name"))
    return rows.join(prior, "doc_id", "left").select(
        "path", "error", "doc_id", "source", "external_id", title.alias("title"), "body", F.coalesce("stated", "named").alias("published_at"), F.coalesce("url", F.lit("")).alias("url"), metadata.alias("metadata"),
        F.array().cast("array<struct<page:int,start:int,end:int>>").alias("pages"),
    )


def cycle(
    hub: hubs.Hub, root: str, source: str, state_folder: str, now: datetime.datetime, *, name: str | None = None, prefix: str = "", bindings: dict[str, tuple[str, str]] | None = None,
    settle_seconds: float = 30.0, retry_seconds: float = 60.0, most_attempts: int = 5, retry_failed: bool = False, most_bytes: int = files.MOST_BYTES,
    encode: Callable | None = None, model: str = "", listed: DataFrame | None = None,
) -> dict:
    """One round over a folder: list (or take a listing that is given), decide, read and parse what has changed, upsert, and keep the state of each file.

    A file is taken whole or not at all, and not if it changes between its listing and the end of its reading. Files that are gone stay in the hub; a folder that can't be listed says nothing
    of its files; links that leave the folder are passed over. errors counts the files that failed by their codes. A document that another file of the source holds is not taken. At the end an encoder, if given, embeds what
    lacks a vector; if it fails the next round tries again.
    """
    spark, report = hub.spark, {"created": 0, "updated": 0, "unchanged": 0, "skipped": 0, "settling": 0, "waiting": 0, "missing": 0, "failed": 0, "errors": {}, "error": None, "semantic": "not_requested"}
    known = {r.source: r.enabled for r in hub.table("sources").where(F.col("source") == source).collect()}
    if not known:
        hub.upsert_sources(spark.createDataFrame([(source, name or source, "local", True)], hubs.SOURCES))
    elif not known[source]:
        return {**report, "error": "source_disabled"}
    base = root.rstrip("/").removeprefix("file://")
    found = (listings.listed(spark, [root]) if listed is None else listed).persist()
    if found.where(F.col("error") == listings.INCOMPLETE).limit(1).count():
        found.unpersist()
        return {**report, "error": listings.INCOMPLETE}
    listed = found.where(F.col("error").isNull() & files.supported(F.col("path")))
    number, everything = versions.latest(spark, state_folder)[0], state_of(hub, state_folder)
    mine = (F.col("root") == base) & (F.col("source") == source)
    state, when = everything.where(mine), F.lit(now).cast("timestamp")
    decided = decide(listed, state, when, settle_seconds, retry_failed).persist()
    report |= {r.action: r.n for r in changes.counts(decided).collect() if r.action != "process"}
    due = listed.join(decided.where("action = 'process'").select("path"), "path", "left_semi")
    todo = due.agg(F.count(F.lit(1)).alias("files"), F.sum(F.least("length", F.lit(most_bytes))).alias("bytes")).first()
    parts = [everything.where(~mine), state.join(decided.where("action in ('waiting', 'skipped')").select("path"), "path", "left_semi")]
    kept = state.select("path", "content", "document_ids")
    marked = lambda action, name, error: decided.where(F.col("action") == action).join(kept, "path", "left").select(F.lit(base).alias("root"), F.lit(source).alias("source"), "path", F.lit("" if action == "settling" else None).cast("string").alias("sha") if action == "settling" else "sha", "content", F.lit(name).alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("next_retry"), F.lit(error).alias("error"), F.coalesce("document_ids", F.array().cast("array<string>")).alias("document_ids"), when.alias("seen"))
    parts += [marked("settling", "settling", ""), marked("missing", "missing", "file_missing_retained")]
    if todo.files:
        tasks = max(1 + todo.bytes // TASK_BYTES, 1 + todo.files // TASK_FILES, min(todo.files, spark.sparkContext.defaultParallelism))
        read = listings.contents(due.repartition(tasks, "path"), most_bytes)
        read = read.select("path", F.sha2("content", 256).alias("content_now"), "content", "problem").join(kept.select("path", F.col("content").alias("content_old")), "path", "left").persist()
        same = read.where(F.col("content_now").eqNullSafe(F.col("content_old")) & F.lit(not retry_failed)).join(state.where("state = 'ok'").select("path"), "path", "left_semi").select("path")
        fresh = read.where("problem is null").join(same, "path", "left_anti")
        docs = _documents(hub, files.parsed(fresh), source, prefix, bindings or {}).persist()
        docs = docs.withColumn("error", F.coalesce(F.nullif(F.col("error"), F.lit("")), hubs.faults(docs)))
        owned = changes.owned_elsewhere(docs.select(F.lit(base).alias("root"), "path", F.col("doc_id").alias("document_id")), everything.where(F.col("source") == source).select("root", "path", "document_ids"))
        twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("path").alias("paths")).where("n > 1").select(F.explode("paths").alias("path"))
        single = docs.groupBy("path").count().where((F.col("count") > 1) & F.col("path").isin(*(bindings or {"": 0}))).select("path")
        good = changes.whole_files(docs)
        coded = lambda rows, code: rows.select("path", F.lit(code).alias("why"))
        why = docs.where("error <> ''").select("path", F.col("error").alias("why")).union(read.where("problem is not null").select("path", F.col("problem")))
        for bad, code in ((owned.select("path"), "document_of_another_file"), (twice, "document_given_twice"), (single, "several_records_bound")):
            good, why = good.join(bad, "path", "left_anti"), why.union(coded(bad, code))
        why = why.groupBy("path").agg(F.min("why").alias("why"))
        good = good.persist()
        report |= {k: report[k] + v for k, v in hub.ingest(good).items()}
        taken = good.groupBy("path").agg(F.collect_set("doc_id").alias("document_ids"))
        ids = changes.with_ids(kept.select("path", "document_ids"), taken, "path")
        outcomes = decided.where("action = 'process'").select("path").join(taken.select("path").union(same).withColumn("yes", F.lit(True)), "path", "left").select("path", F.coalesce("yes", F.lit(False)).alias("ok"))
        report["skipped"] += same.count()
        new = after(decided, outcomes, when, retry_seconds, most_attempts).join(read.select("path", F.col("content_now").alias("content")), "path", "left").join(ids, "path", "left").join(why, "path", "left")
        parts.append(new.select(F.lit(base).alias("root"), F.lit(source).alias("source"), "path", "sha", "content", "state", "attempts", "next_retry", F.when(F.col("state") == "ok", "").otherwise(F.coalesce("why", F.lit("file_failed"))).alias("error"), F.coalesce("document_ids", F.array().cast("array<string>")).alias("document_ids"), when.alias("seen")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    versions.publish(spark, state_folder, {"files": rows}, after=number)
    told = state_of(hub, state_folder).where(mine & F.col("state").isin("retrying", "failed") & (F.col("seen") == when))
    report["errors"] = {r.error: r["count"] for r in told.groupBy("error").count().collect()}
    report["failed"] = sum(report["errors"].values())
    for table in ([read, docs, good] if todo.files else []) + [found, decided]:
        table.unpersist()
    if encode is not None:
        try:
            hub.embed(encode, model)
            report["semantic"] = "ready"
        except Exception:  # noqa: BLE001 - an encoder's failure must not undo the round
            report["semantic"] = "retry_next_cycle"
    return report


@dataclass(frozen=True)
class Root:
    """A folder that a stream of rounds looks after, and whose documents are those of one source."""

    path: str
    source: str
    name: str | None = None
    prefix: str = ""
    bindings: dict[str, tuple[str, str]] = field(default_factory=dict)


def follow(hub: hubs.Hub, roots: list[Root], state_folder: str, checkpoint: str, *, interval_seconds: float | None = None, told: Callable[[int, dict], None] | None = None, **how) -> StreamingQuery:
    """Rounds over several folders as a streaming query: one round if no interval is given, else one each interval, until it is stopped.

    A batch is a listing of all roots; `cycle` takes each root's part with the options in `how`. What goes wrong with a root is its own: the others
    go on, and told(number, {source: report}) hears of it. A round that breaks off is run again from the checkpoint; what
    it has taken in by then is found unchanged.
    """
    if len({r.source for r in roots}) < len(roots):
        raise ValueError("a source has one root")

    def round_(batch: DataFrame, number: int) -> None:
        rows, reports = batch.persist(), {}
        for r in roots:
            now = datetime.datetime.now(datetime.timezone.utc)
            try:
                reports[r.source] = cycle(hub, r.path, r.source, state_folder, now, name=r.name, prefix=r.prefix, bindings=r.bindings, listed=rows.where(F.col("root") == r.path), **how)
            except Exception as error:  # noqa: BLE001 - another root's round must not suffer, and the next round lists all anew
                reports[r.source] = {"error": type(error).__name__}
        rows.unpersist()
        if told is not None:
            told(number, reports)

    writer = listings.rounds(hub.spark, [r.path for r in roots]).writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval_seconds is None else writer.trigger(processingTime=f"{interval_seconds} seconds")
    return writer.start()


def alive(finished: datetime.datetime | None, interval_seconds: float, now: datetime.datetime) -> bool:
    """Whether a loop has finished a round of late: within three intervals, three minutes at least."""
    return finished is not None and (now - finished).total_seconds() <= max(180.0, 3 * interval_seconds)


def watch(round_: Callable[[], dict], interval_seconds: float, stop: threading.Event, once: bool = False) -> dict | None:
    """Runs rounds until stopped. An error ends a single round, but not a loop."""
    last = None
    while not stop.is_set():
        try:
            last = round_()
        except Exception as error:  # noqa: BLE001 - the next round may do better
            if once:
                raise
            last = {"error": type(error).__name__}
        if once:
            break
        stop.wait(interval_seconds)
    return last
