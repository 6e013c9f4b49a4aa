"""A hub of documents: sources, documents, chunks, postings and vectors as one versioned snapshot.

A change reads the newest version and publishes the next one whole: readers see either, and of two
writers one gets versions.Conflict. A change writes a layer of what it touches (sources/layers.py); nothing that
stays is written again, but by merges of layers of like size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, types
from pyspark.sql import functions as F

from fathom.functions import scoring
from fathom.functions.text import document_id, fingerprint, valid_url
from fathom.operators import changes, index, search, stages
from fathom.plans import planner
from fathom.sources import layers, versions
from fathom.sources.policy import Policy

SOURCES = "source string, name string, kind string, enabled boolean"
INPUT = "source string, external_id string, title string, body string, published_at timestamp, url string, metadata map<string,string>, pages array<struct<page:int,start:int,end:int>>"
DOCUMENTS = f"doc_id string, {INPUT}, fingerprint string, content string"
VECTORS = "chunk string, model_digest string, content_hash string, embedding array<double>"
# fixed values: kinds of sources, and the limits of one document
KINDS = ("local", "api", "sharepoint", "database", "demo")
LONGEST_BODY, MOST_METADATA, LONGEST_KEY, LONGEST_VALUE = 2_000_000, 40, 80, 1000


def _names(table: str) -> list[str]:
    """Columns of a table of SCHEMAS; commas inside types don't part columns."""
    return types._parse_datatype_string(SCHEMAS[table]).fieldNames()


def faults(batch: DataFrame) -> Column:
    """What is wrong with a document, or null."""
    pages, body = F.col("pages"), F.length("body")
    order = F.exists(F.sequence(F.lit(1), F.size(pages) - 1), lambda i: (F.get(pages, i)["page"] <= F.get(pages, i - 1)["page"]) | (F.get(pages, i)["start"] < F.get(pages, i - 1)["end"]))
    odd_pages = F.exists(pages, lambda p: (p["start"] < 0) | (p["end"] < p["start"]) | (p["end"] > body)) | ((F.size(pages) > 1) & order)
    odd_metadata = (F.size("metadata") > MOST_METADATA) | F.exists(F.map_entries("metadata"), lambda e: (F.length(e["key"]) > LONGEST_KEY) | (F.length(e["value"]) > LONGEST_VALUE))
    blank = lambda c: F.coalesce(~F.col(c).rlike("(?U)\\S"), F.lit(True))
    return (
        F.when(blank("external_id"), "external_id").when(blank("title"), "title").when(blank("body") | (body > LONGEST_BODY), "body")
        .when((F.coalesce("url", F.lit("")) != "") & ~valid_url(F.col("url")), "url").when(F.coalesce(odd_pages, F.lit(False)), "pages").when(F.coalesce(odd_metadata, F.lit(False)), "metadata")
    )


SCHEMAS = {
    "sources": SOURCES, "documents": DOCUMENTS, "chunks": "chunk string, doc_id string, start int, end int, page int, text string, content_hash string, part int", "postings": "chunk string, doc_id string, token string, tf int, dl int, bucket int",
    "tokens": "token string, n_with long, total long, bucket int", "vectors": f"{VECTORS}, doc_id string, error string",
}
#: Chunks of one unit of embedding, which is kept once it is done, and changed documents of a layer from which its buckets are written from several places.
UNIT, WIDE = 20_000, 10_000


class Stale(ValueError):
    """What a search found is not what the documents hold now."""


class Incomplete(RuntimeError):
    """An encoder has failed on some texts; the vectors of all others are kept."""

    def __init__(self, done: int, failed: int):
        super().__init__(f"{failed} texts could not be encoded, {done} were")
        self.done, self.failed = done, failed


class View:
    """A version of a hub, pinned: searches of one view agree with each other whatever is published meanwhile."""

    def __init__(self, snapshot: layers.Snapshot):
        self.snapshot, self.number = snapshot, snapshot.number
        self.buckets = snapshot.facts.get("buckets", 1)

    def table(self, name: str) -> DataFrame:
        if name == "sources":
            return self.snapshot.whole(name)
        if name == "corpus":
            facts = self.snapshot.facts
            return self.snapshot.spark.createDataFrame([(facts.get("n_chunks", 0), facts.get("n_tokens", 0))], "n_chunks long, n_tokens long")
        if name == "tokens":
            return self.snapshot.tokens()
        rows = self.snapshot.table(name)
        return rows.where("error is null").drop("doc_id", "error") if name == "vectors" else rows

    def index(self) -> index.Index:
        """The index; documents know whether their source is enabled, and search sees those of enabled ones."""
        enabled = self.table("sources").where("enabled").select("source")
        documents = self.table("documents").drop("body").join(enabled, "source")
        return index.Index(documents, *(self.table(n) for n in ("chunks", "postings", "tokens", "corpus")), buckets=self.buckets)


class Hub:
    def __init__(self, spark: SparkSession, folder: str, base_url: str = "", buckets: int = 1, fan: int = layers.FAN):
        """buckets are those of a hub that is new; what a hub was begun with stands in its manifest. Layers of one size class are merged once there are `fan`."""
        self.spark, self.folder, self.base_url, self.fan, self._begun = spark, folder.rstrip("/"), base_url, fan, buckets

    def version(self) -> int:
        return versions.latest(self.spark, self.folder)[0]

    def pin(self) -> View:
        return View(layers.pin(self.spark, self.folder, SCHEMAS))

    @property
    def buckets(self) -> int:
        return self.pin().snapshot.facts.get("buckets", self._begun)

    def table(self, name: str) -> DataFrame:
        return self.pin().table(name)

    def index(self) -> index.Index:
        return self.pin().index()

    def sources(self) -> DataFrame:
        """Sources and how many documents each has, none included."""
        view = self.pin()
        have = view.table("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        return view.table("sources").join(have, "source", "left").withColumn("documents", F.coalesce("n", F.lit(0))).drop("n")

    def upsert_sources(self, rows: DataFrame) -> int:
        rows, view = rows.select("source", "name", "kind", "enabled"), self.pin()
        if not rows.where(~F.col("kind").isin(*KINDS) | ~F.col("source").rlike("^[A-Za-z0-9][A-Za-z0-9_.-]{0,79}$")).isEmpty():
            raise ValueError("a source has an unknown kind or a bad name")
        path = f"{self.folder}/data-{uuid.uuid4().hex}/sources"
        changes.upsert(view.table("sources"), rows, "source").write.parquet(path)
        facts = {"buckets": view.snapshot.facts.get("buckets", self._begun)}
        return layers.publish(view.snapshot, tables={"sources": path}, facts=facts).number

    def _cut(self, documents: DataFrame, buckets: int, size: int) -> dict[str, DataFrame]:
        """Chunks and postings, in blocks, of documents, about `size` of them."""
        rows = index.chunks(documents.select("doc_id", "title", "body", "pages"), pages="pages").withColumn("chunk", F.concat_ws(":", "doc_id", F.lpad(F.col("start").cast("string"), 9, "0")))
        found = index.tables(documents, rows, buckets, index.places_for(size) if size >= WIDE else None)
        chunks = found["chunks"].withColumn("content_hash", F.sha2("text", 256))
        return {"chunks": chunks.select(*_names("chunks")), "postings": found["postings"]}

    @staticmethod
    def _arranged(wide: bool, places: int | None = None):
        """How tables are laid out for writing: of a wide layer each task writes what it has. With places, what is read from other layers is dealt out to them by document first."""

        def lay(name: str, rows: DataFrame) -> DataFrame:
            if name not in index.PARTITIONED:
                return rows if wide else rows.coalesce(1)  # a small batch is one file
            column, key = index.PARTITIONED[name][0], "chunk" if name == "chunks" else "token"
            if wide and name != "tokens":
                return index.laid(rows.repartition(places, "doc_id") if places else rows, column, key)
            return index.laid(rows.repartition(column), column, key)

        return lay

    def _change(self, view: View, fresh: DataFrame | None, cut: DataFrame | None, ended: DataFrame | None, size: int) -> int:
        """The next version: a layer of fresh documents, of what the cut ones among them are cut into, and of tombstones of ended (doc_id, whole).

        Token statistics change by what comes less what goes: postings of ended documents are cut once more from what they
        held, so no posting is read. Writes what the batch holds and no more, then merges layers that are due.
        """
        snapshot, buckets = view.snapshot, view.snapshot.facts.get("buckets", self._begun)
        lay, n_chunks, deltas = self._arranged(size >= WIDE), 0, []
        counted = lambda rows, n, total, sign: rows.groupBy("token", "bucket").agg((sign * F.sum(n)).alias("n_with"), (sign * F.sum(total)).alias("total"))
        tables = {} if fresh is None else {"documents": lay("documents", fresh)}
        if cut is not None:
            tables |= {n: lay(n, rows) for n, rows in self._cut(cut, buckets, size).items()}
        if ended is not None:
            tables["gone"] = lay("gone", ended.select("doc_id", "whole"))
        layer = layers.write(snapshot, tables, index.PARTITIONED, size)
        written = layers.Snapshot(self.spark, self.folder, SCHEMAS, snapshot.number, {"layers": [layer]})
        if cut is not None:
            n_chunks, deltas = written.rows("chunks").count(), [counted(written.rows("postings"), F.lit(1), F.col("tf"), 1)]
        if ended is not None:
            old = self._cut(view.table("documents").join(written.rows("gone").where("whole").select("doc_id"), "doc_id", "left_semi"), buckets, 0)
            n_chunks, deltas = n_chunks - old["chunks"].count(), [*deltas, counted(old["postings"], F.size("chunk"), F.col("total"), -1)]
        n_tokens = 0
        if deltas:
            tokens = reduce(DataFrame.unionByName, deltas).groupBy("token", "bucket").agg(F.sum("n_with").alias("n_with"), F.sum("total").alias("total")).select("token", "n_with", "total", "bucket")
            layers.write(snapshot, {"tokens": lay("tokens", tokens)}, index.PARTITIONED, size, layer["path"])
            layer["tables"] = sorted([*layer["tables"], "tokens"])
            n_tokens = written.rows("tokens", [layer]).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first().n
        facts = {"buckets": buckets, "n_chunks": snapshot.facts.get("n_chunks", 0) + n_chunks, "n_tokens": snapshot.facts.get("n_tokens", 0) + n_tokens}
        return self._merge_due(layers.publish(snapshot, [*snapshot.layers, layer], facts=facts))

    def _merge_due(self, snapshot: layers.Snapshot) -> int:
        """Merges while a size class is full; if another writer publishes meanwhile, its version stands and the merge is left to the next change."""
        while places := layers.due(snapshot.layers, self.fan):
            try:
                snapshot = self._merged(snapshot, places)
            except versions.Conflict:
                break
        return snapshot.number

    def _merged(self, snapshot: layers.Snapshot, places: list[int]) -> layers.Snapshot:
        size = sum(snapshot.layers[i]["size"] for i in places)
        return layers.publish(snapshot, layers.merged(snapshot, places, index.PARTITIONED, self._arranged(size >= WIDE, index.places_for(size))))

    def compact(self) -> int:
        """Writes all live rows as one layer, without tombstones."""
        snapshot = self.pin().snapshot
        return self._merged(snapshot, list(range(len(snapshot.layers)))).number if len(snapshot.layers) > 1 else snapshot.number

    def clean(self, keep: int = 1) -> int:
        """Removes versions but the newest `keep` and the data that none of them names."""
        return versions.clean(self.spark, self.folder, keep)

    def prepared(self, batch: DataFrame) -> DataFrame:
        """Documents of a batch with their ids, fingerprints of all they state, and of what is indexed."""
        names = [x.split()[0] for x in INPUT.split(", ")]
        rows = batch.select(*names).withColumn("doc_id", document_id(F.col("source"), F.col("external_id")))
        rows = rows.withColumn("fingerprint", fingerprint(rows, *names)).withColumn("content", fingerprint(rows, "title", "body", "pages"))
        return rows.select(*[x.split()[0] for x in DOCUMENTS.replace(INPUT, ", ".join(names)).split(", ")])

    def ingest(self, batch: DataFrame) -> dict[str, int]:
        """Upserts documents (INPUT) and returns how many were created, updated and unchanged: all of a batch or, with ValueError, none.

        A document whose title, body and pages are as before keeps its chunks, postings and vectors.
        """
        view, rows = self.pin(), self.prepared(batch)
        # texts meet what is held once, and not at all in a hub that is empty
        held = view.table("documents") if view.snapshot.layers else rows.limit(0)
        rows = changes.actions(held, rows, "doc_id", "fingerprint", "content", tuple(_names("documents")[1:])).persist()
        try:
            return self._ingest(view, rows)
        finally:
            rows.unpersist()

    def _ingest(self, view: View, rows: DataFrame) -> dict[str, int]:
        known = view.table("sources").select("source")
        bad = rows.join(known, "source", "left_anti").select(F.lit("source").alias("fault")).union(rows.select(faults(rows).alias("fault")).where("fault is not null"))
        bad = bad.union(rows.groupBy("doc_id").count().where("count > 1").select(F.lit("external_id").alias("fault")))
        if found := [r.fault for r in bad.distinct().collect()]:  # a few codes
            raise ValueError(f"invalid documents: {', '.join(sorted(found))}")
        told = {r.action: r.n for r in changes.counts(rows).collect()}
        if told.keys() - {"unchanged"}:
            fresh = rows.where("action <> 'unchanged'").select(*_names("documents"))
            cut = rows.where("reindex").select(*_names("documents"))
            ended = rows.where("action = 'updated'").select("doc_id", F.col("reindex").alias("whole"))
            kept = rows.where("reindex").isEmpty()
            self._change(view, fresh, None if kept else cut, ended if "updated" in told else None, told.get("created", 0) + told.get("updated", 0))
        return {name: told.get(name, 0) for name in ("created", "updated", "unchanged")}

    def delete(self, ids: DataFrame) -> int:
        """Documents go with their chunks, postings and vectors; ids that no document has don't matter."""
        view = self.pin()
        ended = view.table("documents").join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(True).alias("whole")).persist()
        n = ended.count()
        number = self._change(view, None, None, ended, n) if n else view.number
        ended.unpersist()
        return number

    def fetch(self, doc_id: str) -> DataFrame:
        """The document of an id with its address, if its source is enabled."""
        view = self.pin()
        enabled = view.table("sources").where("enabled").select("source")
        rows = view.table("documents").where(F.col("doc_id") == doc_id).join(enabled, "source")
        return rows.withColumn("url", self._url()).drop("fingerprint", "content")

    def _url(self) -> Column:
        return F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit(f"{self.base_url}/api/documents/"), F.col("doc_id")))

    @staticmethod
    def _unchanged(ix: index.Index, newer: View) -> DataFrame:
        """(doc_id) of documents that a newer version holds with the same text, in an enabled source: offsets depend on nothing else."""
        return ix.documents.select("doc_id", "content").join(newer.index().documents.select("doc_id", "content"), ["doc_id", "content"], "left_semi").select("doc_id")

    def answered(self, candidates: DataFrame, policy: Policy = Policy(), now: str = "1970-01-01 00:00:00", filters: search.Filters = search.Filters(), limit: int = 10):
        """(results, totals) of candidates (chunk, doc_id, text, score) that another index has found, as search gives them.

        Each is compared with what the hub holds: a passage that is gone, of another document or with another text is Stale. Documents of
        disabled sources and such that filters leave out take no place.
        """
        view = self.pin()
        held = view.table("chunks").select("chunk", F.col("doc_id").alias("owner"), F.col("text").alias("held"))
        rows = candidates.join(held, "chunk", "left")
        if n := rows.where(~F.coalesce((F.col("owner") == F.col("doc_id")) & (F.col("held") == F.col("text")), F.lit(False))).count():
            raise Stale(f"{n} passages are not what the documents hold")
        ix = view.index()
        hits = candidates.select("chunk", "doc_id", F.col("score").alias("relevance")).join(ix.documents.where(filters.condition()).select("doc_id"), "doc_id", "left_semi")
        return search.results(ix, hits, policy, now, limit, self._url())

    def search(self, query: str, policy: Policy = Policy(), now: str = "1970-01-01 00:00:00", filters: search.Filters = search.Filters(), limit: int = 10, aliases=(), query_vector: Sequence[float] | None = None, model: str | None = None, minimum: float = 0.84, view: View | None = None):
        """(results, totals): a row for each document with citation and score_details, and one row of total and matched_chunks.

        Matched chunks are counted before sources of weight 0 go, documents after. With a vector of the query, similarity
        to vectors of the model is blended in. All tables are those of one version: `view`, or the newest. If a newer one than
        view is there, hits whose document is gone, disabled or holds another text now take no place.
        """
        given, view = view, view or self.pin()
        ix, plan = view.index(), planner.plan_query(query, aliases)
        hits = search.lexical(ix, plan.expression, filters)
        if plan.entities or plan.dates:
            hits = hits.where(plan.accepts_title(F.col("title")))
        hits = hits.select("chunk", "doc_id", "relevance")
        if query_vector is not None and plan.expression is not None:
            hits = self._blended(view, ix, hits, plan, filters, query_vector, model, minimum)
        if given is not None and (now_there := self.pin()).number > given.number:
            hits = hits.join(self._unchanged(ix, now_there), "doc_id", "left_semi")
        return search.results(ix, hits, policy, now, limit, self._url())

    def _blended(self, view, ix, hits, plan, filters, query_vector, model, minimum) -> DataFrame:
        target = F.array(*map(F.lit, stages.unit_or_error(query_vector)))
        eligible = (ix.chunks if plan.anchors else ix.chunks.select("chunk", "doc_id")).join(ix.documents.where(filters.condition()).select("doc_id", "title"), "doc_id")
        rows = view.table("vectors").where(F.col("model_digest") == model).join(eligible, "chunk").withColumn("similarity", scoring.cosine(F.col("embedding"), target))
        fits = plan.accepts_title(F.col("title"))
        if plan.anchors:
            fits &= plan.accepts_passage(F.col("title"), F.col("text"))
        near = rows.join(hits.select("chunk", F.lit(True).alias("worded")), "chunk", "left").where(F.col("worded") | fits).select("chunk", "doc_id", "similarity")
        owners = hits.select("chunk", "doc_id").union(near.select("chunk", "doc_id")).distinct()
        return search.blend(hits, near, "chunk", minimum).join(owners, "chunk").select("chunk", "doc_id", "relevance")

    def stale(self, candidates: DataFrame) -> DataFrame:
        """Candidates (doc_id, start, end, snippet) that the documents don't bear out: gone, disabled, or with another text there."""
        rows = candidates.join(self.table("documents").select("doc_id", "source", "body"), "doc_id", "left").join(self.table("sources").select("source", "enabled"), "source", "left")
        good = F.col("enabled") & F.col("body").substr(F.col("start") + 1, F.col("end") - F.col("start")).eqNullSafe(F.col("snippet"))
        return rows.where(~F.coalesce(good, F.lit(False))).select("doc_id", "start", "end")

    def embed(self, encode: Callable[[list[str]], Sequence[Sequence[float]]], model: str, batch: int = 8, unit: int = UNIT) -> int:
        """Gives each chunk a vector of its present text by an injected encoder, a few texts at a time; returns how many were missing.

        Chunks are cut by hash into units of about `unit`, laid out once; each unit that is done is a version of its own, so what
        is encoded when a run breaks off is kept, and a rerun encodes the rest. When the encoder fails on several texts they are tried one
        by one; what fails alone is left out, and Incomplete is raised at the end. A document that changes meanwhile
        ends its vectors, as they bear the number of the version they were made from.
        """
        view = self.pin()
        have = view.table("vectors").where(F.col("model_digest") == model)
        todo = changes.unembedded(view.table("chunks"), have, "chunk").select("chunk", "doc_id", "content_hash", "text")
        work = f"{self.folder}/data-{uuid.uuid4().hex}"
        units = max(1, -(-todo.count() // unit))
        todo.withColumn("unit", F.pmod(F.xxhash64("chunk"), F.lit(units)).cast("int")).write.partitionBy("unit").parquet(work)

        def tried(texts):
            vectors = [[float(x) for x in v] for v in encode(texts)]
            if len(vectors) != len(texts):
                raise ValueError("the encoder gave another number of vectors than texts")
            return [stages.unit_or_error(v) for v in vectors]

        def run(frames):
            for frame in frames:
                found, errors = [], []
                for a in range(0, len(frame), batch):
                    texts = frame["text"].iloc[a : a + batch].tolist()
                    try:
                        found, errors = found + tried(texts), errors + [None] * len(texts)
                    except Exception:  # noqa: BLE001 - a caller's function; one text must not cost the others their vectors
                        for text in texts:
                            try:
                                found, errors = found + tried([text]), [*errors, None]
                            except Exception as error:  # noqa: BLE001
                                found, errors = [*found, None], [*errors, type(error).__name__]
                yield pd.DataFrame({"chunk": frame["chunk"], "model_digest": model, "content_hash": frame["content_hash"], "embedding": found, "doc_id": frame["doc_id"], "error": errors})

        done = failed = 0
        try:
            rows = self.spark.read.schema("chunk string, doc_id string, content_hash string, text string, unit int").parquet(work)
            for number in range(units if todo.count() else 0):
                told = rows.where(F.col("unit") == number).drop("unit").mapInPandas(run, SCHEMAS["vectors"]).withColumn("layer", F.lit(view.number).cast("long"))
                layer = layers.write(view.snapshot, {"vectors": told}, {}, unit, stamped=False)
                counts = view.snapshot.rows("vectors", [layer]).agg(F.count("embedding").alias("done"), F.count("error").alias("failed")).first()
                done, failed = done + counts.done, failed + counts.failed
                while counts.done:
                    newest = self.pin().snapshot
                    try:
                        self._merge_due(layers.publish(newest, [*newest.layers, {**layer, "size": counts.done}]))
                        break
                    except versions.Conflict:  # vectors go with any version
                        continue
        finally:
            fs, path = versions.place(self.spark, work)
            fs.delete(path, True)
        if failed:
            raise Incomplete(done, failed)
        return done

    def coverage(self, model: str | None = None) -> DataFrame:
        """One row: what the index holds and what it lacks."""
        view = self.pin()
        vectors = view.table("vectors").where(F.col("model_digest") == model if model else F.lit(True)).select("chunk", F.col("content_hash").alias("v"))
        chunks = view.table("chunks").join(vectors, "chunk", "left")
        fresh = F.col("v") == F.col("content_hash")
        sampled = index.sampled(view.table("chunks").select("chunk", "doc_id", "start"), "doc_id", "start").select("chunk", F.lit(True).alias("sampled"))
        rows = chunks.join(sampled, "chunk", "left")
        count = lambda c, name: F.count(F.when(c, F.lit(1))).alias(name)
        of_chunks = rows.agg(
            F.count(F.lit(1)).alias("chunks"), count(F.col("v").isNotNull(), "embedded"), count(fresh, "fresh"), count(F.col("v").isNotNull() & ~fresh, "stale"), count(F.col("v").isNull(), "pending"), count(F.col("sampled"), "samples"), count(F.col("sampled") & F.col("v").isNull(), "pending_samples"),
            F.countDistinct("doc_id").alias("documents_with_chunks"), F.countDistinct(F.when(fresh, F.col("doc_id"))).alias("documents_embedded"), F.max(F.length("text")).alias("longest_chunk"),
        )
        documents = view.table("documents").agg(F.count(F.lit(1)).alias("documents"))
        sources = view.table("sources").agg(F.count(F.lit(1)).alias("sources"))
        return of_chunks.crossJoin(F.broadcast(documents)).crossJoin(F.broadcast(sources))

    def export(self, folder: str) -> int:
        """Copies what the newest version holds to another folder, as one layer that appears there whole."""
        snapshot, there = self.pin().snapshot, layers.pin(self.spark, folder.rstrip("/"), SCHEMAS)
        copy = layers.Snapshot(self.spark, there.folder, SCHEMAS, there.number, snapshot.content)
        moved = layers.merged(copy, list(range(len(snapshot.layers))), index.PARTITIONED, self._arranged(True, index.places_for(sum(x["size"] for x in snapshot.layers)))) if snapshot.layers else []
        sources = f"{there.folder}/data-{uuid.uuid4().hex}/sources"
        snapshot.whole("sources").write.parquet(sources)
        return layers.publish(there, moved, {"sources": sources}, snapshot.facts).number
