"""Imported files by content: originals, documents and where each came from, none stored twice.

What is known only grows, so an import adds rows and writes nothing anew. Originals and documents are keyed by
hashes of what they hold, and a file whose bytes and reader are as at its last import is passed over.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import utc_timestamp
from fathom.operators import changes
from fathom.sources import files, versions

#: Which form of the readers has parsed a file; with another one files are read again.
READER = "1"
TABLES = {
    "originals": "raw_hash string, content binary", "documents": "document string, body string", "files": "path string, raw_hash string, reader string, imported long",
    "origins": "origin string, raw_hash string, document string, title string, source string, published_at string, url string, warning string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a table; of files each path's last import. Other keys are there once, as of two imports at a time one is refused."""
    found = versions.tables(spark, folder)[1].get(name)
    rows = found if found is not None else spark.createDataFrame([], TABLES[name])
    return changes.last_of(rows, "path", "imported") if name == "files" else rows


def import_files(spark: SparkSession, folder: str, store: str, reader: str = READER, most_bytes: int = files.MOST_BYTES) -> tuple[dict[str, int], DataFrame]:
    """(counts, errors) of an import of the supported files under a folder; errors (path, error) are of files that were not taken.

    A file is taken whole or not at all. A document that is known, or stands in several files, is stored
    once; each place it comes from is an origin.
    """
    number = versions.latest(spark, store)[0]
    seen = files.listing(spark, folder)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= most_bytes)
    read = read.join(seen.select("path"), "path", "left_semi").select("path", "content", F.sha2("content", 256).alias("raw_hash"), F.lit(reader).alias("reader"))
    told = read.select("path", "raw_hash", "reader").persist()
    fresh = told.join(table(spark, store, "files"), ["path", "raw_hash", "reader"], "left_anti")
    unread = read.select("path", "content").join(fresh.select("path"), "path", "left_semi")
    docs = files.parsed(unread).persist()
    large = seen.where(F.col("length") > most_bytes).select("path", F.lit("too_large").alias("error"))
    errors = docs.where("error <> ''").select("path", "error").distinct().unionByName(large)

    good = changes.whole_files(docs).join(fresh, "path").withColumn("document", document_of(F.col("body"), reader))
    origin = F.concat("path", F.lit("#"), F.col("record").cast("string"))
    origins = good.select(origin.alias("origin"), "raw_hash", "document", "title", "source", "published_at", "url", F.coalesce("warning", F.lit("")).alias("warning"))
    new_origins = origins.join(table(spark, store, "origins"), ["origin", "raw_hash", "document"], "left_anti").persist()
    new_documents = good.groupBy("document").agg(F.first("body").alias("body")).join(table(spark, store, "documents"), "document", "left_anti").persist()
    taken = good.select("path", "raw_hash", "reader").distinct().withColumn("imported", F.lit(time.time_ns()))
    # equal files are one original, read from any of them
    holders = taken.groupBy("raw_hash").agg(F.min("path").alias("path")).join(table(spark, store, "originals").select("raw_hash"), "raw_hash", "left_anti")
    originals = unread.join(holders, "path").select("raw_hash", "content")

    records = good.count()
    counts = {
        "files_seen": seen.count(), "files_unchanged": told.count() - fresh.count(), "new_documents": new_documents.count(), "new_sources": new_origins.count(), "errors": errors.count(),
    }
    counts["duplicate_documents"] = records - counts["new_documents"]
    if records:
        versions.publish(spark, store, {}, after=number, added={"originals": originals, "documents": new_documents, "files": taken, "origins": new_origins})
    for rows in (told, docs, new_origins, new_documents):
        rows.unpersist()
    return counts, errors


def document_of(body: Column, reader: str) -> Column:
    """The id of a text as a reader gives it."""
    return F.sha2(F.to_json(F.struct(body.alias("body"), F.lit(reader).alias("reader"))), 256)


def published(spark: SparkSession, store: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """(document) of documents with an origin published in [since, until), whenever it was imported; without bounds, with any origin."""
    at, rows = utc_timestamp(F.col("published_at")), table(spark, store, "origins")
    if since:
        rows = rows.where(at >= F.lit(since).cast("timestamp"))
    if until:
        rows = rows.where(at < F.lit(until).cast("timestamp"))
    return table(spark, store, "documents").join(rows.select("document"), "document", "left_semi").select("document")
