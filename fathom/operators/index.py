"""From documents to chunks, postings and corpus statistics."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, types
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fathom.functions.text import search_tokens
from fathom.sources import versions

SIZE, OVERLAP = 1400, 160


def page_of(pages: Column, start: Column, end: Column) -> Column:
    """The first page that holds a stretch of text whole, or null."""
    holds = F.filter(pages, lambda p: (p["start"] <= start) & (start < end) & (end <= p["end"]))
    return F.try_element_at(holds, F.lit(1))["page"]


def chunks(docs: DataFrame, body: str = "body", pages: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Windows of SIZE characters that overlap by OVERLAP, never across a page boundary.

    Adds start, end (code points, half open), page and text. Blank windows are dropped; gaps
    between pages are chunks without a page. The starts of a span are a closed form, so this is one
    explode. A null or empty body has no chunks.
    """
    step, text = SIZE - OVERLAP, F.col(body)
    length = F.length(text)
    if pages:
        marks = F.flatten(F.transform(F.col(pages), lambda p: F.array(p["start"], p["end"])))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), length), F.coalesce(marks, F.array().cast("array<int>")))))
    else:
        cuts = F.array_distinct(F.array(F.lit(0), length))
    spans = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.struct(F.element_at(cuts, i).alias("a"), F.element_at(cuts, i + 1).alias("b")))
    starts = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((s["b"] - s["a"] - SIZE) / step)).cast("int")), lambda i: F.struct((s["a"] + i * step).alias("start"), F.least(s["a"] + i * step + SIZE, s["b"]).alias("end")))
    keep = keep or [c for c in docs.columns if c != body]
    out = docs.where(length > 0).select(*docs.columns, F.explode(F.flatten(F.transform(spans, starts))).alias("__c"))
    out = out.select(*keep, "__c.start", "__c.end", *([page_of(F.col(pages), F.col("__c.start"), F.col("__c.end")).alias("page")] if pages else []), text.substr(F.col("__c.start") + 1, F.col("__c.end") - F.col("__c.start")).alias("text"))
    return out.where(F.col("text").rlike("(?U)\\S"))


#: Tokens that are grouped at a time.
TOGETHER = 2_000_000


def _grouped(keys: list[str], schema: pa.Schema):
    """A function for mapInArrow: from rows (key, t: tokens) to blocks, one for each token of those chunks that come together."""

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        lists = rows["t"].combine_chunks()
        told = lists.flatten().dictionary_encode()
        n, length = len(lists), pc.list_value_length(lists)
        both = told.indices.to_numpy().astype(np.int64) * n + pc.list_parent_indices(lists).to_numpy()
        both.sort()
        at = np.flatnonzero(np.diff(both, prepend=-1))
        tf, token, chunk = np.diff(at, append=len(both)), both[at] // n, both[at] % n
        first = np.flatnonzero(np.diff(token, prepend=-1))
        offsets = pa.array(np.append(first, len(token)), pa.int32())
        listed = lambda values: pa.ListArray.from_arrays(offsets, values)
        columns = [told.dictionary.take(pa.array(token[first])), pa.array(np.add.reduceat(tf, first) if len(first) else [], pa.int64())]
        columns += [listed(rows[k].combine_chunks().take(pa.array(chunk))) for k in keys]
        columns += [listed(pa.array(tf, pa.int32())), listed(length.take(pa.array(chunk)).cast(pa.int32()))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not (more := len(batch["t"].flatten())):
                continue
            held, n = [*held, batch], n + more
            if n >= TOGETHER:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return run


def blocks(chunked: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(token, total, a list for each key, tf, dl): the postings of a token in chunks that a task reads together, and the sum of their tf.

    A task groups by token what it has, and sorts lists rather than a row for each posting."""
    rows = chunked.select(*key, search_tokens(text).alias("t"))
    kinds = dict(rows.dtypes)
    out = types._parse_datatype_string(", ".join(["token string, total long", *(f"{k} array<{kinds[k]}>" for k in key), "tf array<int>, dl array<int>"]))
    return rows.mapInArrow(_grouped(key, to_arrow_schema(out)), out)


def unpacked(blocks_: DataFrame, key: list[str], *more: str) -> DataFrame:
    """A row for each posting of blocks."""
    return blocks_.select("token", *more, F.inline(F.arrays_zip(*key, "tf", "dl"))).select(*key, "token", "tf", "dl", *more)


def postings(chunked: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(key, token, tf, dl): each distinct token of a chunk."""
    return unpacked(blocks(chunked, key, text), key)


#: Documents that ask for another bucket of the persisted tables, and the most buckets.
PER_BUCKET, MOST_BUCKETS = 400_000, 4096
#: Documents whose postings are made and sorted in one place: few enough for a task's memory, whatever the size of the corpus or of its files.
PER_PLACE = 4_000


def places_for(documents: int) -> int:
    return -(-documents // PER_PLACE) or 1


def bucket_of(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


@dataclass(frozen=True)
class Index:
    """Tables of a corpus: documents (doc_id, source, title, published_at, metadata, ...), chunks (chunk, doc_id, start,
    end, text, ...), postings (token, chunk, doc_id, tf, dl, bucket), tokens (token, n_with, total, bucket) and a row of
    corpus statistics (n_chunks, n_tokens). Buckets are by token, so a query reads those of its tokens only."""

    documents: DataFrame
    chunks: DataFrame
    postings: DataFrame
    tokens: DataFrame
    corpus: DataFrame
    buckets: int = 1

    def of_tokens(self, table: DataFrame, tokens: list[str]) -> DataFrame:
        return table.where(F.col("bucket").isin(*sorted({bucket_of(t, self.buckets) for t in tokens})) & F.col("token").isin(*tokens))

    def found(self, tokens: list[str]) -> DataFrame:
        """The postings of some tokens with n_with of each, and n_chunks and mean_length, which are over all chunks whatever is filtered."""
        known = self.of_tokens(self.tokens, tokens).select("token", "n_with")  # a row for each token of a query
        whole = self.corpus.select("n_chunks", (F.col("n_tokens") / F.col("n_chunks")).alias("mean_length"))  # one row
        return self.of_tokens(self.postings, tokens).join(F.broadcast(known), "token").crossJoin(F.broadcast(whole))

    def texts(self, keys: DataFrame, *columns: str) -> DataFrame:
        """Columns of the chunks of some keys (chunk, and more), which are few: partitions without any are not read."""
        keys = keys.withColumn("part", (F.crc32(F.col("chunk").cast("binary")) % self.buckets).cast("int"))
        return self.chunks.select("part", "chunk", *columns).join(F.broadcast(keys), ["part", "chunk"]).drop("part")


def number_of(c: str, buckets: int) -> Column:
    return (F.crc32(F.col(c).cast("binary")) % buckets).cast("int")


def number_of(c: str, buckets: int) -> Column:
    return (F.crc32(F.col(c).cast("binary")) % buckets).cast("int")


def tables(documents: DataFrame, chunked: DataFrame, buckets: int = 1, places: int | None = None) -> dict[str, DataFrame]:
    """The tables of an index but the aggregates: documents, chunks, and postings in blocks (rows_of: a row each).

    With places, texts are dealt out by document before postings are made of them: they are a fraction of their postings."""
    dealt = chunked.select("chunk", "doc_id", F.concat_ws(" ", "title", "text").alias("text"))
    dealt = dealt if places is None else dealt.repartition(places, "doc_id")
    told = blocks(dealt, ["chunk", "doc_id"], F.col("text")).withColumn("bucket", number_of("token", buckets))
    return {"documents": documents, "chunks": chunked.drop(*({"title", "source", "published_at", "metadata"} & set(chunked.columns))).withColumn("part", number_of("chunk", buckets)), "postings": told}


def rows_of(blocks_: DataFrame) -> DataFrame:
    return unpacked(blocks_, ["chunk", "doc_id"], "bucket")


def aggregates(postings_: DataFrame) -> dict[str, DataFrame]:
    """tokens, from postings: chunks with each, and how often it occurs."""
    tokens = postings_.groupBy("token", "bucket").agg(F.count(F.lit(1)).alias("n_with"), F.sum("tf").alias("total"))
    return {"tokens": tokens}


def corpus_row(chunks_: DataFrame, postings_: DataFrame) -> DataFrame:
    """One row: chunks (those without a token too) and tokens."""
    return chunks_.agg(F.count(F.lit(1)).alias("n_chunks")).crossJoin(postings_.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens")))


PARTITIONED = {"chunks": ["part"], "postings": ["bucket"], "tokens": ["bucket"]}


def laid(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Rows as they are written, each task into the buckets that it has rows of, sorted by key, so that a scan skips row groups. Blocks
    are sorted as such, and only then a row for each posting."""
    rows = rows.sortWithinPartitions(column, key)
    return rows_of(rows) if dict(rows.dtypes).get("chunk", "").startswith("array") else rows


def write(spark: SparkSession, folder: str, documents: DataFrame, chunked: DataFrame, buckets: int | None = None) -> Index:
    """Builds and publishes an index; a reader sees the version before it, or the whole of it."""
    n = documents.count()
    buckets = buckets or min(MOST_BUCKETS, 1 + n // PER_BUCKET)
    parts = tables(documents, chunked, buckets, places_for(n))
    parts["chunks"], parts["postings"] = laid(parts["chunks"], "part", "chunk"), laid(parts["postings"], "bucket", "token")
    number = versions.publish(spark, f"{folder}/building", parts, PARTITIONED)
    _, have, _ = versions.tables(spark, f"{folder}/building")
    more = {"tokens": aggregates(have["postings"])["tokens"], "corpus": corpus_row(have["chunks"], have["postings"])}
    paths = versions.latest(spark, f"{folder}/building")[1]["tables"]
    data = f"{paths['postings'].rpartition('/')[0]}"
    for name, rows in more.items():
        (rows.coalesce(1) if name == "corpus" else rows.sortWithinPartitions("token")).write.partitionBy(*PARTITIONED.get(name, [])).option("compression", "zstd").parquet(f"{data}/{name}")
        paths[name] = f"{data}/{name}"
    versions.add(spark, folder, versions.latest(spark, folder)[0] + 1, {"tables": paths, "facts": {"buckets": buckets, "number": number}})
    return read(spark, folder)


def read(spark: SparkSession, folder: str) -> Index:
    _, found, facts = versions.tables(spark, folder)
    return Index(*(found[name] for name in ("documents", "chunks", "postings", "tokens", "corpus")), buckets=facts["buckets"])


def of(documents: DataFrame, chunked: DataFrame) -> Index:
    """An index that is not written anywhere, for small tables."""
    parts = tables(documents, chunked)
    rows = rows_of(parts["postings"])
    return Index(parts["documents"], parts["chunks"], rows, aggregates(rows)["tokens"], corpus_row(parts["chunks"], rows))


def sampled(chunked: DataFrame, document: str, order: str) -> DataFrame:
    """First, middle and last chunk of each document."""
    w = Window.partitionBy(document)
    rows = chunked.withColumn("position", F.row_number().over(w.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.where((F.col("position") == 1) | (F.col("position") == F.floor((F.col("n") + 1) / 2)) | (F.col("position") == F.col("n")))
