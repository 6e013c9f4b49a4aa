"""Segments that end at sentences where they can, and chunks packed from whole segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT, CHUNK, OVERLAP = 1400, 6000, 1
# white space as Unicode has it, and four separators besides
_SPACE = r"[\s\x1c-\x1f]"
_ENDED = rf"(?U)(?<=[。！？\n])|(?<=[.!?]{_SPACE})"
_NONE = "array<int>"


def _cuts(text: Column, size: int) -> Column:
    """Where a text is cut, in order: at the last sentence's end in the latter half of what a segment may hold, or where that is full.

    One pass over the sentences. The state is how far it has come, where the open segment begins, and the
    last place to cut it (-1: none); a sentence that doesn't fit closes the segment, and one that is longer than
    a segment is cut where each is full.
    """

    def step(s: Column, sentence: Column) -> Column:
        reached = s["at"] + F.length(sentence)
        over = reached - s["start"] > size
        first = F.when(s["place"] >= 0, s["place"]).otherwise(s["start"] + size)
        full = (F.ceil((reached - first) / size) - 1).cast("int")
        more = F.when(full > 0, F.transform(F.sequence(F.lit(1), full), lambda i: first + i * size)).otherwise(F.array().cast(_NONE))
        start = F.when(over, first + F.greatest(full, F.lit(0)) * size).otherwise(s["start"])
        return F.struct(
            reached.alias("at"), start.alias("start"), F.when(reached - start >= size // 2, reached).otherwise(-1).alias("place"),
            F.when(over, F.concat(s["cuts"], F.array(first), more)).otherwise(s["cuts"]).alias("cuts"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(-1).alias("place"), F.array().cast(_NONE).alias("cuts"))
    return F.aggregate(F.split(text, _ENDED), begin, step)["cuts"]


def segments(docs: DataFrame, key: str, body: str = "body", pages: str | None = None, size: int = SEGMENT) -> DataFrame:
    """(key, segment, start, end, page, text): segments of at most size characters that together hold all of a text but blanks.

    They don't cross pages (page, start, end), and a document with pages has none outside them; one without, or
    with none, is one span. A null or empty body has no segments. The id tells the document and the place.
    """
    whole = F.array(F.struct(F.lit(None).cast("int").alias("page"), F.lit(0).alias("start"), F.length(body).alias("end")))
    spans = F.when(F.size(pages) > 0, F.transform(pages, lambda p: F.struct(p["page"].cast("int").alias("page"), p["start"].cast("int").alias("start"), p["end"].cast("int").alias("end")))).otherwise(whole) if pages else whole
    rows = docs.where(F.length(body) > 0).select(key, body, F.explode(spans).alias("span")).select(key, F.col("span.page").alias("page"), F.col("span.start").alias("a"), F.col(body).substr(F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("span"))
    rows = rows.where(F.length("span") > 0).withColumn("cuts", _cuts(F.col("span"), size))
    ends = F.concat(F.col("cuts"), F.array(F.length("span")))
    rows = rows.select(key, "page", "a", "span", F.explode(F.transform(ends, lambda e, i: F.struct(F.coalesce(F.get("cuts", i - 1), F.lit(0)).alias("s"), e.alias("e")))).alias("c"))
    rows = rows.select(key, (F.col("a") + F.col("c.s")).alias("start"), (F.col("a") + F.col("c.e")).alias("end"), "page", F.col("span").substr(F.col("c.s") + 1, F.col("c.e") - F.col("c.s")).alias("text"))
    rows = rows.where(F.col("text").rlike(rf"(?U)[^\s\x1c-\x1f]"))
    name = F.left(F.sha2(F.concat_ws(":", F.col(key).cast("string"), "start", "end"), 256), F.lit(24))
    return rows.select(key, name.alias("segment"), "start", "end", "page", "text")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the positions of the chunks that hold a segment. Rows come by document and place; a document's first has number 0.

    What is held is the place of the next chunk and those that are open, never a document.
    """
    following, position, opened = 0, 0, []
    for batch in batches:
        held = []
        for i, stop, then in zip(*(batch.column(c).to_numpy().tolist() for c in ("_i", "_stop", "_next")), strict=True):
            if i == 0:
                following, position, opened = 0, 0, []
            if i == following:
                opened, following, position = [*opened, (position, stop)], then, position + 1
            opened = [x for x in opened if i < x[1]]
            held.append([p for p, _ in opened])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.list_(pa.int32()))], names=[*batch.schema.names, "_chunks"])


def packed(rows: DataFrame, key: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk, position, segments, start, end) from segments: each chunk takes as many as it has room for, and
    begins `overlap` segments before the end of the one before, but after its start. A segment over size is an error.

    Rows are dealt once, by document. A window over sums of lengths tells where a chunk from each segment would end: it looks at no more segments
    than a chunk has room for. Then one pass in order follows the chunks that are made; a document may have any number of segments.
    """
    w = Window.partitionBy(key).orderBy("start", "end")
    measured = rows.select(key, "segment", "start", "end", F.length("text").cast("long").alias("_n")).repartition(key)
    measured = measured.withColumn("_i", F.row_number().over(w) - 1).withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_before", F.col("_upto") - F.col("_n"))
    # the last segment that begins where there is still room: it fits only if it is a document's last, or else the next would begin there too
    measured = measured.withColumn("_last", F.max(F.struct("_i", "_upto")).over(Window.partitionBy(key).orderBy("_before").rangeBetween(0, size)))
    fits = F.col("_last._upto") <= F.col("_before") + size
    stop = F.when(F.col("_n") > size, F.raise_error(F.lit("a segment is longer than a chunk")).cast("int")).otherwise(F.col("_last._i") + fits.cast("int"))
    reach = measured.withColumn("_stop", stop).select(key, "segment", "start", "end", "_i", "_stop", F.when(fits, -1).otherwise(F.greatest(F.col("_i") + 1, F.col("_stop") - overlap)).alias("_next"))
    walked = reach.sortWithinPartitions(key, "_i").mapInArrow(_walk, T.StructType([*reach.schema.fields, T.StructField("_chunks", T.ArrayType(T.IntegerType()))]))
    made = walked.select(key, F.explode("_chunks").alias("position"), F.struct("_i", "start", "end", "segment").alias("one")).groupBy(key, "position").agg(F.array_sort(F.collect_list("one")).alias("in"))
    ids = F.transform("in", lambda x: x["segment"])
    return made.select(key, F.sha2(F.concat_ws(":", ids), 256).alias("chunk"), "position", ids.alias("segments"), F.get("in", F.lit(0))["start"].alias("start"), F.element_at("in", -1)["end"].alias("end"))
