"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a share of all words by its weight, at most `most` times its own size. Documents
have a fixed position on a hash line, by id and text; rows that share both are told apart by further digits, of their
number, so that of equal rows as many are taken as the budget asks for. The documents of a source that get
one copy more than the rest are those before a threshold. Thresholds come from nested histograms: words
are summed by source and leading hash digits, the digit at which the budget runs out becomes the
boundary, and only documents inside boundary buckets are looked at again, a digit deeper, until a
boundary is a single row. Nothing is sorted, and each source's histogram has at most RADIX rows a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.shared import cut, partitions

#: Buckets of one level (hex digits of the hash: 3, so 4096), and the levels of a position: of id and text, and of the row.
DIGITS, LEVELS = 3, 8
RADIX = 16**DIGITS
SALT = 16
#: Plan rows, one for each source and some 100 bytes each, that are broadcast at most.
MOST_SOURCES = 100_000
WEIGHTS = (1, 2, 3)
MOST = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def position(id_: Column, text: Column) -> Column:
    """A document's place on the hash line: half of LEVELS * DIGITS hex digits of its id and text (null: empty), half of its row's number,
    which only tells equal rows apart."""
    half = DIGITS * LEVELS // 2
    digits = lambda c: F.substring(F.md5(c.cast("binary")), 1, half)
    return F.concat(digits(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))), digits(F.monotonically_increasing_id().cast("string")))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... by source in code point order, null last; ranges of sources are counted, not gathered."""
    parts = cut(
        sources.repartitionByRange(partitions(sources.sparkSession), F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    )
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}  # one number for each partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    offsets = sources.sparkSession.createDataFrame(list(before.items()), "part int, offset long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("inside") - 1).drop("part", "offset", "inside")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds rank, weight and target to one row (source, source_size) for each source.

    A share that exceeds most * source_size stops there; what it leaves is dealt again by weight to
    the sources under their limit until none exceeds it. Each round is one aggregate.
    """
    ranked = cut(_ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))))
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * most <= F.col("weight") * F.lit(level)
        t = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("source_size") * most)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("rest"), F.sum(full.cast("int")).alias("n"),
        ).first()
        if not t.rest or t.n == capped:
            break
        capped, level = t.n, (t.total - (t.held or 0)) / t.rest
    full = F.col("source_size") * most <= F.col("weight") * F.lit(level)
    return cut(ranked.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.lit(level))))


def placed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, size, at) of documents, computed once."""
    text = F.col(text_col).cast("string")
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(text).alias("size"), position(F.col(id_col).cast("long"), text).alias("at")))


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, size, at) of documents one row for each source: source, source_size, target, full (copies that each document has),
    threshold and closed: documents before that position have one copy more, and those whose position begins with it if closed is 1."""
    sources = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goals = sources.select("source", "source_size", "target").withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("left", F.col("target") - F.col("full") * F.col("source_size"))
    # words of whole buckets before the boundary are taken level by level
    edge, done = None, None
    for level in range(1, LEVELS + 1):
        width = DIGITS * level
        bucket, words = F.substring("at", 1, width).alias("bucket"), (F.sum("size").alias("words"), F.count(F.when(F.col("size") > 0, 1)).alias("rows"))
        if level == 1:
            histogram = docs.groupBy("source", bucket).agg(*words).join(goals.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s")))
        else:  # only what lies inside a boundary bucket
            inside = F.col("source").eqNullSafe(F.col("s")) & (F.substring("at", 1, width - DIGITS) == F.col("prefix"))
            histogram = docs.join(edge, inside).groupBy("source", bucket, "left").agg(*words)
        order = Window.partitionBy("source").orderBy("bucket")
        sums = histogram.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
        crossing = cut(sums.where((F.col("words") > 0) & (F.col("upto") >= F.col("left")) & (F.col("before") < F.col("left"))))
        single = (F.col("rows") == 1) | F.lit(level == LEVELS)  # whichever side is nearer
        nearer = F.when(F.col("upto") - F.col("left") <= F.col("left") - F.col("before"), 1).otherwise(0)
        ends = crossing.where(single).select(F.col("source").alias("s"), F.col("bucket").alias("threshold"), nearer.alias("closed"))
        done = ends if done is None else done.unionByName(ends)
        edge = crossing.where(~single).select(F.col("source").alias("s"), F.col("bucket").alias("prefix"), (F.col("left") - F.col("before")).alias("left"))
        if edge.isEmpty():
            break
    return cut(goals.drop("left").join(done, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def with_copies(docs: DataFrame, plan: DataFrame, source_col="source", at_col="at", most_sources: int = MOST_SOURCES) -> DataFrame:
    """docs, which know their position, and, from the plan of their sources, __size, __target and __copies. The plan is broadcast if it has few
    rows; else a hot source's rows meet its plan in SALT places."""
    plan = plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("full").alias("__full"), F.col("threshold").alias("__threshold"), F.col("closed").alias("__closed"))
    at = F.col(at_col)
    same = F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    if plan.count() <= most_sources:
        rows = docs.join(F.broadcast(plan), same)
    else:
        plan = plan.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALT)))))
        rows = docs.withColumn("__salted", F.pmod(F.xxhash64(at), F.lit(SALT)).cast("int")).join(plan, same & (F.col("__salted") == F.col("__salt"))).drop("__salt", "__salted")
    more = F.when(at < F.col("__threshold"), 1).when(at.startswith(F.col("__threshold")) & (F.col("__closed") == 1), 1).otherwise(0)
    copies = F.when(F.col("__size") > 0, F.col("__full") + F.coalesce(more, F.lit(0))).otherwise(0).cast("long")
    return rows.withColumn("__copies", copies).drop("__source", "__full", "__threshold", "__closed")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most: int = MOST, most_sources: int = MOST_SOURCES) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken.

    copies is how often the mix takes the document, taken = copies * size. Each source's documents
    get floor(target / size) copies and those before its threshold one more, so no document has
    more than `most`. The threshold lies after the document that brings the words taken nearest to
    the target; of rows with one id and one text as many lie before it as that asks for. A null
    text has size 0; null is a source of its own; a source without words gets no copies. The result
    depends on nothing but the rows, so reruns agree; other columns are ignored.
    """
    sized = placed(docs, id_col, text_col, source_col)
    rows = with_copies(sized, plan(sized, weights, most), most_sources=most_sources)
    return rows.select("doc_id", "size", "source", F.col("__size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most: int = MOST, copy_col: str = "copy") -> DataFrame:
    """The rows of docs as often as the mix takes them, with all columns, and which copy they are: 0, 1, ... in copy_col, which takes
    the place of a column of docs of that name. No text is shuffled where sources are few.

    docs are read twice; equal rows are numbered as they are read, so if docs deals them to other partitions the second time,
    the number of them that is taken is near, not equal to, what the target asks for.
    """
    at = position(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    columns = [c for c in docs.columns if c.lower() != copy_col.lower()]
    rows = with_copies(docs.withColumn("__at", at), plan(placed(docs, id_col, text_col, source_col), weights, most), source_col, "__at").where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies").cast("int") - 1))).select(*columns, F.col("__copy").alias(copy_col))
