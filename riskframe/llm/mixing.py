"""Mixing sources to target weights by weighted fair queueing (operator 8).

Each source is a queue of shuffled documents, repeated in up to ``repeats`` epochs.  A document's
virtual finish time is the number of its source's words up to its own end, divided by the source's
target.  All queues together, in the order of finish times, are cut where the budget is reached.

Sources in code-point order, null last, weigh ``weights`` in turn and share the budget (all words).
A target stops at ``repeats`` times its source's size; what is above goes to the others by weight.
With sources in the order of size over weight, the capped ones come first, so the targets follow
from running sums.

No queue is summed in one task: a source's words are summed by ranges of the shuffle order (with the
size and a row number, so that rows of one doc_id spread over ranges), then running sums of the ranges
are joined to the documents.  ``shuffle_by`` names columns whose hash joins the doc_id in the shuffle
key, for tables where many rows share a doc_id; without it those rows are taken by size, as SQL_OP8 says.
Likewise the finish times are cut into ranges of equal width, which hold about equal numbers of words because every queue advances alike.

Defined results: a document without words (null, empty, blanks only) has size 0 and takes 0; equal
rows are separate documents; documents that share a doc_id and differ in size are ordered by size; a
null doc_id is a value like others; the last document is cut at the budget, so the mix holds exactly
as many words as the budget; without words every target is 0; an empty table gives an empty table; a
carried column with the name of a result's own (``size``, ``target``, ...) gets ``_in`` behind its name.
Sources are ordered in one task: they are few, a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.llm import store

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of one unit of finish time at least, and words of a range at most (about).
RANGES, RANGE_WORDS = 2048, 1 << 21


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """sizes: (source, source_size), a row a source. Adds place (from 1), weight and target."""
    ordered = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighed = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    whole = W.partitionBy(F.lit(1))
    filling = whole.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    cap = repeats * F.col("source_size")
    filled = (
        weighed.withColumn("all_size", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum(cap).over(filling), F.lit(0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(filling), F.lit(0)))
        .withColumn("capped", cap * F.col("left_weight") < F.col("left_size") * F.col("weight"))
    )
    first_free = F.row_number().over(whole.orderBy(F.col("capped").asc(), F.col("source_size") / F.col("weight"), "place"))
    level = filled.withColumn("n", first_free)
    free = W.partitionBy(F.lit(1)).orderBy("n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = F.first("left_size").over(free) * F.col("weight") / F.first("left_weight").over(free)
    return level.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(share)).select("source", "source_size", "place", "weight", "target")


def sliced(items: DataFrame) -> DataFrame:
    """Adds ``slice``: numbers of ranges in shuffle order, of about equal numbers of rows."""
    return store.keep(items.repartitionByRange("place", "epoch", "order", "size", "row").withColumn("slice", F.spark_partition_id()))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: str = "mix", carry: tuple[str, ...] = (), shuffle_by: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and the ``carry`` columns of every document."""
    rows = store.keep(
        docs.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)),
            (F.xxhash64(*shuffle_by).cast("string") if shuffle_by else F.lit(None).cast("string")).alias("_by"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = store.keep(source_targets(sizes, weights, repeats).coalesce(1))
    slim = rows.where("size > 0").select("row", "doc_id", "source", "size", "_by")
    words = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    unit = max(RANGES, words // RANGE_WORDS)
    # A source's epochs that its target reaches; the table of targets has a row a source.
    epochs = targets.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).where(F.col("epoch") * F.col("source_size") < F.col("target"))
    order = F.md5(F.concat_ws("#", F.lit(seed), F.col("epoch").cast("string"), F.col("doc_id").cast("string"), "_by"))
    items = slim.withColumnRenamed("source", "from").join(epochs, F.col("from").eqNullSafe(F.col("source"))).withColumn("order", order)
    items = sliced(items.select("row", "size", "place", "epoch", "order", "target"))
    before = W.partitionBy("place").orderBy("epoch", "slice").rowsBetween(W.unboundedPreceding, -1)
    slices = items.groupBy("place", "epoch", "slice").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = W.partitionBy("place", "epoch", "slice").orderBy("order", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    finished = store.keep(
        items.join(slices, ["place", "epoch", "slice"])
        .withColumn("finish", (F.sum("size").over(within) + F.col("offset")).cast("double") / F.col("target"))
        .select("row", "size", "place", "epoch", "order", "finish")
    )
    # Once every queue has passed its target the budget is spent: later documents take nothing.
    last = finished.where("finish >= 1").groupBy("place").agg(F.min("finish").alias("f")).agg(F.max("f").alias("last"))
    due = finished.join(last, F.col("finish") <= F.coalesce(F.col("last"), F.lit(float("inf")))).withColumn("range", F.floor(F.col("finish") * unit))
    earlier = W.partitionBy(F.lit(1)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = due.groupBy("range").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    sorted_range = W.partitionBy("range").orderBy("finish", "place", "epoch", "order", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    budget = targets.agg(F.sum("source_size").alias("budget"))
    running = due.join(ranges, "range").withColumn("before", F.sum("size").over(sorted_range) - F.col("size") + F.col("offset"))
    taken = (
        running.join(budget, F.col("before") < F.col("budget"))
        .groupBy("row").agg(F.sum(F.least(F.col("size"), F.col("budget") - F.col("before"))).alias("taken"))
    )
    with_target = rows.join(targets.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    out, own = with_target.join(taken, "row", "left"), ("doc_id", "size", "source_size", "target", "taken", "source")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source", *(F.col(f"_c{k}").alias(c + "_in" if c in own else c) for k, c in enumerate(carry)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 in turn."""
    return mix_sources(store.table(spark, sf_dir, "documents"))


SQL_OP8 = r"""
WITH base AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM placed),
filled AS (SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0) AS BIGINT) AS left_size,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS BIGINT) AS left_weight
    FROM weighed WINDOW f AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT left_size AS s, left_weight AS w FROM filled WHERE 3 * source_size * left_weight >= left_size * weight
    ORDER BY source_size / weight, place LIMIT 1),
targets AS (SELECT source, source_size, place, CASE WHEN 3 * source_size * left_weight < left_size * weight
    THEN CAST(3 * source_size AS DOUBLE) ELSE CAST((SELECT s FROM free) * weight AS DOUBLE) / (SELECT w FROM free) END AS target FROM filled),
items AS (SELECT rid, size, place, epoch, target, md5('mix#' || epoch || coalesce('#' || doc_id, '')) AS shuffled
    FROM base JOIN targets ON base.source IS NOT DISTINCT FROM targets.source, range(3) AS e(epoch)
    WHERE size > 0 AND epoch * source_size < target),
finished AS (SELECT *, CAST(sum(size) OVER (PARTITION BY place ORDER BY epoch, shuffled, size, rid ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target AS finish FROM items),
running AS (SELECT *, sum(size) OVER (ORDER BY finish, place, epoch, shuffled, size, rid ROWS UNBOUNDED PRECEDING) - size AS before FROM finished),
taken AS (SELECT rid, sum(least(size, (SELECT sum(size) FROM base) - before)) AS taken FROM running
    WHERE before < (SELECT sum(size) FROM base) GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, base.source AS source
FROM base JOIN targets ON base.source IS NOT DISTINCT FROM targets.source LEFT JOIN taken USING (rid)
"""
