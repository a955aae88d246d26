"""Operator 8: mixing sources to target weights along a time-varying curriculum.

Each source's share of the training stream is a straight line in training time
t from 0 to 1, whose integral is the source's target. Cumulative demand is
inverted to give every word, and so every document, the time at which the
stream reaches it; documents are range-sorted by that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.workspace import staged

#: Blocks into which the shuffled order of a source is cut, so that no task sums a whole source.
BLOCKS = 4096


def word_count(text: str) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null as 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """(source, source_size, target, rank) from (source, source_size), one row per source.

    Targets share budget * all sizes by weight, are capped at cap * own size, and
    what is cut off goes to the others by weight until none is above: sources
    reach their cap in order of cap over weight, so running sums tell which do.
    This runs in one task over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    rows = sizes.withColumn("rank", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(weights, (F.pmod("rank", F.lit(len(cycle))) + 1).cast("int")))
    rows = rows.withColumn("limit", F.col("source_size") * cap)
    every = Window.partitionBy()
    fill = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "demand": F.sum("source_size").over(every) * F.lit(float(budget)),
            "full_before": F.coalesce(F.sum("limit").over(fill), F.lit(0.0)),
            "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)),
        }
    )
    level = (F.col("demand") - F.col("full_before")) / F.col("weight_left")
    rows = rows.withColumn("level", level).withColumn("reached", F.col("level") * F.col("weight") >= F.col("limit"))
    # the first source that isn't filled sets the level for all that follow
    rest = F.min(F.when(~F.col("reached"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(every)
    target = F.when(F.col("reached") | rest.isNull(), F.col("limit")).otherwise(rest["level"] * F.col("weight"))
    return rows.withColumn("target", F.least(target, "limit")).select("source", "source_size", "target", "rank")


def demand_time(done: Column, slope: Column) -> Column:
    """The time at which a source has given the share `done` of its target.

    Its rate is 1 + slope * (2t - 1), slope in (-1, 1); its integral
    (1 - slope) * t + slope * t * t is solved for t in a form without cancellation.
    """
    b = F.lit(1.0) - slope
    return 2 * done / (b + F.sqrt(b * b + 4 * slope * done))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    cap: float = 2.0,
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per row of docs, range-sorted by the first time it is reached.

    doc_id, source, size, source_size, target, taken (words, repeats counted),
    copies (whole readings: taken over size, rounded, 1 at least if it is an
    empty text of a source that gives anything), first_time and last_time in
    [0, 1], null where nothing is taken, and times: when each copy begins.

    Sources in order of code points, null last, have the weights of `cycle` in
    turn. Within a source, documents follow a hashed order that depends on
    doc_id and text alone, so reruns agree; the source is read through as often
    as its target asks and the last reading stops at the word that meets it, so
    taken words differ from the target by less than one per source. Null texts
    and ids are allowed; rows that repeat another are told apart only by their
    place among equals, which doesn't change the columns' values as a set. An
    empty table gives no rows.
    """
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), key.alias("key"))
    rows = staged(rows.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")), "sizes")
    blocks_of = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    blocks_of = staged(blocks_of, "blocks")
    targets = source_targets(blocks_of.groupBy("source").agg(F.sum("block_size").alias("source_size")), cycle, budget, cap)
    targets = staged(targets.withColumn("_source", F.struct("source")), "targets")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks_of = blocks_of.withColumn("block_before", F.coalesce(F.sum("block_size").over(before), F.lit(0)))
    same = lambda a, b: F.coalesce(a, F.lit("")).eqNullSafe(F.coalesce(b, F.lit(""))) & a.eqNullSafe(b)
    t, b = targets.alias("t"), blocks_of.alias("b")
    starts = b.join(t, same(F.col("b.source"), F.col("t.source"))).select("b.source", "block", "block_before", "source_size", "target", "rank")
    r, s = rows.alias("r"), starts.alias("s")
    full = r.join(s, (F.col("r.block") == F.col("s.block")) & same(F.col("r.source"), F.col("s.source")))
    full = full.select("r.doc_id", "r.source", "size", "key", "s.block", "block_before", "source_size", "target", "rank")
    inside = Window.partitionBy("rank", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("begin", F.col("block_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.round("target").cast("long")
    full = full.withColumns({"words": words, "rounds": F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))})
    left = F.col("words") - F.col("rounds") * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("begin")))
    full = full.withColumns({"last_part": last, "taken": F.col("rounds") * F.col("size") + last})
    # odd ranks come early in training and fade out, even ones rise
    slope = F.when(F.pmod("rank", F.lit(2)) == 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    final_round = F.when(F.col("last_part") > 0, F.col("rounds")).otherwise(F.col("rounds") - 1)
    at = lambda n: demand_time((n * F.col("source_size") + F.col("begin")) / F.col("words"), slope)
    full = full.withColumns({"first_time": F.when(F.col("taken") > 0, at(F.lit(0))), "last_time": F.when(F.col("taken") > 0, at(final_round))})
    gives = (F.col("words") > 0).cast("long")
    copies = F.when(F.col("size") == 0, gives).otherwise(F.round(F.col("taken") / F.col("size")).cast("long"))
    # an empty text behind the last word taken comes at the end
    begins = lambda k: demand_time(F.least(F.lit(1.0), (k * F.col("source_size") + F.col("begin")) / F.col("words")), slope)
    full = full.withColumn("copies", copies)
    times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), begins))
    out = full.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "first_time", "last_time", times.alias("times"), "key")
    return out.repartitionByRange(F.col("first_time").asc_nulls_last(), "key").sortWithinPartitions(F.col("first_time").asc_nulls_last(), "key")
