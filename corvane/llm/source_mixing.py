"""Mixing sources to target weights, by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source takes part in the mix with a number of words, its target.  Targets share ``share`` times all words by
weight; none is above ``most`` times its source, and what is cut off there is shared among the others by weight, until
nothing is above (a water level: sources are capped in the order of cap / weight).

Within a source, whole epochs come first: a target of 1.6 times the source takes every document once.  The remaining 0.6
is drawn without replacement with chances in proportion to a document's quality: each document gets the exponential key
``-ln(u) / quality`` with ``u`` from a hash of its id, keys are sorted, sizes are prefix-summed, and documents are taken
to the word budget.  The document across the budget's edge is taken if that ends nearer to the target.

No source is sorted as a whole.  Keys fall into ``buckets`` ranges by a monotone map; sizes are summed by (source,
range), the prefix sums run over those sums, ranges wholly below the edge are taken and those above are not.  Only the
documents of the one range across the edge are sorted, so a source with a third of all rows is no large task.  What comes
out is one cut per source, (key, id, hash of text); the mix itself is then a single pass that compares each row with it.

Quality is a number above 0, by default :func:`default_quality`.

Defined results: a null text has 0 words; a null source is a source of its own, the last; a null or non-positive quality
counts as 1; rows that repeat an id share its key and are ordered by a hash of their text, and equal rows are taken
together; an empty table gives an empty result; columns of the input whose names clash with added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, code_points_key, stored, unit

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST, BUCKETS = 1.5, 2.0, 1024
SEED = "mix-1"
#: Sources up to which their cuts, one row each, are broadcast.
FEW = 10_000
ADDED = ("size", "source_size", "target", "times", "taken")


def words(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def default_quality(size: Column) -> Column:
    """Longer documents count for more, by the logarithm: 1 for an empty one, 2 for a thousand words, 3 for a million."""
    return F.lit(1.0) + F.log10(F.lit(1.0) + size.cast("double")) / F.lit(3.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with target added.  One row per source: the windows run over as many rows as there are sources."""
    by_name = Window.orderBy(F.col("source").isNull(), code_points_key(F.col("source")))
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # with the k lowest sources capped, the level is what is left over the weight that is left; capped are those at or below it
    capped_before = F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    weight_before = F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    leveled = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("budget") - capped_before) / (F.sum("weight").over(everything) - weight_before))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    )
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)
    leveled = leveled.withColumn("at", first_open)
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at.level") * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def _keyed(df: DataFrame, quality, seed: str, buckets: int) -> DataFrame:
    rows = df.withColumn("size", words(F.col("text")))
    chosen = quality if isinstance(quality, Column) else (quality or default_quality)(F.col("size"))
    rows = rows.withColumn("__q", F.coalesce(F.when(chosen > 0, chosen), F.lit(1.0)).cast("double"))
    rows = rows.withColumn("__key", -F.log(unit(F.col("doc_id"), seed)) / F.col("__q"))
    bucket = F.floor(F.lit(float(buckets)) * (F.lit(1.0) - F.exp(-F.col("__key")))).cast("int")
    return rows.withColumn("__bucket", bucket).withColumn("__order", F.struct("__key", "doc_id", F.xxhash64("text"))).drop("__q", "__key")


def cuts(keyed: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: its size, target, whole epochs, and where the fraction's prefix ends (range and cut within it)."""
    sums = stored(keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("in_bucket")))
    per_source = targets(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    per_source = per_source.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    per_source = per_source.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sums.join(per_source.select("__source", "rest"), same)
        .withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_bucket") > F.col("rest")))
        .select(F.col("__source").alias("__edge_source"), F.col("__bucket").alias("edge"), "before", "rest")
    )
    inside = Window.partitionBy("source").orderBy("__order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.col("through") - F.col("rest")
    drawn = (
        keyed.select("source", "__bucket", "size", "__order")
        .join(edges, F.col("source").eqNullSafe(F.col("__edge_source")) & (F.col("__bucket") == F.col("edge")))
        .withColumn("through", F.col("before") + F.sum("size").over(inside))
        .filter((over <= 0) | ((over - F.col("size") < 0) & (over <= F.col("size") - over)))
        .groupBy("__edge_source")
        .agg(F.max("__order").alias("cut"))
    )
    edges = edges.drop("before", "rest").withColumnRenamed("__edge_source", "__e")
    plan = per_source.join(edges, F.col("__source").eqNullSafe(F.col("__e")), "left").drop("__e")
    return stored(plan.join(drawn, F.col("__source").eqNullSafe(F.col("__edge_source")), "left").drop("__edge_source"))


def mix(
    df: DataFrame,
    quality: Callable[[Column], Column] | Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """df(doc_id, text, source, ...) with size, source_size, target, times (how often the mix takes the document) and taken (words)."""
    kept = [c for c in df.columns if c not in ADDED]
    rows = _keyed(df.select(*kept), quality, seed, buckets)
    plan = cuts(rows, weights, share, most)
    if plan.count() <= FEW:
        plan = F.broadcast(plan)
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    drawn = (F.col("__bucket") < F.col("edge")) | ((F.col("__bucket") == F.col("edge")) & F.coalesce(F.col("__order") <= F.col("cut"), F.lit(False)))
    times = F.col("epochs") + F.when(drawn, 1).otherwise(0)
    return placed.select(*kept, "size", "source_size", "target", times.cast("int").alias("times"), (F.col("size") * times).cast("bigint").alias("taken"))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of df as many times as it is taken, in df's columns."""
    clash = {c: f"__own_{c}" for c in df.columns if c in ADDED}
    times = mix(df.withColumnsRenamed(clash), **options)
    copies = times.filter(F.col("times") > 0).withColumn("__copy", F.explode(F.expr("sequence(1, times)")))
    return copies.select(*(F.col(clash.get(c, c)).alias(c) for c in df.columns))
