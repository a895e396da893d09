"""Exact percentiles of groups of any size, by selection in rounds: no task ever holds a group's values.

A group of at most `most` values takes Spark's own exact percentile. In larger groups each wanted rank starts in the
range of all values. A round counts the values of its range in `bins` equal bins, map-side, and only the bin that holds
the rank is opened for the next one, narrowed to its least and largest value. A range of at most `most` values, or of
one repeated value, is at its end; the smallest bin always parts the least value from the largest, so rounds end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

MOST, BINS = 1 << 16, 1024
FEW = 1 << 14  # ranges that are broadcast


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", more: Column | None = None) -> DataFrame:
    """A join by keys that may be NULL; the right side's keys go."""
    other = right.select(*(F.col(k).alias(f"_r{keys.index(k)}" if k in keys else k) for k in right.columns))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)], F.lit(True) if more is None else more)
    return left.join(other, on, how).drop(*(f"_r{i}" for i in range(len(keys))))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _ranks(big: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, i, share of the step, low and high: the two ranks between which each wanted share lies."""
    out = big.select(*keys, "_n", F.posexplode(F.array(*map(F.lit, shares))).alias("_i", "_p"))
    at = F.col("_p") * (F.col("_n") - 1)
    return out.select(*keys, "_i", (at - F.floor(at)).alias("_part"), F.floor(at).alias("_low"), F.ceil(at).alias("_high"))


def _selected(some: DataFrame, big: DataFrame, ranks: DataFrame, keys: list[str], most: int, bins: int) -> DataFrame:
    """keys, _rank and _value for each rank of the large groups."""
    each = ranks.select(*keys, F.explode(F.array("_low", "_high")).alias("_rank")).distinct()
    state = written(_on(each, big.select(*keys, "_n", "_lo", "_hi"), keys).withColumn("_below", F.lit(0).cast("long")))
    span = ["_lo", "_hi"]
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    while True:
        open_ = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > most))
        if not open_.limit(1).count():
            break
        rows = _on(some, _few(open_.select(*keys, *span).distinct()), keys, more=inside)
        half = lambda c: F.col(c) / 2  # noqa: E731  a difference of doubles may overflow, one of halves can't
        place = F.least(F.floor((half("_v") - half("_lo")) / (half("_hi") - half("_lo")) * bins), F.lit(bins - 1))
        place = F.when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(place)
        counts = rows.groupBy(*keys, *span, place.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        w = Window.partitionBy(*keys, *span).orderBy("_bin")
        counts = counts.withColumn("_to", F.sum("_c").over(w))
        own = F.col("_rank") - F.col("_below")
        found = _on(open_, counts, [*keys, *span], more=(own >= F.col("_to") - F.col("_c")) & (own < F.col("_to")))
        found = found.select(*keys, "_rank", F.col("_c").alias("_n"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_below") + F.col("_to") - F.col("_c")).alias("_below"))
        state = written(state.where((F.col("_lo") >= F.col("_hi")) | (F.col("_n") <= most)).unionByName(found))
    known = state.where("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_value"))
    last = state.where("_lo < _hi")
    rows = _on(some, _few(last.select(*keys, *span).distinct()), keys, more=inside)
    sorted_ = rows.groupBy(*keys, *span).agg(F.sort_array(F.collect_list("_v")).alias("_all"))  # of at most `most` values
    return known.unionByName(_on(last, sorted_, [*keys, *span]).select(*keys, "_rank", F.get("_all", (F.col("_rank") - F.col("_below")).cast("int")).alias("_value")))


def group_percentiles(values: DataFrame, keys: list[str], value: str, shares: list[float], *, sizes: DataFrame | None = None, most: int = MOST, bins: int = BINS) -> DataFrame:
    """keys and q: the percentiles of each group's values at the shares, in their order, interpolated linearly.

    NULL and NaN values are left out; a group without others has no row. A NULL key is a group of its own. sizes(keys, n),
    where upper bounds of the groups' sizes are known, spares small groups all rounds.
    """
    some = values.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    plain = lambda df: df.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("q"))
    if sizes is not None and not sizes.where(F.col("n") > most).limit(1).count():
        return plain(some)
    some = written(some)
    big = written(some.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where(F.col("_n") > most))
    if not big.limit(1).count():
        return plain(some)
    ranks = _ranks(big, keys, shares)
    found = written(_selected(some, big, ranks, keys, most, bins))
    low = found.select(*keys, F.col("_rank").alias("_low"), F.col("_value").alias("_a"))
    high = found.select(*keys, F.col("_rank").alias("_high"), F.col("_value").alias("_b"))
    both = _on(_on(ranks, low, [*keys, "_low"]), high, [*keys, "_high"])
    step = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - F.col("_part")) * F.col("_a") + F.col("_part") * F.col("_b"))
    q = both.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", step.alias("x")))).alias("q"))  # a struct for each share
    return plain(_on(some, _few(big.select(*keys)), keys, "left_anti")).unionByName(q.select(*keys, F.transform("q", lambda s: s.x).alias("q")))

