"""Corpus planning, coverage, validation and resumption."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.num import share
from ..sources.scratch import settle, written


def year_grid(ids: DataFrame, first: int, last: int) -> DataFrame:
    """Every id in every year."""
    return ids.distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def dense_counts(rows: DataFrame, keys: list[str], filters: dict[str, Column], first: int, last: int) -> DataFrame:
    """Counts of nested filters for each entity and year, zero where there is none. rows has a column year."""
    counts = rows.groupBy(*keys, "year").agg(*(F.count_if(c).alias(name) for name, c in filters.items()))
    grid = year_grid(rows.select(*keys), first, last)
    return grid.join(counts, [*keys, "year"], "left").na.fill(0, list(filters))


def annual_coverage(counts: DataFrame, keys: list[str], value: str, target: int) -> DataFrame:
    v = F.col(value)
    return counts.groupBy(*keys).agg(F.sum(v).alias("total"), F.count_if(v > 0).alias("n_years"), F.count_if(v >= target).alias("n_years_at_target"), F.min(v).alias("least"), F.median(v).alias("median"))


def sample_plan(counts: DataFrame, value: str, target: int, factor: float, limit: int = 10000) -> DataFrame:
    """What to take of each cell, by which method, and how many to ask for first."""
    have = F.greatest(F.col(value), F.lit(0))
    planned = F.least(have, F.lit(target))
    method = F.when(have <= 0, "skip").when(have <= target, "download_all").otherwise("sample")
    first = F.when(method == "sample", F.least(have, F.ceil(planned * factor), F.lit(limit))).otherwise(planned)
    return counts.select(*counts.columns, planned.cast("long").alias("planned"), method.alias("method"), first.cast("long").alias("first_request"))


def redistribute(counts: DataFrame, key: str, value: str, total: int, per_year: int) -> DataFrame:
    """Quotas that reach the total: what scarce years lack goes evenly to years with room, the rest to the earliest.

    An entity has one row for each year, so its rows are few.
    """
    kind = counts.schema[key].dataType.simpleString()

    def run(frame):
        frame = frame.sort_values("year")
        have = [max(int(v), 0) for v in frame[value]]
        quota = [min(v, per_year) for v in have]
        left = total - sum(quota)
        while left > 0 and (room := [i for i, v in enumerate(have) if v > quota[i]]):
            step = max(1, min(left // len(room), min(have[i] - quota[i] for i in room)))
            for i in room[:left]:
                quota[i] += step
            left = total - sum(quota)
        return frame[[key, "year", value]].assign(quota=quota)

    return counts.select(key, "year", F.col(value).cast("long").alias(value)).groupBy(key).applyInPandas(run, f"{key} {kind}, year int, {value} long, quota long")


def eligibility(n: Column, main: int = 2500, least: int = 500) -> Column:
    return F.struct((n >= main).alias("main"), (n >= least).alias("robust"), F.when(n >= main, "main").when(n >= least, "robustness_only").otherwise("too_small").alias("reason"))


def coverage(plan: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Planned against present by cell, with the shortfall."""
    n = have.groupBy(*keys).agg(F.count("*").alias("present"))
    out = plan.join(n, keys, "left").withColumn("present", F.coalesce("present", F.lit(0)))
    short = F.greatest(F.lit(0), F.col("planned") - F.col("present"))
    return out.select(*keys, "planned", "present", short.alias("shortfall"), share(F.col("present"), F.col("planned")).alias("coverage"))


def labels(df: DataFrame, id_: str, name: str, *parents: str) -> DataFrame:
    """`id | parents / name` labels, blanks as Unknown, and whether other ids have the name."""
    clean = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("Unknown"))
    ids = df.groupBy(F.col(name).alias("same")).agg((F.count_distinct(id_) > 1).alias("repeated"))
    text = F.concat_ws(" | ", F.col(id_).cast("string"), F.concat_ws(" / ", *(clean(c) for c in (*parents, name))))
    return df.join(ids, F.col(name).eqNullSafe(F.col("same"))).select(id_, text.alias("label"), "repeated")


def token_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\b\w+\b")), F.lit(0))


@F.arrow_udf(returnType=T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def _spots(lists: pa.Array) -> pa.Array:
    """word -> positions of each list of words; NULL for a NULL list."""
    keys, spots, counts, starts = [], [], [np.zeros(1, np.int32)], [0]
    for words in lists:
        own: dict[str, list[int]] = {}
        for p, w in enumerate(words.as_py() or ()):
            own.setdefault(w, []).append(p)
        keys.append(pa.array(own, pa.string()))
        spots.append(pa.array([p for ps in own.values() for p in ps], pa.int32()))
        counts.append(np.array([len(ps) for ps in own.values()], np.int32))
        starts.append(starts[-1] + len(own))
    values = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts), dtype=np.int32)), pa.concat_arrays([pa.array([], pa.int32()), *spots]))
    at = [None if v else s for s, v in zip(starts, lists.is_null().to_pylist())] + starts[-1:]
    return pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.concat_arrays([pa.array([], pa.string()), *keys]), values)


def inverted_index(df: DataFrame, id_: str, text: str) -> DataFrame:
    """id and index (word -> positions) of each row's text, made where the row is: no word is shuffled."""
    return df.select(id_, _spots(F.split(text, " ")).alias("index"))


def rebuilt(index) -> Column:
    """The text of an inverted index; NULL where it is empty or positions repeat, are negative or leave a gap."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    p = F.transform(spots, lambda s: s.p)
    whole = (F.size(p) > 0) & (F.array_min(p) == 0) & (F.size(F.array_distinct(p)) == F.size(p)) & (F.array_max(p) == F.size(p) - 1)
    return F.when(whole, F.array_join(F.transform(F.array_sort(spots), lambda s: s.w), " "))


def quality_counters(df: DataFrame, checks: dict[str, Column], id_: str) -> DataFrame:
    """One row of defect counters, repeats of the id among them, and whether any is positive."""
    out = df.agg(F.count("*").alias("n_rows"), (F.count(id_) - F.count_distinct(id_)).alias("duplicates"), *(F.count_if(c).alias(k) for k, c in checks.items()))
    bad = F.col("duplicates") > 0
    for k in checks:
        bad = bad | (F.col(k) > 0)
    return out.withColumn("failed", bad)


def pending(plan: DataFrame, manifest: DataFrame, keys: list[str], done: tuple[str, ...]) -> DataFrame:
    return plan.join(manifest.where(F.col("status").isin(*done)).select(*keys).distinct(), keys, "left_anti")


TAIL = 1 << 16  # rows that one task decides in order


def _in_order(per_entity: int):
    """Decides rows in their order, after the counts of what was accepted before each of them."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_o", "ascending")])
        ids, cells, entities, plans, before, others = (group.column(c).to_pylist() for c in ("_id", "_cell", "_entity", "_plan", "_cell_ok", "_entity_ok"))
        seen, in_cell, in_entity, out = set(), {}, {}, []
        for i, c, e, p, b, o in zip(ids, cells, entities, plans, before, others, strict=True):
            ok = i not in seen and in_cell.get(c, 0) + b < p and in_entity.get(e, 0) + o < per_entity
            out.append(ok)
            if ok:
                seen.add(i)
                in_cell[c], in_entity[e] = in_cell.get(c, 0) + 1, in_entity.get(e, 0) + 1
        return pa.table({"_o": group.column("_o"), "_done": out})

    return run


def _decided(rows: DataFrame, per_entity: int, tail: int, by_cell: list[str]) -> DataFrame:
    """The accepted ones of rows(_o, _id, _cell, _entity, _plan), by rounds over all rows at once.

    A round counts for each open row what was accepted before it in its cell and entity, and what was accepted or is
    open. The first open row of an id enters where even the second count leaves room, and ends the id's later rows; a row
    whose first count leaves none is out. What few rows are left, or the earliest ones where a round decided little, are
    decided in order by one task of `tail` rows, so each round decides as many at least.
    """
    own, cell, entity = (Window.partitionBy(*c).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1) for c in (["_id"], by_cell, ["_entity"]))
    cols = ["_o", "_id", "_cell", "_entity", "_plan"]
    live, n = rows.withColumn("_ok", F.lit(False)), None
    while True:
        seen = live.withColumns({"_entity_ok": F.count_if("_ok").over(entity), "_entity_all": F.count(F.lit(1)).over(entity)})
        seen = seen.withColumns({"_cell_ok": F.count_if("_ok").over(cell), "_cell_all": F.count(F.lit(1)).over(cell)})  # no further shuffle where a cell is of one entity
        room = (F.col("_cell_all") < F.col("_plan")) & (F.col("_entity_all") < per_entity)
        none = ~F.col("_ok") & ((F.col("_cell_ok") >= F.col("_plan")) | (F.col("_entity_ok") >= per_entity))
        seen = seen.withColumn("_may", F.when(~none, F.col("_ok") | room))  # NULL: out, and no hindrance to later rows of the id
        seen = seen.withColumns({"_before": F.count("_may").over(own), "_in": F.coalesce(F.first("_may", ignorenulls=True).over(own), F.lit(False))})
        kept = seen.where(F.col("_may").isNotNull() & ~F.col("_in"))
        live = written(kept.select(*cols, (F.col("_ok") | (F.col("_may") & (F.col("_before") == 0))).alias("_ok")))
        last, n = n, live.where("not _ok").count()
        if not n:
            return live.where("_ok").select(*cols)
        if n <= tail or (last is not None and n > 0.9 * last):
            count = live.withColumns({"_cell_ok": F.count_if("_ok").over(cell), "_entity_ok": F.count_if("_ok").over(entity)}).where("not _ok").orderBy("_o").limit(tail)
            kind = rows.schema["_o"].dataType.simpleString()
            done = written(count.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_in_order(per_entity), f"_o {kind}, _done boolean"))
            live = written(live.join(done, "_o", "left").where("_ok OR _done IS NULL OR _done").select(*cols, (F.col("_ok") | F.coalesce("_done", F.lit(False))).alias("_ok")))
            if n <= tail:
                return live.where("_ok").select(*cols)


def accept(rows: DataFrame, id_: str, cell: list[str], entity: str, order: list[str], plan: DataFrame | int, per_entity: int, *, tail: int = TAIL) -> DataFrame:
    """rows with `decision`, as an acceptance in order of arrival makes it: accepted, repeated, cell_full or entity_full.

    An id counts as seen only once it was accepted, so one that a full cell refused may enter another. plan has the
    number of rows of each cell (columns of cell, and planned), or is one number for all. Ties of order go by id and cell.

    Where ids stand in several cells, rounds over all rows decide (see _decided): no task holds more of what ids join than
    `tail` rows.
    """
    cols = rows.columns
    planned = F.lit(plan) if isinstance(plan, int) else F.coalesce("planned", F.lit(0))
    r = rows if isinstance(plan, int) else rows.join(plan.select(*cell, "planned"), cell, "left")
    r = r.select(*cols, F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate([*order, id_, *cell]))).alias("_o"), F.col(id_).alias("_id"), F.concat_ws("\u0001", *cell).alias("_cell"), F.col(entity).alias("_entity"), planned.cast("long").alias("_plan"))
    if not r.groupBy("_id").agg((F.min("_cell") != F.max("_cell")).alias("_many")).where("_many").limit(1).count():
        return in_own_cells(r, cols, per_entity)
    taken = _decided(r.select("_o", "_id", "_cell", "_entity", "_plan"), per_entity, tail, ["_entity", "_cell"] if entity in cell else ["_cell"])
    when = taken.select(F.col("_id").alias("_in"), F.col("_o").alias("_when"))  # an id enters once
    full = taken.groupBy(F.col("_cell").alias("_c")).agg(F.count("*").alias("_n"))
    out = r.join(when, F.col("_id").eqNullSafe(F.col("_in")), "left").join(full, F.col("_cell") == F.col("_c"), "left")
    decision = F.when(F.col("_when") == F.col("_o"), "accepted").when(F.col("_when") < F.col("_o"), "repeated").when(F.coalesce("_n", F.lit(0)) >= F.col("_plan"), "cell_full").otherwise("entity_full")
    return out.select(*cols, decision.alias("decision"))


def in_own_cells(r: DataFrame, cols: list[str], per_entity: int) -> DataFrame:
    """The decisions of accept where each id stands in one cell, by windows alone: no row's fate hangs on another cell's."""
    own, cell, entity = (Window.partitionBy(c) for c in ("_id", "_cell", "_entity"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    out = r.withColumn("_first", F.row_number().over(own.orderBy("_o")) == 1)
    out = out.withColumn("_fits", F.col("_first") & (F.count_if("_first").over(cell.orderBy("_o").rowsBetween(*so_far)) <= F.col("_plan")))
    out = out.withColumn("_ok", F.col("_fits") & (F.count_if("_fits").over(entity.orderBy("_o").rowsBetween(*so_far)) <= per_entity))
    out = out.withColumns({"_full": F.count_if("_ok").over(cell) >= F.col("_plan"), "_in": F.max("_ok").over(own)})
    decision = F.when(F.col("_ok"), "accepted").when(F.col("_in") & ~F.col("_first"), "repeated").when(F.col("_full"), "cell_full").otherwise("entity_full")
    return out.select(*cols, decision.alias("decision"))


def balanced(rows: DataFrame, group: str, id_: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows of each group, drawn by a hash of seed and id: any order and partitioning gives the same."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), id_), id_)
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def describe_counts(df: DataFrame, value: str) -> DataFrame:
    q = F.percentile(value, F.array(*map(F.lit, (0.0, 0.05, 0.5, 0.95, 1.0))))
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q")).select("n", "mean", "std", *(F.col("q")[i].alias(k) for i, k in enumerate(("least", "p05", "median", "p95", "most"))))


def window_sum(counts: DataFrame, keys: list[str], first: int, last: int, value: str, name: str) -> DataFrame:
    """Sum of a value over a range of years by keys."""
    return counts.where(F.col("year").between(first, last)).groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def work_checks(first: int, last: int, language: str, kinds: list[str], title_least: int = 5, body_least: int = 80) -> dict[str, Column]:
    """The counters of a table of works, by their names; all but the first two are critical."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    year = F.col("year")
    return {
        "after_window": F.coalesce(year > last, F.lit(False)), "before_window": F.coalesce(year < first, F.lit(False)), "outside_window": ~F.coalesce(year.between(first, last), F.lit(False)),
        **{f"missing_{c}": blank(c) for c in ("work_id", "l1", "l2", "l3", "topic_id", "topic", "topics_json", "title", "body")},
        "unparsable_topics": F.try_parse_json("topics_json").isNull(), "short_title": ~F.coalesce(token_count("title") >= title_least, F.lit(False)), "short_body": ~F.coalesce(token_count("body") >= body_least, F.lit(False)),
        "other_language": ~F.coalesce(F.col("language") == language, F.lit(False)), "other_kind": ~F.coalesce(F.col("kind").isin(kinds), F.lit(False)),
    }


def downgraded(manifest: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """The manifest with the rows that are kept now; completed cells that have fewer than planned become partial."""
    n = have.groupBy(*keys).agg(F.count("*").alias("_kept"))
    out = manifest.join(n, keys, "left").withColumn("kept", F.coalesce("_kept", F.lit(0))).drop("_kept")
    return out.withColumn("status", F.when((F.col("status") == "completed") & (F.col("kept") < F.col("planned")), "partial").otherwise(F.col("status")))


def backfilled(plan: DataFrame, keys: list[str], fetch: Callable[[DataFrame, int], DataFrame], take: Callable[[DataFrame], DataFrame], request: Callable[[DataFrame, int], DataFrame], rounds: int) -> tuple[DataFrame, list[int]]:
    """Rounds of asking for what cells still lack, until none lacks rows, a round adds none, or `rounds` are over.

    fetch(requests, round) gives rows for cells, take(rows) the accepted ones of all rows so far, request(coverage, round)
    what to ask of cells that fell short. The accepted rows, and how many there were after each round.
    """
    asked, rows, sizes = request(coverage(plan, plan.limit(0), keys), 0), None, []
    for i in range(rounds + 1):
        new = fetch(asked, i)
        rows = settle(new if rows is None else rows.unionByName(new))
        kept = settle(take(rows))
        sizes.append(kept.count())
        short = coverage(plan, kept, keys).where("shortfall > 0")
        if not short.limit(1).count() or (len(sizes) > 1 and sizes[-1] == sizes[-2]):
            break
        asked = request(short, i + 1)
    return kept, sizes
