"""Streams: tumbling windows with late data, and acceptance in order of arrival with a cap by cell."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import shared_folder


def tumbling(events: DataFrame, length: str = "5 days", late: str | None = None) -> DataFrame:
    """Count and sum by window and type; batch tables and streams alike."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


STATE = "users array<string>, types array<string>, ids array<array<long>>"


def _taker(most: int):
    """Accepts in order of arrival for all cells of a bucket, whose state is the ids that each cell holds."""

    def run(key, frames, state: GroupState):
        held = {(u, t): list(ids) for u, t, ids in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        for f in frames:
            f = f.sort_values(["ts", "event_id"])
            for u, t, i in zip(f["user_id"], f["event_type"], f["event_id"], strict=True):
                own = held.setdefault((u, t), [])
                if len(own) < most and i not in own:
                    own.append(int(i))
                    out.append((u, t, int(i)))
        state.update(([u for u, _ in held], [t for _, t in held], list(held.values())))
        yield pd.DataFrame({"user_id": pd.Series([o[0] for o in out], dtype=object), "event_type": pd.Series([o[1] for o in out], dtype=object), "event_id": pd.Series([o[2] for o in out], dtype="int64")})

    return run


def accepted(events: DataFrame, most: int, *, buckets: int = 1 << 12) -> DataFrame:
    """Events of a stream, each id of a cell (user, type) once, up to `most` by cell, whenever it comes.

    A cell's state is its accepted ids, `most` at most, and stays, as a cap without an end asks for: late and repeated
    events are refused however late they are. Cells share `buckets` keys by their hash, as a call of Python for each
    cell takes much longer than its rows; a bucket's state is the cells that fall into it.
    """
    bucket = F.pmod(F.xxhash64("user_id", "event_type"), F.lit(buckets)).alias("bucket")
    rows = events.select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type", "ts", bucket)
    out = rows.groupBy("bucket").applyInPandasWithState(_taker(most), "user_id string, event_type string, event_id long", STATE, "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("user_id").cast("long").alias("user_id"), "event_type", "event_id")


def finished(stream: DataFrame) -> DataFrame:
    """What a stream gives for all data that is there now, from a table in the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
