"""Incremental maintenance with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import folder


def drained(stream: DataFrame, label: str, mode: str = "append", keep: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is and returns what it wrote. ``keep``: for update mode, the key of which only the
    newest row stays."""
    spark = stream.sparkSession
    path, check = folder(spark, label), folder(spark, f"{label}-offsets")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/_b={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if _any(spark, path) else spark.createDataFrame([], schema)
    if keep:
        from pyspark.sql import Window

        out = out.withColumn("_rn", F.row_number().over(Window.partitionBy(*keep).orderBy(F.desc("_batch")))).where("_rn = 1").drop("_rn")
    return out.drop("_batch")


def _any(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def events(spark: SparkSession, path: str, schema: T.StructType | str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once_ever(stream: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key, ever (no horizon; state grows with the keys)."""
    return stream.dropDuplicates(keys)


def once_within(stream: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """A row per key within the watermark's horizon; state is bounded by it."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, at: str, size: str, keys: list[str], late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window (an extension); with ``slide`` the windows overlap."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], late: str) -> DataFrame:
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("session_start"), *keys, "n")


def _rows(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(parts)
    return pd.concat(parts) if parts else pd.DataFrame()


def changes(stream: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Snapshot on change: rows whose value differs from the last one of their key; the state is one value a key."""
    columns = list(dict.fromkeys([key, *order, value]))
    source = stream.select(*columns)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _rows(parts).sort_values(order)
        last, known = (state.get[0], True) if state.exists else (None, False)
        keep = []
        for v in rows[value].tolist():
            keep.append(not known or v != last)
            last, known = v, True
        state.update((last,))
        yield rows[keep]

    kind = source.schema[value].dataType.simpleString()
    return source.groupBy(key).applyInPandasWithState(step, source.schema, f"last {kind}", "append", GroupStateTimeout.NoTimeout)


def drops(stream: DataFrame, key: str, order: list[str], value: str, pct: float) -> DataFrame:
    """Rows at least ``pct`` per cent below the last value of their key: columns, before and drop_pct."""
    columns = list(dict.fromkeys([key, *order, value]))
    source = stream.select(*columns)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _rows(parts).sort_values(order)
        last = state.get[0] if state.exists else None
        before = []
        for v in rows[value].tolist():
            before.append(last)
            last = v
        state.update((last,))
        rows["before"] = pd.array(before, "Float64").to_numpy("float64", na_value=float("nan"))
        rows["drop_pct"] = ((rows["before"] - rows[value]) / rows["before"] * 100).round(4)
        yield rows[(rows["drop_pct"] > 0) & (rows["drop_pct"] >= pct)]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)
    return source.groupBy(key).applyInPandasWithState(step, f"{fields}, before double, drop_pct double", "last double", "append", GroupStateTimeout.NoTimeout)


def late_release(stream: DataFrame, key: str, at: str, ready: str, hold_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Rows (key, at, ready) held per key until one says ready, or until ``hold_seconds`` after the key's first one; then released
    once, with the reason. A timer on the stream's clock (its watermark) releases a key that no further row comes for; a
    release by time is dated to the moment it was due. What is neither ready nor due when the stream ends stays held."""
    source = stream.select(key, at, ready).withWatermark(at, late)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, done = state.get if state.exists else (None, False)
        hold, released = pd.Timedelta(seconds=hold_seconds), None
        if state.hasTimedOut:
            released = (pd.Timestamp(first) + hold, "timeout")
        else:
            rows = _rows(parts).sort_values(at)
            for t, r in zip(rows[at].tolist(), rows[ready].tolist(), strict=True):
                if done or released:
                    break
                first = t if first is None else min(first, t)
                due = pd.Timestamp(first) + hold
                if t >= due:
                    released = (due, "timeout")
                elif r:
                    released = (t, "ready")
        if released and not done:
            done = True
            yield pd.DataFrame({key: [k[0]], "first_at": [first], "released_at": [released[0]], "reason": [released[1]]})
        state.update((first, done))
        if not done:
            due = pd.Timestamp(first) + hold
            # the clock may have passed it already; then the next batch's clock releases it
            state.setTimeoutTimestamp(max(int(due.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    kind = source.schema[key].dataType.simpleString()
    return source.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first_at timestamp, released_at timestamp, reason string", "first timestamp, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def recompute_dirty(stream: DataFrame, key: str, full: Callable[[DataFrame], DataFrame], history: DataFrame, target: str, offsets: str) -> None:
    """Each micro-batch's keys are recomputed from all their history by the same function that the full rebuild uses, and
    written as the batch's version; a key that comes again gets a newer version."""

    def write(batch: DataFrame, number: int) -> None:
        dirty = batch.select(key).distinct()
        full(history.join(dirty, key, "left_semi")).withColumn("_version", F.lit(number)).write.mode("overwrite").parquet(f"{target}/_b={number}")

    stream.writeStream.option("checkpointLocation", offsets).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def newest_versions(spark: SparkSession, target: str, key: str) -> DataFrame:
    from pyspark.sql import Window

    df = spark.read.option("recursiveFileLookup", "true").parquet(target)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_version")))).where("_rn = 1").drop("_rn", "_version")
