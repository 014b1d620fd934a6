"""A detail queue worked off: claims, fetches on the executors, and what becomes of details and of the queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import paging
from ..storage import written

#: What a fetch gives: ok with a payload, gone, or anything else (an error, with its message).
Fetch = Callable[[object], tuple[str, str | None]]


def reclaimed(queue: DataFrame, now: str, minutes: int) -> DataFrame:
    """Claims that are older than ``minutes`` are open again: who held them is taken to be lost."""
    stale = F.col("claimed_at") <= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))
    return queue.withColumn("claimed_at", F.when(~F.coalesce(stale, F.lit(False)), F.col("claimed_at")))


def drained(queue: DataFrame, fetch: Fetch, limit: int, most_attempts: int = 5, tasks: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Works on the next ``limit`` open rows of a queue (id, priority, enqueued_at, attempts, claimed_at): (details (id, payload),
    gone (id), the queue afterwards).

    Details and gone rows leave the queue; a failure stays, with one more attempt and ``last_error``. A fetch that raises is
    a failure. Claims are written before and outcomes after the fetches, so nothing is fetched anew when a result is read; a
    lost executor repeats its own task's fetches, which the caller's fetch must bear. ``tasks`` bounds how many fetch at once.
    """
    kind = queue.schema["id"].dataType

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i in part["id"].tolist():
                try:
                    outcome, said = fetch(i)
                except Exception as e:  # noqa: BLE001 - a page that can't be had is an outcome
                    outcome, said = "error", repr(e)
                out.append((i, outcome if outcome in ("ok", "gone") else "error", said))
            yield pd.DataFrame(out, columns=["id", "outcome", "said"])

    claims = written(paging.claim_queue(queue, limit, most_attempts).select("id"), "claims")
    schema = T.StructType([T.StructField("id", kind), T.StructField("outcome", T.StringType()), T.StructField("said", T.StringType())])
    done = written(claims.repartition(tasks).mapInPandas(work, schema), "fetched")
    details = done.where("outcome = 'ok'").select("id", F.col("said").alias("payload"))
    gone = done.where("outcome = 'gone'").select("id")
    failed = done.where("outcome = 'error'").select("id", F.col("said").alias("_said"), F.lit(1).alias("_again"))
    rest = queue.join(done.where("outcome <> 'error'").select("id"), "id", "left_anti").join(failed, "id", "left")
    old = F.col("last_error") if "last_error" in queue.columns else F.lit(None).cast("string")
    after = rest.withColumn("attempts", F.col("attempts") + F.coalesce("_again", F.lit(0))).withColumn("last_error", F.coalesce("_said", old)).drop("_again", "_said")
    return details, gone, after
