"""The heat ledger as a stream: keyed state that is charged and cools, verdicts per batch, and watermarked sums."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.functions import fixed
from emberline.sources.lineage import place

HALF_LIFE_S = fixed.HALF_LIFE_HOURS * 3600


def ladder(ready: Column, baseline: Column, version: Column, checkout: Column) -> Column:
    """What a sync does before any verdict."""
    return F.when(~ready & baseline.isNull(), "indexing").when(baseline.isNull(), "established").when(baseline == version, "unchanged").when(checkout, "rebased").otherwise("verdict")


def charge(m: float, at: float, mass: float, now: float) -> tuple[float, float, float]:
    """Surprise of a mass at now, and the entry (m, t) after it is charged."""
    held = m * 0.5 ** (max(0.0, now - at) / HALF_LIFE_S)
    return max(0.0, mass - held), max(held, mass), now


def fold(rows: pd.DataFrame, m: float, at: float) -> tuple[list[float], float, float]:
    out = []
    for mass, now in zip(rows["mass"], rows["at"].astype("int64") / 1e9, strict=True):
        delta, m, at = charge(m, at, float(mass), float(now))
        out.append(delta)
    return out, m, at


RESULT, STATE = "key string, at timestamp, mass double, surprise double", "m double, t double"


def _stateful(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m, at = state.get if state.exists else (0.0, 0.0)
    rows = pd.concat(list(batches)).astype({"at": "datetime64[ns]"}).sort_values("at")
    deltas, m, at = fold(rows, m, at)
    state.update((m, at))
    yield pd.DataFrame({"key": key[0], "at": rows["at"], "mass": rows["mass"], "surprise": deltas})


def ledger_stream(charges: DataFrame) -> DataFrame:
    """key, at, mass, surprise of a stream of charges (key, at, mass): each key's entry is state."""
    return charges.groupBy("key").applyInPandasWithState(_stateful, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def ledger_batch(charges: DataFrame) -> DataFrame:
    """The same over a table: what the stream gives, if each key's rows come in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.astype({"at": "datetime64[ns]"}).sort_values("at")
        return rows.assign(surprise=fold(rows, 0.0, 0.0)[0])[["key", "at", "mass", "surprise"]]

    return charges.select("key", "at", "mass").groupBy("key").applyInPandas(run, RESULT)


def hourly(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Sums by event type and hour of a stream of events (ts, event_type, value), late rows beyond the delay dropped."""
    x = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return x.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("mass")).select("w.start", "event_type", "n", "mass")


def drained(rows: DataFrame, mode: str, what: str) -> DataFrame:
    """What a stream gives when it is run to the end of what is there now: each batch is written under its number (in
    complete mode each replaces the one before), so that a batch that comes again after a failure counts once."""
    spark = rows.sparkSession
    home = place(spark, what)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/{'all' if mode == 'complete' else number}")

    run = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    try:
        return spark.read.schema(rows.schema).parquet(f"{home}/out/*")
    except AnalysisException:  # there was no batch
        return spark.createDataFrame([], rows.schema)


def verdict_stream(changes: DataFrame, decide, path: str):
    """A started query that runs decide(batch, id) on each micro-batch of changes, once for what is there. decide must be
    idempotent in id: a batch may come again after a failure."""
    return changes.writeStream.foreachBatch(decide).option("checkpointLocation", path).trigger(availableNow=True).start()
