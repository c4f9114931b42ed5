"""Running a streaming job over a bounded set of arrivals, resuming from its checkpoint each time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .stateful import PROVIDER

# Joins keep one store a task instead of four.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def replay(
    parts: Iterable[DataFrame], job: Callable[[DataFrame], DataFrame], mode: str = "append"
) -> DataFrame:
    """Feed ``parts`` one after the other to ``job`` and return what it emitted, with the batch.

    Every arrival is written to the source folder and processed by a run of the same query from
    the same checkpoint, so state carries over as in a long-running job.
    """
    source = sink = state = None
    spark: SparkSession | None = None
    for part in parts:
        if spark is None:
            spark = part.sparkSession
            source, sink, state = (scratch(spark, n) for n in ("source", "sink", "state"))
        part.write.mode("append").parquet(source)
        before = {k: spark.conf.get(k, None) for k in SETTINGS}
        for k, value in SETTINGS.items():
            spark.conf.set(k, value)
        try:
            stream = spark.readStream.schema(part.schema).parquet(source)

            def write(rows: DataFrame, batch: int) -> None:
                rows.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

            run = (
                job(stream)
                .writeStream.outputMode(mode)
                .option("checkpointLocation", state)
                .trigger(availableNow=True)
                .foreachBatch(write)
                .start()
            )
            run.awaitTermination()
        finally:
            for k, value in before.items():
                spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    return spark.read.option("basePath", sink).parquet(f"{sink}/batch=*")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Final rows of an update-mode job: the last batch per key."""
    body = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*body), "batch").alias("_r")).select(*keys, "_r.*")
