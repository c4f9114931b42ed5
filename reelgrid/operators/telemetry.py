"""Telemetry, requests and visit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import arrange, running_sum, sequence, settle

HISTORY = 128
KEEP, BLEND = 0.85, 0.15


def nearest_rank(values: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Element ceil(p * n) of the sorted values, exact, for each named p.

    Values are counted per distinct value first, so a frequent value is one row.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    o = arrange(counted, tuple(keys), (value,))
    o = settle(running_sum(o, F.col("_c"), "_upto"))
    total = o.df.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    rows = o.plain().join(total, keys)
    wanted = [
        F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.lit(p) * F.col("_n")), F.lit(1)), F.col(value))).alias(name)
        for name, p in ranks.items()
    ]
    return rows.groupBy(*keys).agg(*wanted)


def telemetry_summary(log: DataFrame) -> DataFrame:
    """Cache hit percentage, evictions, delivered and dropped frames and last seek per session.

    The log has one row per observation: session_id, seq, metric, value.
    """
    def total(metric: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0.0))

    hits, misses = total("hit"), total("miss")
    seeks = F.when(F.col("metric") == "seek", F.col("seq"))
    return log.groupBy("session_id").agg(
        F.when(hits + misses > 0, hits * 100.0 / (hits + misses)).otherwise(0.0).alias("hit_percent"),
        total("eviction").alias("evictions"),
        total("delivered").alias("delivered"),
        total("dropped").alias("dropped"),
        F.max(F.when(F.col("metric") == "seek", F.struct("seq", "value"))).getField("value").alias("last_seek"),
    )


def latest_request(requests: DataFrame, keys: list[str], generation: str = "generation") -> DataFrame:
    """The request of the highest generation per key; older ones are dropped."""
    body = [c for c in requests.columns if c not in keys]
    order = F.struct(generation, *[c for c in body if c != generation])
    return requests.groupBy(*keys).agg(F.max_by(F.struct(*body), order).alias("_r")).select(*keys, "_r.*")


def decode_rate(log: DataFrame, key: str = "session_id", seq: str = "seq", seconds: str = "seconds") -> DataFrame:
    """Smoothed rate per session: 0.85 old + 0.15 new, seeded with the first observation.

    The recursion is unrolled to weights 0.85^k, so it is an ordinary sum: the weight of a value
    depends only on its distance from the end, and values more than a few thousand observations
    back weigh exactly 0 in double precision.
    """
    valid = log.where(F.col(seconds) > 0).select(key, seq, (1.0 / F.col(seconds)).alias("_rate"))
    o = settle(sequence(arrange(valid, (key,), (seq,)), names=("_i", "", "")))
    count = o.df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = o.plain().join(count, key)
    age = (F.col("_n") - 1 - F.col("_i")).cast("double")
    weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(BLEND)) * F.pow(F.lit(KEEP), age)
    return rows.groupBy(key).agg(
        F.sum(F.col("_rate") * weight).alias("rate"), F.max("_n").alias("observations")
    )


def recent_visits(visits: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Newest distinct visits per user: consecutive repeats collapse to their last row.

    Two rows repeat each other when they share a session serial, or an index, or else time and pts.
    """
    fields = ["serial", "presentation_index", "pt_ns", "pts", "media_id"]
    o = arrange(visits.where(F.col("pt_ns").isNotNull()), ("user_id",), ("seq",))
    o = sequence(o, fields, pos=False, next=True)
    n = F.col("_next")
    both_indexed = F.coalesce((F.col("presentation_index") >= 0) & (n["presentation_index"] >= 0), F.lit(False))
    same_serial = F.coalesce((F.col("serial") != 0) & (F.col("serial") == n["serial"]), F.lit(False))
    same = same_serial | F.when(both_indexed, F.col("presentation_index") == n["presentation_index"]).otherwise(
        (F.col("pt_ns") == n["pt_ns"]) & F.col("pts").eqNullSafe(n["pts"])
    )
    same = F.coalesce(same & F.col("media_id").eqNullSafe(n["media_id"]), F.lit(False))
    kept = settle(o.to(o.df.where(~same).drop("_next")))
    kept = sequence(kept, names=("_n", "", ""))
    total = kept.df.groupBy("user_id").agg((F.max("_n") + 1).alias("_total"))
    return (
        kept.plain().join(total, "user_id")
        .withColumn("recency", F.col("_total") - F.col("_n"))
        .where(F.col("recency") <= max(1, keep))
        .drop("_n", "_total")
    )
