"""Similar frames by perceptual hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scores import hamming

MAX_RESULTS = 48
MAX_DISTANCE = 24
# A band search needs a table of radius + 1 bands, each of several bits, to prune anything.
BAND_RADIUS = 7
# Beyond it, blocks of so many queries and samples of a media meet in one task, so many queries at once.
BLOCK_ROWS = 8192
QUERIES_AT_ONCE = 128
SALTS = 64


def _bands(value: Column, radius: int) -> Column:
    """radius + 1 disjoint bit bands; two hashes within the radius agree on at least one."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("band"),
                F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"),
            )
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    )


def find_similar(
    queries: DataFrame,
    samples: DataFrame,
    results: int = MAX_RESULTS,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """The nearest hashes of each query frame inside its media: by distance, then closeness in
    time, then time. The query's own frame is left out.

    queries: query_id, media_id, q_hash, q_time, q_index. Small radii join on bit bands and rank per salt
    first, so a query that matches most of its media never reaches one task whole. A wide radius has to
    look at every sample of the media: every block of queries meets every block of samples, and a
    pair of blocks gives the nearest of each query only, so no matching pair becomes a row beyond them.
    """
    s = samples.where(F.col("perceptual_hash").isNotNull()).select(
        "media_id", "pt_ns", "presentation_index", "perceptual_hash"
    )
    q = queries.where(F.col("q_hash").isNotNull())
    order = [
        "hamming", F.abs(F.col("pt_ns") - F.col("q_time")), "pt_ns",
        F.col("presentation_index").asc_nulls_first(),
    ]
    local = _band_hits(q, s, results, distance, order) if distance <= BAND_RADIUS else _block_hits(q, s, results, distance)
    whole = Window.partitionBy("query_id").orderBy(*order)
    ranked = local.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= results)
    one, bits = F.lit(1.0).cast("float"), F.lit(64.0).cast("float")
    return ranked.select(
        "query_id", "media_id", "rank", "pt_ns", "presentation_index", "hamming",
        (one - (F.col("hamming").cast("float") / bits).cast("float")).cast("float").alias("similarity"),
    )


def _band_hits(q: DataFrame, s: DataFrame, results: int, distance: int, order: list) -> DataFrame:
    s = s.withColumn("_salt", F.pmod(F.xxhash64("pt_ns", "presentation_index"), F.lit(SALTS)))
    pairs = _band_join(q, s, distance)
    near = hamming(F.col("q_hash"), F.col("perceptual_hash")) <= distance
    index_known = (F.col("q_index") >= 0) & (F.col("presentation_index") >= 0)
    own = F.when(
        F.coalesce(index_known, F.lit(False)), F.col("presentation_index") == F.col("q_index")
    ).otherwise(F.col("pt_ns") == F.col("q_time"))
    hits = pairs.where(near & ~F.coalesce(own, F.lit(False))).withColumn(
        "hamming", hamming(F.col("q_hash"), F.col("perceptual_hash"))
    )
    parts = Window.partitionBy("query_id", "_salt").orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(parts)).where(F.col("_r") <= results)


def _block_hits(q: DataFrame, s: DataFrame, results: int, distance: int) -> DataFrame:
    """The nearest ``results`` of each query in every block of its media's samples."""
    count = lambda df, name: df.groupBy("media_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    blocks = count(s, "_ns").join(count(q, "_nq"), "media_id")
    place = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = s.join(blocks, "media_id").select(*s.columns, place("_ns", "pt_ns", "presentation_index").alias("_sb"), every("_nq").alias("_qb"))
    names = ["query_id", "q_hash", "q_time", "q_index"]
    # Under another name, as queries are often made of the samples.
    right = q.join(blocks, "media_id").select(F.col("media_id").alias("_media"), *names, place("_nq", "query_id", "q_time").alias("_qb"), every("_ns").alias("_sb"))
    kept = {"query_id": q, "q_time": q, "media_id": s, "pt_ns": s, "presentation_index": s}
    schema = StructType([StructField(c, df.schema[c].dataType) for c, df in kept.items()] + [StructField("hamming", IntegerType())])
    meet = lambda samples, queries: _nearest(samples, queries, results, distance)
    return left.groupBy("media_id", "_sb", "_qb").cogroup(right.groupBy("_media", "_sb", "_qb")).applyInArrow(meet, schema)


def _nearest(samples: pa.Table, queries: pa.Table, results: int, distance: int) -> pa.Table:
    """The nearest of all samples to each query, in the order of ``find_similar``; absent values come first."""
    whole = lambda table, c: pc.fill_null(table.column(c).cast(pa.int64()), -(2**63)).to_numpy()
    known = lambda table, c: table.column(c).is_valid().to_numpy()
    hashes, wanted = whole(samples, "perceptual_hash").view(np.uint64), whole(queries, "q_hash").view(np.uint64)
    times, index, timed = whole(samples, "pt_ns"), whole(samples, "presentation_index"), known(samples, "pt_ns")
    q_times, q_index, q_timed = whole(queries, "q_time"), whole(queries, "q_index"), known(queries, "q_time")
    found = [np.zeros((3, 0), np.int64)]
    for a in range(0, len(wanted) if len(hashes) else 0, QUERIES_AT_ONCE):
        at = slice(a, a + QUERIES_AT_ONCE)
        apart = np.bitwise_count(wanted[at, None] ^ hashes)
        own = index == q_index[at, None]
        if (index < 0).any() or (q_index[at] < 0).any():
            same_time = (times == q_times[at, None]) & timed & q_timed[at, None]
            own = np.where((index >= 0) & (q_index[at, None] >= 0), own, same_time)
        apart[own] = 65
        limit = np.full(len(apart), min(distance, 64))
        if len(hashes) > results:
            limit = np.minimum(limit, np.partition(apart, results - 1, axis=1)[:, results - 1])
        row, column = np.nonzero(apart <= limit[:, None])
        both = timed[column] & q_timed[a + row]
        gap = np.where(both, np.abs(np.where(both, times[column], 0) - np.where(both, q_times[a + row], 0)), -1)
        order = np.lexsort((index[column], times[column], gap, apart[row, column], row))
        row, column = row[order], column[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < results
        row, column = row[best], column[best]
        found.append(np.stack([row + a, column, apart[row, column]]))
    query, sample, apart = np.concatenate(found, axis=1)
    columns = {c: queries.column(c).take(query) for c in ("query_id", "q_time")} | {c: samples.column(c).take(sample) for c in ("media_id", "pt_ns", "presentation_index")}
    return pa.table(columns | {"hamming": pa.array(apart, pa.int32())})


def _band_join(q: DataFrame, s: DataFrame, radius: int) -> DataFrame:
    """Pairs that agree on at least one band, each once."""
    left, right = F.col("q_hash"), F.col("perceptual_hash")
    qb = q.withColumn("_b", F.explode(_bands(left, radius)))
    sb = s.withColumn("_b", F.explode(_bands(right, radius)))
    pairs = qb.join(sb, ["media_id", "_b"])
    # A pair may meet on several bands; it counts on its first equal one.
    differing = _bands(left.bitwiseXOR(right), radius)
    first = F.get(F.filter(differing, lambda b: b["bits"] == 0), F.lit(0))["band"]
    return pairs.where(F.col("_b.band") == first).drop("_b")
