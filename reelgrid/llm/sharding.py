"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each block go to each shard follows the multivariate hypergeometric law. It is drawn
first: shard totals are split between the halves of a binary tree over the blocks, each node with its
own seed, so every block finds its own row of the matrix without seeing the others. Then each block
permutes its rows and deals them by that row, rows are exchanged, and each shard permutes again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import leave_out, numbered, parts, plainly, stored, told_apart


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts at most one apart, larger ones first."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def split_counts(totals: np.ndarray, into_left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each shard's rows fall to the left half, which holds ``into_left`` rows in all."""
    left = np.zeros_like(totals)
    need, rest = int(into_left), int(totals.sum())
    for j, n in enumerate(totals.tolist()):
        rest -= n
        left[j] = draw = hypergeometric(n, rest, need, rng)
        need -= draw
    return left


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """One draw; numpy's sampler takes fewer than 10^9 items, from larger populations it is drawn by inversion."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    first, chances = law(good, bad, draws)
    sums = np.cumsum(chances)
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def law(good: int, bad: int, draws: int, reach: float = 10.0) -> tuple[int, np.ndarray]:
    """The least outcome within ``reach`` deviations of the mode, and the chances of it and those that follow.

    From the ratios of neighbouring chances, so no factorial of the population is needed. What lies further out
    is less likely than the smallest step of a random number.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((good + 1) * (draws + 1) // (total + 2), low), high)
    spread = (draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1)) ** 0.5
    wide = int(reach * spread) + 30
    up = np.arange(mode, min(high, mode + wide), dtype=np.float64)
    down = np.arange(mode, max(low, mode - wide), -1, dtype=np.float64)
    rising = np.cumsum(np.log((good - up) * (draws - up)) - np.log((up + 1) * (bad - draws + up + 1)))
    falling = np.cumsum(np.log(down * (bad - draws + down)) - np.log((good - down + 1) * (draws - down + 1)))
    chances = np.exp(np.concatenate([falling[::-1], [0.0], rising]))
    return mode - len(falling), chances / chances.sum()


def matrix_row(totals: np.ndarray, block: int, levels: int, counts: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Rows of one block for each shard. counts: rows in (left, right) at each node from the root down."""
    for level in range(levels):
        node = block >> (levels - level)
        left, right = counts[level]
        rng = np.random.default_rng([seed, level, node])
        share = split_counts(totals, left, rng)
        totals = totals - share if (block >> (levels - level - 1)) & 1 else share
        if not totals.any():
            break
    return totals


def shard(df: DataFrame, shards: int, seed: int = 7, block_rows: int = 50_000) -> DataFrame:
    """All rows with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes are at most one apart; each assignment of rows to shards is equally likely over seeds.
    The result depends on the rows and the seed only, not on partitions, so retried tasks give the same.
    Columns may hold nulls; rows that repeat wholly are told apart by their number, and each gets its own
    slot. An empty table gives an empty one. Columns of the names ``shard`` and ``slot`` are replaced.
    Column types must be such as can be grouped by (no maps).
    """
    spark = df.sparkSession
    df, back = plainly(leave_out(df, "shard", "slot"))
    mixed, rows = told_apart(df, seed)
    block_rows = min(block_rows, max(64, rows // (8 * parts(spark)) + 1))
    levels = max(6, int(np.ceil(np.log2(max(1, rows) / block_rows))))
    sizes = shard_sizes(rows, shards)
    blocked = mixed.withColumn("_mix", F.xxhash64("_mix", "_copy")).withColumn("_block", F.pmod("_mix", F.lit(1 << levels)))
    in_block = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    # Rows on either side of every node above each block: at most `levels` rows per block.
    nodes = in_block.select("_n", "_block", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level"))
    down = F.expr(f"shiftright(_block, {levels} - _level - 1)")
    nodes = nodes.groupBy("_level", F.shiftright(down, 1).alias("_node")).agg(
        F.sum(F.when(down % 2 == 0, F.col("_n")).otherwise(0)).alias("_left"),
        F.sum(F.when(down % 2 == 1, F.col("_n")).otherwise(0)).alias("_right"),
    )
    above = (
        in_block.select("_block", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level"))
        .withColumn("_node", F.expr(f"shiftright(_block, {levels} - _level)"))
        .join(nodes, ["_level", "_node"])
        .groupBy("_block")
        .agg(F.sort_array(F.collect_list(F.struct("_level", "_left", "_right"))).alias("_path"))
    )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, path in zip(batch.column("_block").to_pylist(), batch.column("_path").to_pylist()):
                own = matrix_row(sizes, block, levels, [(p["_left"], p["_right"]) for p in path], seed)
                out.append(np.cumsum(own).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("_block"), pa.array(out, pa.list_(pa.int64()))], ["_block", "_ends"])

    matrix = above.mapInArrow(draw, "_block long, _ends array<bigint>")
    # Local permutation, then the block's rows are dealt out by its row of the matrix.
    place = F.row_number().over(Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), "_mix"), "_mix", "_copy")) - 1
    dealt = blocked.withColumn("_place", place).join(matrix, "_block")
    dealt = dealt.withColumn("shard", F.expr("size(filter(_ends, e -> e <= _place))").cast("int"))
    dealt = stored(dealt.drop("_block", "_ends", "_place"), "dealt")
    dealt = numbered(dealt, ["shard"], ["_mix", "_copy"], "slot", seed + 2)
    named = back(dealt.select(*df.columns)).columns
    return dealt.select(*df.columns, "shard", "slot").toDF(*named, "shard", "slot")
