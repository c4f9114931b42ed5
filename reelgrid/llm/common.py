"""What the operators share: exact column choice, shared storage, bounded ranking."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by exact name (first of that name), under new names; all others are left out.

    Works where other columns differ only in case or repeat a name.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*places).select(*[F.col(places[df.columns.index(old)]).alias(new) for new, old in columns.items()])


def plainly(df: DataFrame, **roles: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """All columns under names of our own, and the way back for a frame of the same columns in that order.

    ``roles``: our name for a column of the given exact name (first of that name). What the other columns
    are called, twice or in another case, does not matter in between.
    """
    names = df.columns
    own = {names.index(name): role for role, name in roles.items()}
    return df.toDF(*[own.get(i, f"c{i}") for i in range(len(names))]), lambda d: d.toDF(*names)


def leave_out(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns of exactly these names."""
    places = [f"c{i}" for i in range(len(df.columns))]
    kept = [i for i, name in enumerate(df.columns) if name not in names]
    return df.toDF(*places).select(*[places[i] for i in kept]).toDF(*[df.columns[i] for i in kept])


def forget(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote for this application. Frames that read it cannot be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its JVM with it
        forget(spark)


_watched: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as Parquet in the shared folder and read them back.

    A lost executor costs no more than the tasks it ran; nothing is kept in executor memory. The files
    of an application lie in one folder, which is deleted when its driver ends, or by ``forget``.
    """
    spark = df.sparkSession
    folder = _own_folder(spark)
    if folder not in _watched:
        _watched.add(folder)
        atexit.register(_forget_at_exit, spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about this many bytes of one column; a longer row stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at, held = 0, 0
        for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if held and held + (size or 0) > most_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size or 0
        yield batch.slice(at)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, seed: int = 0) -> DataFrame:
    """Add the gapless position (from 0) of each row in its group, in an order fixed by a hash of ``order``.

    A group may hold any share of the rows: it is cut into blocks by that hash, each block is
    ranked by itself and block offsets come from counts. No block holds more than about an eighth
    of an even share of the rows, nor more than 50,000. Rows equal in ``order`` are interchangeable.
    """
    spark = df.sparkSession
    groups = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_in_group"))
    total = F.sum("_in_group")
    rows = groups.agg(total).first()[0] or 0
    block_rows = min(50_000, max(100, rows // (8 * parts(spark)) + 1))
    spread = F.xxhash64(F.lit(seed), *order)
    keyed = df.withColumn("_spread", spread)
    # Only groups of more than one block are looked up: at most rows / block_rows of them.
    large = groups.filter(F.col("_in_group") > block_rows).select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.ceil(F.col("_in_group") / block_rows).cast("long").alias("_blocks")
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    on = same[0]
    for more in same[1:]:
        on = on & more
    if rows // block_rows < 10_000:
        large = F.broadcast(large)
    keyed = (
        keyed.join(large, on, "left")
        .withColumn("_block", F.coalesce(F.pmod(F.shiftrightunsigned("_spread", 20), F.col("_blocks")), F.lit(0)))
        .drop("_blocks", *[f"_g_{g}" for g in group])
    )
    counts = keyed.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    # One block per group needs no offset, so only groups of several blocks are joined.
    offsets = offsets.filter(F.col("_offset") > 0)
    if rows // block_rows < 10_000:
        offsets = F.broadcast(offsets)
    ranked = keyed.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*group, "_block").orderBy("_spread", *order)) - 1
    )
    return (
        ranked.join(offsets, on & (F.col("_block") == F.col("_b")), "left")
        .withColumn(name, (F.coalesce(F.col("_offset"), F.lit(0)) + F.col("_rank")).cast("long"))
        .drop("_spread", "_block", "_b", "_rank", "_offset", *[f"_g_{g}" for g in group])
    )


def placed(df: DataFrame, group: str, order: list[str], then: list[str] | None = None) -> DataFrame:
    """Add ``index`` (from 0, nulls first in ``order``) and ``total`` of each row's group (no null), as stored rows.

    Rows are sorted over all partitions by range, with a number that tells equal rows apart, so neither a
    large group nor many equal rows end in one task. Places in a partition are counted from its first row.
    ``then``: further order of rows equal in ``order``, kept out of the range bounds, which the driver holds.
    """
    kept = df.columns
    salt = [F.col("_row")]
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order]]
    last = [F.col(c).asc_nulls_first() for c in then or []]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts(df.sparkSession), *keys, *(salt if then is None else [])).sortWithinPartitions(*keys, *last, *salt)
    rows = stored(rows.select(*kept, F.monotonically_increasing_id().alias("_at")), "ordered")
    part = F.shiftright("_at", 33)
    runs = rows.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_group", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("_group")).alias("total"),
    )
    rows = rows.join(runs, (F.col(group) == F.col("_group")) & (part == F.col("_part")))
    return rows.select(*kept, (F.col("_at") + F.col("_shift")).alias("index"), "total")


def told_apart(df: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """Rows with ``_mix`` (hash of all columns) and ``_copy`` (number among wholly equal rows), and their count.

    Equal rows are counted before they are dealt out again, so none of them is a hot key; where no two
    rows are equal nothing is shuffled but hashes.
    """
    key = df.columns
    mixed = df.select("*", F.xxhash64(F.lit(seed), *key).alias("_mix"))
    like = mixed.groupBy("_mix").agg(F.count(F.lit(1)).alias("_n"))
    rows, most = like.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if most > 1:
        mixed = mixed.groupBy(*key, "_mix").agg(F.count(F.lit(1)).alias("_n"))
        mixed = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")
    else:
        mixed = mixed.withColumn("_copy", F.lit(1).cast("long"))
    return mixed, rows


def by_bitmap(df: DataFrame, key: str, ids: DataFrame, bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` may be among ``ids`` (one column), and rows whose key is not.

    A bit map of fixed size (``bits`` / 64 rows at most, whatever the data) is broadcast, so that wide rows
    that an exact join would not touch are not shuffled for it. A full map puts all rows in the first part.
    """
    at = F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(bits))
    words = ids.select((at / 64).cast("int").alias("_word"), F.lit(1).cast("long").alias("_one"), (at % 64).cast("int").alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("_bits"))
    own = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    rows = df.withColumn("_own", own).withColumn("_word", (F.col("_own") / 64).cast("int")).join(F.broadcast(words), "_word", "left")
    there = F.expr("coalesce(shiftrightunsigned(_bits, cast(_own % 64 as int)) & 1 = 1, false)")
    return tuple(rows.filter(f).select(*df.columns) for f in (there, ~there))


def likely(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return by_bitmap(df, key, ids)[0]


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``key`` is not among ``ids``; a null key is not."""
    rows, back = plainly(df, key=key)
    maybe, surely_not = by_bitmap(rows, "key", ids)
    return back(surely_not.unionAll(maybe.join(ids.toDF("_id"), F.col("key") == F.col("_id"), "left_anti")))
