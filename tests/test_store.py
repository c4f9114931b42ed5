"""The sample store: replacing runs, unpublished runs, incomplete documents."""

from pyspark.sql import functions as F

from reelgrid.schemas import SCHEMAS
from reelgrid.sources import tables as IO


def rows(spark, media, n):
    blank = dict.fromkeys([c.split()[0] for c in SCHEMAS["samples"].split(", ")])
    made = [{**blank, "media_id": media, "presentation_index": i, "pts": i, "pt_ns": i, "duration_ns": 1, "key_frame": False, "ingest_seq": 0} for i in range(n)]
    return spark.createDataFrame([tuple(r.values()) for r in made], SCHEMAS["samples"])


def catalogue(spark, *media):
    return spark.createDataFrame([(m, f"/{m}", 5, 7, 0) for m in media], "media_id string, path string, file_size long, mtime_ms long, stream_index int")


def test_later_runs_replace_earlier_ones(spark, tmp_path):
    media, path = catalogue(spark, "a", "b"), str(tmp_path / "store")
    IO.write_samples(rows(spark, "a", 5), media, path, complete=False)
    assert IO.read_samples(spark, media, path).count() == 5
    assert IO.read_samples(spark, media, path, complete_only=True).count() == 0
    assert {r.media_id for r in IO.pending_media(media, spark.read.parquet(f"{path}/status")).collect()} == {"a", "b"}
    for _ in range(2):
        IO.write_samples(rows(spark, "a", 10), media, path)
    assert IO.read_samples(spark, media, path).count() == 10
    IO.write_samples(rows(spark, "b", 3), media, path)
    assert {r.media_id: r["count"] for r in IO.read_samples(spark, media, path).groupBy("media_id").count().collect()} == {"a": 10, "b": 3}
    assert IO.pending_media(media, spark.read.parquet(f"{path}/status")).count() == 0


def test_unpublished_rows_are_not_seen(spark, tmp_path):
    media, path = catalogue(spark, "a"), str(tmp_path / "store")
    run = IO.write_samples(rows(spark, "a", 4), media, path)
    data = spark.read.parquet(f"{path}/data")
    orphan = data.where(F.col("run") == run).withColumn("run", F.lit("0"))
    orphan.write.mode("append").partitionBy("algo_version", "run").parquet(f"{path}/other")
    spark.read.parquet(f"{path}/other").write.mode("append").partitionBy("algo_version", "run").parquet(f"{path}/data")
    assert spark.read.parquet(f"{path}/data").count() == 8
    assert IO.read_samples(spark, media, path).count() == 4


def test_media_with_an_invalid_sample_are_kept_apart(spark, tmp_path):
    media, path = catalogue(spark, "a", "b"), str(tmp_path / "store")
    bad = rows(spark, "b", 2).withColumn("duration_ns", F.lit(-1).cast("bigint"))
    IO.write_samples(rows(spark, "a", 4).unionByName(bad), media, path)
    assert IO.read_samples(spark, media, path).count() == 4
    assert spark.read.parquet(f"{path}/quarantine").count() == 2


def results(spark, *rows):
    return spark.createDataFrame(rows, "media_id string, kind string, n long")


def seen(spark, path):
    return sorted(((r.media_id, r.kind, r.n) for r in IO.read_results(spark, path).collect()), key=repr)


def test_versions_of_results_replace_their_partitions(spark, tmp_path):
    path = str(tmp_path / "results")
    IO.write_results(results(spark, ("a", "1", 1), ("b", "1", 2), ("a", "02", 3), ("c", None, 4)), path)
    assert seen(spark, path) == [("a", "02", 3), ("a", "1", 1), ("b", "1", 2), ("c", None, 4)]
    before = IO.read_results(spark, path)
    IO.write_results(results(spark, ("d", "1", 5), ("d", None, 6)), path)
    assert seen(spark, path) == [("a", "02", 3), ("d", "1", 5), ("d", None, 6)]
    assert before.count() == 4  # files under a reader stay
    IO.write_results(results(spark), path)
    assert len(seen(spark, path)) == 3
    IO.write_results(results(spark, ("e", "1", 7)), path, whole=True)
    assert seen(spark, path) == [("e", "1", 7)]
    IO.write_results(results(spark), path, whole=True)
    assert seen(spark, path) == []


def test_a_version_is_invisible_until_published(spark, tmp_path):
    path, later = str(tmp_path / "results"), results(spark, ("a", "x", 2), ("b", "x", 3))
    IO.write_results(results(spark, ("a", "x", 1)), path)
    version = IO.write_results(later, path, publish=False)
    assert seen(spark, path) == [("a", "x", 1)]
    IO.publish_results(spark, path, version, later.schema)
    assert seen(spark, path) == [("a", "x", 2), ("b", "x", 3)]


def test_results_without_partitions_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "results")
    for n in (1, 2):
        IO.write_results(results(spark, *[(m, "x", n) for m in "abc"]), path, by=())
    assert seen(spark, path) == [("a", "x", 2), ("b", "x", 2), ("c", "x", 2)]


def test_a_manifest_of_three_versions_is_planned_once(spark, monkeypatch):
    """Each version, and each one's cut points, planned all ranges again."""
    from reelgrid.plans import selection
    from reelgrid.registry import planning

    planned = spark.sparkContext.accumulator(0)
    whole = selection.range_plan

    def counted(rows):
        for batch in rows:
            planned.add(batch.num_rows)
            yield batch

    def counting(*given, **named):
        plan = whole(*given, **named)
        return plan.mapInArrow(counted, plan.schema)

    monkeypatch.setattr(planning.P, "range_plan", counting)
    folder = "/root/testdata/sf0.001"
    files = planning.stored_manifest(spark, folder).agg(F.sum("files")).first()[0]
    assert files and planned.value == files
