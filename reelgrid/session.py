"""Session settings and reliable materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on. Times are UTC, joins and skew are left to AQE, and
# Python kernels receive batches bounded in bytes, because a row may carry a whole image plane.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Checkpoints that nothing refers to any more are deleted.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "reelgrid", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    The folder named by ``spark.checkpoint.dir`` is used as it is. Where neither that setting nor a
    folder of the context exists, a private one is made on a local master, which has one machine only;
    on a cluster that is an error, as other machines would not see the files.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="reelgrid-checkpoint-"))
    return context.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that kernels can be imported there."""
    context = spark.sparkContext
    if getattr(context, "_reelgrid_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="reelgrid-package-")) / "reelgrid.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._reelgrid_shipped = True


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path on the shared checkpoint storage, for stream outputs and tables."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
