"""Session, table access and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def get_spark(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow on; ``conf`` overrides anything."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns are pruned by what a query uses."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they need not have it installed.

    Spark's own file server hands the archive (some 100 kB) to every executor, also to one that joins later.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def checkpoint_folder(named: str | None, master: str) -> str:
    """The shared folder that the session names; a temporary one only where everything runs in one process."""
    if named:
        return named
    if re.fullmatch(r"local(\[[^\]]*\])?", master):
        return tempfile.mkdtemp(prefix="plumbline-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is ``spark.checkpoint.dir`` of the session.  Only on a single machine (tests, a laptop) a temporary
    folder is chosen where that is unset; on a cluster that is an error, since executors could not read it.
    Checkpoint files survive the loss of executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None), context.master))
    return df.checkpoint(eager=True)
