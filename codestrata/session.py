"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codestrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # HotSpot never compiles methods above 8000 bytes; fall back before that
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, removed when the application ends.

    A cluster names its parent in ``spark.checkpoint.dir``. Only a session on
    one machine may leave that unset; it then gets a temporary folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set("spark.checkpoint.dir", named)
    root = f"{named.rstrip('/')}/codestrata-{context.applicationId}"
    if root not in _REMOVED_AT_END:
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _REMOVED_AT_END.add(root)
    return root


_REMOVED_AT_END: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Executors get it as a file; workers beside the driver (planning of streams)
    do not, they find it by their search path.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        environment = spark.sparkContext.environment
        known = environment.get("PYTHONPATH", "")
        environment["PYTHONPATH"] = f"{package.parent}{os.pathsep + known if known else ''}"
        target = Path(tempfile.mkdtemp(prefix="codestrata-")) / "codestrata_package"
        archive = shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where two later steps must see identical rows (for example partition
    numbers and the offsets derived from them), also after executor loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no later step reads, before the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
