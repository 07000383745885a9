"""Session helpers: a sensible local session for tests/bench and the checkpoint folder.

On a cluster the session is built by the caller; the library only reads its settings.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "cograph") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session (``spark.checkpoint.dir``).

    Only when the session names none and runs in local mode (tests, bench) do we pick a
    scratch folder ourselves; a cluster must configure a shared one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        conf = tempfile.mkdtemp(prefix="cograph-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet in the session's shared checkpoint folder and read it back.

    One computation (an eager RDD checkpoint runs the plan twice), the lineage is cut, the copy
    survives executor loss, and the re-read scan carries file statistics for AQE. ``partition_by``: a column
    whose values become directories.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cograph-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give this package's code to the Python workers (as ``--py-files`` does), once for each version of it."""
    top = Path(__file__).resolve().parent
    files = {p: p.read_bytes() for p in sorted(top.rglob("*.py"))}
    name = f"{top.name}-{hashlib.sha256(b''.join(files.values())).hexdigest()[:12]}.zip"
    if name in {Path(f).name for f in spark.sparkContext.listFiles}:
        return
    to = Path(tempfile.mkdtemp()) / name  # only read by the driver, which serves it to the executors
    with zipfile.ZipFile(to, "w") as z:
        for p, data in files.items():
            z.writestr(str(p.relative_to(top.parent)), data)
    spark.sparkContext.addPyFile(str(to))
