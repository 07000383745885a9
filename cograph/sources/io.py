"""Sources and sinks: S1-S10. Parquet is the interchange format everywhere (scans are lazy,
prune columns and push filters); CSV only where the reference writes CSV reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import Dictionary, DictionaryTable, load_dictionary


def _fs_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system of the path (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet file or a directory of Parquet files."""
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: by extension (case-insensitive): .csv (header, inferred types) or .parquet."""
    if not _fs_exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    ext = Path(path).suffix.lower()
    if ext == ".csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"cannot read {ext or 'files without suffix'}: a table is .csv or .parquet")


def csv_to_parquet(spark: SparkSession, src: str, dst: str | None = None) -> str:
    """CSV -> Parquet; default destination replaces the .csv suffix; no index column."""
    if dst is None:
        dst = (src[:-4] if src.lower().endswith(".csv") else src) + ".parquet"  # a URI, not a local path
    spark.read.option("header", True).option("inferSchema", True).csv(src).write.mode("overwrite").parquet(dst)
    return dst


def read_contrast_topics(df: DataFrame, topic: str = "topic", sides: str = "sides") -> DataFrame:
    """Topic -> map(side -> text) rows exploded to long (topic, side, text), keeping topic order."""
    return df.select(topic, F.posexplode(F.map_entries(F.col(sides))).alias("side_pos", "e")).select(
        topic, F.col("e.key").alias("side"), F.col("e.value").alias("text")
    )


def write_contexts(contexts: DataFrame, path: str) -> None:
    """S6 write: per-corpus feature sets (ctx, features array)."""
    contexts.write.mode("overwrite").parquet(path)


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """S6 read: raises AnalysisException when the cache is missing."""
    return spark.read.parquet(path)


def write_graph(edges: DataFrame, nodes: DataFrame, root: str, graph: str) -> None:
    """S7 write: ``<root>/<graph>/edges`` and ``<root>/<graph>/nodes`` Parquet (ids keep their type;
    an empty graph still leaves both folders, with their schema)."""
    edges.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{graph}/edges")
    nodes.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{graph}/nodes")


def read_graph(spark: SparkSession, root: str, graph: str) -> tuple[DataFrame, DataFrame] | None:
    """S7 read: (edges, nodes) of one graph, or None when it was never written (callers skip it)."""
    e_path, n_path = f"{root.rstrip('/')}/{graph}/edges", f"{root.rstrip('/')}/{graph}/nodes"
    if not (_fs_exists(spark, e_path) and _fs_exists(spark, n_path)):
        return None
    edges = spark.read.parquet(e_path)
    nodes = spark.read.parquet(n_path)
    return edges.withColumn("weight", F.col("weight").cast("double")), nodes  # P10


def read_dictionary(spark: SparkSession, path: str, b_dec_path: str | None = None, expected_dim: int | None = None) -> Dictionary | DictionaryTable:
    """Dictionary weights (one row per feature) + optional b_dec; dimensions checked."""
    table = spark.read.parquet(path)
    b_dec = None
    if b_dec_path:
        b_dec = spark.read.parquet(b_dec_path).select("b_dec").first()[0]
    d = load_dictionary(table, b_dec)
    if expected_dim is not None and d.dim != expected_dim:
        raise ValueError(f"dictionary dimension {d.dim} != model dimension {expected_dim}")
    return d


def write_result_csv(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, input_path: str, split_col: str = "split") -> dict[str, str]:
    """train/valid/test beside the input, in the input's format."""
    ext = Path(input_path).suffix.lower()
    parent = input_path.rstrip("/").rsplit("/", 1)[0]
    out = {}
    for name in ("train", "valid", "test"):
        dst = f"{parent}/{name}{ext}"
        part = df.filter(F.col(split_col) == name).drop(split_col)
        if ext == ".csv":
            part.write.mode("overwrite").option("header", True).csv(dst)
        else:
            part.write.mode("overwrite").parquet(dst)
        out[name] = dst
    return out
