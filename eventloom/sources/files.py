"""Reading logs from files, with their columns kept and several parts told apart; and writing them for later."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.xes import read_xes

FORMATS = {"parquet": ".parquet", "csv": ".csv"}


def kind_of(path: str) -> str:
    """parquet, csv or xes, by the name's ending; .gz may follow."""
    suffixes = [s.lower() for s in PurePosixPath(str(path).rstrip("/")).suffixes]
    if suffixes and suffixes[-1] == ".gz":
        suffixes.pop()
    kind = suffixes[-1][1:] if suffixes else ""
    if kind not in ("parquet", "csv", "xes"):
        raise ValueError(f"{path}: a log is a .parquet, .csv or .xes file")
    return kind


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of all files, by column name; columns that a file lacks are null. Several XES parts get log_version, the part's name."""
    if not paths:
        raise ValueError("no files are given")
    parts = []
    for path in map(str, paths):
        kind = kind_of(path)
        if kind == "xes":
            part = read_xes(spark, path).drop("file", "ordinal")
            if len(paths) > 1:
                part = part.withColumn("log_version", F.lit(PurePosixPath(path.removesuffix(".gz")).stem))
        elif kind == "csv":
            part = spark.read.csv(path, header=True, inferSchema=True)
        else:
            part = spark.read.parquet(path)
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_log(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a flat log as Parquet, or as CSV with a header."""
    if kind not in FORMATS:
        raise ValueError(f"a log is written as one of {list(FORMATS)}, not {kind!r}")
    writer = df.write.mode(mode)
    writer.parquet(path) if kind == "parquet" else writer.csv(path, header=True)
