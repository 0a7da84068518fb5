"""Sinks, and scans of what they wrote under a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.streaming.events import shared_folder


def write(df: DataFrame, path: str, kind: str) -> None:
    """Write parquet, csv (with a header) or json lines, replacing what is there."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def read(spark, path: str, kind: str, schema) -> DataFrame:
    """Scan under ``schema``; nothing is inferred."""
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to a folder that all executors share, and scanned again."""
    path = f"{shared_folder(df.sparkSession)}/{kind}"
    write(df, path, kind)
    return read(df.sparkSession, path, kind, df.schema)


def first_readable(spark, paths: list[str]) -> str | None:
    """The first path of which a row can be read; a listing alone proves nothing."""
    for path in paths:
        try:
            spark.read.parquet(path).limit(1).collect()
            return path
        except Exception:  # noqa: BLE001
            continue
    return None


def access(spark: SparkSession, folder: str, names: list[str]) -> list[tuple[str, str]]:
    """(name, status) of each table of a folder: READABLE, NOT THERE, NO ACCESS or ERROR, told by reading one row."""
    out = []
    for name in names:
        try:
            spark.read.parquet(f"{folder}/{name}.parquet").limit(1).collect()
            status = "READABLE"
        except Exception as e:  # noqa: BLE001
            told = str(e)
            status = "NOT THERE" if "PATH_NOT_FOUND" in told else "NO ACCESS" if "ermission denied" in told or "AccessControl" in told else "ERROR"
        out.append((name, status))
    return out
