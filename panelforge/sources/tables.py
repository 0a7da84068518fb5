"""The tables of a data folder.

A column that a file lacks comes out as null, further columns are left out, and
NaN in a double column is turned into null at the scan, since Spark's NaN is a
value (it is greater than any number) and not a missing one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "dsf": "obs_id bigint, permno bigint, lineno int, date date, ret double, prc double, shrout double, cfacpr double, cfacshr double, loadts timestamp_ntz",
    "names": "name_id bigint, permno bigint, namedt date, nameendt date, shrcd int, exchcd int, ticker string, comnam string, recdt date, wddt date",
    "membership": "mbr_id bigint, permno bigint, mbrstartdt date, mbrenddt date, recdt date",
    "delist": "delist_id bigint, permno bigint, dlstdt date, dlret double, dlstcd int, recdt date",
    "rf": "date date, rf double",
    "documents": "doc_id bigint, permno bigint, pubts timestamp_ntz, lang string, source string, n_chars int, text string",
    "eval_items": "item_id bigint, suite string, passage string, question string, answer string",
    "subjects": "subject string, title string, descr string",
    "subject_examples": "example_id bigint, subject string, lang string, text string",
}


def conform(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``df`` with the declared columns of table ``name`` (or the given ones), in order."""
    kinds = dict(part.strip().rsplit(" ", 1) for part in SCHEMAS[name].split(","))
    out = []
    for column in columns or kinds:
        kind = kinds[column]
        if column not in df.columns:
            out.append(F.lit(None).cast(kind).alias(column))
        elif kind == "double":
            out.append(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias(column))
        else:
            out.append(F.col(column).cast(kind).alias(column))
    return df.select(*out)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan ``folder/name.parquet``; only ``columns`` reach the reader."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return conform(df, name, *columns) if name in SCHEMAS else (df.select(*columns) if columns else df)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The tables that lie in ``folder``, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(name[: -len(".parquet")] for name in (f.getPath().getName() for f in found) if name.endswith(".parquet"))
