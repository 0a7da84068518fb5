"""The training-data queries on texts and groups, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import leaks, subjects, tokens, topn
from panelforge.operators.latest import valid_rows
from panelforge.sources import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 listings of largest market value on every date."""
    dsf = table(spark, folder, "dsf", "obs_id", "permno", "lineno", "date", "prc", "shrout", "loadts")
    valued = valid_rows(dsf, "prc", "shrout").select(F.unix_date("date").alias("day"), (F.abs("prc") * F.col("shrout")).alias("score"), "permno", "lineno").where("score > 0")
    best = topn.top_n(valued, "day", "score", ["permno", "lineno"], 10)
    return best.select(F.date_format(F.date_from_unix_date(F.col("group").cast("int")), "yyyy-MM-dd").alias("date"), "rank", "permno", F.col("lineno").cast("int").alias("lineno"))


P6_SQL = """
with valid as (
  select permno, lineno, date, abs(prc) * shrout as score from dsf
  qualify row_number() over (partition by permno, lineno, date order by loadts desc nulls last, obs_id desc) = 1
), ranked as (
  select strftime(date, '%Y-%m-%d') as date, cast(row_number() over (partition by date order by score desc, permno, lineno) as integer) as rank, permno, lineno
  from valid where score > 0 and not isnan(score) and date is not null
)
select * from ranked where rank <= 10
"""


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(_documents(spark, folder))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return tokens.round_trip(_documents(spark, folder))


P8_SQL = "select doc_id, coalesce(text, '') as text from documents"


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of document and leaked evaluation item."""
    return leaks.leaks(_documents(spark, folder), table(spark, folder, "eval_items", "item_id", "suite", "passage")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item, how many documents hold it."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of every document."""
    codes = [r["subject"] for r in table(spark, folder, "subjects", "subject").where("subject is not null").distinct().orderBy("subject").collect()]
    return subjects.assign(_documents(spark, folder), table(spark, folder, "subject_examples"), codes)


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and their characters by subject; a document of two subjects counts for both."""
    sizes = table(spark, folder, "documents", "doc_id", "n_chars")
    return p10_found(spark, folder).join(sizes, "doc_id").groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_chars").cast("bigint")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (p6_found, p8_ids, p8_roundtrip, p9_found, p9_report, p10_found, p10_composition)}
SQL = {"p6_found": P6_SQL, "p8_roundtrip": P8_SQL}
