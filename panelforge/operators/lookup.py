"""Joins whose right side is broadcast only where its measured size allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import cut

#: Rows up to which a lookup side is broadcast. The side is counted first.
BROADCAST_ROWS = 400_000
#: Copies of the lookup side, and parts of each key of the other, beyond that.
SALTS = 8


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Join ``facts`` to ``lookup`` (at most one row a key) on ``keys``.

    Up to ``rows`` counted rows the lookup is broadcast. Beyond, each key of
    the facts is spread over ``salts`` parts and the lookup is copied to each,
    so that a key that holds a third of all facts is no single task. The lookup
    is cut from its lineage, so counting it does not compute it twice.
    """
    lookup = cut(lookup)
    if lookup.count() <= rows:
        return facts.join(F.broadcast(lookup), keys, how)
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(salts)).cast("int")  # equal rows are spread as well
    copies = lookup.withColumn("__salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return facts.withColumn("__salt", spread).join(copies, [*keys, "__salt"], how).drop("__salt")
