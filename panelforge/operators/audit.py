"""A tamper-evident log and manifests of what a run read and wrote."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENESIS = "0" * 64
EVENT = "touch_id bigint, timestamp string, provenance string, reason string, prev_hash string, event_hash string, payload string"


def event_hash(event: dict) -> str:
    """SHA-256 of an event without its own hash, as JSON with sorted keys."""
    body = {k: v for k, v in event.items() if k not in ("event_hash", "payload")}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class TouchLog:
    """An append-only JSONL log of accesses to a locked region; each event holds the hash of the one before."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.open = False

    def events(self) -> list[dict]:
        return [json.loads(line) for line in self.path.read_text().splitlines() if line.strip()] if self.path.exists() else []

    def unlock(self, reason: str, provenance: str = "analysis") -> dict:
        before = self.events()
        event = {"touch_id": len(before) + 1, "timestamp": datetime.now(timezone.utc).isoformat(), "provenance": provenance, "reason": reason, "prev_hash": before[-1]["event_hash"] if before else GENESIS}
        event["event_hash"] = event_hash(event)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as out:
            out.write(json.dumps(event, sort_keys=True) + "\n")
        self.open = True
        return event

    def relock(self) -> None:
        self.open = False

    def check(self) -> None:
        """Raise unless the region was unlocked."""
        if not self.open:
            raise PermissionError("the region is locked; unlock it with a reason, which is logged")

    def verify(self) -> None:
        """Raise if an event was changed, removed or moved."""
        before = GENESIS
        for n, event in enumerate(self.events(), 1):
            if event["prev_hash"] != before or event["event_hash"] != event_hash(event):
                raise ValueError(f"the log is broken at event {n}")
            before = event["event_hash"]


def touch_hash() -> Column:
    """``event_hash`` of the events of a TouchLog, as a column."""
    return F.sha2(F.to_json(F.struct("prev_hash", "provenance", "reason", "timestamp", "touch_id")), 256)


def link_hash() -> Column:
    """The hash of the events of ``hashed_chain``, as a column."""
    return F.sha2(F.concat_ws("|", "prev_hash", "touch_id", F.coalesce("reason", F.lit("None"))), 256)


def touches(events: DataFrame) -> DataFrame:
    """provenance, n: accesses by kind, so that self-tests are told from others."""
    return events.groupBy("provenance").agg(F.count("*").alias("n"))


def chain_breaks(events: DataFrame, own: Column | None = None) -> DataFrame:
    """touch_id, kind of every break: 'content' where an event's hash is not that of what it holds, 'link' where its prev_hash is not the hash of an earlier event, 'twice' where another event already follows that one.

    Hashes are recomputed by ``own`` (link_hash unless given), and predecessors
    are found by a join on the hash, so a log of any length is checked in parallel.
    """
    own = link_hash() if own is None else own
    before = events.select(F.col("event_hash").alias("prev_hash"), F.col("touch_id").alias("__before")).groupBy("prev_hash").agg(F.min("__before").alias("__before"))
    least = events.groupBy("prev_hash").agg(F.min("touch_id").alias("__first"))
    met = events.join(before, "prev_hash", "left").join(least, "prev_hash", "left")
    linked = F.when(F.col("prev_hash") == GENESIS, F.lit(True)).otherwise(F.coalesce(F.col("__before") < F.col("touch_id"), F.lit(False)))
    kinds = F.array(F.when(own != F.col("event_hash"), "content"), F.when(~linked, "link"), F.when(F.col("touch_id") > F.col("__first"), "twice"))
    return met.select("touch_id", F.explode(F.array_compact(kinds)).alias("kind"))


def hashed_chain(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    """Events made of (id, reason), chained by hash."""
    out, before = [], GENESIS
    for n, reason in rows:
        digest = hashlib.sha256(f"{before}|{n}|{reason}".encode()).hexdigest()
        out.append((n, reason, before, digest))
        before = digest
    return spark.createDataFrame(out, "touch_id bigint, reason string, prev_hash string, event_hash string")


def manifest(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Per table its rows, columns and an order-free hash of all its content."""
    out = None
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        one = df.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("content")).select(F.lit(name).alias("tab"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "content")
        out = one if out is None else out.unionByName(one)
    return out


def compared(expected: DataFrame, actual: DataFrame, tolerance: float) -> DataFrame:
    """name, expected, actual, status: numbers against published ones, missing ones told apart."""
    both = expected.join(actual, "name", "full")
    status = F.when(F.col("actual").isNull() | F.col("expected").isNull(), "CHECK").when(F.abs(F.col("actual") - F.col("expected")) <= tolerance, "PASS").otherwise("FAIL")
    return both.select("name", "expected", "actual", status.alias("status"))
