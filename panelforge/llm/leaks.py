"""Evaluation passages inside a corpus, by winnowed fingerprints.

Texts are reduced to words (case, spacing, markup and forms of characters
aside). Of every ``WINDOW`` adjacent runs of ``GRAM`` words the one with the
least hash is a fingerprint, so any shared span of GRAM + WINDOW - 1 words
shares one. Fingerprints of documents are joined with those of the evaluation
passages, and each hit is extended on both sides, over single words that were
changed, misspelt, added or dropped. A document leaks a passage if at most two
such stretches hold enough of its words.

Scale: the words of the evaluation set are counted first. Up to a stated number
they are one broadcast block, and the corpus is read once and does not move.
Beyond it nothing of the set is gathered: a bit field of fixed size tells which
fingerprints of the corpus may be in the set at all, those are joined with the
set's by hash, and only documents with hits meet their passages again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.words import Hasher, grams, spread, winnow, words
from panelforge.session import cut

GRAM, WINDOW = 4, 3
#: Words of the evaluation set up to which it is broadcast: about 40 bytes each, so 40 MB.
BROADCAST_WORDS = 1_000_000
#: Bits of the field that tells which fingerprints may be in a larger set (16 MB).
FIELD_BITS = 1 << 27
#: Share of a passage's words that make a leak, and words that a stretch has at least.
SHARE, STRETCH = 0.25, 8
#: Share of the words of a stretch that must agree, over the stretch and close to any of its words.
DENSE = 0.8


def own_passages(items: DataFrame) -> DataFrame:
    """item_id and passage without the heading of its suite.

    A heading is a first paragraph, set off by a blank line, with which at
    least two different passages of a suite open. Any other first paragraph is
    part of its passage. Items without a suite are a suite of their own.
    """
    suite = F.col("suite") if "suite" in items.columns else F.lit(None)
    whole = F.ltrim(F.regexp_replace("passage", r"\r\n?", "\n"))
    parts = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(suite.cast("string"), F.lit("")).alias("suite"), F.split(whole, r"\n[ \t]*\n", 2).alias("parts"))
    parts = parts.select("item_id", "suite", F.col("parts")[0].alias("head"), F.get("parts", F.lit(1)).alias("rest"))
    parts = parts.withColumn("rest", F.when(F.trim("rest") != "", F.col("rest")))
    told = parts.where("rest is not null").groupBy("suite", "head").agg((F.min(F.xxhash64("rest")) < F.max(F.xxhash64("rest"))).alias("shared"))
    passage = F.when(F.col("rest").isNull(), F.col("head")).when(F.col("shared"), F.col("rest")).otherwise(F.concat_ws("\n\n", "head", "rest"))
    return parts.join(told, ["suite", "head"], "left").select("item_id", passage.alias("passage"))


def alike(a: str, b: str) -> bool:
    """Whether one word may be the other misspelt: one edit, two in words of eight letters or more."""
    if a == b:
        return True
    m, n = len(a), len(b)
    most = 2 if min(m, n) >= 8 else 1 if min(m, n) >= 4 else 0
    if not most or abs(m - n) > most or a.isdigit() or b.isdigit():
        return False
    x, y = set(a), set(b)
    if len(x - y) > most or len(y - x) > most:  # an edit brings or takes one letter at most
        return False
    before = list(range(n + 1))
    older = before
    for i, x in enumerate(a, 1):
        row = [i] + [0] * n
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return False
        older, before = before, row
    return before[n] <= most


#: How far the two sides may step to meet again after words that differ.
STEPS = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2), (2, 0), (0, 2))


def extend(doc: list[str], item: list[str], p: int, q: int, way: int) -> list[tuple[int, int]]:
    """Pairs of agreeing positions from (p, q) on, forwards or backwards."""
    out, n, m = [], len(doc), len(item)
    recent: list[int] = []
    while 0 <= p < n and 0 <= q < m:
        if doc[p] == item[q] or alike(doc[p], item[q]):
            out.append((p, q))
            recent.append(1)
            p, q = p + way, q + way
        else:
            for a, b in STEPS:
                x, y = p + way * a, q + way * b
                if 0 <= x < n and 0 <= y < m and 0 <= x + way < n and 0 <= y + way < m and doc[x] == item[y] and doc[x + way] == item[y + way]:
                    recent += [0] * max(a, b)
                    p, q = x, y
                    break
            else:
                break
        if len(recent) > 10 and sum(recent[-10:]) < 10 * DENSE - 1:
            break
    return out


def leaked_words(doc: list[str], item: list[str], hits: list[tuple[int, int]]) -> int:
    """Words of ``item`` that the two best stretches around ``hits`` (positions in both) reproduce."""
    used: set[tuple[int, int]] = set()
    stretches: list[set[int]] = []
    for p, q in sorted(hits):
        if (p, q) in used:
            continue
        pairs = extend(doc, item, p - 1, q - 1, -1)[::-1] + extend(doc, item, p, q, 1)
        used.update(pairs)
        if len(pairs) < STRETCH:
            continue
        covered = {y for _, y in pairs}
        if len(covered) < DENSE * (max(covered) - min(covered) + 1):
            continue
        stretches.append(covered)
    stretches = sorted(map(set, {frozenset(one) for one in stretches}), key=len, reverse=True)
    apart: list[set[int]] = []  # one within another adds nothing to any pair
    for one in stretches:
        if not any(one <= other for other in apart):
            apart.append(one)
    best = len(apart[0]) if apart else 0
    for i, one in enumerate(apart):
        for two in apart[i + 1 :]:
            if len(one) + len(two) <= best:  # the rest are no longer
                break
            best = max(best, len(one | two))
    return best


def leak_share(doc: list[str], item: list[str], hits: list[tuple[int, int]]) -> float | None:
    """The share of the words of ``item`` that ``doc`` reproduces, or None if that is no leak."""
    count = leaked_words(doc, item, hits)
    return count / len(item) if count >= SHARE * len(item) and count >= min(STRETCH, len(item)) else None


class Block:
    """Fingerprints of some passages, to be broadcast."""

    def __init__(self, passages: list[tuple[int, list[str]]]):
        hasher = Hasher()
        hashes, owners, places = [], [], []
        for number, (_, tokens) in enumerate(passages):
            fingerprints = grams(hasher(tokens), GRAM)  # all, so that a document's choice always meets its like
            hashes.append(fingerprints)
            owners.append(np.full(len(fingerprints), number))
            places.append(np.arange(len(fingerprints)))
        whole = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(whole, kind="stable")
        self.hashes = whole[order]
        self.owners = np.concatenate(owners)[order] if owners else np.zeros(0, dtype=np.int64)
        self.places = np.concatenate(places)[order] if places else np.zeros(0, dtype=np.int64)
        self.passages = passages

    def found(self, tokens: list[str], hashes: np.ndarray) -> Iterator[tuple[int, float]]:
        """The items that a document leaks, with the share of their words."""
        fingerprints = grams(hashes, GRAM)
        chosen = winnow(fingerprints, WINDOW)
        if not len(chosen) or not len(self.hashes):
            return
        values = fingerprints[chosen]
        low = np.searchsorted(self.hashes, values, "left")
        if not (self.hashes[np.minimum(low, len(self.hashes) - 1)] == values).any():
            return
        high = np.searchsorted(self.hashes, values, "right")
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, a, b in zip(chosen.tolist(), low.tolist(), high.tolist()):
            for at in range(a, b):
                hits[int(self.owners[at])].append((p, int(self.places[at])))
        for number, pairs in hits.items():
            item, own = self.passages[number]
            share = leak_share(tokens, own, pairs)
            if share is not None:
                yield item, share


def _kernel(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, block = Hasher(), shared.value
        for batch in batches:
            docs, items, shares = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words(text.as_py())
                if len(tokens) < GRAM:
                    continue
                for item, share in block.found(tokens, hasher(tokens)):
                    docs.append(doc)
                    items.append(item)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "share"])

    return run


def _words_of_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [words(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], names=["item_id", "words"])


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, place and hash of every run of words of every passage."""
    hasher = Hasher()
    for batch in batches:
        for item, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = grams(hasher(tokens), GRAM)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own.view(np.int64))], names=["item_id", "place", "hash"])


def _possible(shared):
    """doc_id, text hash, place and hash of the fingerprints of a corpus whose bit is set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, field = Hasher(), shared.value
        for batch in batches:
            docs, texts, places, hashes = [], [], [], []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens = words(text.as_py())
                if len(tokens) < GRAM:
                    continue
                own = grams(hasher(tokens), GRAM)
                at = winnow(own, WINDOW)
                bit = (own[at] % np.uint64(FIELD_BITS)).astype(np.int64)
                at = at[(field[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                docs += [doc] * len(at)
                texts += [key] * len(at)
                places.append(at)
                hashes.append(own[at])
            place = np.concatenate(places).astype(np.int32) if places else np.zeros(0, dtype=np.int32)
            value = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.int64()), pa.array(place), pa.array(value)], names=["doc_id", "key", "at", "hash"])

    return run


def _extended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, items, shares = [], [], []
        before, tokens = None, []
        for doc, text, item, own, at, place in zip(*(c.to_pylist() for c in batch.columns)):
            if text != before:
                before, tokens = text, words(text)
            share = leak_share(tokens, own, list(zip(at, place)))
            if share is not None:
                docs.append(doc)
                items.append(item)
                shares.append(share)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "share"])


FOUND = "doc_id bigint, item_id bigint, share double"


def _joined(documents: DataFrame, own: DataFrame) -> DataFrame:
    """The leaks of an evaluation set of any size, by joins on hashes and keys."""
    spark = documents.sparkSession
    postings = own.mapInArrow(_postings, "item_id bigint, place int, hash bigint")
    bit = F.expr(f"hash & {FIELD_BITS - 1}L")  # the remainder of its unsigned value
    parts = postings.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    field = np.zeros(FIELD_BITS // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():  # FIELD_BITS in all, whatever the size of the set
        part = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        field[(row["bucket"] - 1) * len(part) : row["bucket"] * len(part)] |= part
    shared = spark.sparkContext.broadcast(field)
    texts = documents.select("doc_id", F.xxhash64("text").alias("key"), "text")
    possible = texts.mapInArrow(_possible(shared), "doc_id bigint, key bigint, at int, hash bigint")
    hits = possible.distinct().join(postings, "hash").groupBy("doc_id", "key", "item_id").agg(F.collect_list("at").alias("at"), F.collect_list("place").alias("place"))
    met = texts.join(hits, ["doc_id", "key"]).join(own, "item_id")  # sizes are measured at run time
    return met.select("doc_id", "text", "item_id", "words", "at", "place").mapInArrow(_extended, FOUND)


def leaks(documents: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Every pair of document and leaked item: doc_id, item_id, share of the passage's words.

    ``documents``: doc_id, text; ``items``: item_id, passage and, where there is
    one, suite. Null, empty and wordless texts and passages, passages of fewer
    than four words, and items or documents without an id leak nothing. Equal
    documents count each, as do equal passages of several items.
    """
    spark = documents.sparkSession
    own = cut(own_passages(items).mapInArrow(_words_of_items, "item_id bigint, words array<string>").where(F.size("words") >= GRAM))
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    held = own.agg(F.sum(F.size("words"))).first()[0] or 0
    if held > broadcast_words:
        return _joined(documents, own)
    block = Block([(r["item_id"], r["words"]) for r in own.collect()])  # at most broadcast_words
    shared = spark.sparkContext.broadcast(block)
    return spread(documents).mapInArrow(_kernel(shared), FOUND)
