"""Encoding of a corpus by a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern, and each piece is merged
by a priority queue of merge ranks over a doubly linked list of symbols: the
lowest rank is taken, an entry whose symbols have changed since is stale and
skipped, and a merge puts its two new neighbour pairs on the queue. A piece of
n bytes costs O(n log n), so a text of one endless word is no trouble. Pieces
recur, so each worker remembers merged pieces up to a bound.

Scale: a projection of one column that moves nothing. The vocabulary (50,000
entries, whatever the corpus) is broadcast.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelforge.llm.words import spread

FOLDER = "/opt/tokenizers"
#: Fixed value: the public pattern by which the vocabulary's texts are cut.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 200_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary of ranks: a token in base 64 and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    start, end = list(range(n)), list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, left, upto = heapq.heappop(queue)
        right = after[left]
        # stale: the left symbol is gone, or the pair now ends elsewhere
        if not alive[left] or right < 0 or end[right] != upto:
            continue
        alive[right] = False
        end[left] = upto
        follow = after[left] = after[right]
        if follow >= 0:
            before[follow] = left
            rank = ranks.get(piece[start[left] : end[follow]])
            if rank is not None:
                heapq.heappush(queue, (rank, left, end[follow]))
        lead = before[left]
        if lead >= 0:
            rank = ranks.get(piece[start[lead] : upto])
            if rank is not None:
                heapq.heappush(queue, (rank, lead, upto))
    out, at = [], 0
    while at >= 0:
        out.append(ranks[piece[start[at] : end[at]]])
        at = after[at]
    return out


class Encoder:
    """Texts to ids, with a bounded memory of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, array] = {}

    def into(self, text: str, out: array) -> None:
        """Append the ids of ``text``."""
        known, extend = self.known, out.extend
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = array("i", merge(piece.encode("utf-8"), self.ranks))
                if len(piece) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.into(text, out)
        return out.tolist()


def decode(ids: Iterable[int], tokens: list[bytes]) -> str:
    """The text of ids: their vocabulary strings one after the other."""
    return b"".join(tokens[i] for i in ids).decode("utf-8", errors="replace")


def _encoding(shared, back: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        encoder = Encoder(ranks)
        tokens = sorted(ranks, key=ranks.get) if back else []
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(keys):
                ids, bounds = array("i"), [0]
                begun = at
                while at < len(keys) and len(ids) < 4_000_000:
                    text = texts[at].as_py()
                    if text:
                        encoder.into(text, ids)
                    bounds.append(len(ids))
                    at += 1
                flat = np.frombuffer(ids, dtype=np.int32) if len(ids) else np.zeros(0, dtype=np.int32)
                if back:
                    held = [decode(flat[a:b].tolist(), tokens) for a, b in zip(bounds, bounds[1:])]
                    yield pa.RecordBatch.from_arrays([keys.slice(begun, at - begun), pa.array(held, pa.string())], names=["doc_id", "text"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.array(bounds, dtype=np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([keys.slice(begun, at - begun), lists], names=["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, path: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and ids of every document; null and empty texts give an empty list.

    No special tokens: text that looks like one is ordinary text. Repeated
    rows are encoded each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load_ranks(path))
    return spread(documents.select("doc_id", "text")).mapInArrow(_encoding(shared, False), "doc_id bigint, ids array<int>")


def round_trip(documents: DataFrame, path: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and text of every document, encoded and decoded again; a null text comes back empty."""
    shared = documents.sparkSession.sparkContext.broadcast(load_ranks(path))
    return spread(documents.select("doc_id", "text")).mapInArrow(_encoding(shared, True), "doc_id bigint, text string")
