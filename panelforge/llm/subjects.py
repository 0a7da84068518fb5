"""Subject areas of documents, by averaged word and subword embeddings.

A sentence is the mean of the embeddings of its words and of their character
n-grams, and every subject has a logistic output of its own, so a sentence may
belong to none. A document is given the subjects of a stated share of its
sentences on any subject.

Training starts from the labelled examples, in whose texts every sentence
carries the text's label, and goes on with sentences of a bounded sample of the
corpus, labelled by the model before: a clear sentence by itself, a doubtful
one by the clear ones around it, and, once wording is known, a sentence that
still says nothing as one on no subject. That is how wording which the examples
lack, and remarks which all subjects share, are learnt.

Scale: each round every shard of the training rows makes its own pass from the
common weights, and its summed gradient steps are averaged over the shards that
touched a weight. Weights have a fixed size, rows a bound, whatever the corpus.
Every document is scored, in one pass that moves no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.words import plain, spread
from panelforge.session import cut

#: Hashed features, and numbers of an embedding.
FEATURES, WIDTH = 1 << 15, 24
#: Labelled examples of a subject, and documents of the sample, on which the model is fitted; shards of the training rows.
PER_SUBJECT, SAMPLE_DOCS, SHARDS = 2_000, 9_000, 8
#: Passes over the training rows from each labelling of the sample to the next.
PASSES = (4, 4, 4)
#: Probability from which a sentence is on a subject, and share of such sentences that makes it a document's.
ON, SHARE = 0.5, 0.28
#: Words of a sentence at least.
WORDS = 4

_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
#: What is written into prose and is none: links, commands of markup, notes in brackets, names with underscores.
_GLUED = re.compile(r"(?:https?:|www\.)\S*|\\(?:begin|end)\{[^{}]*\}|\\[a-z]+\*?(?=[\s{])|\[[^\[\]]{0,60}\]|[^\s(]*_\S*|\.{4,}")
_EDGE = re.compile(r"^[\s>|*#]+|[\s|]+$")
_SIGN = re.compile(r"[\"']:|[|{}\\=_<>\[\]]|\w\(|;(?=\S|$)|https?:|\.{4}")
#: Share of signs among the characters of a line from which it is code or a table.
SIGNS = 0.04
_WORD = re.compile(r"[^\W\d_]{2,}")


def prose(part: str) -> str:
    """``part`` without what is glued into it, or nothing where it is code or a table's row."""
    if not _SIGN.search(part):
        return part
    bare = _GLUED.sub(" ", _EDGE.sub("", part))
    if "\\" in part:
        bare = bare.replace("{", " ").replace("}", " ")
    return "" if len(_SIGN.findall(bare)) >= max(2, SIGNS * len(bare)) else bare


def sentences(text: str | None) -> list[list[str]]:
    """The words of every sentence in prose; lines of code and tables have none.

    Links, commands of markup, notes in brackets and names with underscores are
    taken out of a sentence, which counts with the rest of its words.
    """
    out = []
    for part in _SENTENCE.split(plain(text) if text else ""):
        found = _WORD.findall(prose(part))
        if len(found) >= WORDS:
            out.append(found)
    return out


def features(word: str) -> list[int]:
    """The hashed features of a word: itself and its n-grams of 4 and 5 letters."""
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode())]
    for n in (4, 5):
        out += [zlib.crc32(marked[i : i + n].encode()) for i in range(len(marked) - n + 1)]
    return [x % FEATURES for x in out]


class Weights:
    """The model: embeddings, outputs and biases, and the step sizes of training."""

    def __init__(self, subjects: int, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.embedding = draw.normal(0, 0.1, (FEATURES, WIDTH)).astype(np.float32)
        self.output = np.zeros((WIDTH, subjects), dtype=np.float32)
        self.bias = np.full(subjects, -2.2, dtype=np.float32)
        self.embedding_steps = np.full((FEATURES, 1), 1e-6, dtype=np.float32)
        self.output_steps = np.full((WIDTH, subjects), 1e-6, dtype=np.float32)

    NAMES = ("embedding", "output", "bias", "embedding_steps", "output_steps")

    def copy(self) -> Weights:
        other = object.__new__(Weights)
        for name in self.NAMES:
            setattr(other, name, getattr(self, name).copy())
        return other

    def train(self, rows: list[np.ndarray], targets: np.ndarray, epochs: int, seed: int, rate: float = 0.3, batch: int = 96) -> None:
        """Minibatch gradient steps (AdaGrad) on the summed logistic losses."""
        draw = np.random.default_rng(seed)
        sizes = np.array([len(r) for r in rows])
        for _ in range(epochs):
            order = draw.permutation(len(rows))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                n = sizes[at]
                flat = np.concatenate([rows[i] for i in at])
                ends = np.cumsum(n)
                mean = np.add.reduceat(self.embedding[flat], ends - n, axis=0) / n[:, None]
                gradient = (1 / (1 + np.exp(-(mean @ self.output + self.bias))) - targets[at]).astype(np.float32)
                step = mean.T @ gradient / len(at)
                back = (gradient @ self.output.T / n[:, None]).astype(np.float32)
                self.output_steps += step**2
                self.output -= rate * step / np.sqrt(self.output_steps)
                self.bias -= 0.1 * gradient.mean(axis=0)
                order_flat = np.argsort(flat, kind="stable")
                ids = flat[order_flat]
                first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                summed = np.add.reduceat(back[np.repeat(np.arange(len(at)), n)[order_flat]], first, axis=0)
                touched = ids[first]
                self.embedding_steps[touched] += (summed**2).mean(axis=1, keepdims=True)
                self.embedding[touched] -= rate * summed / np.sqrt(self.embedding_steps[touched])


class Scorer:
    """Probabilities of sentences, with a bounded memory of words."""

    def __init__(self, weights: Weights, bound: int = 100_000):
        self.weights, self.bound = weights, bound
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1024, WIDTH), dtype=np.float32)  # of each known word's features
        self.counts = np.zeros(1024, dtype=np.float32)

    def _row(self, word: str) -> int:
        row = len(self.known)
        if row == len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        at = features(word)
        self.sums[row], self.counts[row] = self.weights.embedding[at].sum(axis=0), len(at)
        self.known[word] = row
        return row

    def __call__(self, parts: list[list[str]]) -> np.ndarray:
        if len(self.known) >= self.bound:
            self.known.clear()
        known = self.known
        rows = np.array([known[w] if w in known else self._row(w) for part in parts for w in part])
        ends = np.cumsum([len(part) for part in parts])
        starts = np.r_[0, ends[:-1]]
        means = np.add.reduceat(self.sums[rows], starts, axis=0) / np.add.reduceat(self.counts[rows], starts)[:, None]
        return 1 / (1 + np.exp(-(means @ self.weights.output + self.weights.bias)))


def _flat(part: list[str]) -> list[int]:
    return [x for word in part for x in features(word)]


def label(p: np.ndarray, silent: bool) -> np.ndarray | None:
    """Targets of a document's sentences from their probabilities, or None where too few are clear."""
    best, top = p.max(axis=1), p.argmax(axis=1)
    clear = best > 0.6
    if clear.sum() < 3:
        return None
    around = np.bincount(top[clear], minlength=p.shape[1]) / clear.sum()
    out = np.tile(around, (len(p), 1))
    if silent:
        out[best < 0.5] = 0
    sure = (best > 0.8) & (around[top] >= 0.15)  # a remark of all subjects disagrees with most texts it is in
    out[sure] = 0
    out[sure, top[sure]] = 1
    return out


ROWS = "shard int, features array<int>, target array<float>"


def _sampled(shared, silent: bool, shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            shard, flat, targets = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = sentences(text)
                if not parts:
                    continue
                told = label(scorer(parts), silent)
                if told is not None:
                    shard += [zlib.crc32(str(key).encode()) % shards] * len(parts)
                    flat += map(_flat, parts)
                    targets += told.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(flat, pa.list_(pa.int32())), pa.array(targets, pa.list_(pa.float32()))], names=["shard", "features", "target"])

    return run


def _example_rows(examples: list[tuple[str, str]], subjects: list[str], teacher: Weights | None) -> list[tuple[list[int], list[float]]]:
    scorer = Scorer(teacher) if teacher is not None else None
    out = []
    for subject, text in examples:
        parts = sentences(text)
        if not parts or subject not in subjects:
            continue
        at = subjects.index(subject)
        p = scorer(parts)[:, at] if scorer else np.ones(len(parts))
        for part, sure in zip(parts, p):
            target = [0.0] * len(subjects)
            target[at] = 1.0 if sure >= 0.5 else 0.0
            out.append((_flat(part), target))
    return out


def bounded(examples: DataFrame, per_subject: int) -> DataFrame:
    """At most ``per_subject`` examples of every subject, drawn by hash, so that order of arrival plays no part."""
    drawn = F.row_number().over(Window.partitionBy("subject").orderBy(F.xxhash64("example_id", "text"), "example_id", "text"))
    return examples.where("subject is not null and text is not null").select("example_id", "subject", "text", drawn.alias("drawn")).where(F.col("drawn") <= per_subject)


def train(documents: DataFrame, examples: DataFrame, subjects: list[str], sample_docs: int = SAMPLE_DOCS, per_subject: int = PER_SUBJECT, shards: int = SHARDS, passes: tuple[int, ...] = PASSES) -> Weights:
    """Fit on at most ``per_subject`` examples of each subject, then once per entry of ``passes`` on them and a sample of about ``sample_docs`` documents."""
    spark = documents.sparkSession
    held = [(r["subject"], r["text"]) for r in bounded(examples.where(F.col("subject").isin(subjects)), per_subject).orderBy("example_id", "subject", "text").collect()]
    weights = Weights(len(subjects))
    rows = _example_rows(held, subjects, None)
    if not rows:
        return weights
    weights.train([np.array(f) for f, _ in rows], np.array([t for _, t in rows], dtype=np.float32), 12, 1, batch=64)
    many = documents.count()  # by the files' own counts
    grain = 1 << 30
    kept = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < F.lit(min(grain, int(grain * sample_docs / max(many, 1)) + 1)))
    kept = cut(kept.select("doc_id", "text").repartition(shards))
    for turn, count in enumerate(passes):
        teacher = spark.sparkContext.broadcast(weights)
        own = _example_rows(held, subjects, weights if turn else None)
        frame = spark.createDataFrame(pd.DataFrame([(i % shards, f, t) for i, (f, t) in enumerate(own * 3)], columns=["shard", "features", "target"]), ROWS)
        data = cut(kept.mapInArrow(_sampled(teacher, turn > 0, shards), ROWS).unionByName(frame).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("features", "target")))
        weights = Weights(len(subjects), seed=turn + 1)
        for step in range(count):
            weights = _synchronised(data, weights, 100 * turn + step)
        teacher.destroy()
    return weights


def _shard_pass(shared, seed: int):
    """One pass of a partition over its rows, from common weights; out come its steps."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, targets, shard = [], [], 0
        for batch in batches:
            if batch.num_rows:
                shard = batch.column(0)[0].as_py()
                rows += [np.asarray(x.values) for x in batch.column(1)]
                targets.append(np.asarray(batch.column(2).flatten(), dtype=np.float32).reshape(batch.num_rows, -1))
        if rows:
            before = shared.value
            after = before.copy()
            after.train(rows, np.concatenate(targets), 1, seed * 1000 + shard)
            steps = [(getattr(after, n) - getattr(before, n)).tobytes() for n in Weights.NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(Weights.NAMES), pa.array([shard] * len(steps), pa.int32()), pa.array(steps, pa.binary())], names=["name", "shard", "step"])

    return run


def _averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The common step of one array of weights: summed step sizes, else the mean over the shards that moved a row."""
    name = pdf["name"].iloc[0]
    moves = [np.frombuffer(x, dtype=np.float32) for x in pdf.sort_values("shard")["step"]]  # in order, so that sums come out alike
    total = np.sum(moves, axis=0)
    if name == "embedding":
        touched = np.sum([(m.reshape(FEATURES, WIDTH) != 0).any(axis=1) for m in moves], axis=0)
        total = (total.reshape(FEATURES, WIDTH) / np.maximum(touched, 1)[:, None].astype(np.float32)).ravel()
    elif not name.endswith("_steps"):
        total = total / np.float32(len(moves))
    return pd.DataFrame({"name": [name], "step": [total.astype(np.float32).tobytes()]})


def _synchronised(data: DataFrame, weights: Weights, seed: int) -> Weights:
    """One pass of every shard from common weights, and the mean of their steps."""
    shared = data.sparkSession.sparkContext.broadcast(weights)
    steps = data.mapInArrow(_shard_pass(shared, seed), "name string, shard int, step binary").groupBy("name").applyInPandas(_averaged, "name string, step binary").collect()  # one model's size
    out = weights.copy()
    for row in steps:
        base = getattr(out, row["name"])
        base += np.frombuffer(row["step"], dtype=np.float32).reshape(base.shape)
    shared.destroy()
    return out


def subjects_of(p: np.ndarray, on: float = ON, share: float = SHARE) -> list[int]:
    """The subjects of a document from the probabilities of its sentences."""
    if not len(p):
        return []
    told = p >= on  # a sentence may be on several
    counts, n = told.sum(axis=0), int(told.any(axis=1).sum())
    return [int(i) for i in np.flatnonzero((counts > 0) & (counts >= share * n))]


def _scoring(shared, subjects: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            docs, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = sentences(text.as_py())
                if parts:
                    for i in subjects_of(scorer(parts)):
                        docs.append(key)
                        found.append(subjects[i])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.string())], names=["doc_id", "subject"])

    return run


def assign(documents: DataFrame, examples: DataFrame, subjects: list[str], weights: Weights | None = None) -> DataFrame:
    """doc_id and subject, a row for every subject of every document.

    Null, empty and blank texts, and texts without a sentence on any subject,
    have no row. Repeated documents have rows each.
    """
    weights = train(documents, examples, subjects) if weights is None else weights
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    return spread(documents.select("doc_id", "text")).mapInArrow(_scoring(shared, subjects), "doc_id bigint, subject string")
