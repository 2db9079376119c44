"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashed buckets of its words, word pairs and pairs with one word
between, each present or absent; words are runs of letters and digits, A-Z lower-cased. Training
follows the gradient of one example at a time with a learning rate per coordinate and soft
thresholding (L1), so that most weights are exactly zero; the rest is small enough to broadcast,
whatever the corpus holds: at most ``2**BITS`` numbers, in practice some hundreds.

The model is fitted on a bounded sample of labelled rows (``train_rows``, chosen by a hash of the
document id); scores cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.llm.common import materialize
from tissuegrid.llm.textarrays import Words, batches, byte_table

BITS = 20
#: About this many labelled rows are used for fitting; a documented bound.
TRAIN_ROWS = 12_000
#: Examples seen in training, in passes over the sample (one pass at least).
STEPS = 36_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
THRESHOLD = 0.3
#: Remainder of crc32(doc_id) modulo 4 that is never learnt from.
HELD_OUT = 2

_SEPARATORS = [b for b in range(128) if not chr(b).isalnum()]
_SHIFT = np.uint64(64 - BITS)

#: Log odds of every text where there was no example.
NOTHING_LEARNT = -35.0


def is_held_out(doc_id: str = "doc_id"):
    """Whether a document's label must not be learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of each word, word pair and skip pair of a batch of texts."""
    words = Words(raw, byte_table(_SEPARATORS, fold=True))
    h, doc = words.hash, words.doc
    buckets, owners = [h >> _SHIFT], [doc]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD1B54A32D192ED03)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            joined = (h[:-gap] * np.uint64(salt)) ^ (h[gap:] + np.uint64(gap))
            joined = (joined ^ (joined >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((joined >> _SHIFT)[same])
            owners.append(doc[:-gap][same])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal state: per coordinate the gradient sums that give its weight and rate."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)
        self.bias = 1 << bits  # last coordinate, not penalised

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == self.bias, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, at: np.ndarray, label: float) -> None:
        """One example with the coordinates ``at`` set to one."""
        at = np.append(at, self.bias)
        w = self.weights(at)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        squared = gradient * gradient
        sigma = (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += squared

    def table(self) -> pd.DataFrame:
        """Non-zero weights; the bias has the bucket one beyond the last."""
        every = np.flatnonzero(self.n)
        w = self.weights(every)
        return pd.DataFrame({"bucket": every[w != 0], "weight": w[w != 0]})


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, steps: int = STEPS) -> DataFrame:
    """(``bucket``, ``weight``) learnt from rows of ``labels`` (``doc_id``, ``toxic``) that are not held out.

    Null labels, null ids, contradictory labels of one id (the greater counts) and repeated rows are
    harmless; a labelled id without a document is passed over. Without any example the model is empty,
    and ``score`` predicts 0 for every text.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    share = min(1.0, train_rows / max(1, usable.count()))
    # Documents are chosen by their hash: the same ones whatever the layout.
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, raw in batches(frame["text"]):
                bucket, owner = features(raw)
                pair = np.unique(owner * (1 << BITS) + bucket)
                cut = np.searchsorted(pair, np.arange(1, len(raw)) * (1 << BITS))
                part = frame.iloc[first:first + len(raw)]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "label": part["label"].to_numpy(),
                    "buckets": [(v & ((1 << BITS) - 1)).astype("<i4").tobytes() for v in np.split(pair, cut)]})

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f for f in frames] or [pd.DataFrame({"doc_id": [], "label": [], "buckets": []})])
        rows = rows.drop_duplicates(["doc_id", "buckets"]).sort_values(["doc_id", "buckets"], ignore_index=True)
        model, rng = Ftrl(), np.random.Generator(np.random.PCG64(3))
        examples = [np.frombuffer(b, dtype="<i4") for b in rows["buckets"]]
        label = rows["label"].to_numpy(dtype=float)
        for _ in range(max(1, round(steps / max(1, len(rows))))):
            for i in rng.permutation(len(rows)):
                model.learn(examples[i], label[i])
        yield model.table()

    # A bounded number of examples goes to one task, as each step needs the weights of the one before.
    examples = materialize(texts.mapInPandas(extract, "doc_id long, label int, buckets binary"), "examples")
    return examples.repartition(1).mapInPandas(learn, "bucket long, weight double")


def score(docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(``doc_id``, ``held_out``, ``score``, ``predicted``), one row per row of ``docs``.

    A null or empty text has no feature and gets the score of the bias alone. Repeated rows and rows
    with a null ``doc_id`` are scored like any other; other columns are ignored. An empty model knows
    no toxic text: every score is close to 0.
    """
    # At most one row per bucket.
    learnt = weights.toPandas()
    at, w = learnt["bucket"].to_numpy(dtype=np.int64), learnt["weight"].to_numpy(dtype=float)
    bias = float(w[at == 1 << BITS].sum()) if len(at) else NOTHING_LEARNT
    shared = docs.sparkSession.sparkContext.broadcast((at[at < 1 << BITS], w[at < 1 << BITS]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, value = shared.value
        dense = np.zeros(1 << BITS)
        dense[place] = value
        for frame in frames:
            for first, raw in batches(frame["text"]):
                bucket, owner = features(raw)
                hit = dense[bucket] != 0
                pair = np.unique(owner[hit] * (1 << BITS) + bucket[hit])
                total = bias + np.bincount(
                    pair >> BITS, weights=dense[pair & ((1 << BITS) - 1)], minlength=len(raw))
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[first:first + len(raw)].to_numpy(),
                                    "score": 1.0 / (1.0 + np.exp(-total))})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = docs.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
