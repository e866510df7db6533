"""Quality classifier: supervised subword embeddings.

Words and character n-grams of a text are hashed into ``buckets`` vectors of
``dim`` numbers; a text is the mean of its vectors, a softmax over it gives the
label. Vectors and output weights are trained together by stochastic gradient
descent in numpy, on a bounded sample of ``sample_rows`` labelled rows.
Scoring folds vectors and output weights into one number per bucket (the
softmax of two classes needs only their difference), so that a text's score is
a mean of looked-up numbers: one pass, no shuffle, a model of fixed size.

Edge cases: null and empty texts get the prior; rows with null doc_id or label
are never trained on; a doc_id with several labels counts with the larger one,
with several texts by the smallest; without labelled rows of both classes the
score is the (smoothed) share of label 1; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.llm.shared import all_rows, bound_batches, free_name, packed_rows, unpacked

BUCKET_BITS = 16
DIM = 16
NGRAMS = (3, 4)
EPOCHS = 4
RATE = 1.0
BATCH = 32
#: Bound of the training sample (rows); also bounds what one task reads.
SAMPLE_ROWS = 2500
BLOCK_CHARS = 1 << 18

_MIX = np.uint32(2654435761)
_STEP = 16777619
_BACK = pow(_STEP, -1, 2 ** 32)


def _powers(base: int, n: int) -> np.ndarray:
    out, factor = np.ones(1, np.uint32), base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint32(factor)])
        factor = factor * factor % 2 ** 32
    return out[:n]


_powers_at = {}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers_at.get(base, ())) < n:
        _powers_at[base] = _powers(base, max(n, BLOCK_CHARS * 2))
    return _powers_at[base][:n]


def features(texts: list[str], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every word, word repeat and character n-gram."""
    # texts are separated by a NUL code; a NUL inside a text only cuts n-grams there
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    shift = np.uint32(32 - bits)
    buckets, docs = [], []
    mixed = codes * _MIX ^ (codes >> np.uint32(3))
    sound = codes != 0
    rolled, good = mixed.copy(), sound.copy()
    for n in range(2, max(NGRAMS) + 1):
        if len(codes) < n:
            break
        rolled = (rolled[: len(codes) - n + 1] * np.uint32(_STEP)) ^ mixed[n - 1:]
        good = good[: len(codes) - n + 1] & sound[n - 1:]
        if n in NGRAMS:
            at = np.flatnonzero(good)
            buckets.append(((rolled[at] + np.uint32(n)) * _MIX) >> shift)
            docs.append(owner[at])
    inside = (codes > 32)
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start):
        total = np.concatenate([np.zeros(1, np.uint32), np.cumsum(mixed * powers(_STEP, len(mixed)), dtype=np.uint32)])
        word = (total[end] - total[start]) * powers(_BACK, len(mixed))[start]
        buckets.append((word * _MIX) >> shift)
        docs.append(owner[start])
        # a word that repeats the one before it is a feature of its own, whatever the word
        again = np.flatnonzero((word[1:] == word[:-1]) & (owner[start[1:]] == owner[start[:-1]]))
        buckets.append(np.zeros(len(again), np.uint32))
        docs.append(owner[start[again + 1]])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(docs)


def bags(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, shares) per text."""
    for text in texts:
        found, times = np.unique(features([text], bits)[0], return_counts=True)
        yield found.astype(np.int64), (times / max(1, times.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], bits: int = BUCKET_BITS, dim: int = DIM, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = 0) -> tuple[np.ndarray, float]:
    """(score of each bucket, intercept): the log-odds of label 1 is the mean
    of a text's bucket scores plus the intercept."""
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share)))
    bag = list(bags(texts, bits))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    steps = epochs * -(-len(y) // BATCH)
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at: at + BATCH]
            lr = rate * (1 - step / steps)
            step += 1
            idx = np.concatenate([bag[r][0] for r in rows])
            w = np.concatenate([bag[r][1] for r in rows])
            doc = np.repeat(np.arange(len(rows)), [len(bag[r][0]) for r in rows])
            mean = np.stack([bag[r][1] @ vectors[bag[r][0]] for r in rows])
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ out.T
            out -= lr * (mean.T @ p)
            bias -= lr * 0.1 * p.sum(axis=0)
            # one text's share of a bucket is small: vectors take the step scaled up to the bag's size
            np.add.at(vectors, idx, -lr * (w * 20)[:, None] * back[doc])
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def log_odds(texts: list[str | None], table: np.ndarray, intercept: float) -> np.ndarray:
    """Log-odds of label 1 per text, texts taken in blocks of bounded size."""
    bits = int(np.log2(len(table)))
    out = np.full(len(texts), intercept)
    part: list[int] = []
    held = 0

    def flush():
        nonlocal held
        if part:
            bucket, doc = features([texts[i] for i in part], bits)
            total = np.bincount(doc, weights=table[bucket], minlength=len(part))
            out[part] += total / np.maximum(1, np.bincount(doc, minlength=len(part)))
        part.clear()
        held = 0

    for i, text in enumerate(texts):
        if text:
            part.append(i)
            held += len(text)
            if held >= BLOCK_CHARS:
                flush()
    flush()
    return out


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int,
                    rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled rows outside the held-out
    fold, drawn by a hash of the id. The drawn ids are a bounded broadcast, so
    the documents aren't shuffled."""
    drawn = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return (docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1,
        rows: int = SAMPLE_ROWS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Train in one task on the bounded sample; only the model (fixed size)
    comes back to the driver."""
    sample = labelled_sample(docs, labels, label, folds, fold, rows)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = all_rows(frames)
        if frame is None:
            return
        frame = frame.sort_values("doc_id")
        table, intercept = train([t or "" for t in frame["text"]], frame["y"].tolist(), seed=seed)
        yield pd.DataFrame({"model": [table.tobytes()], "intercept": [intercept]})

    got = sample.coalesce(1).mapInPandas(learn, "model binary, intercept double").first()
    if got is None:
        return train([], [])
    return np.frombuffer(got.model, np.float32), got.intercept


def with_score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one float per bucket

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        table, intercept = shared.value
        z = log_odds(texts.tolist(), table, intercept)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    name = free_name(docs, "score")
    return docs.withColumn(name, score("text")).withColumn(free_name(docs, "predicted"), (F.col(name) >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return unpacked(with_score(packed_rows(docs), model).where("predicted = 1"), docs.columns)
