"""Operator 3: a quality classifier on averaged subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codepoints import codes, grouped, ngrams, sums
from .common import pick, ship, text_or_empty
from .text_hash import NOT_SPACE, bounds, buffers, word_hashes

BUCKET_BITS = 16
NGRAMS = (3, 4)
DIMENSIONS = 12
#: Hashed buckets, then one bucket for each relation of a word to the one before.
_BUCKETS = 1 << BUCKET_BITS
_ALL_BUCKETS = _BUCKETS + 3
#: Buckets of fewer training documents keep a zero vector: they would only be learned by heart.
MIN_DOCUMENTS = 5
#: Labelled documents that the classifier is fitted on at most, drawn by hash of
#: the id. A few thousand settle its weights; the bound keeps the fit's time and
#: the driver's memory the same at every corpus size.
MAX_TRAINING = 3000
EPOCHS = 6
LEARNING_RATE = 0.6
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _relations(words: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each word the bucket of its relation to the one before: the same, another, or none before."""
    out = np.full(len(words), _BUCKETS, np.int64)
    out[1:] += np.where(rows[1:] == rows[:-1], np.where(words[1:] == words[:-1], 2, 1), 0)
    return out


def _features(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For runs [i, j) of rows: per kind of feature, the buckets and where each row's begin."""
    texts = column.to_pylist()
    shift = np.uint64(64 - BUCKET_BITS)
    for i, j in grouped(texts):
        data, offsets = buffers(column.slice(i, j - i))
        words, rows = word_hashes(data, offsets, NOT_SPACE)
        at = bounds(rows, j - i)
        kinds = [((words >> shift).astype(np.int64), at), (_relations(words, rows, at), at)]
        found, begin = codes(texts[i:j])
        for n in NGRAMS:
            hashes, inside = ngrams(found, n)
            at = np.flatnonzero(inside)
            kinds.append(((hashes[at] >> shift).astype(np.int64), np.searchsorted(at, begin)))
        yield i, j, kinds


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each training text as its buckets and their shares."""
    for batch in batches:
        bags = []
        for i, j, kinds in _features(batch.column("text")):
            for k in range(j - i):
                mine = np.concatenate([b[at[k] : at[k + 1]] for b, at in kinds])
                bucket, count = np.unique(mine, return_counts=True)
                bags.append((bucket.astype("<u4").tobytes(), (count / max(1, len(mine))).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("quality"),
                pa.array([b for b, _ in bags], pa.binary()),
                pa.array([s for _, s in bags], pa.binary()),
            ],
            names=["doc_id", "quality", "buckets", "shares"],
        )


@dataclass
class Model:
    """The softmax of a mean of vectors depends on it through one weight a bucket: kept ready for scoring."""

    weights: np.ndarray
    bias: float


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Learn vectors and a two-class softmax by stochastic gradient descent.

    ``bags`` holds (label, buckets, shares) of each document.
    """
    random = np.random.default_rng(seed)
    seen = np.zeros(_ALL_BUCKETS, np.int64)
    for _, buckets, _ in bags:
        seen[buckets] += 1
    known = seen >= MIN_DOCUMENTS
    vectors = random.uniform(-1, 1, (_ALL_BUCKETS, DIMENSIONS)) / DIMENSIONS
    vectors[~known] = 0
    out, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(bags)):
            label, buckets, shares = bags[k]
            some = known[buckets]
            buckets, shares = buckets[some], shares[some].astype(float)
            rate = LEARNING_RATE * (1 - done / steps)
            done += 1
            mean = shares @ vectors[buckets]
            logits = mean @ out + bias
            grad = np.exp(logits - logits.max())
            grad /= grad.sum()
            grad[label] -= 1
            back = out @ grad
            out -= rate * np.outer(mean, grad)
            bias -= rate * grad
            # the vectors' step, for all buckets as if each were the whole text
            vectors[buckets] -= rate * (shares / max(shares.max(initial=0), 1e-9))[:, None] * back
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_training: int = MAX_TRAINING,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Fit on the labelled documents that are not held out, at most ``max_training`` of them."""
    ship(docs.sparkSession)
    labelled = pick(labels, doc_id="doc_id", quality=label_col)
    labelled = labelled.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = (
        labelled.groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_training)
    )
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty("text").alias("text"))
    chosen = rows.join(F.broadcast(sample), "doc_id")  # max_training rows
    found = (
        chosen.select("doc_id", "quality", "text")
        .mapInArrow(_bags, "doc_id long, quality int, buckets binary, shares binary")
        .groupBy("doc_id")
        .agg(F.min(F.struct("quality", "buckets", "shares")).alias("bag"))  # of several texts with one id always the same
        .select("doc_id", "bag.*")
        .toArrow()
        .sort_by("doc_id")
    )
    columns = (found[c] for c in ("quality", "buckets", "shares"))
    # views of Arrow's buffers: a training document costs the driver 8 bytes for each of its buckets
    bags = [(q.as_py(), np.frombuffer(b.as_buffer(), "<u4"), np.frombuffer(s.as_buffer(), "<f4")) for q, b, s in zip(*columns, strict=True)]
    return fit([b for b in bags if len(b[1])])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, j, kinds in _features(batch.column("_text")):
                total, n = np.zeros(j - i), np.zeros(j - i)
                for bucket, at in kinds:
                    total += sums(model.weights[bucket], at, j - i)
                    n += np.diff(at[: j - i + 1])
                scores[i:j] = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + model.bias)))
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_text"]
            names = [name for name in batch.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*names, "_score"])

    return run


def _with_scores(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` under inner column names _0, _1, ... and _score."""
    ship(docs.sparkSession)
    at = f"_{docs.columns.index(text_col)}"
    rows = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    schema = rows.withColumn("_score", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.withColumn("_text", text_or_empty(at)).mapInArrow(_scores(shared), schema)


def quality_scores(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score (nearer 1: label 1 likelier), predicted.

    The features of a whole text are its words and its character 3- and
    4-grams, hashed to buckets, and whether each word repeats the one before;
    the mean of their vectors goes to the softmax.

    Nulls and empties: a text without features is scored by the bias alone;
    null ids are carried along, as not held out, and no label is learned from
    them. Repeated rows get the same score. An empty table gives no rows, an
    empty label table a score of 0.5. Other columns are ignored.
    """
    scored = _with_scores(pick(docs, doc_id=id_col, text=text_col), model, "text")
    return scored.select(
        F.col("_0").alias("doc_id"),
        held_out(F.col("_0")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without those that the classifier rejects; no shuffle."""
    scored = _with_scores(docs, model, text_col).where(F.col("_score") >= threshold)
    return scored.drop("_score").toDF(*docs.columns)
