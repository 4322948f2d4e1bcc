"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text becomes the hashed counts of its words, word pairs and their shapes; nothing else is an input. One task trains on
a bounded sample of labelled rows; the weights, a vector of fixed size, go to all executors, and each text is scored
there as the dot product of its sparse counts and the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import map_rows, whole_text

#: Labelled rows to train on: those with the smallest hash of their id, so the same ones in every run.
TRAIN_ROWS = 12_000
BITS = 18
EPOCHS = 3

_SHAPES = bytes(0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate follow-the-regularised-leader steps; l1 leaves weights at zero that data don't support."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0


def features(text: str) -> np.ndarray:
    """Hashed coordinates of a text's n-grams, one entry for each occurrence; the first coordinate is the bias."""
    raw = text.encode("utf-8")
    words, shapes = text.lower().encode("utf-8").split(), raw.translate(_SHAPES).split()
    if not words:
        return np.array([1], np.uint32)
    one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    shape = np.fromiter(map(zlib.crc32, shapes), np.uint32, len(shapes)) * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(0x85EBCA6B) ^ one[1:]
    pair = shape[:-1] * np.uint32(0xC2B2AE35) ^ shape[1:]
    mixed = np.concatenate([one, two, shape, pair])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - BITS)) | np.uint32(2)


def sparse(coordinates: np.ndarray) -> np.ndarray:
    """Two rows: the different coordinates and how often each occurs."""
    return np.stack([x.astype(np.uint32) for x in np.unique(coordinates, return_counts=True)])


def margin(weights: np.ndarray, coordinates: np.ndarray) -> float:
    return float(weights[0] + weights[coordinates].sum(dtype=np.float64) / np.sqrt(len(coordinates)))


def chance(value: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, value)))))


def train(rows: Iterable[tuple[np.ndarray, int]], rule: Ftrl = Ftrl()) -> np.ndarray:
    """Weights after one update for each (sparse counts, label), in the given order; no row is held."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for (coordinates, counts), label in rows:
        at, x = np.append(0, coordinates), np.append(1.0, counts / np.sqrt(counts.sum()))
        w = _weights(z[at], n[at], rule)
        gradient = (chance(float(w @ x)) - label) * x
        squares = gradient * gradient
        z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / rule.alpha * w
        n[at] += squares
    return _weights(z, n, rule).astype(np.float32)


def _weights(z: np.ndarray, n: np.ndarray, rule: Ftrl) -> np.ndarray:
    return np.where(np.abs(z) <= rule.l1, 0.0, -(z - np.sign(z) * rule.l1) / ((rule.beta + np.sqrt(n)) / rule.alpha + rule.l2))


def held_out(key: Column) -> Column:
    """Rows that training never sees: crc32 of the key as text, modulo 4, is 2. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from the labelled rows that aren't held out.

    Ids with contradicting labels, null labels and null ids are left out. Without any row all weights are 0, and every
    score is 0.5. At most ``rows`` labelled ids take part, each with one text, the one of least hash if an id is there
    with several. The one task that trains streams past them once for each epoch and holds the weights and a batch: a
    text is at most 2 ** BITS coordinates, however long.
    """
    agreed = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    # The order is by a hash of the id: as good as random, and the same in every run.
    chosen = agreed.select(F.col(key).alias("key"), F.col("y").cast("int").alias("y"), F.xxhash64(key).alias("turn")).orderBy("turn", "key").limit(rows)
    sample = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).join(F.broadcast(chosen), "key").select("turn", "key", "y", F.xxhash64("text").alias("h"), "text")

    def featurized():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [sparse(features(x)).tobytes() for x in batch.column(4).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(packed, pa.binary())], ["turn", "key", "y", "h", "packed"])

        return step

    def trained(batches):
        rows = ((np.frombuffer(p.as_buffer(), np.uint32).reshape(2, -1), y.as_py()) for b in batches for y, p in zip(b.column(1), b.column(2), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()], pa.binary())], ["weights"])

    kind = docs.schema[key].dataType.simpleString()
    counted = map_rows(sample, f"turn bigint, key {kind}, y int, h bigint, packed binary", featurized)
    one_each = counted.groupBy("turn", "key", "y").agg(F.min_by("packed", "h").alias("packed"))
    epochs = one_each.select(F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"), "turn", "key", "y", "packed")
    in_order = epochs.repartition(1).sortWithinPartitions("epoch", "turn", "key").select("epoch", "y", "packed")
    found = in_order.mapInArrow(trained, T.StructType([T.StructField("weights", T.BinaryType())])).collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the chance of label 1 for every whole text.

    A null text is the empty text, which has a coordinate of its own. Rows are kept as they are, repeated ones and null
    keys too; other columns are not read. An empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 << BITS bytes, whatever the data

    def make():
        held = shared.value

        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            scores = [chance(margin(held, features(x))) for x in rows.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64())], [key, "score"])

        return step

    return map_rows(docs.select(key, whole_text(text).alias("text")), f"`{key}` {kind}, score double", make)
