"""Quality classifier: logistic regression on hashed word n-grams, learned by follow the regularised leader."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .text import Memo, crc_remainder, few, mixed, turn_to

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
#: Features are hashed to so many places.
PLACES = 1 << 18
#: A document's features sum up to this.
SCALE = 16.0


def _lower(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token.lower(), 3)


def _shape(token: bytes) -> int:
    """Letters by their case and rough length, digits as one class, everything else as it is."""
    if token[:1].isdigit():
        return 1
    if not token[:1].isalpha() and token[0] < 128:
        return _lower(token[:4])
    case = 2 if token.islower() else 3 if token.istitle() else 4 if token.isupper() else 5
    return case * 8 + min(len(token) // 4, 7)


_WORDS, _SHAPES = Memo(_lower), Memo(_shape)


def features(utf8: bytes) -> np.ndarray:
    """A place for each word, each run of up to three word shapes, and each word that repeats the one before."""
    tokens = TOKEN.findall(utf8)
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, n)
    s = mixed(np.fromiter(map(_SHAPES.__getitem__, tokens), np.uint64, n))
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = s[:-1] * a + s[1:]
    runs = pairs[:-1] * b + s[2:]
    again = np.full(int((w[:-1] == w[1:]).sum()), 77, np.uint64)
    grams = np.concatenate((w, s + np.uint64(1), pairs + np.uint64(2), runs + np.uint64(3), again))
    return (mixed(grams) % np.uint64(PLACES)).astype(np.int64)


@dataclass(frozen=True)
class Leader:
    """Settings of follow the regularised leader (proximal, a rate for each coordinate)."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.5
    epochs: int = 2


def learn(rows: Iterable[tuple[bytes, int]], how: Leader = Leader()) -> np.ndarray:
    """Weights of all places, and last the bias, from (text, label) in the given order.

    Texts are read once; later passes go over their features, six bytes each.
    """
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    held: list[tuple[np.ndarray, np.ndarray, int]] = []

    def weights(z, n):
        kept = np.abs(z) > how.l1
        return np.where(kept, -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2), 0.0)

    def see(places, counts, label):
        values = np.append(counts * (SCALE / max(1, counts.sum(dtype=np.int64))), 1.0)
        at = np.append(places, PLACES)
        zp, np_ = z[at], n[at]
        w = weights(zp, np_)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
        more = np_ + g * g
        z[at] = zp + g - (np.sqrt(more) - np.sqrt(np_)) / how.alpha * w
        n[at] = more

    for utf8, label in rows:
        places, counts = np.unique(features(utf8), return_counts=True)
        held.append((places.astype(np.int32), np.minimum(counts, 65535).astype(np.uint16), label))
        see(*held[-1])
    for _ in range(how.epochs - 1):
        for example in held:
            see(*example)
    return weights(z, n)


class QualityModel:
    """Weights, sent to the executors once: their number is fixed."""

    def __init__(self, spark, weights: np.ndarray):
        self.weights = spark.sparkContext.broadcast(weights.astype(np.float32).tobytes())

    def score(self, text: Column) -> Column:
        """Between 0 and 1, higher if label 1 is likelier; a null text counts as empty."""
        held = self.weights

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            turn_to("quality")
            weights = np.frombuffer(held.value, np.float32)
            for texts in batches:
                yield pa.array([probability(weights, t.as_py()) for t in texts], pa.float64())

        return scored(F.coalesce(text.cast("binary"), F.lit(b"")))


def probability(weights: np.ndarray, utf8: bytes) -> float:
    places = features(utf8)
    total = float(weights[places].sum(dtype=np.float64)) * SCALE / len(places) if len(places) else 0.0
    return float(1 / (1 + np.exp(-np.clip(total + float(weights[PLACES]), -30, 30))))


def fit_quality(docs: DataFrame, labels: DataFrame, examples: int = 10_000, doc_id: str = "doc_id", text: str = "text",
                label: str = "quality", how: Leader = Leader()) -> QualityModel:
    """Learns from labelled documents whose crc32(id as text) mod 3 is not 1.

    ``examples`` bounds the sample: the labels with the smallest hashes of their ids. Null ids and null labels are not used;
    a document labelled twice counts twice, within the bound. Without any example all scores are 0.5.
    """
    hashed = F.xxhash64(F.col("id"))
    wanted = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (crc_remainder(F.col("id"), 3) != 1))
    chosen = F.broadcast(wanted.orderBy(hashed, "id", "label").limit(examples))
    sample = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("utf8")).join(
        chosen, "id").orderBy(hashed, "id", F.xxhash64("utf8"), "label").limit(examples).select("utf8", "label")

    def train(batches):
        turn_to("learning")
        rows = (row for batch in batches for part in few(batch) for row in zip(*[c.to_pylist() for c in part.columns]))
        first = next(rows, None)
        if first is not None:
            yield pa.RecordBatch.from_pydict({"w": pa.array([learn(chain([first], rows), how).astype(np.float32).tobytes()], pa.binary())})

    found = sample.mapInArrow(train, "w binary").collect()
    weights = np.frombuffer(found[0]["w"], np.float32) if found else np.zeros(PLACES + 1, np.float32)
    return QualityModel(docs.sparkSession, weights)


def quality_scores(docs: DataFrame, labels: DataFrame, examples: int = 10_000, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (1 from 0.5 on).

    See :func:`fit_quality` for what is learned. Empty and null texts get the bias alone; null ids are not held out;
    other columns are not read.
    """
    model = fit_quality(docs, labels, examples, doc_id, text)
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(crc_remainder(F.col(doc_id), 3) == 1, F.lit(False)).alias("held_out"),
        model.score(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
