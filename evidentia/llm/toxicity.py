"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is toxic if one of its sentences is: with sentence probabilities p the document has
1 - prod(1 - p) (noisy-or). The sentence model is logistic over hashed words and word beginnings
and is trained through the noisy-or from document labels alone, so that its sentence scores
afterwards show where a document offends.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from evidentia.llm.common import emit, ship, texts_of

#: Labelled documents of each class that the model is fitted on at most, taken by a hash of the id.
SAMPLE = 4000
#: Characters of sampled text of each class, so that the driver's share stays bounded.
SAMPLE_CHARS = 8_000_000
#: Characters of the longest text that is learned from; scoring reads texts of any length.
LONGEST = SAMPLE_CHARS // 8
BUCKETS = 1 << 18
BEGINNINGS = (2, 3, 4, 5, 6, 7)
#: Documents that must hold a feature before it gets a weight.
LEAST_DOCS = 3
#: Standard errors by which a feature's shares must differ between the classes before it gets a weight.
LEAST_Z = 4.5

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
_WORD = re.compile(r"\w+")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Half-open character spans of the sentences, which end at . ! ? or a line feed."""
    return [m.span() for m in _SENTENCE.finditer(text)]


class Features:
    """Feature buckets of words, with a bounded cache."""

    def __init__(self, most: int = 100_000):
        self.cache: dict[str, tuple[int, ...]] = {}
        self.most = most

    def of(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > self.most:
                self.cache.clear()
            names = [f"w {word}", *[f"b {word[:n]}" for n in BEGINNINGS if len(word) > n]]
            found = self.cache[word] = tuple({zlib.crc32(n.encode()) % BUCKETS for n in names})
        return found


@dataclass
class ToxicityModel:
    """Sentence weights; a sentence's logit is bias + the sum over its distinct words' weights."""

    weights: np.ndarray
    bias: float


def _telling(texts: list[str], y: np.ndarray, features: Features) -> np.ndarray:
    """Of each bucket: whether its share among toxic documents differs from that among others by LEAST_Z standard errors."""
    toxic, every, ones = np.zeros(BUCKETS), np.zeros(BUCKETS), y.sum()
    for text, label in zip(texts, y, strict=True):
        found = set().union(*map(features.of, set(_WORD.findall(text.lower()))))
        index = np.fromiter(found, np.int64, len(found))
        every[index] += 1
        toxic[index] += label
    share = every / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / (len(y) - ones)))
    return (every >= LEAST_DOCS) & (np.abs(toxic / ones - (every - toxic) / (len(y) - ones)) >= LEAST_Z * error)


def _arrays(texts: list[str], kept: np.ndarray, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept feature buckets, the sentence of each, and the document of each sentence."""
    index, sentence, document = array("q"), array("q"), array("q")
    held: dict[str, tuple[int, ...]] = {}
    for d, text in enumerate(texts):
        for part in _SENTENCE.findall(text):
            found: set[int] = set()
            for word in set(_WORD.findall(part.lower())):
                if word not in held:
                    held[word] = tuple(i for i in features.of(word) if kept[i])
                found.update(held[word])
            index.extend(found)
            sentence.extend([len(document)] * len(found))
            document.append(d)
        if len(held) > features.most:
            held.clear()
    return np.array(index, np.int64), np.array(sentence, np.int64), np.array(document, np.int64)


def fit(texts: list[str], labels: list[int], share: float | None = None, epochs: int = 120, rate: float = 0.25, penalty: float = 2e-6) -> ToxicityModel:
    """Train through the noisy-or by full-batch Adam; one-sided labels give a constant model.

    `share` is the share of toxic documents among all labelled ones, where the sample has another.
    """
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(np.zeros(BUCKETS), 12.0 if len(y) and y[0] else -12.0)
    features = Features()
    feature, sentence, document = _arrays(texts, _telling(texts, y, features), features)
    n_docs, n_sentences = len(texts), len(document)
    used, feature = np.unique(feature, return_inverse=True)
    w, bias = np.zeros(len(used)), -7.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    taken = y.mean()
    share = taken if share is None else share
    cost = np.where(y > 0, share / taken, (1 - share) / (1 - taken))
    for step in range(1, epochs + 1):
        z = bias + np.bincount(sentence, w[feature], n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), n_docs)
        whole = np.clip(1 - np.exp(log_none), 1e-9, 1 - 1e-9)
        doc_side = np.where(y > 0, -(1 - whole) / whole, 1.0) * cost
        slope = doc_side[document] * p / n_docs
        gradient = np.append(np.bincount(feature, slope[sentence], len(used)) + penalty * w, slope.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        move = rate * (1 - 0.9 * step / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return ToxicityModel(weights, float(bias))


def sample(docs: DataFrame, labels: DataFrame, spare_rest: int | None = 2, longest: int = LONGEST) -> tuple[list[str], list[int], float | None]:
    """The labelled texts to learn from: those whose crc32(doc_id) mod 4 is not `spare_rest`, bounded by SAMPLE and SAMPLE_CHARS; and the share of toxic ones among all of these.

    Which documents are taken depends on a hash of the id alone. Rows without an id, a text or a
    label teach nothing; a document with several labels is taken once with the largest, and one of
    the texts of a repeated id. Texts of more than `longest` characters are left out, so that a few
    cannot use up SAMPLE_CHARS. Lengths are looked at first and only the chosen texts are fetched.
    """
    order = F.xxhash64("doc_id", F.lit(29))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if spare_rest is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != spare_rest)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    of = lambda label: known.where(F.col("toxic") == label).withColumn("o", order).orderBy("o", "doc_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= longest).withColumn("key", F.xxhash64("text"))
    lengths = rows.join(F.broadcast(of(0).unionByName(of(1))), "doc_id").groupBy("toxic", "o", "doc_id").agg(F.min(F.struct("key", F.length("text").alias("n"))).alias("t"))
    room, chosen = {0: SAMPLE_CHARS, 1: SAMPLE_CHARS}, []
    for row in sorted(lengths.select("toxic", "o", "doc_id", "t.*").collect()):  # 2 * SAMPLE at most
        room[row["toxic"]] -= row["n"]
        if room[row["toxic"]] >= 0:
            chosen.append((row["doc_id"], row["key"], row["toxic"], len(chosen)))
    if not chosen:
        return [], [], n.get(1, 0) / sum(n.values()) if n else None
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, key long, toxic int, place int")
    taken = sorted(rows.join(F.broadcast(wanted), ["doc_id", "key"]).groupBy("place", "toxic").agg(F.first("text").alias("text")).collect())
    return [r["text"] for r in taken], [r["toxic"] for r in taken], n.get(1, 0) / sum(n.values())


def train(docs: DataFrame, labels: DataFrame, spare_rest: int | None = 2) -> ToxicityModel:
    """The model fitted on a bounded sample of the labelled documents."""
    return fit(*sample(docs, labels, spare_rest))


_SCORES = pa.schema(
    [("doc_id", pa.int64()), ("score", pa.float64()), ("worst_start", pa.int64()), ("worst_end", pa.int64()), ("worst_score", pa.float64())]
    + [("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.features = model, Features()
        self.cache: dict[str, float] = {}

    def sentences(self, text: str) -> np.ndarray:
        """Probabilities of the sentences."""
        cache, buckets, weights = self.cache, self.features.of, self.model.weights
        if len(cache) > 200_000:
            cache.clear()
        logits = []
        for part in _SENTENCE.findall(text):
            words = set(_WORD.findall(part.lower()))
            total = 0.0
            for w in words:
                x = cache.get(w)
                if x is None:
                    x = cache[w] = float(sum([weights[i] for i in buckets(w)]))
                total += x
            logits.append(total)
        z = np.clip(np.array(logits) + self.model.bias, -30, 30)
        return 1 / (1 + np.exp(-z))


_scorers: dict[int, _Scorer] = {}


def _scorer(key: int, model: ToxicityModel) -> _Scorer:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = _Scorer(model)
    return _scorers[key]


def noisy_or(p: np.ndarray) -> float:
    """The probability that at least one sentence offends; 0 without sentences."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def score_documents(docs: DataFrame, model: ToxicityModel, locate: float = 0.3) -> DataFrame:
    """doc_id, score and, from a score of `locate` on, the worst sentence's span and score and all offending ones, of every whole text.

    A sentence offends if its own score reaches `locate`; of a document that only all sentences
    together bring there, the worst does. Empty and null texts score 0 and have no sentence.
    Nothing but the text is looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    held, key = spark.sparkContext.broadcast(model), zlib.crc32(model.weights.tobytes()) ^ hash(model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, held.value)
        for batch in batches:
            rows = []
            for text in texts_of(batch.column("text")):
                p = scorer.sentences(text)
                whole = noisy_or(p)
                if whole >= locate:
                    worst, spans = int(p.argmax()), sentence_spans(text)
                    offending = [{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in sorted({worst, *np.flatnonzero(p >= locate).tolist()})]
                    rows.append((whole, *spans[worst], float(p[worst]), offending))
                else:
                    rows.append((whole, None, None, None, None))
            yield from emit(_SCORES, [batch.column("doc_id"), *zip(*rows, strict=True)] if rows else [batch.column("doc_id"), [], [], [], [], []])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, worst_start long, worst_end long, worst_score double, offending array<struct<start:long,end:long,score:double>>")


def score_table(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, the worst sentence's place and all offending sentences of every document.

    held_out marks ids whose crc32 leaves 2 modulo 4; they are never learned from. A missing id
    is not held out. Repeated rows are scored each. Without labels of both kinds every sentence
    has the score of the one kind, near 1 or near 0; an empty text still scores 0.
    """
    out = score_documents(docs, train(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score", "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores under the threshold, with the columns that they had.

    Only texts go to Python and only scores come back.
    """
    spark = docs.sparkSession
    ship(spark)
    model = train(docs, labels)
    held, key = spark.sparkContext.broadcast(model), zlib.crc32(model.weights.tobytes()) ^ hash(model.bias)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        scorer = _scorer(key, held.value)
        return pa.array([noisy_or(scorer.sentences(t)) for t in texts_of(texts)], pa.float64())

    return docs.where(score(F.col("text").cast("string")) < threshold)
