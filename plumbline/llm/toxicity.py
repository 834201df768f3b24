"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; any other text is unlabelled, never taken for clean. With class prior p the
risk of a classifier g is p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)]): the risk on clean text is the
unlabelled risk less the share that toxic text has in it, and where a batch makes that estimate negative, the step goes
the other way. l is the sigmoid loss, bounded, so that a prior slightly off moves the estimate of the clean risk by no
more than its error; the score is the sigmoid of g.

A text is described by the share of its words that hold a feature: a whole word, a word's first 3 to 6 letters or five
letters inside it, found by their hash. The features are learned: those whose presence differs most (G test) between the
sampled positives and unlabelled documents, counted on Spark. Several classifiers (small networks of one hidden layer,
with other starts) are trained with numpy, and their scores averaged.

The sample is bounded: about ``max_positive`` toxic and ``max_unlabelled`` other documents, chosen by a hash of the id
below a threshold that follows from their counts; sampled documents are read whole. Scoring reads every whole text.

Defined results: NULL or empty text has no features and gets the score the models give it; without toxic examples every
score is the share of toxic labels seen (0.5 without any label). Repeated label rows of one document count once, the
larger label wins; of repeated ids one row is learned from. Rows are scored one by one, so repeated rows agree. An empty
table gives an empty result. Columns other than doc_id, text and the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrays import Codes, Spans, giving_back, mix, strings, text_chunks, word_spans
from .frames import fold_of, hash_sample, id_and_text, packed, unpacked

MAX_POSITIVE, MAX_UNLABELLED = 2000, 6000
THRESHOLD = 0.7
#: Features kept, the least G value and the least sampled positives that hold one.
FEATURES, LEAST_G, LEAST_POSITIVE = 1024, 10.0, 3
PREFIXES, INNER = (3, 4, 5, 6), 5
MODELS, HIDDEN = 3, 8


class Reader:
    """Features of the words of chunks of texts."""

    def __init__(self) -> None:
        self.codes, self.spans = Codes(), Spans()

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the chunk's distinct words the features (feature, word number); for each word its text and number."""
        symbols, bounds = Codes.of([t.lower() for t in texts])
        starts, ends, ranges = word_spans(self.codes.letter(symbols), bounds)
        hashes = self.spans.hashes(symbols, starts, ends)
        _, one, number = np.unique(hashes, return_index=True, return_inverse=True)
        text = np.repeat(np.arange(len(texts)), np.diff(ranges))
        starts, sizes = starts[one], (ends - starts)[one]
        features, owner = [mix(hashes[one])], [np.arange(len(one))]
        for k in PREFIXES:
            longer = np.flatnonzero(sizes > k)
            features.append(mix(self.spans.hashes(symbols, starts[longer], starts[longer] + k) + np.uint64(k)))
            owner.append(longer)
        count = np.maximum(0, sizes - INNER)
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
        begin = np.repeat(starts, count) + inner
        features.append(mix(self.spans.hashes(symbols, begin, begin + INNER) + np.uint64(100)))
        owner.append(np.repeat(np.arange(len(one)), count))
        return np.concatenate(features), np.concatenate(owner), text, number.reshape(-1), np.diff(ranges)


def _per_text(features: np.ndarray, owner: np.ndarray, text: np.ndarray, number: np.ndarray, kinds: int):
    """(text, feature, words with it) of each text, the features numbered below ``kinds``."""
    order = np.argsort(owner, kind="stable")
    features, owner = features[order], owner[order]
    first = np.searchsorted(owner, number)
    count = np.searchsorted(owner, number, "right") - first
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    held = features[np.repeat(first, count) + inner]
    pairs, times = np.unique(np.repeat(text, count) * kinds + held, return_counts=True)
    return pairs // kinds, pairs % kinds, times


class Vectors:
    """Turns texts into rows over the learned features."""

    def __init__(self, features: np.ndarray) -> None:
        self.reader, self.features = Reader(), features

    def sparse(self, texts: list[str]):
        """(text, feature number, value) of a chunk; the value is the root of the share of words with the feature."""
        features, owner, text, number, words = self.reader.read(texts)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        known = self.features[at] == features
        row, column, times = _per_text(at[known], owner[known], text, number, len(self.features))
        return row, column, np.sqrt(times / np.maximum(words, 1)[row])

    def dense(self, texts: list[str]) -> np.ndarray:
        row, column, value = self.sparse(texts)
        out = np.zeros((len(texts), len(self.features)), np.float32)
        out[row, column] = value
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _network(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """g of each row, with the hidden values that the gradient needs: a linear part and a hidden layer beside it."""
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    return h @ w["out"] + x @ w["direct"] + w["bias"], h


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
    """Of a sum of losses whose derivatives by g are ``d``."""
    dh = d[:, None] * w["out"] * (1 - h**2)
    return {"out": h.T @ d, "direct": x.T @ d, "bias": d.sum(), "encode": x.T @ dh, "encode_b": dh.sum(0)}


def risk(g_positive: np.ndarray, g_unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk on toxic text, and the estimated risk on clean text, which may come out below 0."""
    return prior * _sigmoid(-g_positive).mean(), _sigmoid(g_unlabelled).mean() - prior * _sigmoid(g_positive).mean()


def step_of(w: dict[str, np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> dict[str, np.ndarray]:
    """The gradient to follow: of the whole risk, or away from a clean-text risk below 0."""
    x = np.concatenate([positive, unlabelled])
    g, h = _network(w, x)
    gp, gu = g[: len(positive)], g[len(positive) :]
    slope = lambda z: _sigmoid(z) * _sigmoid(-z) / max(1, len(z))
    clean = np.concatenate([-prior * slope(gp), slope(gu)])
    if risk(gp, gu, prior)[1] < 0:
        return _gradients(w, x, h, -clean)
    return _gradients(w, x, h, clean + np.concatenate([-prior * slope(gp), np.zeros(len(gu))]))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, epochs: int = 30, size: int = 128) -> dict[str, np.ndarray]:
    """One classifier, fitted by Adam on batches that hold both kinds in proportion."""
    rng = np.random.default_rng(seed)
    width = positive.shape[1]
    w = {
        "encode": rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), "encode_b": np.zeros(HIDDEN), "out": rng.normal(0, 0.1, HIDDEN),
        "direct": np.zeros(width), "bias": np.float64(np.log(prior / (1 - prior))),
    }
    m, s, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    batches = max(1, -(-(len(positive) + len(unlabelled)) // size))
    for epoch in range(epochs):
        parts = zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches))
        for p, u in parts:
            if not len(p) or not len(u):
                continue
            g = step_of(w, positive[p], unlabelled[u], prior)
            step += 1
            rate = 5e-3 * (1 - epoch / epochs) + 1e-4
            for k in w:
                grad = g[k] + (0 if k == "bias" else 1e-4 * w[k])
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Model:
    base: float
    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    scale: np.ndarray | None = None
    networks: list[dict[str, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.networks:
            return np.full(len(x), self.base)
        return np.mean([_sigmoid(_network(w, x * self.scale)[0]) for w in self.networks], axis=0)


def _presence(sample: DataFrame) -> DataFrame:
    """(feature, positive, documents): sampled documents with each feature, of those the positives."""

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            texts, positive = strings(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in text_chunks(texts):
                features, owner, text, number, _ = reader.read(texts[first:last])
                kinds, at = np.unique(features, return_inverse=True)
                if not len(kinds):
                    continue
                row, column, _ = _per_text(at.reshape(-1), owner, text, number, len(kinds))
                toxic = np.bincount(column, weights=positive[first:last][row], minlength=len(kinds)).astype(np.int64)
                every = np.bincount(column, minlength=len(kinds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds.view(np.int64)), pa.array(toxic), pa.array(every)], names=["feature", "positive", "documents"]
                )

    found = sample.select("text", "positive").mapInArrow(work, "feature long, positive long, documents long")
    return found.groupBy("feature").agg(F.sum("positive").alias("positive"), F.sum("documents").alias("documents"))


def choose_features(sample: DataFrame, positive: int, unlabelled: int, count: int = FEATURES) -> np.ndarray:
    """The features with the largest G value of presence against kind, as sorted hashes."""
    a, b = F.col("positive"), F.col("documents") - F.col("positive")
    total = F.lit(float(positive + unlabelled))
    part = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * total / (row * column))).otherwise(0.0)
    held, free = a + b, total - a - b
    rows = F.lit(float(positive)), F.lit(float(unlabelled))
    g = 2 * (part(a, held, rows[0]) + part(b, held, rows[1]) + part(rows[0] - a, free, rows[0]) + part(rows[1] - b, free, rows[1]))
    told = _presence(sample).where(a >= LEAST_POSITIVE).select("feature", g.alias("g")).where(F.col("g") >= LEAST_G)
    chosen = told.orderBy(F.desc("g"), "feature").limit(count).toArrow()
    return np.sort(chosen["feature"].to_numpy().view(np.uint64))


def sample_rows(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_positive: int, max_unlabelled: int):
    """(text, positive) of the bounded sample, written once, and the share of toxic among the labels seen (NULL: none)."""
    rows = id_and_text(docs)
    learned = fold_of(F.col("doc_id"), folds) != held_out
    seen = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    seen = seen.agg(F.max("toxic").cast("int").alias("toxic")).where(learned)
    prior = seen.agg(F.avg("toxic")).first()[0]
    # Both lists of ids are bounded by their threshold, so the first may be broadcast.
    toxic = hash_sample(seen.where("toxic = 1").select("doc_id"), max_positive)
    positive = rows.join(F.broadcast(toxic), "doc_id").select("doc_id", "text", F.lit(True).alias("positive"))
    other = hash_sample(rows.where(learned & F.col("doc_id").isNotNull()), max_unlabelled).select("doc_id", "text", F.lit(False).alias("positive"))
    return cut(positive.unionByName(other).dropDuplicates(["doc_id", "positive"]).select("text", "positive")), prior


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1,
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Learns from confirmed toxic and from unlabelled documents outside the held-out fold."""
    sample, prior = sample_rows(docs, labels, folds, held_out, max_positive, max_unlabelled)
    if prior is None:
        return Model(0.5)
    counts = {r["positive"]: r["c"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not counts.get(True) or not counts.get(False) or prior >= 1:
        return Model(float(prior))
    features = choose_features(sample, counts[True], counts[False])
    if not len(features):
        return Model(float(prior))
    known = packed(docs.sparkSession, features)

    @giving_back
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(unpacked(known))
        for batch in batches:
            texts = strings(batch.column(0))
            for first, last in text_chunks(texts):
                row, column, value = vectors.sparse(texts[first:last])
                offsets = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, last - first), lists(column.astype(np.int32)), lists(value.astype(np.float32))],
                    names=["positive", "at", "value"],
                )

    coded = sample.mapInArrow(encode, "positive boolean, at array<int>, value array<float>")
    table = coded.orderBy("positive", F.xxhash64("at", "value")).toArrow()
    at, value = table["at"].combine_chunks(), table["value"].combine_chunks()
    x = np.zeros((len(table), len(features)), np.float32)
    x[np.repeat(np.arange(len(table)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = value.flatten().to_numpy()
    positive = table["positive"].to_numpy()
    scale = (1 / np.maximum(np.sqrt((x.astype(np.float64) ** 2).mean(0)), 0.01)).astype(np.float32)
    x *= scale
    networks = [train(x[positive], x[~positive], float(prior), seed) for seed in range(MODELS)]
    return Model(float(prior), features, scale, [{k: np.asarray(v, np.float32) for k, v in w.items()} for w in networks])


def scorer(model: Model):
    """A column function: the score of a text, near 1 for toxic text."""

    @F.arrow_udf("double")
    @giving_back
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = Vectors(model.features) if model.networks else None
        for column in batches:
            texts, out = strings(column), [np.empty(0)]
            for first, last in text_chunks(texts, rows=4096):
                chunk = texts[first:last]
                out.append(model.score(vectors.dense(chunk) if vectors else np.zeros((len(chunk), 0))))
            yield pa.array(np.concatenate(out).astype(float))

    return score


def assess(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the other folds."""
    model = fit(docs, labels, folds, held_out)
    scored = id_and_text(docs).select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
