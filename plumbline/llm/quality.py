"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded into a vector of surface statistics (character
classes, marks, word lengths, repetition inside the passage and against the earlier text of the document). A gated
attention network gives each passage a weight; the weighted mean of the passages' hidden vectors is scored by a
logistic layer. Labels exist per document only; the weights are learned with them, by Adam on the cross-entropy.

The model is fitted on a bounded sample: about ``max_sample`` labelled documents, half per class where there are enough,
fewer where they hold more than ``MAX_PASSAGES`` passages in all; they are chosen by a hash of the id below a threshold
that follows from the counts, and read whole. Scoring reads every passage of every whole text.

Defined results: NULL or empty text is one empty passage (all statistics 0) and gets the score that the model gives it;
with nothing to learn from, every score is the share of the labels seen (0.5 without any). Repeated label rows of one
document count once, the larger label wins; of repeated ids one row is learned from. Rows are scored one by one, so
repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrays import Codes, Spans, fold, giving_back, strings, text_chunks, word_spans
from .frames import fold_of, hash_sample, id_and_text, release

PASSAGE_WORDS = 64
MAX_SAMPLE = 4000
MAX_PASSAGES = 100_000
THRESHOLD = 0.7
_MARKS = 16
HIDDEN, ATTENTION = 24, 12


class Encoder:
    """Passage statistics of chunks of texts."""

    WIDTH = 20 + _MARKS

    def __init__(self) -> None:
        self.codes = Codes()
        self.spans = Spans()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Passage vectors of all texts, and the bounds of each text's passages (one at least)."""
        symbols, bounds = Codes.of(texts)
        flags = self.codes.flags(symbols)
        space, letters, digits = (flags & Codes.SPACE) > 0, (flags & Codes.LETTER) > 0, (flags & Codes.DIGIT) > 0
        starts, ends, ranges = word_spans(~space, bounds)
        counts = np.diff(ranges)
        passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
        bags = np.concatenate([[0], np.cumsum(passages)])
        total, words = int(bags[-1]), len(starts)
        x = np.zeros((total, self.WIDTH), np.float32)
        if not words:
            return x, bags
        text_of = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(words) - ranges[:-1][text_of]
        passage = bags[:-1][text_of] + place // PASSAGE_WORDS
        first = np.searchsorted(passage, np.arange(total))
        n = np.bincount(passage, minlength=total).astype(np.float32)
        length = (ends - starts).astype(np.float32)
        per = lambda values: np.bincount(passage, weights=values, minlength=total).astype(np.float32)
        word_n = np.maximum(n, 1)

        def inside(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return (sums[ends] - sums[starts]).astype(np.float32)

        letter, upper, digit = inside(letters), inside((flags & Codes.UPPER) > 0), inside(digits)
        marks = ~(letters | digits | space)
        mark = inside(marks)
        chars = np.maximum(per(length), 1)
        hashes = self.spans.hashes(symbols, starts, ends)
        same = np.zeros(words, bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (place[1:] > 0)
        # Words seen before in the same passage, and runs of five words seen before in the same text.
        order = np.lexsort((np.arange(words), hashes, passage))
        again = np.zeros(words, bool)
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
        seen = np.zeros(words, bool)
        runs = fold(hashes, 5)
        if len(runs):
            by = np.lexsort((np.arange(len(runs)), runs, text_of[: len(runs)]))
            seen[by[1:]] = (runs[by[1:]] == runs[by[:-1]]) & (text_of[by[1:]] == text_of[by[:-1]])
        newline = np.concatenate([[0], np.cumsum(symbols == 10, dtype=np.int64)])
        next_start = np.append(starts[1:], len(symbols))
        next_start[ranges[1:][counts > 0] - 1] = bounds[1:][counts > 0]
        breaks = (newline[next_start] - newline[ends]).astype(np.float32)
        alone = mark >= length
        last = marks[ends - 1]
        all_upper = (upper >= letter) & (letter >= 2)
        columns = [
            n / PASSAGE_WORDS, np.log1p(per(length)) / 6, per(length) / word_n / 6, per(letter) / chars, per(upper) / chars,
            per(digit) / chars, per(mark) / chars, per(mark > 0) / word_n, per(mark >= 2) / word_n, per(last) / word_n,
            per(alone) / word_n, per(all_upper) / word_n, per(same) / word_n, per(again) / word_n, per(seen) / word_n,
            per(breaks) / word_n, per(length >= 12) / word_n, per(length <= 2) / word_n,
            np.sqrt(np.maximum(0, per(length**2) / word_n - (per(length) / word_n) ** 2)) / 6, (first < words) * 1.0,
        ]
        x[:, : len(columns)] = np.stack(columns, 1)
        where = np.flatnonzero(marks)
        owner = passage[np.searchsorted(starts, where, "right") - 1]
        kind = (symbols[where] * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.int64)
        histogram = np.bincount(owner * _MARKS + kind, minlength=total * _MARKS).reshape(total, _MARKS)
        x[:, 20:] = np.sqrt(histogram / word_n[:, None])
        return x, bags


@dataclass
class Model:
    base: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bags) - 1, self.base)
        return _forward(self.weights, (x - self.shift) * self.scale, bags)[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray):
    """Score of each bag, with what the gradient needs."""
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    v, u = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
    e = (v * u) @ w["attend"]
    starts, owner = bags[:-1], np.repeat(np.arange(len(bags) - 1), np.diff(bags))
    a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
    a /= np.add.reduceat(a, starts)[owner]
    z = np.add.reduceat(a[:, None] * h, starts)
    return _sigmoid(z @ w["out"] + w["out_b"]), (h, v, u, a, z, owner)


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray, importance: np.ndarray):
    p, (h, v, u, a, z, owner) = _forward(w, x, bags)
    d = (p - y) * importance / importance.sum()
    dz = d[:, None] * w["out"]
    g = {"out": z.T @ d, "out_b": d.sum()}
    da = (h * dz[owner]).sum(1)
    de = a * (da - np.add.reduceat(a * da, bags[:-1])[owner])
    g["attend"] = (v * u).T @ de
    dvu = de[:, None] * w["attend"]
    dv, du = dvu * u * (1 - v**2), dvu * v * u * (1 - u)
    g["value"], g["gate"] = h.T @ dv, h.T @ du
    dh = (a[:, None] * dz[owner] + dv @ w["value"].T + du @ w["gate"].T) * (1 - h**2)
    g["encode"], g["encode_b"] = x.T @ dh, dh.sum(0)
    return g


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, importance: np.ndarray, epochs: int = 60, size: int = 64) -> Model:
    """Fits the network to bags of passages with one label each."""
    base = float((y * importance).sum() / importance.sum()) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return Model(base)
    shift, scale = x.mean(0), 1 / np.maximum(x.std(0), 0.02)
    x = (x - shift) * scale
    rng = np.random.default_rng(7)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {
        "encode": draw(x.shape[1], HIDDEN), "encode_b": np.zeros(HIDDEN), "value": draw(HIDDEN, ATTENTION),
        "gate": draw(HIDDEN, ATTENTION), "attend": draw(ATTENTION), "out": draw(HIDDEN), "out_b": 0.0,
    }
    m, s, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), size):
            take = np.sort(order[i : i + size])
            rows = np.concatenate([np.arange(bags[t], bags[t + 1]) for t in take])
            sizes = np.diff(bags)[take]
            g = _gradients(w, x[rows], np.concatenate([[0], np.cumsum(sizes)]), y[take], importance[take])
            step += 1
            rate = 4e-3 * (1 - epoch / epochs) + 1e-4
            for k in w:
                grad = g[k] + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(base, shift.astype(np.float32), scale.astype(np.float32), {k: np.asarray(v, np.float32) for k, v in w.items()})


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_sample: int = MAX_SAMPLE) -> Model:
    """Learns from the labelled documents outside the held-out fold."""

    @giving_back
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            texts = strings(batch.column(1))
            for first, last in text_chunks(texts):
                x, bags = encoder.encode(texts[first:last])
                kept = [x[a:b].tobytes() for a, b in zip(bags[:-1], bags[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), pa.array(kept, pa.binary())],
                    names=["doc_id", "quality", "passages"],
                )

    seen = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    seen = seen.agg(F.max("quality").cast("int").alias("quality")).where(fold_of(F.col("doc_id"), folds) != held_out)
    half = lambda q: hash_sample(seen.where(F.col("quality") == q), max_sample // 2)
    # The thresholds bound the ids, so they may be broadcast.
    bags = id_and_text(docs).join(F.broadcast(half(0).unionByName(half(1))), "doc_id").dropDuplicates(["doc_id"])
    coded = cut(bags.select("doc_id", "text", "quality").mapInArrow(encode, "doc_id long, quality int, passages binary"))
    rows, passages = coded.agg(F.count(F.lit(1)), F.sum(F.length("passages") / (4 * Encoder.WIDTH))).first()
    chosen = hash_sample(coded, int(rows * min(1, MAX_PASSAGES / max(1, passages or 0))))
    table = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    if not len(table):
        return Model(0.5)
    parts = [np.frombuffer(p.as_buffer(), np.float32).reshape(-1, Encoder.WIDTH) for p in table["passages"].combine_chunks()]
    y = table["quality"].to_numpy().astype(float)
    # The sample holds the classes evenly as far as there are rows; weights bring back their shares among all labels.
    prior, share = float(seen.agg(F.avg("quality")).first()[0]), y.mean()
    importance = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    model = train(np.concatenate(parts).astype(np.float64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), y, importance)
    del table, parts
    release(docs.sparkSession)
    return model


def scorer(model: Model):
    """A column function: the score of a text."""

    @F.arrow_udf("double")
    @giving_back
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder()
        for column in batches:
            texts, out = strings(column), []
            for first, last in text_chunks(texts):
                out.append(model.score(*encoder.encode(texts[first:last])))
            yield pa.array(np.concatenate(out).astype(float) if out else np.empty(0))

    return score


def assess(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the other folds."""
    model = fit(docs, labels, folds, held_out)
    scored = id_and_text(docs).select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted to be of quality 1; the rows themselves are unchanged."""
    model = fit(docs, labels)
    return docs.where(scorer(model)(docs["text"].cast("string")) >= threshold)
