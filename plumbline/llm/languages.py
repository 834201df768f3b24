"""Language identification by the nearest of several TF-IDF centroids per language.

A text is the TF-IDF vector of its hashed letter n-grams (1 to 3 letters, anything that is no letter is one space). Each
language's vectors are clustered into a few centroids; a text gets the language of the centroid with the highest
cosine. A text without letters, or farther from every centroid than texts of that language and length are, is rejected.

The model is fitted on a bounded sample: about ``max_sample`` labelled texts, shared evenly among the languages and
chosen by a hash of the id below a threshold that follows from the language's count; of repeated ids one row counts. A quarter as many texts again are left out of the fit; the cosines of these texts and of
their beginnings to their own language's solid centroids give the least cosine (a low quantile) of each language and length. Length is
counted in distinct n-grams, so that a text of one repeated word is short. The prediction reads whole texts of all rows.

Defined results: NULL text or text without a letter is ``und`` with score 0 and rejected; so is every text when nothing
can be learned. Ties go to the language that sorts first. Rows are scored one by one, so repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrays import Codes, giving_back, strings, text_chunks
from .frames import fold_of, id_and_text, release

BINS = 4096
CENTROIDS = 4
MAX_SAMPLE = 2000
#: Cosine distance beyond which a text of any length is in none of the learned languages.
MAX_DISTANCE = 0.92
#: Share of a language's left out texts below the least cosine, and rows that give one of its points.
TAIL, POINT_ROWS = 0.01, 60
#: Share of a language's texts that a centroid needs to vouch for others; one of a few odd texts only names the language.
SOLID = 0.05
UNKNOWN = "und"
_ROWS = 128


def gram_counts(texts: list[str], codes: Codes) -> np.ndarray:
    """Counts of hashed letter n-grams, one row of BINS for each text."""
    symbols, bounds = codes.of([t.lower() for t in texts])
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(bounds))
    letters = codes.letter(symbols)
    # One space stands for each run of other characters, and one before each text.
    keep = letters.copy()
    keep[1:] |= letters[:-1] & (row[1:] == row[:-1])
    symbols, row = np.where(letters, symbols, 0)[keep].astype(np.uint32), row[keep]
    first = np.searchsorted(row, np.arange(n))
    has = np.bincount(row, minlength=n) > 0
    symbols, row = np.insert(symbols, first[has], 0), np.insert(row, first[has], np.flatnonzero(has))
    counts = np.zeros((n, BINS), np.float32)
    flat = counts.reshape(-1)
    h = symbols
    for k in range(3):
        if k:
            same = row[k:] == row[:-k]
            h = h[: len(symbols) - k] * np.uint32(0x01000193) + symbols[k:]
            keys, rows = h[same], row[k:][same]
        else:
            keys, rows = symbols[symbols > 0], row[symbols > 0]
        keys = (keys ^ (keys >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        bins = (keys >> np.uint32(20)).astype(np.int64)
        flat += np.bincount(rows * BINS + bins, minlength=n * BINS).astype(np.float32)
    return counts


@dataclass
class Model:
    languages: list[str]
    owners: np.ndarray  # language of each centroid
    centroids: np.ndarray
    weights: np.ndarray  # inverse document frequencies
    solid: np.ndarray = field(default_factory=lambda: np.empty(0, bool))  # centroids of more than a few odd texts
    floors: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # lengths and least cosines of each language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weights
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the language (-1: no letter) and its cosine."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(1)
        found = counts.any(1)
        return np.where(found, self.owners[best], -1), np.where(found, cosines.max(1), 0.0)

    def near(self, counts: np.ndarray, k: int) -> np.ndarray:
        """The cosine of each row to the nearest solid centroid of language ``k``."""
        return (self.vectors(counts) @ self.centroids[(self.owners == k) & self.solid].T).max(1)

    def accepts(self, counts: np.ndarray, found: np.ndarray, max_distance: float) -> np.ndarray:
        """Whether each row is as near to its language ``found`` as texts of that language and length are."""
        accepted = np.zeros(len(counts), bool)
        for k in np.unique(found[found >= 0]):
            mine = np.flatnonzero(found == k)
            least = np.full(len(mine), 1 - max_distance)
            if self.floors:
                least = np.maximum(least, np.interp(length(counts[mine]), *self.floors[k]))
            accepted[mine] = self.near(counts[mine], k) >= least
        return accepted


def length(counts: np.ndarray) -> np.ndarray:
    """Logarithm of the number of distinct n-grams."""
    return np.log2(np.maximum(1, (counts > 0).sum(1)))


def beginnings(text: str) -> list[str]:
    """The text and its beginnings, each longer by half; later parts may be in other languages than the label."""
    found, size = [text], 8
    while size < len(text):
        found.append(text[:size])
        size += size // 2
    return found


def _floor(lengths: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cosines at a few lengths; of under 1 / TAIL rows the tail is taken to go on below the lowest one."""
    x, y = [], []
    for rows in np.array_split(np.lexsort((cosines, lengths)), max(1, len(lengths) // POINT_ROWS)):
        low, middle = np.quantile(cosines[rows], [TAIL, 0.5])
        x.append(lengths[rows].mean())
        y.append(low - max(0.0, 1 - TAIL * len(rows)) * (middle - low) / 4)
    return np.array(x), np.array(y)


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest vector and then the farthest ones."""
    chosen = [int((x @ x.mean(0)).argmax())]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(1)
        centres = np.stack([x[owner == i].sum(0) if (owner == i).any() else centres[i] for i in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _solid(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    held = np.bincount((x @ centres.T).argmax(1), minlength=len(centres))
    return held >= min(SOLID * len(x), held.max())


def fit(labelled: DataFrame, max_sample: int = MAX_SAMPLE) -> Model | None:
    """Learns from (doc_id, text, lang); NULL languages are left out. None if nothing can be learned."""

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            texts = strings(batch.column(1))
            for first, last in text_chunks(texts, rows=_ROWS):
                x = gram_counts(texts[first:last], codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first),
                        pa.array([r.tobytes() for r in np.minimum(x, 65535).astype(np.uint16)], pa.binary()),
                    ],
                    names=["doc_id", "lang", "counts"],
                )

    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["c"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row a language
    if not sizes:
        return None
    each = max(1, max_sample // len(sizes))
    also = max(1, each // 4)  # texts left out of the fit
    # The sample is chosen on the ids by a hash below each language's threshold; only its rows bring their texts.
    below = F.create_map(*[F.lit(x) for lang, c in sorted(sizes.items()) for x in (lang, min(1.0, (each + also) / c))])
    uniform = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    left_out = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(5)) == 2
    picked = rows.where(uniform < below[F.col("lang")]).select("doc_id", "text", "lang").dropDuplicates(["doc_id"])
    picked = cut(picked.withColumn("left_out", left_out))
    table = picked.where("not left_out").select("doc_id", "text", "lang").mapInArrow(count, "doc_id long, lang string, counts binary")
    sample = table.orderBy("lang", F.xxhash64("doc_id")).toArrow()
    x = np.stack([np.frombuffer(v.as_buffer(), np.uint16) for v in sample["counts"]]).astype(np.float32) if len(sample) else np.empty((0, BINS))
    names = sample["lang"].to_pylist()
    full = x.any(1)
    x, names = x[full], np.array([n for n, f in zip(names, full) if f], dtype=object)
    if not len(x):
        return None
    del sample
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    model = Model(sorted(set(names)), np.empty(0, int), np.empty((0, BINS)), weights)
    vectors = model.vectors(x)
    groups = [_centroids(vectors[names == name], CENTROIDS) for name in model.languages]
    model.owners = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    model.centroids = np.concatenate(groups).astype(np.float32)
    model.solid = np.concatenate([_solid(vectors[names == name], g) for name, g in zip(model.languages, groups)])
    model.floors = _floors(picked.where("left_out"), model)
    del x, vectors, groups
    release(labelled.sparkSession)
    return model


def _floors(left_out: DataFrame, model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each language the least cosines by length; of all languages together for one without texts."""

    @giving_back
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for doc_id, text, name in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist()):
                if name not in model.languages:
                    continue
                own = model.languages.index(name)
                texts = beginnings(text)
                for first, last in text_chunks(texts, rows=_ROWS):
                    counts = gram_counts(texts[first:last], codes)
                    counts = counts[counts.any(1)]
                    cosine = model.near(counts, own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc_id] * len(counts), pa.int64()), pa.array([name] * len(counts), pa.string()),
                            pa.array(length(counts).astype(float)), pa.array(cosine.astype(float)),
                        ],
                        names=["doc_id", "lang", "length", "cosine"],
                    )

    measured = left_out.select("doc_id", "text", "lang").mapInArrow(measure, "doc_id long, lang string, length double, cosine double")
    found = measured.orderBy(F.xxhash64("doc_id"), "lang", "length", "cosine").toArrow()
    names = np.array(found["lang"].to_pylist(), dtype=object)
    lengths, cosines = found["length"].to_numpy(), found["cosine"].to_numpy()
    if not len(names):
        return []
    return [_floor(lengths[mine], cosines[mine]) if (mine := names == name).any() else _floor(lengths, cosines) for name in model.languages]


def predict(docs: DataFrame, model: Model | None, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(doc_id, lang_pred, score, rejected): score is the cosine to the nearest centroid."""

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            texts = strings(batch.column(1))
            for first, last in text_chunks(texts, rows=_ROWS):
                counts = gram_counts(texts[first:last], codes)
                found, cosine = model.score(counts) if model else (np.full(len(counts), -1), np.zeros(len(counts)))
                names = [model.languages[i] if i >= 0 else UNKNOWN for i in found]
                score = np.clip(cosine.astype(float), 0, 1)
                accepted = model.accepts(counts, found, max_distance) if model else found >= 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(names, pa.string()), pa.array(score),
                        pa.array(~accepted),
                    ],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    return id_and_text(docs).mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")


def learning_rows(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    rows = docs.where(fold_of(docs["doc_id"], folds) != held_out)
    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["text"].alias("text"), rows["lang"].alias("lang"))


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document, learned from the other folds."""
    model = fit(learning_rows(docs, folds, held_out))
    return predict(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", "rejected"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified; the rows themselves are unchanged."""
    model = fit(learning_rows(docs))
    return _keep(docs, model)


def _keep(docs: DataFrame, model: Model | None, max_distance: float = MAX_DISTANCE) -> DataFrame:
    accepted = accept(model, max_distance)
    return docs.where(accepted(docs["text"]))


def accept(model: Model | None, max_distance: float = MAX_DISTANCE):
    """A column function: whether a text is accepted."""

    @F.arrow_udf("boolean")
    @giving_back
    def accepted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = Codes()
        for column in batches:
            texts, keep = strings(column), []
            for first, last in text_chunks(texts, rows=_ROWS):
                counts = gram_counts(texts[first:last], codes)
                if model is None:
                    keep += [False] * len(counts)
                else:
                    keep += list(model.accepts(counts, model.score(counts)[0], max_distance))
            yield pa.array([bool(k) for k in keep], pa.bool_())

    return accepted
