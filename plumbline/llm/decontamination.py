"""Benchmark decontamination: passages of documents against a BM25 index of test items, with block-max pruning.

Test items are documents of a BM25 inverted index; each posting's impact is divided by the item's score for itself, so
an item that stands in a passage completely scores 1. Every document is cut into overlapping passages such that any run
of words as long as the longest item of a length class lies in one passage whole; each passage is a query. Postings are
grouped in blocks of items with the block's largest impact. Sums of block maxima bound the score of every item of a
block, terms of many items enter that bound with a constant; only blocks whose bound reaches the threshold are scored
exactly, so all items above the threshold are retrieved. A retrieved pair is verified on the document's words: the
item's question must be there with at least ``question`` of its distinct five-word shingles and its answer with at least
``answer`` of its distinct words. Without an answer column the last sentence (or the last quarter) is the answer.

Index parts hold ``PART_CHARS`` characters of items at most (or one item); only one part at a time is sent to the
tasks, so any number of items can be checked. Words are maximal runs of letters, digits and underscores, lower-cased.

Defined results: NULL or empty texts and items without words match nothing; repeated items count once, repeated
documents are judged one by one and reported once per id; rows without doc_id or item_id are left out of the pairs. An
empty table on either side gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrays import Codes, Spans, fold, giving_back, strings, text_chunks, word_spans
from .frames import id_and_text, packed, unpacked

THRESHOLD = 0.6
QUESTION, ANSWER = 0.8, 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK = 4
PART_CHARS = 8_000_000
#: Passages times blocks that are summed at once.
CELLS = 2_000_000


class Words:
    """Word hashes of chunks of texts."""

    def __init__(self) -> None:
        self.codes, self.spans = Codes(), Spans()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the range of each text's words."""
        symbols, bounds = self.codes.of([t.lower() for t in texts])
        starts, ends, ranges = word_spans(self.codes.word(symbols), bounds)
        return self.spans.hashes(symbols, starts, ends), ranges


def question_and_answer(text: str) -> tuple[str, str]:
    """The text before its last sentence and the last sentence; of a single sentence the last quarter of the words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    edge = max(1, len(words) - len(words) // 4)
    return " ".join(words[:edge]), " ".join(words[edge:])


def shingles(hashes: np.ndarray) -> np.ndarray:
    return np.unique(fold(hashes, min(SHINGLE, max(1, len(hashes)))))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of every run, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


@dataclass
class Class:
    """The index of items of similar length."""

    step: int  # passages start every so many words and are twice as long
    terms: np.ndarray
    posting_start: np.ndarray
    posting_item: np.ndarray
    impact: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_impact: np.ndarray
    frequent: np.ndarray  # terms that enter the bound as a constant
    constant: np.ndarray  # for each block
    items: list[tuple[int, np.ndarray, np.ndarray]]  # id, question shingles, answer words

    def retrieve(self, hashes: np.ndarray, ranges: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(text, word position, item, score) of each passage and item at or above the threshold."""
        term = np.searchsorted(self.terms, hashes)
        term[term == len(self.terms)] = 0
        known = np.flatnonzero(self.terms[term] == hashes)
        if not len(known):
            return
        text_of = np.searchsorted(ranges, known, "right") - 1
        counts = np.diff(ranges)
        windows = np.maximum(1, -(-counts // self.step))
        base = np.concatenate([[0], np.cumsum(windows)])
        slot = (known - ranges[text_of]) // self.step
        window = base[text_of] + slot
        earlier = slot > 0
        keys = np.concatenate([window * len(self.terms) + term[known], (window[earlier] - 1) * len(self.terms) + term[known[earlier]]])
        keys = np.unique(keys)
        window, term = keys // len(self.terms), keys % len(self.terms)
        blocks = len(self.constant)
        per = max(1, CELLS // blocks)
        edges = np.searchsorted(window, np.arange(0, int(base[-1]) + per, per))
        for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            low = part * per
            w, t = window[a:b] - low, term[a:b]
            rare = ~self.frequent[t]
            sizes = (self.block_start[t + 1] - self.block_start[t])[rare]
            at = ragged(self.block_start[t][rare], sizes)
            cells = np.bincount(np.repeat(w[rare], sizes) * blocks + self.block[at], weights=self.block_impact[at], minlength=per * blocks)
            open_cells = (cells.reshape(per, blocks) + self.constant >= threshold) & (cells.reshape(per, blocks) > 0)
            some = open_cells.any(1)
            if not some.any():
                continue
            mine = some[w]
            w, t = w[mine], t[mine]
            sizes = self.posting_start[t + 1] - self.posting_start[t]
            at, w = ragged(self.posting_start[t], sizes), np.repeat(w, sizes)
            item = self.posting_item[at]
            inside = open_cells[w, item // BLOCK]
            pair, back = np.unique(w[inside] * len(self.items) + item[inside], return_inverse=True)
            score = np.bincount(back, weights=self.impact[at][inside])
            for p, s in zip(pair[score >= threshold - 1e-9], score[score >= threshold - 1e-9]):
                found = int(p) // len(self.items) + low
                text = int(np.searchsorted(base, found, "right")) - 1
                yield text, (found - int(base[text])) * self.step, int(p) % len(self.items), float(s)


def build(items: list[tuple[int, str, str]], documents: int, mean_length: float, frequencies: dict[int, int], threshold: float) -> list[Class]:
    """The classes of one index part; the counts are those of all items."""
    words = Words()
    grouped: dict[int, list] = {}
    for item_id, question, answer in items:
        both, ranges = words.of([question, answer])
        if len(both):
            grouped.setdefault((len(both).bit_length() - 1) // 2, []).append((item_id, both, both[: ranges[1]], both[ranges[1] :]))
    out = []
    for members in grouped.values():
        members.sort(key=lambda m: len(m[1]))
        terms = np.unique(np.concatenate([m[1] for m in members]))
        rows = []
        for i, (_, both, _, _) in enumerate(members):
            own, tf = np.unique(both, return_counts=True)
            df = np.array([frequencies[int(h)] for h in own], float)
            idf = np.log1p((documents - df + 0.5) / (df + 0.5))
            gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(both) / mean_length))
            rows.append((np.searchsorted(terms, own), np.full(len(own), i), gain / gain.sum()))
        term, item, impact = (np.concatenate(c) for c in zip(*rows))
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        blocks = -(-len(members) // BLOCK)
        pair, first = np.unique(term * blocks + item // BLOCK, return_index=True)
        largest = np.maximum.reduceat(impact, first)
        block_start = np.searchsorted(pair, np.arange(len(terms) + 1) * blocks)
        # The terms with most postings go into a constant as long as it stays below half the threshold in every block.
        constant, frequent = np.zeros(blocks), np.zeros(len(terms), bool)
        for t in np.argsort(-np.diff(block_start), kind="stable"):
            span = slice(block_start[t], block_start[t + 1])
            more = constant.copy()
            more[pair[span] % blocks] += largest[span]
            if more.max() > threshold / 2:
                break
            constant, frequent[t] = more, True
        out.append(
            Class(
                max(len(m[1]) for m in members), terms, np.searchsorted(term, np.arange(len(terms) + 1)), item, impact,
                block_start, pair % blocks, largest, frequent, constant,
                [(m[0], shingles(m[2]) if len(m[2]) else np.empty(0, np.uint64), np.unique(m[3])) for m in members],
            )
        )
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> float:
    return float(np.isin(part, whole).mean()) if len(part) else 1.0


def _parts(items: DataFrame) -> tuple[DataFrame, DataFrame, int, float, int]:
    """Distinct items with their part, document frequencies of terms, number and mean length of items, parts."""

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            both = [f"{q}\n{a}" for q, a in zip(strings(batch.column(1)), strings(batch.column(2)))]
            for first, last in text_chunks(both):
                hashes, ranges = words.of(both[first:last])
                own = [np.unique(hashes[a:b]) for a, b in zip(ranges[:-1], ranges[1:])]
                sizes = [len(o) for o in own]
                part = np.repeat(np.asarray(batch.column(3))[first:last], sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array(np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64)),
                     pa.array(np.repeat(np.diff(ranges), sizes), pa.int64())],
                    names=["part", "term", "length"],
                )

    @F.arrow_udf("struct<question:string,answer:string>")
    def halves(column: pa.Array) -> pa.Array:
        pairs = [question_and_answer(t) for t in strings(column)]
        return pa.StructArray.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["question", "answer"])

    rows = items.where("item_id is not null")
    if "question" in items.columns and "answer" in items.columns:
        rows = rows.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    else:
        rows = rows.select(F.col("item_id").cast("long").alias("item_id"), halves(F.coalesce("text", F.lit(""))).alias("h"))
        rows = rows.select("item_id", "h.question", "h.answer")
    rows = rows.where(F.concat("question", "answer").rlike(r"\w")).distinct()
    size = rows.agg(F.sum(F.length("question") + F.length("answer"))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_CHARS))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(parts))))
    counted = cut(rows.select("item_id", "question", "answer", "part").mapInArrow(count, "part long, term long, length long"))
    frequencies = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(F.split(F.concat_ws(" ", "question", "answer"), r"\W+"))).alias("m")).first()
    terms = cut(counted.select("part", "term").distinct().join(frequencies, "term"))
    return rows, terms, int(totals["n"]), float(totals["m"] or 1), parts


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): verified pairs, each once with its best values."""
    rows, terms, n, mean, parts = _parts(items)
    texts = id_and_text(docs).where("doc_id is not null")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], schema)
    for part in range(parts if n else 0):
        # One part is bounded by PART_CHARS, and so is what the driver and the tasks hold of it.
        own = [tuple(r) for r in rows.where(F.col("part") == part).select("item_id", "question", "answer").collect()]
        counts = terms.where(F.col("part") == part).select("term", "df").toArrow()
        frequencies = dict(zip(counts["term"].to_numpy().view(np.uint64).tolist(), counts["df"].to_pylist()))
        index = packed(docs.sparkSession, build(own, n, mean, frequencies, threshold))

        @giving_back
        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            words, classes = Words(), unpacked(index)
            for batch in batches:
                texts = strings(batch.column(1))
                for first, last in text_chunks(texts):
                    hashes, ranges = words.of(texts[first:last])
                    out = []
                    for c in classes:
                        for text, place, item, score in c.retrieve(hashes, ranges, threshold):
                            begin, end = int(ranges[text]), int(ranges[text + 1])
                            near = hashes[max(begin, begin + place - c.step) : min(end, begin + place + 3 * c.step)]
                            item_id, asked, answered = c.items[item]
                            q = _share(asked, fold(near, SHINGLE)) if len(asked) != 1 else float(_single(asked, near))
                            out.append((batch.column(0)[first + text].as_py(), item_id, score, q, _share(answered, near)))
                    out = [o for o in out if o[3] >= question - 1e-9 and o[4] >= answer - 1e-9]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[i] for o in out], kind) for i, kind in enumerate([pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()])],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        found = found.unionByName(texts.mapInArrow(search, schema))
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def _single(asked: np.ndarray, near: np.ndarray) -> bool:
    """Whether a question of one shingle (five words or fewer) stands among the words."""
    return any(np.isin(asked, fold(near, k)).any() for k in range(1, SHINGLE + 1))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item; the rows themselves are unchanged."""
    hit = cut(matches(docs, items).select("doc_id").distinct())
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
