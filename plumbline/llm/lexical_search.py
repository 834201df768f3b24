"""Ranked lexical search: dense blocks of document impacts times item weights, multiplied by BLAS.

The items are dealt into blocks whose (item, term) rows are bounded, so a block's terms may be sent to the tasks. One pass
over the documents finds the block's terms in each whole text and writes (doc_id, n, terms, times); the corpus counts N, L
and df are sums over that table. A second pass fills tiles of documents by terms with the impacts
(1e9 * tf) div (1000 * tf + 12 * m) and multiplies them with the tile of terms by items that holds a term's weight times
its occurrences in the item. All factors are whole numbers below 1e6 and below 2**53 / 1e6 in sum, so that no partial sum
of a product, in whatever order BLAS adds, reaches 2**53: float64 is exact. A wider tile is cut into several, whose
results are added as 64-bit integers.

Each tile leaves, for every item, the documents that reach the k-th best score seen so far, ties included; a task keeps k
per item, and windows on Spark choose among the tasks.

Defined results: documents without a term count neither in N nor as results; equal scores go by ascending doc_id, a NULL
doc_id last; repeated rows are documents of their own. An item is an item_id: of repeated rows with other texts the
smallest text counts, NULL ids take no part, NULL or empty texts give no rows. Terms are compared byte by byte after
their hashes agree. Empty tables give an empty result. Columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .arrays import Spans, byte_rows, giving_back, row_chunks, word_spans
from .frames import id_and_text, packed, unpacked

#: (item, term) rows of a block; items and documents of a tile; cells of a document tile.
BLOCK, ITEMS, DOCS, CELLS = 500_000, 64, 512, 1 << 20
#: An impact is smaller than this; a sum of products of a tile stays below LIMIT.
IMPACT, LIMIT = 1_000_000, 1 << 53
#: Lanes in which the tasks' best documents of one item are ranked before the last choice.
LANES = 64

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(data: np.ndarray, bounds: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of some rows, start, end and hash of each term in them, and the bounds of each row's terms."""
    symbols = _LOWER[data[bounds[0] : bounds[-1]]]
    starts, ends, ranges = word_spans(_TERM[symbols], bounds - bounds[0])
    return symbols, starts, ends, spans.hashes(symbols, starts, ends), ranges


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): the terms of each item with their occurrences."""

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans()
        for batch in batches:
            data, bounds = byte_rows(batch.column(1))
            for first, last in row_chunks(bounds):
                symbols, starts, ends, _, ranges = _terms(data, bounds[first : last + 1], spans)
                whole = symbols.tobytes()
                ids = np.repeat(batch.column(0).to_numpy()[first:last], np.diff(ranges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([whole[a:b] for a, b in zip(starts, ends)], pa.binary())], names=["item_id", "term"]
                )

    one = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    one = one.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    return one.mapInArrow(work, "item_id long, term binary").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class Vocabulary:
    """The terms of a block, looked up by hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]) -> None:
        sizes = np.array([len(t) for t in terms], np.int64)
        data, bounds = np.frombuffer(b"".join(terms), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        hashes = Spans().hashes(data, bounds[:-1], bounds[1:])
        order = np.argsort(hashes, kind="stable")
        # Terms with equal hashes share a range of the order.
        self.hashes, self.number = hashes[order], order.astype(np.int32)
        self.data, self.starts, self.sizes = data, bounds[:-1], sizes
        self.deepest = int(np.unique(hashes, return_counts=True)[1].max()) if len(terms) else 0

    def find(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for other words."""
        out = np.full(len(starts), -1, np.int32)
        if not len(self.hashes) or not len(starts):
            return out
        low = np.searchsorted(self.hashes, hashes)
        for step in range(self.deepest):
            at = np.minimum(low + step, len(self.hashes) - 1)
            number = self.number[at]
            like = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[number] == ends - starts) & (out < 0))
            sizes = self.sizes[number[like]]
            inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            wrong = symbols[np.repeat(starts[like], sizes) + inner] != self.data[np.repeat(self.starts[number[like]], sizes) + inner]
            good = np.ones(len(like), bool)
            good[np.repeat(np.arange(len(like)), sizes)[wrong]] = False
            out[like[good]] = number[like[good]]
        return out


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, times): terms of each whole text in all, and the vocabulary's ones with their occurrences."""

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, known = Spans(), unpacked(vocabulary)
        width = max(1, len(known.sizes))
        for batch in batches:
            data, bounds = byte_rows(batch.column(1))
            for first, last in row_chunks(bounds):
                symbols, starts, ends, hashes, ranges = _terms(data, bounds[first : last + 1], spans)
                number = known.find(symbols, starts, ends, hashes)
                row = np.repeat(np.arange(last - first), np.diff(ranges))
                pairs, times = np.unique(row[number >= 0] * width + number[number >= 0], return_counts=True)
                offsets = np.searchsorted(pairs, np.arange(last - first + 1) * width).astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(ranges), pa.int64()), lists(pairs % width), lists(times)],
                    names=["doc_id", "n", "terms", "times"],
                )

    return id_and_text(docs).mapInArrow(work, "doc_id long, n long, terms array<int>, times array<int>")


class Tile:
    """Some items and their compact vocabulary, in columns cut so that sums of products stay below ``limit``."""

    def __init__(self, first: int, items: np.ndarray, terms: np.ndarray, values: np.ndarray, count: int, width: int, limit: int) -> None:
        """``items`` count from ``first``; ``values`` are weights times occurrences of ``terms`` in ``items``."""
        self.first, self.count = first, count
        self.terms, column = np.unique(terms, return_inverse=True)
        self.column = np.full(width, -1, np.int32)
        self.column[self.terms] = np.arange(len(self.terms))
        weights = np.zeros((len(self.terms), count))
        weights[column, items - first] = values
        # Parts of the columns whose largest sum over an item stays in bounds; a single term always does.
        largest = weights.max(1) if count else np.zeros(0)
        self.parts, begin, total = [], 0, 0.0
        for k, value in enumerate(largest):
            if k > begin and (total + value) * IMPACT >= limit:
                self.parts.append((begin, k, weights[begin:k]))
                begin, total = k, 0.0
            total += value
        if len(self.terms):
            self.parts.append((begin, len(self.terms), weights[begin:]))

    def scores(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((len(dense), self.count), np.int64)
        for begin, stop, weights in self.parts:
            out += (dense[:, begin:stop] @ weights).astype(np.int64)
        return out


class Best:
    """The k best (score, doc_id) of each item so far, equal scores by ascending id, NULL ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.item, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.none = np.empty(0, bool)
        self.floor = np.ones(items, np.int64)

    def take(self, first: int, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Adds a tile of documents by items; a score at an item's floor may win by its id."""
        floor = self.floor[first : first + scores.shape[1]]
        if len(scores) > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=0)[-self.k])
        row, column = np.nonzero(scores >= floor)
        if not len(row):
            return
        item, score = np.append(self.item, column + first), np.append(self.score, scores[row, column])
        ids, none = np.append(self.id, ids[row]), np.append(self.none, none[row])
        order = np.lexsort((ids, none, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        kept = order[place < self.k]
        self.item, self.score, self.id, self.none = item[kept], score[kept], ids[kept], none[kept]
        full = order[place == self.k - 1]
        self.floor[item[full]] = score[full]


def _scored(counts: DataFrame, tiles, ids: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of every item in each task."""

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, item_ids = unpacked(tiles)
        best = Best(len(item_ids), k)
        for batch in batches:
            n, terms, times = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            m = 75 + (25 * n * total) // length
            offsets = terms.offsets.to_numpy().astype(np.int64)
            term, tf = terms.values.to_numpy(), times.values.to_numpy().astype(np.int64)
            doc_ids, none = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for tile in blocks:
                step = max(1, min(DOCS, CELLS // max(1, len(tile.terms))))
                for first in range(0, len(n), step):
                    last = min(first + step, len(n))
                    a, b = offsets[first], offsets[last]
                    row = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
                    column = tile.column[term[a:b]]
                    held = column >= 0
                    row, column, often = row[held], column[held], tf[a:b][held]
                    dense = np.zeros((last - first, len(tile.terms)))
                    dense[row, column] = (1_000_000_000 * often) // (1000 * often + 12 * m[first:last][row])
                    best.take(tile.first, tile.scores(dense), doc_ids[first:last], none[first:last])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item_ids[best.item], pa.int64()), pa.array(best.id, pa.int64(), mask=best.none), pa.array(best.score, pa.int64())],
            names=["item_id", "doc_id", "score"],
        )

    return counts.mapInArrow(work, "item_id long, doc_id long, score long")


def _block_best(docs: DataFrame, block: pa.Table, k: int, limit: int) -> DataFrame:
    """(item_id, doc_id, score) for the items of one block; several documents more than k each."""
    spark = docs.sparkSession
    kinds, number = np.unique(np.array(block["term"].to_pylist(), object), return_inverse=True)
    counts = cut(term_counts(docs, packed(spark, Vocabulary(list(kinds)))))
    total, length = counts.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    # The block's terms are bounded, so their document frequencies are too.
    table = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(kinds), np.int64)
    df[table["term"].to_numpy()] = table["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    ids, item = np.unique(block["item_id"].to_numpy(), return_inverse=True)
    values = weight[number] * block["times"].to_numpy()
    order = np.argsort(item, kind="stable")
    tiles = []
    for first in range(0, len(ids), ITEMS):
        count = min(ITEMS, len(ids) - first)
        rows = order[np.searchsorted(item[order], first) : np.searchsorted(item[order], first + count)]
        tiles.append(Tile(first, item[rows], number[rows], values[rows], count, len(kinds), limit))
    return _scored(counts, packed(spark, (tiles, ids)), ids, total, length, k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, scores above 0 only."""
    terms = cut(item_terms(items))
    blocks = -(-terms.count() // block)
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for number in range(blocks):
        # Whole items by their hash: a block is about as large as the bound, or one item.
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).toArrow()
        if len(part):
            found = found.unionByName(_block_best(docs, part, k, limit))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    lane = F.pmod(F.xxhash64("doc_id", "score"), F.lit(LANES))
    for place in (["item_id", lane], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
