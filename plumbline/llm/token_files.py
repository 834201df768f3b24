"""Token ids of documents in ORC files.

Documents are dealt to ranges of ascending doc_id and sorted, each range is encoded with the tokenizers library and
written as one ORC file: integer run-length encoding for ids, offsets and lengths, stripes of a chosen size, row indexes
for every 10,000 rows and Bloom filters on doc_id. Every row holds its place inside its file, so a reader needs only the
files' totals to know the place of a document among all ids; lookups by doc_id skip files, stripes and row groups.

White space separates words of this tokenizer and is dropped, so a text is encoded by its distinct chunks between
ASCII white space; a bounded table keeps the ids of chunks seen before. Where the tokenizer lower-cases and
divides chunks into letters, digits and signs, a new chunk of Latin-1 characters is put together from its pieces, and a
second bounded table keeps theirs; other chunks are encoded whole.

Defined results: NULL text is empty and holds only the end id. Rows with equal doc_id stand in the order of their text's
hash; equal rows are each written. Rows without doc_id come first. An empty table gives an empty folder of files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import byte_rows, giving_back, row_chunks
from .frames import packed

END = 1
#: Bytes of text that one file takes about.
FILE_BYTES = 64 << 20
STRIPE_BYTES = 16 << 20
#: Bytes of text that are divided at once.
CHUNK_BYTES = 8 << 20
REMEMBERED = 690_000
#: A character that stands between words that are encoded together; words that hold it are encoded on their own.
MARK = "\x01"
#: The normalisers and the division into pieces for which chunks are put together from pieces.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
DIVISION = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin-1 without spaces and controls, and its lower-case letters and its numbers.
LATIN, LATIN_LINES = re.compile("[!-~\xa1-\xff]+"), re.compile("[!-~\xa1-\xff\n]+")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\n{_LETTERS}{_NUMBERS}]+")
SCHEMA = "doc_id long, part int, place long, n_tokens int, ids array<int>"


class Memory:
    """Ids of strings seen before: each string's number, and where its ids stand in one array."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.starts, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes, self.ids = np.append(self.sizes, sizes), np.append(self.ids, ids)

    def gather(self, words: list[str], order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words one after the other (of words[i] for each i of ``order``), and where each one's end."""
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if order is not None:
            index = index[order]
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        source = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - self.starts[index], sizes)
        return self.ids[source], ends


class Encoder:
    """Encodes texts with the tokenizers library; remembers the ids of chunks between white space and of their pieces."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.chunks, self.pieces = Memory(), Memory()
        told = json.loads(definition)
        self.added = [t["content"] for t in told["added_tokens"]]
        normalizers = (told["normalizer"] or {}).get("normalizers")
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        division = [s.get("pattern", {}).get("Regex") for s in steps if s.get("type") == "Split"]
        self.divided = normalizers == NORMALIZERS and division == [DIVISION] and steps[0]["invert"] and [s["type"] for s in steps[1:]] == ["ByteLevel"]
        self.last = np.empty(0, bool)
        if self.divided:
            # Pieces need no normaliser and are divided by spaces alone; a piece's last id bears the suffix.
            told |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *steps[1:]]}}
            self.joined = Tokenizer.from_str(json.dumps(told))
            self.joined.no_padding()
            self.joined.no_truncation()
            self.last = np.zeros(max(told["model"]["vocab"].values()) + len(self.added) + 1, bool)
            if suffix := told["model"].get("end_of_word_suffix"):
                self.last[[i for token, i in told["model"]["vocab"].items() if token.endswith(suffix)]] = True

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in one array, and each word's number of ids."""
        if len(words) > 1 and len(self.mark) == 1 and not any(MARK in w for w in words):
            # White space separates words, so many are encoded as one text with a mark between them.
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, np.int32)
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(words) - 1:
                return np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for own in found for i in own], np.int32), np.array([len(own) for own in found], np.int64)

    def _learn(self, memory: Memory, words: list[str]) -> None:
        words = [w for w in words if MARK not in w] + [w for w in words if MARK in w]
        parts = [self._encode(words[i : i + 2048]) for i in range(0, len(words), 2048)]
        memory.add(words, *(np.concatenate(c) for c in zip(*parts)))

    def _compose(self, words: list[str]) -> None:
        """Learns chunks of Latin-1 characters from the ids of their pieces."""
        parts = PIECES.findall("\n".join(words).lower())
        distinct = set(parts)
        fresh = distinct.difference(self.pieces.known)
        if fresh and len(self.pieces.known) + len(fresh) > REMEMBERED:
            self.pieces, fresh = Memory(), distinct
        if "\n" in fresh:
            # The line end between chunks has no ids.
            fresh.remove("\n")
            self.pieces.add(["\n"], np.empty(0, np.int32), np.zeros(1, np.int64))
        fresh = list(fresh)
        for start in range(0, len(fresh), 2048):
            own = fresh[start : start + 2048]
            ids = np.array(self.joined.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.int32)
            lasts = np.flatnonzero(self.last[ids])
            if len(lasts) == len(own) and lasts[-1] == len(ids) - 1:
                self.pieces.add(own, ids, np.diff(lasts, prepend=-1))
            else:
                self.pieces.add(own, *self._encode(own))
        ids, ends = self.pieces.gather(parts)
        lasts = np.append(np.flatnonzero(np.fromiter(map("\n".__eq__, parts), bool, len(parts))), len(parts) - 1)
        self.chunks.add(words, ids, np.diff(ends[lasts], prepend=0))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``, in one array, and the bounds of each text's ids."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        fresh = set(words).difference(self.chunks.known)
        if fresh and len(self.chunks.known) + len(fresh) > REMEMBERED:
            self.chunks, fresh = Memory(), set(words)
        if fresh:
            text = "\n".join(fresh)
            special = [t for t in self.added if t in text]
            if self.divided and "" not in fresh and LATIN_LINES.fullmatch(text):
                plain = list(fresh)
            else:
                plain = [w for w in fresh if LATIN.fullmatch(w)] if self.divided else []
            if special:
                plain = [w for w in plain if not any(t in w for t in special)]
            if plain:
                self._compose(plain)
            if whole := list(fresh.difference(plain)):
                self._learn(self.chunks, whole)
        ids, ends = self.chunks.gather(words, coded.indices.to_numpy())
        counts = pc.list_value_length(split).to_numpy()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return np.insert(ids, bounds[1:], end), bounds + np.arange(len(texts) + 1)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END, file_bytes: int = FILE_BYTES) -> str:
    """Writes the files below ``path`` in ascending doc_id order and returns ``path``."""
    with open(tokenizer, encoding="utf-8") as file:
        shared = packed(docs.sparkSession, file.read())

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        import pickle

        part, place, encoder = TaskContext.get().partitionId(), 0, Encoder(pickle.loads(shared.value))
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for first, last in row_chunks(byte_rows(texts)[1], CHUNK_BYTES):
                flat, bounds = encoder.encode(texts.slice(first, last - first), end)
                sizes = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(place + bounds[:-1]), pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)),
                    ],
                    names=["doc_id", "part", "place", "n_tokens", "ids"],
                )
                place += int(bounds[-1])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-int(size) // file_bytes), min(rows.sparkSession.sparkContext.defaultParallelism, -(-int(size) // (1 << 20))))
    # An id that many rows share is spread by its texts' hashes, and equal rows by where they were read.
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    (
        dealt.select("doc_id", "text").mapInArrow(work, SCHEMA).write
        .option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", 10_000).option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).option("compression", "zstd")
        .orc(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(path)
    # One row for each file, so the running sum over them stays small.
    totals = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(totals), "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; statistics, row indexes and Bloom filters decide what is read."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(column: pa.Array) -> pa.Array:
        bounds = np.asarray(column.offsets)
        values = np.asarray(column.values).astype("<u4")
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())

    return tokens.select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))
