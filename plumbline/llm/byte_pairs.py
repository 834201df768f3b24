"""Byte-level BPE in batched numpy merge rounds, and its decoding.

Texts are cut into pre-tokens by the tokenizer's pattern. The symbols of all pre-tokens that a task sees for the first
time stand in one flat array; in each round every pre-token finds the lowest rank among its adjacent pairs (a binary
search over the sorted pair keys, repeated only where symbols changed) and merges all its occurrences from left to
right; finished pre-tokens leave the array. A bounded table keeps the ids of pre-tokens seen before.

The vocabulary is read on the driver from a tokenizers JSON file and sent to the tasks; its size is fixed by the file.

Defined results: NULL is encoded as empty text, which has no ids. The strings of added tokens in a text get their ids,
as the tokenizers library does. Ids without a token decode to nothing; bytes that are no UTF-8 decode to U+FFFD. Rows are
encoded one by one, so repeated rows agree, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrays import giving_back, strings, text_chunks
from .frames import id_and_text, packed, unpacked

#: Fixed value: how byte-level BPE cuts texts into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pre-tokens and their ids that a task remembers about; beyond it starts anew, which changes no result.
REMEMBERED, ENTRY = 48 << 20, 120
_NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = (256 + i for i in range(256))
    return [chr(b) if b in printable else chr(next(moved)) for b in range(256)]


@dataclass
class Vocabulary:
    base: np.ndarray  # id of each byte
    keys: np.ndarray  # sorted pair keys: left * size + right
    ranks: np.ndarray
    merged: np.ndarray
    size: int
    pieces: list[bytes]  # bytes of each id
    added: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    ids: dict[str, int] = parts["model"]["vocab"]
    letters = byte_letters()
    byte_of = {c: i for i, c in enumerate(letters)}
    added = {t["content"]: t["id"] for t in parts["added_tokens"]}
    size = max([*ids.values(), *added.values()]) + 1
    pairs = [p if isinstance(p, list) else p.split(" ") for p in parts["model"]["merges"]]
    keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    pieces = [b""] * size
    for token, i in [*ids.items(), *added.items()]:
        known = all(c in byte_of for c in token)
        pieces[i] = bytes(byte_of[c] for c in token) if known else token.encode()
    merged = np.array([ids[a + b] for a, b in pairs], np.int64)
    base = np.array([ids.get(c, -1) for c in letters], np.int64)
    return Vocabulary(base, keys[order], order.astype(np.int64), merged, size, pieces, added)


def merge_words(words: Sequence[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the number of each word's ids."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbols = v.base[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    done_owner, done_symbols, done_place = [], [], []

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * v.size + right
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        return np.where(v.keys[at] == key, v.ranks[at], _NONE)

    def ranks_at(places: np.ndarray) -> np.ndarray:
        out = np.full(len(places), _NONE)
        inner = places < len(symbols) - 1
        p = places[inner]
        same = owner[p] == owner[p + 1]
        values = np.full(len(p), _NONE)
        values[same] = rank(symbols[p[same]], symbols[p[same] + 1])
        out[inner] = values
        return out

    pair = ranks_at(np.arange(len(symbols)))
    while len(symbols):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        counts = np.diff(np.append(starts, len(symbols)))
        best = np.minimum.reduceat(pair, starts)
        active = best < _NONE
        if not active.all():
            stay = np.repeat(active, counts)
            done_owner.append(owner[~stay])
            done_symbols.append(symbols[~stay])
            symbols, owner, pair = symbols[stay], owner[stay], pair[stay]
            best, counts = best[active], counts[active]
            if not len(symbols):
                break
        hit = pair == np.repeat(best, counts)
        # A pair of equal symbols can overlap the next one: of a run every second is taken.
        place = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
        at = np.flatnonzero(hit & ((place - run) % 2 == 0))
        symbols[at] = v.merged[pair[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        new = np.cumsum(keep) - 1
        symbols, owner, pair = symbols[keep], owner[keep], pair[keep]
        at = new[at]
        touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
        pair[touched] = ranks_at(touched)
    if not done_owner:
        return np.empty(0, np.int64), sizes * 0
    owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes texts; remembers the ids of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.find = regex.compile(PATTERN).findall
        special = sorted(vocabulary.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.sizes, self.starts, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, sizes = merge_words([w.encode("utf-8", "surrogatepass") for w in words], self.v)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ids, self.sizes, self.starts = np.append(self.ids, ids), np.append(self.sizes, sizes), np.append(self.starts, starts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text's ids."""
        words, counts, marked = [], [], []
        for text in texts:
            before = len(words)
            if self.special is not None and self.special.search(text):
                for i, piece in enumerate(self.special.split(text)):
                    if i % 2:
                        marked.append((len(words), self.v.added[piece]))
                        words.append("")
                    else:
                        words += self.find(piece)
            else:
                words += self.find(text)
            counts.append(len(words) - before)
        distinct = set(words)
        fresh = distinct.difference(self.known)
        if fresh and self.held + sum(map(len, fresh)) + ENTRY * len(fresh) > REMEMBERED:
            self._forget()
            fresh = distinct
        self.held += sum(map(len, fresh)) + ENTRY * len(fresh)
        if fresh:
            self._learn(list(fresh))
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[index]
        for at, _ in marked:
            sizes[at] = 1
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) - np.repeat(ends - sizes - self.starts[index], sizes)
        for at, _ in marked:
            source[ends[at] - 1] = 0
        ids = self.ids[source] if total and len(self.ids) else np.zeros(total, np.int64)
        for at, value in marked:
            ids[ends[at] - 1] = value
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids, bounds


def decode(ids: Sequence[int], v: Vocabulary) -> str:
    """The text of the ids, added tokens included."""
    return b"".join([v.pieces[i] for i in ids if 0 <= i < v.size]).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    shared = packed(docs.sparkSession, read_vocabulary(path))

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = unpacked(shared)
        encoder, decimal = Encoder(v), [str(i) for i in range(v.size)]
        for batch in batches:
            texts = strings(batch.column(1))
            for first, last in text_chunks(texts):
                ids, bounds = encoder.encode(texts[first:last])
                listed, coded, decoded = ids.tolist(), [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = listed[a:b]
                    coded.append(hashlib.sha256(",".join([decimal[i] for i in own]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(decode(own, v).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))),
                        pa.array(np.diff(bounds), pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs).mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    shared = packed(encoded.sparkSession, read_vocabulary(path))

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = unpacked(shared)
        for batch in batches:
            texts = [decode([i for i in ids if i is not None], v) if ids is not None else None for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
