"""Spelling variants: words one letter apart, found with a bit-sliced position index.

Runs of letters are counted over all texts. Two words are near if one inserted, deleted or replaced code point turns one
into the other. For a pair whose shorter word has ``a`` code points, the first place where the two differ lies in one of
the segments [i, j) of 0 to ``a``; all that stands outside that segment is equal in both. So every word is dealt to the
groups (a, i, j, its letters outside the segment), for ``a`` its own length and one less, and each near pair meets in
exactly one group. Words start with two halves; a group of over CROWD words is dealt again with its segment halved, down
to one place, where a group holds no more words than the alphabet and its square allow.

Groups are compared in tiles. A tile's index has one bitset per (position, letter): bit k is set if word k has that
letter there. For each word the recurrence goes through the positions with three bitsets for the whole tile at once: the
words equal so far, and those with one replaced or one inserted (for the longer word: one deleted) letter, which enter
where equality ends and go on with the position shifted. The words of a tile stand in order of falling count, so the
number of set bits is the number of near words and the lowest set bit is the most frequent of them: no pair is written.

Defined results: NULL and empty text hold no words; a NULL id counts as empty text in the checksum. Repeated rows count
each. Very long runs are words like any other. Ties for the form go to the smallest word in code-point order. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import id_and_text

#: Letters of a run, as a regular expression's class.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Members of a group beyond which its segment is halved; members of a dealt part and of a tile (on average, at least).
CROWD, PART, TILE = 1024, 16_384, 512
#: Code points that a tile holds (unless one group holds more).
SYMBOLS = 1 << 21


def counted_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of ``least_length`` code points and ``least_count`` occurrences, after the planted slips.

    A run loses the code point h % length where ``every`` divides h, the crc32 of id, colon and lower-cased run. Runs
    shorter than ``least_length`` can't become words and are left in the text.
    """
    pattern = F.lit(f"[{LETTERS}]{{{least_length},}}")
    runs = id_and_text(docs).select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    checksum = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    hashed = runs.select("run", checksum.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def _keyed(members: DataFrame) -> DataFrame:
    """Adds g, the hash of a member's letters outside its segment (a collision only makes a group larger)."""
    tail = F.substring("word", F.char_length("word") - (F.col("a") - F.col("j")) + 1, F.col("a") - F.col("j"))
    outside = F.xxhash64("a", "i", "j", F.substring("word", F.lit(1), F.col("i")), tail)
    return members.select("word", "n", "a", "i", "j", outside.alias("g"))


def _halved(members: DataFrame) -> DataFrame:
    """Each member with both halves of its segment."""
    middle = F.floor((F.col("i") + F.col("j")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("i"), middle.alias("j")), F.struct(middle.alias("i"), F.col("j"))
    )
    return members.select("word", "n", "a", F.explode(halves).alias("s")).select("word", "n", "a", "s.i", "s.j")


def _dealt(words: DataFrame, least: int, crowd: int) -> DataFrame:
    """(word, n, a, i, j, g): every word in its groups, crowded ones dealt again with halved segments."""
    length = F.char_length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("a")).where(F.col("a") >= least)
    whole = whole.withColumns({"i": F.lit(0), "j": F.col("a")})
    members, out = _keyed(_halved(whole)), None
    while True:
        crowded = members.groupBy("g", "i", "j").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > crowd) & (F.col("j") - F.col("i") > 1))
        crowded = cut(crowded.select("g").distinct())
        if crowded.isEmpty():
            return members if out is None else out.unionByName(members)
        small = members.join(crowded, "g", "left_anti").unionByName(
            members.join(crowded, "g", "left_semi").where(F.col("j") - F.col("i") <= 1)
        )
        out = small if out is None else out.unionByName(small)
        members = cut(_keyed(_halved(members.join(crowded, "g", "left_semi").where(F.col("j") - F.col("i") > 1))))


def _bitsets(column: np.ndarray, letters: int) -> np.ndarray:
    """For each letter the set of rows that hold it, 64 rows in a word."""
    marks = np.zeros((letters, -(-len(column) // 64) * 64), bool)
    marks[column, np.arange(len(column))] = True
    return np.packbits(marks, axis=1, bitorder="little").view(np.uint64)


def near_sets(codes: np.ndarray, long: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each row the bitset of the rows near to it that differ from it first at a place in [first, last).

    ``codes`` has a + 1 letter numbers a row; rows that are not ``long`` have ``a`` letters and then 0, which is no
    letter. Rows of ``a`` letters meet those with one replaced or one more, rows of a + 1 letters those with one less.
    A segment that reaches the shorter word's end includes a letter added there.
    """
    a = codes.shape[1] - 1
    letters = int(codes.max()) + 1
    index = [_bitsets(codes[:, p], letters) for p in range(a + 1)]
    longer = _bitsets(long.astype(np.int64), 2)[1]
    shorter = _bitsets((~long).astype(np.int64), 2)[1]
    near = np.zeros((len(codes), len(longer)), np.uint64)

    rows = np.flatnonzero(~long)
    if len(rows):
        equal = np.broadcast_to(shorter | longer, (len(rows), len(longer))).copy()
        replaced, inserted = np.zeros_like(equal), np.zeros_like(equal)
        for p in range(a):
            here, shifted = index[p][codes[rows, p]], index[p + 1][codes[rows, p]]
            replaced &= here
            inserted &= shifted
            if first <= p < last:
                leaves = equal & ~here
                replaced |= leaves
                inserted |= leaves & shifted
            equal &= here
        if last == a:
            inserted |= equal
        near[rows] = (replaced & shorter) | (inserted & longer)

    rows = np.flatnonzero(long)
    if len(rows):
        equal = np.broadcast_to(shorter, (len(rows), len(longer))).copy()
        deleted = np.zeros_like(equal)
        for p in range(a + 1):
            here = index[p][codes[rows, p]]
            if p:
                deleted &= index[p - 1][codes[rows, p]]
            if first <= p < last or p == last == a:
                deleted |= equal & ~here
            equal &= here
        near[rows] = deleted
    return near


def _summed(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set bits of each row, and the place of the lowest."""
    count = np.bitwise_count(near).sum(1).astype(np.int64)
    word = np.argmax(near != 0, axis=1)
    value = near[np.arange(len(near)), word]
    lowest = np.bitwise_count((value & (~value + np.uint64(1))) - np.uint64(1))
    return count, word * 64 + lowest.astype(np.int64)


def _tiles(kinds: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole groups of one kind; ``kinds`` has the columns a, i, j, g of sorted rows."""
    bounds = np.flatnonzero((kinds[1:] != kinds[:-1]).any(1)) + 1
    bounds = np.concatenate([[0], bounds, [len(kinds)]])
    symbols = np.concatenate([[0], np.cumsum(sizes)])
    out, begin = [], 0
    for start, stop in zip(bounds[:-1], bounds[1:]):
        same = (kinds[begin, :3] == kinds[start, :3]).all()
        if start > begin and (not same or stop - begin > TILE or symbols[stop] - symbols[begin] > SYMBOLS):
            out.append((begin, int(start)))
            begin = int(start)
    out.append((begin, len(kinds)))
    return out


def _compared(table: pa.Table) -> pa.Table:
    """(word, n_near, form_n, form) of the members that have near words in their groups."""
    table = table.sort_by([("n", "descending"), ("word", "ascending")])
    words, n = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
    kinds = np.stack([table[c].to_numpy().astype(np.int64) for c in ("a", "i", "j", "g")], 1)
    order = np.lexsort((np.arange(len(kinds)), *kinds.T[::-1]))
    kinds = kinds[order]
    found = []
    for begin, stop in _tiles(kinds, kinds[:, 0] + 1):
        if stop - begin < 2:
            continue
        # Rows of a tile go back to the order of falling counts.
        rows = np.sort(order[begin:stop])
        a, i, j = (int(x) for x in kinds[begin, :3])
        sizes = np.array([len(w) for w in words[rows]])
        symbols = np.frombuffer("".join(words[rows]).encode("utf-32-le"), np.uint32)
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters, numbers = np.unique(symbols, return_inverse=True)
        codes = np.zeros((len(rows), a + 1), np.int64)
        codes[np.repeat(np.arange(len(rows)), sizes), place] = numbers + 1
        count, best = _summed(near_sets(codes, sizes > a, i, j))
        some = np.flatnonzero(count)
        found.append((rows[some], count[some], rows[best[some]]))
    if not found:
        rows, count, best = (np.empty(0, np.int64),) * 3
    else:
        rows, count, best = (np.concatenate(x) for x in zip(*found))
    return pa.table(
        {"word": pa.array(words[rows], pa.string()), "n_near": pa.array(count, pa.int64()),
         "form_n": pa.array(n[best], pa.int64()), "form": pa.array(words[best], pa.string())}
    )


def near_counts(words: DataFrame, least: int, crowd: int = CROWD) -> DataFrame:
    """(word, n_near, best): number of near words of each word that has any, and the most frequent one (n, word)."""
    total = 4 * words.count()
    members = _dealt(words, least, crowd)
    parts = max(1, -(-total // PART))
    found = members.withColumn("part", F.pmod("g", F.lit(parts))).groupBy("part").applyInArrow(
        _compared, "word string, n_near long, form_n long, form string"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return summed.select("word", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word that the forms (word, form) lead to, by pointer doubling.

    A form is at least ten times as frequent as its word, so a chain is no longer than the digits of the largest count.
    """
    up = cut(links.select("word", F.col("form").alias("root")))
    while True:
        further = up.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = cut(up.join(further, F.col("root") == F.col("_word"), "left"))
        if joined.where("_root is not null").isEmpty():
            return up
        up = joined.select("word", F.coalesce("_root", "root").alias("root"))


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10, every: int = 31, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every counted word with the frequent word that it is a variant of.

    ``form`` is the most frequent near word if it is ``times`` as frequent; ``root`` is the last word along the forms.
    """
    if least_length < 2:
        raise ValueError("least_length must be 2 or more")
    words = cut(counted_words(docs, least_length, least_count, every))
    near = near_counts(words, least_length, crowd)
    is_form = F.col("form_n") >= times * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    judged = cut(judged)
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
