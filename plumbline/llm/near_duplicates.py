"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Every text becomes the set of its distinct word shingles and a MinHash signature. Rows with the same set are one class;
only classes are compared. Classes that agree on all hashes of a band share a bucket. Inside a bucket members are
compared with a hub first, so a bucket with a large group costs one pair per member; buckets whose members are all
linked are finished, and what is left is compared member by member across components. A pair's signatures are compared
batch by batch: with m of n hashes equal and a uniform prior, the similarity has a Beta(m + 1, n - m + 1) posterior,
and the pair is dropped as soon as the probability of a similarity at the threshold falls below ``miss``. Survivors
are confirmed on their full shingle sets. Crowded buckets that hubs do not finish are compared on full sets in cells of
bounded size, which report only the links that join components.

Defined results: NULL or empty text has no shingles and links with nothing. A row without an id takes no part
(component_id NULL, kept true). Repeated rows are members of one class; an id repeated with other texts is in a class
with each of them. Ties go to the smaller id. An empty table gives
an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .arrays import CHUNK, Spans, byte_rows, fold, giving_back, row_chunks, word_spans
from .frames import components, id_and_text, only, release

#: Bands times rows hashes make a signature. A pair at similarity 0.8 shares no band with probability 5e-5.
BANDS, ROWS = 25, 5
#: Probability of losing a true pair in the sequential comparison, and hashes per batch.
MISS, BATCH = 1e-6, 25
#: Rounds with hubs go on while each leaves at most this share of the cross pairs that were left before.
PROGRESS = 0.8
#: Members of a bucket that is compared pair by pair in the end; larger ones are compared in cells of two blocks of
#: about CELL members, SLICE shingles at a time.
SMALL, CELL, SLICE = 32, 512, 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int, spans: Spans) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of UTF-8 bytes."""
    offsets = bounds - bounds[0]
    symbols = _LOWER[data[bounds[0] : bounds[-1]]]
    starts, ends, ranges = word_spans(~_SPACE[symbols], offsets)
    hashes = spans.hashes(symbols, starts, ends)
    folded = fold(hashes, words)
    out = []
    for first, last in zip(ranges[:-1], ranges[1:]):
        n = int(last - first)
        if n >= words:
            out.append(np.unique(folded[first : last - words + 1]))
        else:
            out.append(fold(hashes[first:last], n) if n else np.empty(0, np.uint64))
    return out


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(20_240_817).integers(0, 1 << 32, (2, count), dtype=np.uint64).astype(np.uint32)
    return numbers[0] | np.uint32(1), numbers[1]


def minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Signatures of non-empty sets, one row each."""
    factors, flips = _permutations(count)
    out = np.empty((len(sets), count), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for first, last in row_chunks(bounds, 1 << 15):
        values = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = bounds[first:last] - bounds[first]
        work = np.empty_like(values)
        for i in range(count):
            np.bitwise_xor(values, flips[i], out=work)
            np.multiply(work, factors[i], out=work)
            # The least value's low bits differ with probability 1 - 2**-16 where the least values do.
            out[first:last, i] = np.minimum.reduceat(work, starts).astype(np.uint16)
    return out


def signatures(docs: DataFrame, words: int, count: int = BANDS * ROWS) -> DataFrame:
    """(doc_id, text_key, n_shingles, k1, k2, sig): a hash of the text, set size, 128-bit digest of the set and signature.

    Digest and signature are NULL for empty sets.
    """

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans()
        for batch in batches:
            data, bounds = byte_rows(batch.column(1))
            for first, last in row_chunks(bounds):
                sets = shingle_sets(data, bounds[first : last + 1], words, spans)
                full = [i for i, s in enumerate(sets) if len(s)]
                digests = np.zeros((len(sets), 2), np.int64)
                for i in full:
                    digests[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                empty = np.ones(len(sets), bool)
                empty[full] = False
                sigs: list[bytes | None] = [None] * len(sets)
                for i, row in zip(full, minhashes([sets[i] for i in full], count) if full else ()):
                    sigs[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(2).slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests[:, 0], mask=empty),
                        pa.array(digests[:, 1], mask=empty),
                        pa.array(sigs, pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "k1", "k2", "sig"],
                )

    keyed = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(work, "doc_id long, text_key long, n_shingles long, k1 long, k2 long, sig binary")


def least_matches(threshold: float, miss: float, count: int) -> np.ndarray:
    """For n compared hashes the fewest equal ones with P(similarity >= threshold | matches) >= miss.

    With a uniform prior that probability is the chance of at most m successes in n + 1 draws at the threshold.
    """
    out = np.zeros(count + 1, np.int64)
    for n in range(1, count + 1):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out[n] = m
    return out


def prune(left: np.ndarray, right: np.ndarray, least: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Which rows of two signature matrices survive the batchwise comparison."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
    for start in range(0, left.shape[1], batch):
        stop = min(start + batch, left.shape[1])
        equal[alive] += (left[alive, start:stop] == right[alive, start:stop]).sum(1)
        alive = alive[equal[alive] >= least[stop]]
    keep = np.zeros(len(left), bool)
    keep[alive] = True
    return keep


def _likely(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that survive sequential Bayesian verification on their signatures."""
    least = least_matches(threshold, miss, BANDS * ROWS)

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for i in (2, 3)]
            keep = pa.array(prune(matrix[0], matrix[1], least))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    sigs = only(sigs, wanted, "rep")
    sides = [sigs.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    near = joined.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(threshold) - F.lit(1e-9))
    return near.select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a long, b long")


def _full_sets(needed: DataFrame, docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(rep, shingles): the sorted shingle hashes of the classes ``needed`` (rep), computed from their texts again."""

    @giving_back
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans()
        for batch in batches:
            data, bounds = byte_rows(batch.column(1))
            for first, last in row_chunks(bounds):
                found = shingle_sets(data, bounds[first : last + 1], words, spans)
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([int(d[0]) for d in digests], pa.int64()),
                        pa.array([int(d[1]) for d in digests], pa.int64()),
                        pa.array([s.tobytes() for s in found], pa.binary()),
                    ],
                    names=["first", "k1", "k2", "shingles"],
                )

    wanted = cut(needed.join(reps.select("rep", "first", "k1", "k2"), "rep"))
    rows = only(id_and_text(docs), wanted.select(F.col("first").alias("doc_id")).distinct(), "doc_id")
    found = rows.mapInArrow(sets, "first long, k1 long, k2 long, shingles binary")
    # An id that is repeated with other texts gives several sets; the class digest tells which one is meant.
    return cut(wanted.join(found, ["first", "k1", "k2"]).dropDuplicates(["rep"]).select("rep", "shingles"))


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs whose full shingle sets are at least ``threshold`` similar."""
    share = round(threshold * 100)

    @giving_back
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= share * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    needed = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    texts = _full_sets(needed, docs, reps, words)
    left = texts.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = texts.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(confirm, "a long, b long")


def similar_pairs(sets: list[np.ndarray], split: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i < split, j) with 100 * |i and j| >= share * |i or j|; j runs over all rows after i if split is len(sets).

    Common shingles are counted by products of incidence matrices, a slice of the shingles at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    kinds, kind, times = np.unique(values, return_inverse=True, return_counts=True)
    # A shingle of one set is in no intersection.
    shared = times[kind] > 1
    number = np.cumsum(times > 1) - 1
    owner, kind = owner[shared], number[kind[shared]]
    low = 0 if split == len(sets) else split
    common = np.zeros((split, len(sets) - low), np.float32)
    order = np.argsort(kind, kind="stable")
    owner, kind = owner[order], kind[order]
    for start in range(0, int(kind[-1]) + 1 if len(kind) else 0, SLICE):
        a, b = np.searchsorted(kind, (start, start + SLICE))
        matrix = np.zeros((len(sets), SLICE), np.float32)
        matrix[owner[a:b], kind[a:b] - start] = 1
        common += matrix[:split] @ matrix[low:].T
    union = sizes[:split, None] + sizes[None, low:] - common
    left, right = np.nonzero((100 * common >= share * union) & (union > 0))
    right = right + low
    return left[left < right], right[left < right]


def _crowded_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join different components of crowded groups.

    ``members`` (rep, crowd, comp). Every member outside a crowd's largest component meets every other member of the
    crowd in a cell of two blocks; a cell reports only links that join components it has not yet joined itself.
    """
    share = round(threshold * 100)
    sizes = members.groupBy("crowd", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("crowd").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.sum("c").alias("size"), F.max("c").alias("main_size"))
    main = main.where("size > main_size").select(
        "crowd", "main", F.ceil((F.col("size") - F.col("main_size")) / CELL).cast("int").alias("rests"),
        F.ceil(F.col("main_size") / CELL).cast("int").alias("mains"),
    )
    placed = members.join(main, "crowd").withColumn("rest", F.col("comp") != F.col("main"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int")
    placed = placed.withColumn("block", block)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(upto(F.col("rests")), lambda j: F.struct(F.lit(0).alias("kind"), F.least("block", j).alias("p"), F.greatest("block", j).alias("q")))
    against = F.transform(upto(F.col("mains")), lambda j: F.struct(F.lit(1).alias("kind"), F.col("block").alias("p"), j.alias("q")))
    asked = F.transform(upto(F.col("rests")), lambda j: F.struct(F.lit(1).alias("kind"), j.alias("p"), F.col("block").alias("q")))
    cells = F.when(F.col("rest"), F.concat(among, against)).otherwise(asked)
    dealt = placed.select("rep", "comp", "crowd", "rest", F.explode(cells).alias("cell")).select("rep", "comp", "crowd", "rest", "cell.*")

    def links(table: pa.Table) -> pa.Table:
        rest = table["rest"].to_numpy()
        order = np.lexsort((table["rep"].to_numpy(), ~rest))
        reps, comps = table["rep"].to_numpy()[order], table["comp"].to_numpy()[order]
        held = table["shingles"].combine_chunks()
        sets = [np.frombuffer(held[int(i)].as_buffer(), np.uint64) for i in order]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        out = []
        for i, j in zip(*similar_pairs(sets, int(rest.sum()), share)):
            x, y = root(int(comps[i])), root(int(comps[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(reps[i]), int(reps[j])))
        return pa.table({"a": pa.array([min(o) for o in out], pa.int64()), "b": pa.array([max(o) for o in out], pa.int64())})

    return dealt.join(sets, "rep").groupBy("crowd", "kind", "p", "q").applyInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links, text_key, k1, k2): one row per document.

    component_id is the smallest doc_id reachable over links of at least ``threshold`` Jaccard similarity; n_links
    counts the verified links of the document's class that built the components.
    """
    spark = docs.sparkSession
    rows = cut(signatures(docs, words))
    known = rows.where("doc_id is not null and k1 is not null")
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    # A class is a node of the search. Its smallest id names it, or, where an id repeated with other texts is the
    # smallest of several classes, its digest for all but one of them.
    least = classes.groupBy("first").agg(F.min(F.struct("k1", "k2")).alias("least"), F.count(F.lit(1)).alias("c"))
    several = cut(least.where("c > 1").select("first", "least"))
    named = classes.join(several, "first", "left")
    own = F.col("least").isNull() | (F.struct("k1", "k2") == F.col("least"))
    classes = cut(named.select("k1", "k2", "first", F.when(own, F.col("first")).otherwise(F.col("k1")).alias("rep")))
    reps = known.join(classes, ["k1", "k2"]).where("doc_id = first").dropDuplicates(["rep"])
    reps = cut(reps.select("rep", "first", "k1", "k2", F.col("n_shingles").alias("n"), "sig"))
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    )
    banded = reps.select("rep", F.explode(bands).alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = cut(banded.join(crowded.select("bucket"), "bucket", "left_semi"))
    total = buckets.count()

    links = spark.createDataFrame([], "a long, b long")
    tested = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, root long")
    exhaust, turn, before = False, 0, None
    while total:
        named = labels.select(F.col("node").alias("rep"), "root")
        placed = buckets.join(named, "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("comp"))
        # Members per bucket and component: a bucket with one component is finished.
        parts = placed.groupBy("bucket", "comp").agg(
            F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep")).alias("first")
        )
        state = parts.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("parts"), F.sum("c").alias("size"), F.max(F.struct("c", "first", "comp")).alias("main")
        ).where("parts > 1")
        state = cut(
            state.select(
                "bucket", "size", F.col("main.c").alias("main_size"), F.col("main.comp").alias("main"), F.col("main.first.rep").alias("hub")
            )
        )
        left = state.agg(F.sum((F.col("size") - F.col("main_size")) * F.col("size"))).first()[0] or 0
        if not left:
            break
        exhaust = before is not None and left > PROGRESS * before
        before, turn = left, turn + 1
        active = placed.join(state, "bucket")
        if exhaust:
            # In a small bucket everything outside its largest component meets every member of another component.
            small = active.where(F.col("size") <= SMALL)
            outside = small.where("comp <> main").select("bucket", F.col("rep").alias("x"), F.col("comp").alias("xc"))
            pairs = small.join(outside, "bucket").where("comp <> xc and (comp = main or rep < x)").select(
                F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")
            )
        else:
            # At most one hub for each member and turn: most members are linked by the first one.
            hubs = active.where("comp <> main").groupBy("rep").agg(
                F.min(F.struct(F.xxhash64("hub", F.lit(turn)).alias("h"), "hub"))["hub"].alias("hub")
            )
            pairs = hubs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        pairs = cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        survivors = cut(_likely(pairs, reps, threshold, miss))
        found = cut(_confirmed(survivors, docs, reps, words, threshold)) if not survivors.isEmpty() else survivors
        if exhaust:
            # Large buckets overlap; what they connect is one crowd, compared in cells of bounded size.
            large = active.where(F.col("size") > SMALL).select("bucket", "rep", "comp", "hub")
            crowds = components(large.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
            members = cut(large.select("rep", "comp").distinct().join(crowds.select(F.col("node").alias("rep"), F.col("root").alias("crowd")), "rep"))
            if not members.isEmpty():
                sets = _full_sets(members.select("rep"), docs, reps, words)
                found = found.unionByName(cut(_crowded_links(members, sets, threshold)))
        links = links.unionByName(found)
        if not found.isEmpty():
            labels = components(links)
        release(spark)
        if exhaust:
            break
        tested = tested.unionByName(pairs)

    degree = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    # A component has the smallest id of all its classes.
    joined = classes.join(labels.select(F.col("node").alias("rep"), "root"), "rep")
    ids = joined.groupBy("root").agg(F.min("first").alias("component"))
    linked = joined.select("rep", "root").join(ids, "root").select("rep", "component")
    named = classes.join(linked, "rep", "left").join(degree, "rep", "left")
    named = named.select("k1", "k2", F.coalesce("component", "first").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.drop("sig").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "text_key", "k1", "k2",
    )


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents with one of each group left: the one with the smallest id.

    Of rows with one id those of different groups stay, and one of those with the same shingles.
    """
    marked = cut(near_duplicates(docs, words, threshold).select("doc_id", "text_key", "k1", "k2", "kept").where("doc_id is not null"))
    repeated = cut(marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"))
    kept = marked.where("kept").select("doc_id").distinct()
    single = docs.join(kept, "doc_id", "left_semi").join(repeated, "doc_id", "left_anti").unionByName(docs.where("doc_id is null"))
    # Only rows whose id is repeated have to be gathered: one text for each class that stays.
    several = marked.where("kept").join(repeated, "doc_id", "left_semi")
    chosen = several.groupBy("doc_id", "k1", "k2").agg(F.min("text_key").alias("_text_key")).select("doc_id", "_text_key").distinct()
    again = docs.join(repeated, "doc_id", "left_semi").withColumn("_text_key", F.xxhash64(docs["text"].cast("string")))
    again = again.join(chosen, ["doc_id", "_text_key"], "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return single.unionByName(again.drop("_text_key")).select(*docs.columns)
