"""Spelling variants, ranked search and toxicity against brute force, SQL and held-out rows; odd rows in each."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lexical_search, near_duplicates, spelling, toxicity
from plumbline.llm.frames import hash_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n string, score string, rank string"


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in any column, empty and very long texts, repeated rows, names that clash with inner columns."""
    long = "abcdefgh " * 20_000
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, long), (5, "z" * 20_000 + " " + "z" * 19_999), (5, "z" * 20_000 + " " + "z" * 19_999), (6, "z" * 19_999),
        (None, "abcdefgh abcdefgx ABCDEFGH"), (7, "abcdefgh abcdefgx ABCDEFGH"), (8, "éééééééé ÉÉÉÉÉÉÉÉ éééééééx"), (9, "éééééééé éééééééx"), (10, "12 !!"),
    ]
    return spark.createDataFrame([(*r, *("a",) * 2, 1, *("b",) * 4) for r in rows], DOCS)


def brute_variants(rows: list[tuple]) -> set[tuple]:
    count = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def near(x: str, y: str) -> bool:
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    some = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and near(v, w)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in some.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(some[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("crowd", [2, 1024])
def test_spelling_equals_brute_force(spark, odd, crowd):
    """Words over a small alphabet, near to many others; crowded groups are dealt again."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abÀ"), n)) for n in rng.integers(5, 9, 700)]
    heavy = np.repeat(words[:12], 40).tolist() + np.repeat(words[12:20], 500).tolist()
    heavy += ["chaincca"] * 2 + ["chaincbb"] * 40 + ["chaincca".replace("a", "x"), "chaincba"] * 3 + ["chaintbb"] * 900
    rows = [(int(i), " ".join(part)) for i, part in enumerate(np.array_split(rng.permutation(words + words + heavy), 40))]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows)
    assert {tuple(r) for r in got.collect()} == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)
    plain = odd.select("doc_id", "text")
    assert {tuple(r) for r in spelling.variants(odd, crowd=crowd).collect()} == brute_variants([tuple(r) for r in plain.collect()])
    assert spelling.variants(odd.limit(0)).count() == 0


def test_near_sets_equal_brute_force():
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("ab"), n)) for n in rng.choice([6, 7], 150)})
    codes = np.array([[ord(c) - 96 for c in w] + [0] * (7 - len(w)) for w in words])
    long = np.array([len(w) == 7 for w in words])
    for first, last in ((0, 3), (3, 6), (0, 6), (2, 3)):
        sets = spelling.near_sets(codes, long, first, last)
        got = {(i, j) for i in range(len(words)) for j in range(len(words)) if sets[i, j // 64] >> np.uint64(j % 64) & np.uint64(1)}
        want = set()
        for i, x in enumerate(words):
            for j, y in enumerate(words):
                at = next((p for p in range(6) if x[p] != y[p]), 6)
                one = x[at + 1 :] == y[at + 1 :] if len(x) == len(y) else x[at:] == y[at + 1 :] if len(x) < len(y) else x[at + 1 :] == y[at:]
                # Two of seven letters meet in the groups of words of seven.
                if x != y and one and (len(x), len(y)) != (7, 7) and (first <= at < last or at == last == 6):
                    want.add((i, j))
        assert got == want


def brute_ranks(docs: list[tuple], items: list[tuple], k: int) -> set[tuple]:
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = set()
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 75 + (25 * sum(b.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text))
            scores.append((-score, d is None, d))
        out |= {(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]) if s < 0}
    return out


@pytest.mark.parametrize("limit", [1 << 53, 1 << 33])
def test_search_equals_brute_force(spark, odd, limit, monkeypatch):
    """Many ties and repeated rows, several blocks and tiles; narrow limits cut the vocabulary into parts."""
    monkeypatch.setattr(lexical_search, "ITEMS", 3)
    monkeypatch.setattr(lexical_search, "DOCS", 16)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)] + ["é", "X9"]
    docs = [(int(d), " ".join(rng.choice(words, rng.integers(0, 12)))) for d in rng.permutation(200)]
    docs += [docs[0], (None, docs[0][1]), (500, docs[0][1]), (501, None)] + [tuple(r) for r in odd.select("doc_id", "text").collect()]
    items = [(i, " ".join(rng.choice(words, 5))) for i in range(10)] + [(20, "abcdefgh É abcdefgh w1"), (21, ""), (22, None), (23, "nowhere")]
    item_rows = spark.createDataFrame([*[(*i, "x") for i in items], (3, items[3][1], "y"), (None, "w1", "z")], "item_id long, text string, times string")
    frame = spark.createDataFrame([(*d, "t") for d in docs], "doc_id long, text string, terms string").repartition(7)
    got = lexical_search.rank_documents(frame, item_rows, k=6, block=25, limit=limit)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == brute_ranks(docs, items, 6)
    assert len(rows) == len({r[:2] for r in rows})
    assert lexical_search.rank_documents(frame.limit(0), item_rows).count() == 0
    assert lexical_search.rank_documents(frame, item_rows.limit(0)).count() == 0


def test_vocabulary_compares_bytes():
    """Spans whose hash equals a term's by accident are told apart by their bytes."""
    known = lexical_search.Vocabulary([b"one", b"two"])
    data = np.frombuffer(b"one six", np.uint8)
    found = known.find(data, np.array([0, 4]), np.array([3, 7]), np.repeat(known.hashes[known.number == 0], 2))
    assert found.tolist() == [0, -1]


def test_tiles_stay_exact():
    tile = lexical_search.Tile(0, np.arange(50) % 2, np.arange(50), np.full(50, 23_000 * 9), 2, 60, 1 << 41)
    assert len(tile.parts) > 1 and [p[0] for p in tile.parts[1:]] == [p[1] for p in tile.parts[:-1]]
    dense = np.full((1, 50), 999_999.0)
    assert tile.scores(dense).tolist() == [[25 * 23_000 * 9 * 999_999] * 2]


def test_toxicity_held_out(spark, odd):
    for folder, least, recall in (("/root/testdata/sf0.01", 0.92, 0.5), ("/root/testdata/sf0.1", 0.98, 0.85)):
        docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
        scored = toxicity.assess(docs, labels)
        assert scored.count() == docs.count()
        rows = scored.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
        assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > least
        assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > recall
        assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) < 0.005
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    assert all(0 <= r["score"] <= 1 for r in rows)
    unlabelled = toxicity.assess(odd, labels.limit(0)).collect()
    assert len(unlabelled) == odd.count() and all(r["score"] == 0.5 for r in unlabelled)
    clean = toxicity.assess(odd, labels.withColumn("toxic", F.lit(0))).collect()
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in clean)
    both = toxicity.assess(docs.unionByName(odd.select(docs.columns)), labels)
    assert both.count() == docs.count() + odd.count()
    assert toxicity.assess(odd.limit(0), labels).count() == 0


def test_non_negative_gradient():
    """The step follows the whole risk, and leaves the clean-text risk where its estimate is below 0."""
    rng = np.random.default_rng(0)
    positive, unlabelled, prior = rng.normal(size=(6, 5)), rng.normal(size=(9, 5)), 0.3
    for bias in (0.4, -9.0):
        w = {"encode": rng.normal(size=(5, 3)), "encode_b": rng.normal(size=3), "out": rng.normal(size=3), "direct": rng.normal(size=5), "bias": np.float64(bias)}
        if bias < 0:
            positive = positive + 20 * w["direct"]

        def followed() -> float:
            toxic, clean = toxicity.risk(toxicity._network(w, positive)[0], toxicity._network(w, unlabelled)[0], prior)
            return toxic + clean if clean >= 0 else -clean

        assert (toxicity.risk(toxicity._network(w, positive)[0], toxicity._network(w, unlabelled)[0], prior)[1] < 0) == (bias < 0)
        g = toxicity.step_of(w, positive, unlabelled, prior)
        for name in ("encode", "encode_b", "out", "direct"):
            at = (0,) * w[name].ndim
            w[name][at] += 1e-6
            up = followed()
            w[name][at] -= 2e-6
            assert abs((up - followed()) / 2e-6 - g[name][at]) < 1e-5
            w[name][at] += 1e-6


def test_hash_sample(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "doc_id")
    assert hash_sample(rows, 20_000).count() == 10_000
    some = {r[0] for r in hash_sample(rows, 1000).collect()}
    assert 850 < len(some) < 1150 and some == {r[0] for r in hash_sample(rows.repartition(5), 1000).collect()}


def test_near_duplicates_of_repeated_ids(spark):
    """An id repeated with different texts links through each of them."""
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    edited = [t.replace("30 ", "x ", 1) for t in base]
    rows = [(1, base[0]), (1, base[1]), (2, edited[0]), (3, edited[1]), (4, base[2]), (4, base[2]), (5, edited[2]), (4, base[2].upper()), (6, None), (6, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k1 string")
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates.near_duplicates(df, words=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    kept = near_duplicates.keep_one(df, words=2)
    assert kept.columns == df.columns
    found = sorted((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect())
    assert [f for f in found if f[0] != 6] == [(1, base[0]), (1, base[1]), (4, base[2])] and {f[0] for f in found} == {1, 4, 6}
