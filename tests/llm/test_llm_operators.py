"""The training-data operators against brute force, round trips and held-out rows; odd rows in every operator."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from oracle import compare, connect
from plumbline.llm import byte_pairs, chat_formatting, decontamination, inner_products, languages, licenses, near_duplicates, quality, sharding, token_files
from plumbline.llm.queries import ORACLES, QUERIES, tokenizer_path
from plumbline.session import fresh_path

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rep string, v string, label string"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in any column, empty and very long texts, repeated rows, names that clash with inner columns."""
    long = "many words that go on and on without any end " * 4000
    rows = [
        (1, None, "en", None, None), (2, "", "en", "s", 0), (3, "\n \t", None, "s", 3), (4, "Word.", "en", "s", 5), (5, long, "en", "s", len(long)),
        (6, long + "tail", "en", "s", 1), (7, "x" * 30_000, None, None, None), (8, "same text here again and more", "en", "s", 1),
        (8, "same text here again and more", "en", "s", 1), (9, "same text here again and more", "fr", "s", 1), (None, "same text here again and more", "en", "s", 1),
        (10, "12345 !!! 678", "en", "s", 1), (11, "<|endoftext|> a'll   é<|startoftext|>", "en", "s", 1),
    ]
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)


def shingle_set(text: str, k: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows: dict[int, str], k: int) -> dict[int, int]:
    sets = {i: shingle_set(t, k) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    want = connect(FOLDER).execute(ORACLES[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in want.description], want.fetchall()) is None


def test_inner_products_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (None, [9.0, 9.0]), (6, [1.0, 2.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in inner_products.top_products(df, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 327680), (0, 2, 6, 327680), (0, 3, 5, 65536)]
    assert inner_products.top_products(df.limit(0), F.col("id") == 0).count() == 0


def test_inner_products_cells(spark, monkeypatch):
    monkeypatch.setattr(inner_products, "CANDIDATES", 100)
    monkeypatch.setattr(inner_products, "QUERIES", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)) * rng.exponential(size=(600, 1))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in inner_products.top_products(df, F.col("id") % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = np.floor(256 * x)
    for q in range(0, 600, 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:5]
        assert got[q] == [(i, int(s[i])) for i in order]


def test_decontamination_equals_search(spark, documents, odd):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    flat = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    wanted = {(d, i) for d, t in documents.select("doc_id", "text").collect() for i, b in items.select("item_id", "text").collect() if flat(b) in flat(t)}
    got = decontamination.matches(documents, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == wanted
    assert decontamination.matches(odd, items).count() == 0
    assert decontamination.matches(odd, items.limit(0)).count() == 0
    own = spark.createDataFrame([(1, "Same text, here? Again and more."), (1, "Same text, here? Again and more."), (2, None), (None, "x y")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(odd, own).collect()} == {(8, 1), (9, 1)}
    assert decontamination.keep_clean(odd, own).count() == odd.count() - 3


def test_chat_formatting_order_and_problems(spark):
    calls = spark.createDataFrame(
        [(1, "b", 2, "t", '{"z":1,"a":"x"}', "a", 0), (1, "a", 1, "t", '{"a":"q"}', None, 0), (1, "c", 0, "t", '{"a":1}', "b", 0), (1, "d", 5, "u", "{", "gone", 0),
         (2, "p", 0, "t", None, "q", 0), (2, "q", 1, "t", '{"a":"x"}', "p", 0), (None, "n", 0, "t", "{}", None, 0), (1, "a", 9, "t", "{}", None, 0)],
        "conv_id long, call_id string, turn long, name string, arguments string, parent_id string, place int")
    results = spark.createDataFrame([(1, "a", 2, "late"), (1, "a", 1, "first"), (3, "x", 0, None)], "conv_id long, call_id string, turn long, content string")
    schemas = spark.createDataFrame([("t", "a", "string", True)], "name string, field string, type string, required boolean")
    got = {(r["conv_id"], r["call_id"]): r for r in chat_formatting.messages(calls, results, schemas).collect()}
    assert [k[1] for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["place"])] == ["a", "d", "b", "c"]
    a = got[1, "a"]
    assert (a["depth"], a["linked"], a["result_turn"], a["extra_results"], a["repeats"], a["valid"]) == (0, True, 1, 1, 1, True)
    assert a["message"] == '{"arguments":{"a":"q"},"id":"a","name":"t","result":"first"}'
    assert got[1, "b"]["problems"] == "unknown z" and got[1, "b"]["message"] == '{"arguments":{"a":"x","z":1},"id":"b","name":"t"}'
    assert got[1, "c"]["problems"] == "type of a" and got[1, "c"]["depth"] == 2
    assert got[1, "d"]["problems"] == "arguments are no object, unknown parent" and got[1, "d"]["message"] is None
    assert got[2, "q"]["depth"] is None and got[2, "q"]["problems"] == "cycle"
    assert chat_formatting.messages(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_license_lines(spark, documents, odd):
    wanted = {(d, n) for d, t in documents.select("doc_id", "text").collect() for n, line in enumerate((t or "").split("\n")) if line in set(licenses.TEMPLATES.values())}
    got = {(r["doc_id"], r["first_line"]) for r in licenses.scan(documents).where("license is not null and size(differences) = 0").collect()}
    assert got == wanted
    assert licenses.scan(odd).count() == 0
    changed = spark.createDataFrame([(1, "Intro.\nThis work is licensed under the GNU General Public License, version 4.\nEnd"), (2, "no licence to kill"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(changed).collect()}
    assert rows[1]["license"] in ("GPL-2.0", "GPL-3.0") and len(rows[1]["differences"]) == 1 and rows[1]["first_line"] == 1


def test_license_in_long_lines(spark):
    """A notice in a text without line breaks is found wherever it stands, also between many other licence words."""
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abdeghilnorstu"), n)) for n in rng.integers(2, 10, 4000)] + ["the", "of", "all", "this"] * 400
    rows, wanted = [], {}
    for size in (5_000, 20_000, 100_000):
        for k, (name, template) in enumerate(licenses.TEMPLATES.items()):
            prose = " ".join(rng.choice(plain, size // 6))
            cut = prose.index(" ", (k + 1) * len(prose) // 20)
            wanted[len(rows)] = name
            rows.append((len(rows), f"{prose[:cut]}. {template} Then{prose[cut:]}"))
    licence = "nobody asked for a license or a permission to cross the river at night " * 1500
    wanted[len(rows)] = "MPL-2.0"
    rows.append((len(rows), f"{licence}{licenses.TEMPLATES['MPL-2.0']} {licence}"))
    docs = spark.createDataFrame([*rows, (len(rows), licence)], "doc_id long, text string")
    got = licenses.scan(docs).collect()
    assert {r["doc_id"]: r["license"] for r in got if r["license"]} == wanted
    assert all(not r["differences"] for r in got) and [r["license"] for r in got if r["doc_id"] == len(rows)] == [None]


def test_all_licenses_of_a_block(spark):
    """Each of several notices is a row, in neighbouring lines, in one line and across the windows of a long one."""
    t = licenses.TEMPLATES
    rng, names = np.random.default_rng(5), sorted(t)
    many = [names[i] for i in rng.permutation(np.repeat(np.arange(len(names)), 20))]
    parts = [f"{t[n]} Then {' '.join(rng.choice(['river', 'bank', 'town', 'of'], 3 + 9 * (i % 5)))}." for i, n in enumerate(many)]
    changed = t["GPL-3.0"].replace("This work", "This small work")
    texts = [
        "Licensed under CC BY 4.0.\nReleased under the MIT License.", f"A tale. {t['MPL-2.0']} All rights reserved. The end.",
        f"{t['MIT']} {t['MIT']}\nCopyright nobody.", f"{t['LGPL-3.0']} {changed} {t['CC0-1.0']}", " ".join(parts), "A licence of their own.\nThe License",
    ]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["first_line"], r["last_line"], r["license"], len(r["differences"])))
    assert got[0] == [(0, 0, "CC-BY-4.0", 0), (1, 1, "MIT", 0)] and got[1] == [(0, 0, "MPL-2.0", 0), (0, 0, "All rights reserved", 0)]
    assert got[2] == [(0, 0, "MIT", 0)] * 2 and got[3] == [(0, 0, "LGPL-3.0", 0), (0, 0, "GPL-3.0", 1), (0, 0, "CC0-1.0", 0)]
    assert got[4] == [(0, 0, n, 0) for n in many] and got[5] == [(0, 1, None, 0)]


def test_byte_pairs_equal_library(spark, documents, odd):
    tokenizer = Tokenizer.from_file(tokenizer_path(BYTE))
    for docs in (documents, odd):
        encoded = byte_pairs.encode_documents(docs, tokenizer_path(BYTE))
        texts = collections.defaultdict(set)
        for d, t in docs.select("doc_id", "text").collect():
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            texts[d].add((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        rows = encoded.collect()
        assert len(rows) == docs.count()
        assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in texts[r["doc_id"]] for r in rows)
    back = byte_pairs.decode_documents(byte_pairs.encode_documents(documents, tokenizer_path(BYTE)), tokenizer_path(BYTE))
    assert back.join(documents.select("doc_id", F.col("text").alias("was")), "doc_id").where("text <> was").count() == 0
    assert byte_pairs.encode_documents(odd.limit(0), tokenizer_path(BYTE)).count() == 0


def test_token_files_equal_library(spark, documents, odd):
    tokenizer = Tokenizer.from_file(tokenizer_path(WORD))
    for docs in (documents, odd.where("doc_id is not null and doc_id <> 8")):
        path = token_files.write_tokens(docs, tokenizer_path(WORD), fresh_path(spark, "tokens"), file_bytes=50_000)
        start = 0
        rows = token_files.with_checksums(token_files.read_tokens(spark, path)).orderBy("doc_id").collect()
        for (d, t), r in zip(sorted(docs.select("doc_id", "text").collect()), rows, strict=True):
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            assert tuple(r) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    path = token_files.write_tokens(odd, tokenizer_path(WORD), fresh_path(spark, "tokens"))
    assert spark.read.orc(path).count() == odd.count()
    assert token_files.lookup(spark, path, [4, 99]).count() == 1
    empty = token_files.write_tokens(odd.limit(0), tokenizer_path(WORD), fresh_path(spark, "tokens"))
    assert token_files.read_tokens(spark, empty).count() == 0


def test_near_duplicates_odd_rows(spark, odd):
    rows = [tuple(r)[:4] for r in near_duplicates.near_duplicates(odd, words=2).collect()]
    by = {r[0]: r for r in rows}
    assert len(rows) == odd.count()
    assert by[1] == (1, 0, 1, True) and by[2] == (2, 0, 2, True) and by[9][2:] == (8, False) and by[6][2:] == (5, False)
    assert by[None][2:] == (None, True) and by[4] == (4, 1, 4, True)
    assert near_duplicates.near_duplicates(odd.limit(0)).count() == 0
    kept = near_duplicates.keep_one(odd)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 7, 8, 10, 11]


def test_near_duplicates_of_a_crowd(spark, monkeypatch):
    """Copies with many edits share buckets although most pairs are not similar enough; cells must still be exact."""
    monkeypatch.setattr(near_duplicates, "SMALL", 4)
    monkeypatch.setattr(near_duplicates, "CELL", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for d in range(160):
        words = list(base)
        for p in rng.choice(120, rng.integers(0, 16), replace=False):
            words[p] = f"e{d}x{p}" if rng.random() < 0.7 else f"common{p}"
        rows[d] = " ".join(words)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df, words=2).collect()}
    assert got == brute_components(rows, 2)


def test_similar_pairs_equal_brute_force():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(40)]
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))
    for split in (40, 15):
        want = {(i, j) for i in range(split) for j in range(max(i + 1, 0 if split == 40 else split), 40) if similar(sets[i], sets[j])}
        assert set(zip(*(x.tolist() for x in near_duplicates.similar_pairs(sets, split, 60)))) == want


def test_bayesian_bounds():
    least = near_duplicates.least_matches(0.8, 1e-6, 125)
    tail = lambda n, m: sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
    assert all(tail(n, int(least[n])) >= 1e-6 and (least[n] == 0 or tail(n, int(least[n]) - 1) < 1e-6) for n in (25, 50, 125))


def test_quality_held_out(spark, odd):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.assess(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    scored = quality.assess(odd, labels.limit(0)).collect()
    assert len(scored) == odd.count() and all(r["score"] == 0.5 for r in scored)
    assert all(0 <= r["score"] <= 1 for r in quality.assess(odd.unionByName(docs, True), labels).where("doc_id < 12").collect())
    assert quality.assess(odd.limit(0), labels).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(0)
    bags, y = np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    x, importance = rng.normal(size=(9, 5)), np.array([1.0, 2.0, 0.5])
    w = {"encode": rng.normal(size=(5, 4)), "encode_b": rng.normal(size=4), "value": rng.normal(size=(4, 3)), "gate": rng.normal(size=(4, 3)), "attend": rng.normal(size=3), "out": rng.normal(size=4), "out_b": 0.1}

    def loss():
        p = quality._forward(w, x, bags)[0]
        return -(importance * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / importance.sum()

    g = quality._gradients(w, x, bags, y, importance)
    for name in ("encode", "value", "gate", "attend", "out"):
        at = (0,) * w[name].ndim
        w[name][at] += 1e-6
        up = loss()
        w[name][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[name][at]) < 1e-5
        w[name][at] += 1e-6


@pytest.mark.parametrize("empty", [False, True])
def test_sharding_law(spark, documents, odd, empty):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs = docs.limit(0) if empty else docs
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    if not empty:
        sizes = [len(slots[s]) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
        plain = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs.collect())
        assert plain == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)


def test_sharding_cuts_few_links(spark, documents):
    docs = documents.select("doc_id", "text")
    found = sharding.cut_links(sharding.shard(docs), docs).first()
    dealt = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(24)).cast("int").alias("shard"))
    plain = sharding.cut_links(dealt, docs).first()
    assert found["lines"] == plain["lines"] > 0 and found["links"] == plain["links"]
    assert found["cut"] < 0.6 * plain["cut"] and found["held"] > plain["held"]
    # A text with more copies than a shard holds is split, and the law still holds.
    heavy = spark.createDataFrame([(i, "same\nlines") for i in range(40)] + [(100 + i, f"own {i}") for i in range(32)], "doc_id long, text string")
    sizes = collections.Counter(r["shard"] for r in sharding.shard(heavy).collect())
    assert [sizes[s] for s in range(24)] == [3] * 24


def test_languages_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = languages.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    got = {r["doc_id"]: r for r in languages.identify(odd).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 and got[d]["rejected"] for d in (1, 2, 3, 10))
    assert got[4]["lang_pred"] in ("en", "fr") and languages.identify(odd.limit(0)).count() == 0


@pytest.mark.parametrize("left_out", [None, "de", "en"])
def test_languages_reject_noise_and_unlearned(spark, left_out):
    """Random letters of any script and length and a language left out of learning are rejected, held-out good rows stay."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = languages.fit(languages.learning_rows(docs).where(F.col("lang") != (left_out or "")))
    rng, scripts = np.random.default_rng(6), ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x4E00, 0x5600)))]
    noise = [" ".join("".join(rng.choice(list(s), rng.integers(2, 10))) for _ in range(n)) for s in scripts for n in (10, 30, 100, 1000, 10_000)]
    noise = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    assert languages.predict(noise, model).where("not rejected").count() == 0
    assert languages._keep(noise, model).count() == 0
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    rows = languages.predict(docs, model).join(docs.select("doc_id", "lang", (languages.fold_of(F.col("doc_id"), 5) == 0).alias("held_out")), "doc_id")
    if left_out:
        assert rows.where(F.col("lang") == left_out).agg(F.avg(F.col("rejected").cast("int"))).first()[0] > 0.95
    kept = rows.where((F.col("lang") != (left_out or "")) & F.col("held_out")).join(good, "doc_id")
    assert kept.agg(F.avg((~F.col("rejected")).cast("int"))).first()[0] > 0.95


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    """Deduplication, decontamination and encoding of what the classifiers kept, against brute force."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, FOLDER)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").collect()}
    first = {d for d, c in brute_components(texts, 5).items() if d == c}
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {d for d in first if not any(i in flat(texts[d]) for i in items)}
    tokenizer = Tokenizer.from_file(tokenizer_path(BYTE))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {d: tokenizer.encode(texts[d], add_special_tokens=False).ids for d in clean}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert np.mean([labels[d] == 1 for d in texts if d in labels]) > 0.95
