"""The operators on the given tables, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources.tables import load
from . import (
    byte_pairs, chat_formatting, decontamination, inner_products, languages, lexical_search, licenses, near_duplicates, quality, sharding,
    spelling, token_files, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is: a folder named by PUBLIC_TOKENIZERS, else the installed package."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query(
    "op1_inner_products",
    """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_products(load(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


#: Tools of the derived calls: name, field, type, required.
TOOLS = [
    ("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "exact", "boolean", False),
    ("lookup", "query", "string", True), ("lookup", "limit", "integer", False), ("lookup", "exact", "boolean", True),
    ("note", "query", "string", True), ("note", "limit", "number", False),
]


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls from assistant turns and results from user turns, with problems planted by conversation and turn."""
    c = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    call_id = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    turn, conv = F.col("turn"), F.col("conv_id")
    name = F.when((conv + turn) % 41 == 0, F.lit("erase")).otherwise(
        F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("note")), (turn % 3 + 1).cast("int"))
    )
    exact = F.when(turn % 3 != 2, conv % 2 == 0)
    arguments = F.to_json(
        F.struct(
            F.when(conv % 13 != 5, F.col("text")).alias("query"), F.when(conv % 17 != 3, turn).alias("limit"),
            exact.alias("exact"), F.when(conv % 17 == 3, F.lit("many")).alias("more"),
        )
    )
    broken = F.when((conv * 7 + turn) % 29 == 0, F.concat(F.lit("{"), arguments)).otherwise(arguments)
    parent = F.when(turn >= 2, call_id(turn - 2)).when(conv % 19 == 2, call_id(turn + 2))
    calls = c.where("role = 'assistant'").select(
        "conv_id", call_id(turn).alias("call_id"), "turn", name.alias("name"), broken.alias("arguments"), parent.alias("parent_id")
    )
    results = c.where("role = 'user'").select("conv_id", call_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


@query(
    "op3_chat_formatting",
    """
    WITH RECURSIVE c AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
    ), calls AS (
        SELECT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id,
               CASE WHEN (conv_id + turn) % 41 = 0 THEN 'erase' ELSE ['search', 'lookup', 'note'][turn % 3 + 1] END AS name,
               CASE WHEN turn >= 2 THEN 'call_' || conv_id || '_' || (turn - 2)
                    WHEN conv_id % 19 = 2 THEN 'call_' || conv_id || '_' || (turn + 2) END AS parent_id,
               CASE WHEN turn % 3 <> 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END END AS exact_,
               min(text) AS text, count(*) - 1 AS repeats
        FROM c WHERE role = 'assistant' GROUP BY ALL
    ), results AS (
        SELECT 'call_' || conv_id || '_' || (turn - 1) AS call_id, turn AS result_turn, min(text) AS content, count(*) - 1 AS extra_results
        FROM c WHERE role = 'user' GROUP BY ALL
    ), args AS (
        SELECT *, (conv_id * 7 + turn) % 29 = 0 AS broken,
               '{' || concat_ws(',', '"exact":' || exact_, CASE WHEN conv_id % 17 <> 3 THEN '"limit":' || turn END,
                    CASE WHEN conv_id % 17 = 3 THEN '"more":"many"' END,
                    CASE WHEN conv_id % 13 <> 5 THEN '"query":' || CAST(to_json(text) AS VARCHAR) END) || '}' AS arguments
        FROM calls
    ), tree AS (
        SELECT a.*, p.call_id IS NOT NULL AS has_parent FROM args a LEFT JOIN calls p ON a.parent_id = p.call_id
    ), walk AS (
        SELECT call_id, 0 AS depth FROM tree WHERE NOT has_parent
        UNION ALL
        SELECT t.call_id, w.depth + 1 FROM tree t JOIN walk w ON t.parent_id = w.call_id
    ), checked AS (
        SELECT t.*, w.depth, r.result_turn, r.content, r.call_id IS NOT NULL AS linked, coalesce(r.extra_results, 0) AS extra_results,
               CASE WHEN broken THEN ['arguments are no object'] WHEN name = 'erase' THEN ['unknown tool'] ELSE list_sort(list_filter([
                    CASE WHEN conv_id % 13 = 5 THEN 'missing query' END,
                    CASE WHEN conv_id % 17 = 3 AND name = 'search' THEN 'missing limit' END,
                    CASE WHEN conv_id % 17 = 3 THEN 'unknown more' END,
                    CASE WHEN exact_ IS NULL AND name = 'lookup' THEN 'missing exact' END,
                    CASE WHEN exact_ IS NOT NULL AND name = 'note' THEN 'unknown exact' END], lambda x: x IS NOT NULL)) END
               || CASE WHEN t.parent_id IS NOT NULL AND NOT has_parent THEN ['unknown parent'] ELSE [] END
               || CASE WHEN w.depth IS NULL THEN ['cycle'] ELSE [] END AS problems
        FROM tree t LEFT JOIN walk w USING (call_id) LEFT JOIN results r USING (call_id)
    )
    SELECT conv_id, call_id, turn, name, CAST(depth AS BIGINT) AS depth, linked, result_turn, CAST(extra_results AS BIGINT) AS extra_results,
           CAST(repeats AS BIGINT) AS repeats, len(problems) = 0 AS valid, array_to_string(problems, ', ') AS problems,
           CASE WHEN NOT broken THEN '{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '"'
                || CASE WHEN linked THEN ',"result":' || CAST(to_json(content) AS VARCHAR) ELSE '' END || '}' END AS message,
           row_number() OVER (PARTITION BY conv_id ORDER BY depth NULLS LAST, turn, call_id) - 1 AS place
    FROM checked
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = derived_calls(load(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(TOOLS, "name string, field string, type string, required boolean")
    return chat_formatting.messages(calls, results, schemas)


@query("op4_license_scans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


@query("op5_byte_pairs")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_pairs.encode_documents(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), fresh_path(spark, "tokens"))
    return token_files.with_checksums(token_files.read_tokens(spark, path))


@query(
    "op7_near_duplicates",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
            ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
        FROM w
    ), sizes AS (
        SELECT doc_id, len(s) AS n FROM sets
    ), shingles AS (
        SELECT doc_id, unnest(s) AS g FROM sets
    ), common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)
    ), both_ways AS (
        SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reach AS (
        SELECT doc_id AS a, doc_id AS r FROM sizes
        UNION
        SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON reach.a = both_ways.a
    ), roots AS (
        SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY ALL
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN roots USING (doc_id)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(load(spark, sf_dir, "documents"), words=2, threshold=0.8)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(load(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op10_languages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(load(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query(
    "op11_spelling_variants",
    r"""
    WITH RECURSIVE crc_table AS (
        SELECT list(list_reduce(list_concat([i], range(8)),
            lambda x, k: CASE WHEN x % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), x >> 1) ELSE x >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)
    ), runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
    ), long_runs AS (
        SELECT id, run, count(*) AS times, hex(encode(id || run)) AS bytes FROM runs WHERE length(run) >= 7 GROUP BY ALL
    ), hashed AS (
        SELECT run, times, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(bytes) + 1, 2),
            lambda i: 16 * (instr('0123456789ABCDEF', substring(bytes, i, 1)) - 1) + instr('0123456789ABCDEF', substring(bytes, i + 1, 1)) - 1)),
            lambda s, b: xor(s >> 8, crc[CAST(xor(s, b) & 255 AS INTEGER) + 1])), 4294967295) AS h
        FROM long_runs, crc_table
    ), slipped AS (
        SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2)
            ELSE run END AS word, times FROM hashed
    ), words AS (
        SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
    ), less AS (
        SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
    ), pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION
        SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
        UNION
        SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs
    ), judged AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
        FROM words w LEFT JOIN best b ON w.word = b.word AND b.place = 1
    ), walk AS (
        SELECT word, word AS root, 0 AS depth FROM judged
        UNION ALL
        SELECT walk.word, j.form, depth + 1 FROM walk JOIN judged j ON j.word = walk.root WHERE j.form IS NOT NULL
    ), ends AS (
        SELECT word, arg_max(root, depth) AS root FROM walk GROUP BY word
    )
    SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"))


@query(
    "op12_lexical_search",
    r"""
    WITH docs AS (
        SELECT doc_id, row_number() OVER () AS row, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
            lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents WHERE text IS NOT NULL
    ), items AS (
        SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
            lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
        FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id)
    ), asked AS (
        SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL
    ), totals AS (
        SELECT count(*) AS total, CAST(sum(len(terms)) AS BIGINT) AS length FROM docs WHERE len(terms) > 0
    ), counted AS (
        SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, totals GROUP BY term, total
    ), impacts AS (
        SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // length))) AS value
        FROM counted JOIN weights USING (term), totals
    ), scored AS (
        SELECT item_id, row, doc_id, CAST(sum(times * value) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
