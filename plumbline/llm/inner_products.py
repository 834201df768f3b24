"""Exact top-k by inner product: vectors in descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

The eigenvectors of the vectors' Gram matrix (the right singular vectors) rotate all vectors, so that the first
coordinates carry most of every product. Candidates are dealt to groups of descending length. The group of the longest
vectors is searched first and gives every query a lower bound for its k-th best score. Every other group is searched
in blocks of descending length: the product over the leading coordinates plus the product of the residual lengths
bounds the score from above (Cauchy-Schwarz); only pairs whose bound reaches the query's current k-th score get their
full product, in whole numbers. A block whose length bound is below all queries' k-th scores ends the group.

Queries and candidates meet in cells of a query group and a candidate group, both of bounded size.

Defined results: a NULL vector, or one with NULL or non-finite components, takes no part, nor does a row without id. A
shorter vector counts as padded with zeros. Rows equal in id and vector count once; a query never meets rows of its own
id. Ties go to the smaller id. Fewer than k candidates are all returned; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a candidate group and of a query group, and of a block inside a candidate group.
CANDIDATES, QUERIES, BLOCK = 16_384, 2_048, 2_048
#: Share of the coordinates in the first partial sum.
LEADING = 0.25


def whole_vectors(rows: DataFrame, vector_id: str, vector: str, scale: int) -> DataFrame:
    """(id long, v array<long>): floor(scale * component) of every complete finite vector, distinct."""
    x = F.transform(rows[vector], lambda c: c.cast("double"))
    ok = rows[vector].isNotNull() & rows[vector_id].isNotNull() & F.forall(
        x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    )
    picked = rows.where(ok).select(rows[vector_id].cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return picked.distinct()


def _matrix(column, width: int) -> np.ndarray:
    """Rows of whole numbers as doubles (exact below 2**53), padded with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten(), dtype=np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first; the Gram matrix is summed by Spark."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "value"])

    summed = vectors.select("v").mapInArrow(gram, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(width * width)
    for row in summed.collect():  # width squared rows, whatever the number of vectors
        out[row["cell"]] = row["value"]
    return np.linalg.eigh(out.reshape(width, width))[1][:, ::-1]


def search_cell(ids, ints, candidate_ids, candidates, turn: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query row, candidate id, score) of the best k candidates of each query in one cell.

    ``floor`` holds a score for each query that k candidates are known to reach; lower ones are left out.
    """
    length = np.sqrt((candidates**2).sum(1))
    order = np.argsort(-length, kind="stable")
    candidate_ids, candidates, length = candidate_ids[order], candidates[order], length[order]
    lead = max(1, int(np.ceil(turn.shape[1] * LEADING)))
    q = ints @ turn
    q_head, q_rest, q_length = q[:, :lead], np.sqrt((q[:, lead:] ** 2).sum(1)), np.sqrt((ints**2).sum(1))
    best_score = np.full((len(ids), k), -np.inf)
    best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
    for start in range(0, len(candidates), BLOCK):
        reach = np.maximum(floor, best_score[:, -1])
        slack = 1e-6 * (1 + q_length * length[start])
        open_queries = np.flatnonzero(q_length * length[start] + slack >= reach)
        if not len(open_queries):
            break
        block, own = candidates[start : start + BLOCK], candidate_ids[start : start + BLOCK]
        rotated = block @ turn
        rest = np.sqrt((rotated[:, lead:] ** 2).sum(1))
        bound = q_head[open_queries] @ rotated[:, :lead].T + np.outer(q_rest[open_queries], rest)
        row, col = np.nonzero(bound + slack[open_queries, None] >= reach[open_queries, None])
        row = open_queries[row]
        apart = ids[row] != own[col]
        row, col = row[apart], col[apart]
        if len(row) * 4 > len(open_queries) * len(block):
            score = (ints[open_queries] @ block.T)[np.searchsorted(open_queries, row), col]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", ints[row[i : i + 65536]], block[col[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.empty(0)])
        hit = score >= reach[row]
        row, col, score = row[hit], col[hit], score[hit]
        rows = np.unique(row)
        all_row = np.concatenate([np.repeat(rows, k), row])
        all_score = np.concatenate([best_score[rows].ravel(), score])
        all_id = np.concatenate([best_id[rows].ravel(), own[col]])
        by = np.lexsort((all_id, -all_score, all_row))
        all_row, all_score, all_id = all_row[by], all_score[by], all_id[by]
        rank = np.arange(len(all_row)) - np.searchsorted(all_row, all_row)
        keep = rank < k
        best_score[all_row[keep], rank[keep]] = all_score[keep]
        best_id[all_row[keep], rank[keep]] = all_id[keep]
    row, at = np.nonzero(np.isfinite(best_score))
    return row, best_id[row, at], best_score[row, at]


def top_products(rows: DataFrame, is_query: Column, k: int = 5, vector_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which ``is_query`` (on ``id``) holds."""
    spark = rows.sparkSession
    vectors = cut(whole_vectors(rows, vector_id, vector, scale))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.sum(is_query.cast("int")).alias("q")).first()
    n, width, asked = size["n"], max(1, size["width"] or 1), size["q"] or 0
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(vectors, width)
    squares = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    groups, query_groups = -(-n // CANDIDATES), -(-asked // QUERIES)
    # Ranges of descending length; equal lengths are split by id, so no group grows with them.
    dealt = vectors.withColumn("length", squares).repartitionByRange(groups, F.col("length").desc(), F.col("id"))
    candidates = cut(dealt.select("id", "v", F.spark_partition_id().alias("c")))
    queries = cut(vectors.where(is_query).withColumn("g", F.pmod(F.xxhash64("id"), F.lit(query_groups)).cast("int")))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        x, y = (_matrix(t["v"].combine_chunks(), width) for t in (left, right))
        floor = np.asarray(left["floor"].to_numpy(zero_copy_only=False), float)
        row, found, score = search_cell(ids, x, other, y, turn, k, floor)
        return pa.table({"query_id": ids[row], "vec_id": found, "score": score.astype(np.int64)})

    def search(asked: DataFrame, first: int, last: int) -> DataFrame:
        """All queries against the candidate groups first..last."""
        left = asked.withColumn("c", F.explode(F.sequence(F.lit(first), F.lit(last))))
        right = candidates.where(F.col("c").between(first, last)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
        cells = left.select("id", "v", "floor", "g", "c").groupBy("g", "c").cogroup(right.select("id", "v", "g", "c").groupBy("g", "c"))
        return cells.applyInArrow(cell, "query_id long, vec_id long, score long")

    found = cut(search(queries.withColumn("floor", F.lit(float("-inf"))), 0, 0))
    if groups > 1:
        reached = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("s")).where(F.col("n") >= k)
        bounded = queries.join(reached, F.col("id") == F.col("query_id"), "left")
        floors = bounded.select("id", "v", "g", F.coalesce("s", F.lit(float("-inf"))).alias("floor"))
        found = found.unionByName(search(floors, 1, groups - 1))
    # Rows of one id with several vectors may bring an id more than once; each is a candidate of its own.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
