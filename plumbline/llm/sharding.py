"""Balanced label propagation: documents to shards of equal counts, few links cut.

Vertices are the distinct texts, weighted by their number of documents; two texts are linked by every line that both
hold. The links are kept as text-line pairs, never as pairs of texts. Texts that have their rarest shared line in common
start in one shard. In every round each line takes the shard that weighs most among its texts and votes for it with the
weight that lies there (with a share of it below 1 if no shard can hold all its texts), each text wants the shard with most votes of its lines, and moves from shard to
shard are admitted by hash with the probability that keeps every shard within its quota: balanced exchanges plus free
room. The rounds end when the lines' agreement rises by less than GAIN, and the labels with the highest agreement count. At
the end every shard keeps as many documents as its exact share, texts with most copies first, and what is beyond fills
the free places of the others, so that the counts differ by one at most. A text with more copies than a shard holds is
split.

Only a table of shards squared and the agreement reach the driver.

Defined results: NULL text is empty, of size 8; all empty texts are one group without lines. Rows without doc_id are
placed like others. Repeated rows are rows of their own. Ties go to the smaller shard, then the smaller id. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import positions
from ..session import cut

SHARDS = 24
#: Rounds at most, and the rise of the agreement (relative) below which they end.
ROUNDS, GAIN = 16, 0.005
#: Units of a vote.
FULL = 1000
#: Share of the mean by which a shard may exceed it between rounds.
SLACK = 0.02


def _favoured(vertices: DataFrame, links: DataFrame, quota: float) -> DataFrame:
    """(line, line_label, vote): each line's best shard, and the weight of its texts there: the links that a text gains by
    joining them. A line heavier than a shard is cut wherever its texts lie, so it only breaks ties."""
    favour = links.join(vertices, "vertex").groupBy("line", "label").agg(F.sum("weight").alias("w"))
    # A text's own weight counts too, so a pair of texts agrees on the smaller shard.
    lines = favour.groupBy("line").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("best"), F.sum("w").alias("all"))
    vote = F.when(F.col("all") <= quota, F.col("best.w") * FULL).otherwise(F.floor(F.col("best.w") * FULL / F.col("all"))).cast("long")
    return lines.select("line", (-F.col("best.l")).alias("line_label"), vote.alias("vote"))


def _move(vertices: DataFrame, links: DataFrame, lines: DataFrame, shards: int, turn: int, total: int) -> DataFrame:
    """One round: the vertices (vertex, weight, label) with new labels."""
    wants = links.join(lines, "line").groupBy("vertex", "line_label").agg(F.sum("vote").alias("votes"))
    wants = wants.groupBy("vertex").agg(F.max(F.struct("votes", (-F.col("line_label")).alias("l"))).alias("best"))
    wants = wants.select("vertex", (-F.col("best.l")).cast("int").alias("wanted"))
    wishes = cut(vertices.join(wants, "vertex", "left").withColumn("wanted", F.coalesce("wanted", "label")))
    flows = {(r["label"], r["wanted"]): r["w"] for r in wishes.groupBy("label", "wanted").agg(F.sum("weight").alias("w")).collect()}
    size = [sum(w for (a, _), w in flows.items() if a == s) for s in range(shards)]
    quota = total / shards * (1 + SLACK)
    chance = []
    for a in range(shards):
        for b in range(shards):
            asked = flows.get((a, b), 0)
            if a == b or not asked:
                continue
            coming = sum(flows.get((x, b), 0) for x in range(shards) if x != b)
            room = max(0.0, quota - size[b]) * asked / coming
            chance.append((a, b, min(1.0, (min(asked, flows.get((b, a), 0)) + room) / asked)))
    if not chance:
        return vertices
    table = F.create_map(*[x for a, b, p in chance for x in (F.lit(a * shards + b), F.lit(p))])
    draw = F.pmod(F.xxhash64("vertex", F.lit(turn)), F.lit(1 << 30)) / (1 << 30)
    go = draw < F.coalesce(table[F.col("label") * shards + F.col("wanted")], F.lit(0.0))
    return cut(wishes.select("vertex", "weight", F.when(go, F.col("wanted")).otherwise(F.col("label")).alias("label")))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, label): label is the shard that propagation gave the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("vertex"),
        F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda l: F.length(l) > 0), lambda l: F.xxhash64(l))).alias("lines"),
    )
    rows = cut(rows)
    vertices = rows.groupBy("vertex").agg(F.count(F.lit(1)).alias("weight"))
    total = rows.count()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("label"))
    # A copy brings the same lines, so one row of each text is enough; lines of a single text link nothing.
    links = rows.select("vertex", F.explode("lines").alias("line")).distinct()
    shared = links.groupBy("line").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    links = cut(links.join(shared, "line"))
    rarest = links.groupBy("vertex").agg(F.min(F.struct("c", "line"))["line"].alias("_first"))
    links = links.select("vertex", "line")
    start = F.pmod(F.xxhash64(F.coalesce("_first", "vertex"), F.lit(-1)), F.lit(shards)).cast("int")
    vertices = cut(vertices.join(rarest, "vertex", "left").select("vertex", "weight", start.alias("label")))
    best, agreement = vertices, -1
    for turn in range(rounds + 1):
        lines = cut(_favoured(vertices, links, total / shards))
        reached = lines.agg(F.coalesce(F.sum("vote"), F.lit(0))).first()[0]
        rises = reached > agreement * (1 + GAIN)
        if reached > agreement:
            best, agreement = vertices, reached
        if not rises or turn == rounds:
            break
        vertices = _move(vertices, links, lines, shards, turn, total)
    vertices = best
    placed = rows.drop("lines").join(vertices, "vertex")
    # Texts with many copies come first in their shard, so what has to leave a full shard are mostly single texts.
    order = [F.col("weight").desc(), F.col("vertex").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc()]
    ordered = positions(placed, ["label"], order, "place")
    found = {r["label"]: r["c"] for r in placed.groupBy("label").agg(F.count(F.lit(1)).alias("c")).collect()}
    goal = [((s + 1) * total) // shards - (s * total) // shards for s in range(shards)]
    surplus = [max(0, found.get(s, 0) - goal[s]) for s in range(shards)]
    room = [max(0, goal[s] - found.get(s, 0)) for s in range(shards)]
    before = lambda values, s: sum(values[:s])
    listed = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    # The documents beyond a shard's count, in one row over all shards, fill the free places in order.
    extra = F.col("place") - 1 - listed(goal)[F.col("label")]
    nth = extra + listed([before(surplus, s) for s in range(shards)])[F.col("label")]
    ends = [before(room, s + 1) for s in range(shards)]
    goes = F.size(F.filter(listed(ends), lambda e: e <= F.col("nth")))
    out = ordered.withColumn("extra", extra).withColumn("nth", F.when(extra >= 0, nth))
    out = out.withColumn("shard", F.when(F.col("nth").isNull(), F.col("label")).otherwise(goes).cast("int"))
    free = listed([found.get(s, 0) - before(room, s) for s in range(shards)])[F.col("shard")]
    slot = F.when(F.col("nth").isNull(), F.col("place") - 1).otherwise(F.col("nth") + free)
    return out.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "label")


def cut_links(sharded: DataFrame, docs: DataFrame) -> DataFrame:
    """(lines, held, links, cut): lines that several documents share, those within one shard, (document, line) pairs of the
    shared lines, and how many of them lie outside the line's largest shard."""
    lines = F.split(F.coalesce(docs["text"].cast("string"), F.lit("")), "\n")
    pairs = docs.select("doc_id", F.explode(F.array_distinct(F.filter(lines, lambda l: F.length(l) > 0))).alias("line"))
    pairs = pairs.select("doc_id", F.xxhash64("line").alias("line")).join(sharded.select("doc_id", "shard"), "doc_id")
    parts = pairs.groupBy("line", "shard").agg(F.count(F.lit(1)).alias("n"))
    spread = parts.groupBy("line").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return spread.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("n") == F.col("most")).alias("held"),
        count("n").alias("links"), count(F.col("n") - F.col("most")).alias("cut"),
    )
