"""The relational workload: what a shop and a blog ask of their tables.

Bindings: product = part, category = brand (or market segment), order = orders, item = lineitem,
customer/author = customer, post = orders (published when its status is 'F'), tag = supplier
(a post has a tag when one of its items comes from that supplier), comment/review = lineitem.
"Now" is the newest timestamp in the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import csv_field, slugify
from ..session import cut
from ..sources.tables import Tables
from .registry import query

#: Default and largest page size.
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100


def page_size(requested: int | None = None) -> int:
    """A page size between 1 and MAX_PAGE_SIZE."""
    return min(max(requested or DEFAULT_PAGE_SIZE, 1), MAX_PAGE_SIZE)


def page_offset(page: int | None = None, size: int = DEFAULT_PAGE_SIZE) -> int:
    return (max(page or 1, 1) - 1) * size


def after_cursor(df: DataFrame, newest: str, key: str, cursor: Column) -> DataFrame:
    """Rows after the cursor row in (newest descending, key descending) order."""
    return df.where(F.struct(newest, key) < cursor)


def money(value: Column | str) -> Column:
    return F.round(F.sum(value), 2)


@query(
    "q01_orders_by_status_page",
    """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
              (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total
       FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40""",
)
def q01(t: Tables, status: str = "P", page: int = 3, size: int = 20) -> DataFrame:
    rows = t.orders.where(F.col("o_orderstatus") == status)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return (
        rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .orderBy("o_orderdate", "o_orderkey").offset(page_offset(page, size)).limit(page_size(size))
        .withColumn("total", total)
    )


@query(
    "q02_keyset_page",
    """WITH cur AS (SELECT o_orderdate AS d, o_orderkey AS k FROM orders
                    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 50),
       page AS (SELECT o.o_orderkey, o.o_orderdate, o.o_totalprice,
                       row_number() OVER (ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn
                FROM orders o, cur WHERE (o.o_orderdate, o.o_orderkey) < (cur.d, cur.k)
                ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 21)
       SELECT o_orderkey, o_orderdate, o_totalprice,
              CASE WHEN (SELECT count(*) FROM page) > 20
                   THEN (SELECT o_orderkey FROM page WHERE rn = 20) END AS next_cursor
       FROM page WHERE rn <= 20""",
)
def q02(t: Tables, start: int = 50, size: int = 20) -> DataFrame:
    newest = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    cursor = orders.orderBy(*newest).offset(start).limit(1)
    cursor = cursor.select(F.struct("o_orderdate", "o_orderkey")).scalar()
    page = after_cursor(orders, "o_orderdate", "o_orderkey", cursor).orderBy(*newest).limit(size + 1)
    ranked = page.withColumn("rn", F.row_number().over(Window.orderBy(*newest)))
    whole = Window.partitionBy()
    following = F.when(
        F.count(F.lit(1)).over(whole) > size,
        F.max(F.when(F.col("rn") == size, F.col("o_orderkey"))).over(whole),
    )
    return ranked.withColumn("next_cursor", following).where(F.col("rn") <= size).drop("rn")


@query(
    "q04_low_stock",
    """SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size <= 5
       ORDER BY p_size, p_name, p_partkey LIMIT 100""",
)
def q04(t: Tables, threshold: int = 5) -> DataFrame:
    return (
        t.part.where(F.col("p_size") <= threshold).select("p_partkey", "p_name", "p_brand", "p_size")
        .orderBy("p_size", "p_name", "p_partkey").limit(MAX_PAGE_SIZE)
    )


@query(
    "q05_recent_days",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders
       WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY""",
)
def q05(t: Tables, days: int = 30) -> DataFrame:
    newest = t.orders.agg(F.max("o_orderdate")).scalar()
    since = newest - F.expr(f"INTERVAL {days} DAYS")
    return t.orders.where(F.col("o_orderdate") >= since).select("o_orderkey", "o_custkey", "o_orderdate")


def search(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows whose columns contain the trimmed text, ignoring case; nothing for under 3 letters."""
    wanted = text.strip().lower()
    if len(wanted) < 3:
        return df.limit(0)
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.col(c)).contains(wanted)
    return df.where(found)


@query(
    "q06_search",
    """SELECT p_partkey, p_name, p_retailprice FROM part
       WHERE contains(lower(p_name), 'wid') OR contains(lower(p_type), 'wid')
       ORDER BY p_name, p_partkey LIMIT 50""",
)
def q06(t: Tables, text: str = " Wid ") -> DataFrame:
    found = search(t.part, ["p_name", "p_type"], text)
    return found.select("p_partkey", "p_name", "p_retailprice").orderBy("p_name", "p_partkey").limit(50)


@query(
    "q06_document_search",
    """SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'oredat')""",
)
def q06_documents(t: Tables, text: str = "Oredat") -> DataFrame:
    return search(t.documents, ["text"], text).select("doc_id", "lang")


@query(
    "q07_recent_orders_with_customer",
    """SELECT o_orderkey, o_orderdate, o_totalprice, c_name, c_mktsegment
       FROM orders JOIN customer ON c_custkey = o_custkey
       ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
)
def q07(t: Tables) -> DataFrame:
    # Every order has a customer, so the 50 orders are known before the join.
    latest = t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    joined = latest.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("o_orderkey", "o_orderdate", "o_totalprice", "c_name", "c_mktsegment")


@query(
    "q08_order_with_items",
    """SELECT o_orderkey, any_value(c_name) AS c_name, count(*) AS items,
              list(l_linenumber || ':' || p_name || ':' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
                   ORDER BY l_linenumber, p_name, CAST(l_quantity AS BIGINT)) AS lines
       FROM orders JOIN customer ON c_custkey = o_custkey
       JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
       WHERE o_orderstatus = 'P' GROUP BY o_orderkey""",
)
def q08(t: Tables, status: str = "P") -> DataFrame:
    """Orders with their customer and an array of items. Only items of the listed orders meet the products."""
    orders = t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey")
    named = orders.join(t.customer.select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    items = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity"))
    bought = named.join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    products = t.part.select("p_partkey", "p_name")
    listed = bought.join(products, F.col("p_partkey") == F.col("l_partkey")).groupBy("o_orderkey").agg(
        F.any_value("c_name").alias("c_name"),
        F.count(F.lit(1)).alias("items"),
        F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name", "quantity"))).alias("lines"),
    )
    text = lambda x: F.concat_ws(":", x["l_linenumber"], x["p_name"], x["quantity"])
    return listed.withColumn("lines", F.transform("lines", text))


@query(
    "q09_invoice_lines",
    """SELECT l_orderkey, l_linenumber, coalesce(p_name, '(discontinued)') AS product,
              l_quantity, p_retailprice, round(l_quantity * p_retailprice, 2) AS amount
       FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_brand <> 'Brand#7') p ON p_partkey = l_partkey""",
)
def q09(t: Tables, withdrawn: str = "Brand#7") -> DataFrame:
    """Line amounts; a product that no longer exists keeps its line under a fallback name."""
    products = t.part.where(F.col("p_brand") != withdrawn)
    return t.lineitem.join(products, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("(discontinued)")).alias("product"),
        "l_quantity", "p_retailprice",
        F.round(F.col("l_quantity") * F.col("p_retailprice"), 2).alias("amount"),
    )


def child_count(parent: DataFrame, key: str, child: DataFrame, child_key: str, name: str, **extra: Column) -> DataFrame:
    """Parents with the number of their children, zero included. Children are counted first."""
    counted = child.groupBy(F.col(child_key).alias(key)).agg(
        F.count(F.lit(1)).alias(name), *[c.alias(n) for n, c in extra.items()]
    )
    return parent.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


@query(
    "q10_customers_with_order_count",
    """SELECT c_custkey, c_name, count(o_orderkey) AS orders
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
)
def q10(t: Tables) -> DataFrame:
    return child_count(t.customer.select("c_custkey", "c_name"), "c_custkey", t.orders, "o_custkey", "orders")


@query(
    "q11_published_posts_per_author",
    """SELECT c_custkey, c_name, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS published
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
)
def q11(t: Tables, status: str = "F") -> DataFrame:
    published = t.orders.where(F.col("o_orderstatus") == status)
    return child_count(t.customer.select("c_custkey", "c_name"), "c_custkey", published, "o_custkey", "published")


@query(
    "q12_newest_per_category",
    """SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_orderdate,
                row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
              FROM orders) WHERE place <= 4""",
)
def q12(t: Tables, k: int = 4) -> DataFrame:
    """The newest k per category; each task keeps its own top k before the shuffle."""
    newest = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    ranked = t.orders.select("o_orderpriority", "o_orderkey", "o_orderdate")
    return ranked.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= k)


@query(
    "q13_price_range_per_category",
    """SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, count(*) AS products
       FROM part GROUP BY p_brand""",
)
def q13(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(
        F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"),
        F.count(F.lit(1)).alias("products"),
    )


@query(
    "q14_average_rating_per_category",
    """SELECT p_brand, round(avg(l_quantity), 2) AS rating, count(l_orderkey) AS reviews
       FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand""",
)
def q14(t: Tables) -> DataFrame:
    """Average over two levels of children; reviews are added up per product before the join."""
    reviews = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("s"), F.count("l_quantity").alias("n"))
    joined = t.part.join(reviews, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.groupBy("p_brand").agg(
        F.round(F.try_divide(F.sum("s"), F.sum("n")), 2).alias("rating"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("reviews"),
    )


@query(
    "q15_customer_summary",
    """SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0.0) AS spent,
              max(o_orderdate) AS last_order,
              round(count(o_orderkey) / greatest(1, datediff('month', min(o_orderdate),
                    (SELECT max(o_orderdate) FROM orders))), 4) AS orders_per_month
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def q15(t: Tables) -> DataFrame:
    now = t.orders.agg(F.max("o_orderdate")).scalar()
    totals = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), money("o_totalprice").alias("spent"),
        F.max("o_orderdate").alias("last_order"), F.min("o_orderdate").alias("first_order"),
    )
    joined = t.customer.select("c_custkey").join(totals, "c_custkey", "left").withColumn("now", now)
    months = 12 * (F.year("now") - F.year("first_order")) + F.month("now") - F.month("first_order")
    orders = F.coalesce("orders", F.lit(0))
    return joined.select(
        "c_custkey", orders.alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"), "last_order",
        F.round(orders / F.greatest(F.lit(1), months), 4).alias("orders_per_month"),
    )


@query(
    "q16_category_stats",
    """SELECT p_type, count(*) AS products, round(avg(p_retailprice), 4) AS avg_price, sum(p_size)::BIGINT AS stock
       FROM part GROUP BY p_type""",
)
def q16(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("products"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"),
        F.sum("p_size").alias("stock"),
    )


@query(
    "q16_segments_of_nations",
    """SELECT n_name AS name, count(*) AS customers, round(avg(c_acctbal), 4) AS avg_balance, count(DISTINCT c_mktsegment) AS segments
       FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
def q16_named(t: Tables) -> DataFrame:
    """Statistics per key, joined to the names after grouping."""
    grouped = t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance"), F.countDistinct("c_mktsegment").alias("segments")
    )
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return grouped.join(names, "c_nationkey").drop("c_nationkey")


@query(
    "q03_clamped_pages",
    """SELECT 'large' AS asked, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100)
       UNION ALL SELECT 'none', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1)
       UNION ALL SELECT 'default', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 20)""",
)
def q03_clamped(t: Tables) -> DataFrame:
    """Pages of a size asked for: too large, below one, and not given."""
    ordered = t.orders.select("o_orderkey").orderBy("o_orderkey")
    page = lambda asked, size, offset: ordered.offset(offset).limit(size).select(F.lit(asked).alias("asked"), "o_orderkey")
    return (
        page("large", page_size(1000), page_offset(0, page_size(1000)))
        .unionByName(page("none", page_size(-3), page_offset(-1, page_size(-3))))
        .unionByName(page("default", page_size(), page_offset(2)))
    )


@query(
    "q17_sales_by_status",
    """SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders
       WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY o_orderstatus ORDER BY o_orderstatus""",
)
def q17(t: Tables, since: str = "2000-01-01") -> DataFrame:
    recent = t.orders.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    return recent.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), money("o_totalprice").alias("revenue")
    ).orderBy("o_orderstatus")


@query(
    "q18_top_products",
    """SELECT p_partkey, p_name, units FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS units
         FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey
       ORDER BY units DESC, p_partkey LIMIT 10""",
)
def q18(t: Tables, n: int = 10) -> DataFrame:
    """Best sellers: summed before the join, so each product is joined once."""
    sold = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("units"))
    joined = t.part.select("p_partkey", "p_name").join(sold, F.col("l_partkey") == F.col("p_partkey"))
    return joined.orderBy(F.desc("units"), "p_partkey").limit(n).select("p_partkey", "p_name", "units")


@query(
    "q19_daily_revenue",
    """SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) AS orders,
              round(sum(o_totalprice), 2) AS revenue
       FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
)
def q19(t: Tables, excluded: str = "P") -> DataFrame:
    kept = t.orders.where(F.col("o_orderstatus") != excluded)
    return kept.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), money("o_totalprice").alias("revenue")
    )


@query(
    "q20_overview",
    """SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM part) AS products,
              (SELECT count(*) FROM orders) AS orders,
              (SELECT coalesce(round(sum(o_totalprice), 2), 0) FROM orders) AS revenue,
              (SELECT coalesce(round(avg(o_totalprice), 2), 0) FROM orders) AS average_order""",
)
def q20(t: Tables) -> DataFrame:
    rows = lambda df: df.agg(F.count(F.lit(1))).scalar()
    orders = t.orders.agg(
        F.count(F.lit(1)).alias("orders"), F.coalesce(money("o_totalprice"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.round(F.avg("o_totalprice"), 2), F.lit(0.0)).alias("average_order"),
    )
    return orders.select(rows(t.customer).alias("customers"), rows(t.part).alias("products"), "orders", "revenue", "average_order")


@query(
    "q21_top_authors",
    """SELECT c_custkey, c_name, n AS posts FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders
         GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5) ON o_custkey = c_custkey""",
)
def q21(t: Tables, n: int = 5) -> DataFrame:
    top = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("posts"))
    top = top.orderBy(F.desc("posts"), "o_custkey").limit(n)
    return top.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "posts")


@query(
    "q22_average_children_per_author",
    """SELECT o_custkey AS author, count(*) AS posts, sum(coalesce(n, 0))::BIGINT AS comments,
              round(sum(coalesce(n, 0)) / count(*), 1) AS comments_per_post
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
            ON l_orderkey = o_orderkey GROUP BY o_custkey""",
)
def q22(t: Tables) -> DataFrame:
    posts = child_count(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", t.lineitem, "l_orderkey", "n")
    return posts.groupBy(F.col("o_custkey").alias("author")).agg(
        F.count(F.lit(1)).alias("posts"), F.sum("n").alias("comments"),
        F.round(F.sum("n") / F.count(F.lit(1)), 1).alias("comments_per_post"),
    )


@query(
    "q23_author_card",
    """SELECT c_custkey, c_name, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS published,
              max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS latest
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
)
def q23(t: Tables) -> DataFrame:
    published = t.orders.where(F.col("o_orderstatus") == "F")
    authors = t.customer.select("c_custkey", "c_name")
    return child_count(authors, "c_custkey", published, "o_custkey", "published", latest=F.max("o_orderdate"))


@query(
    "q24_posts_with_tag",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE EXISTS
         (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)""",
)
def q24(t: Tables, tag: int = 7) -> DataFrame:
    tagged = t.lineitem.where(F.col("l_suppkey") == tag).select("l_orderkey")
    return t.orders.join(tagged, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_orderdate")


@query(
    "q25_related_by_category",
    """SELECT p.p_partkey, p.p_name FROM part p
       WHERE p.p_brand = (SELECT p_brand FROM part WHERE p_partkey = 11) AND p.p_partkey <> 11
       ORDER BY p.p_name, p.p_partkey LIMIT 6""",
)
def q25(t: Tables, product: int = 11) -> DataFrame:
    category = t.part.where(F.col("p_partkey") == product).select("p_brand").scalar()
    others = t.part.where((F.col("p_brand") == category) & (F.col("p_partkey") != product))
    return others.select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(6)


@query(
    "q25_related_by_tag",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey <> 100 AND o_orderkey IN (
         SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey = 100))
       ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5""",
)
def q25_tag(t: Tables, post: int = 100) -> DataFrame:
    tags = t.lineitem.where(F.col("l_orderkey") == post).select("l_suppkey").distinct()
    sharing = t.lineitem.where(F.col("l_orderkey") != post).join(tags, "l_suppkey", "left_semi").select("l_orderkey")
    related = t.orders.join(sharing, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return related.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select("o_orderkey", "o_orderdate")


@query(
    "q26_authors_per_tag",
    """SELECT l_suppkey AS tag, count(DISTINCT o_custkey) AS authors, count(DISTINCT o_orderkey) AS posts
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey""",
)
def q26(t: Tables) -> DataFrame:
    """Distinct counts through the bridge table, which is reduced to distinct pairs first."""
    bridge = t.lineitem.select(F.col("l_suppkey").alias("tag"), "l_orderkey").distinct()
    joined = bridge.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    per_author = joined.groupBy("tag", "o_custkey").agg(F.count(F.lit(1)).alias("posts"))
    return per_author.groupBy("tag").agg(F.count(F.lit(1)).alias("authors"), F.sum("posts").alias("posts"))


@query(
    "q27_tag_cloud",
    """WITH c AS (SELECT s_suppkey AS tag, count(l_orderkey) AS n FROM supplier
                  LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey)
       SELECT tag, n, CAST(round(n / greatest(1, (SELECT max(n) FROM c)) * 4) AS BIGINT) + 1 AS weight FROM c""",
)
def q27(t: Tables) -> DataFrame:
    tags = cut(child_count(t.supplier.select(F.col("s_suppkey").alias("tag")), "tag", t.lineitem, "l_suppkey", "n"))
    top = F.greatest(F.lit(1), tags.agg(F.max("n")).scalar())
    return tags.withColumn("weight", F.round(F.col("n") / top * 4).cast("bigint") + 1)


@query(
    "q28_search_index",
    """SELECT o_orderkey, c_name AS author, coalesce(tags, []) AS tags
       FROM orders JOIN customer ON c_custkey = o_custkey
       LEFT JOIN (SELECT l_orderkey, list(DISTINCT s_name ORDER BY s_name) AS tags FROM lineitem
                  JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def q28(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    named = pairs.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    tags = named.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("s_name")).alias("tags"))
    authors = t.customer.select("c_custkey", F.col("c_name").alias("author"))
    return (
        t.orders.join(authors, F.col("c_custkey") == F.col("o_custkey"))
        .join(tags, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select("o_orderkey", "author", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    )


@query(
    "q29_export_csv",
    """SELECT p_partkey, p_partkey || ',' || p_name || ',' || p_brand || ',' || p_size AS line FROM part""",
)
def q29(t: Tables) -> DataFrame:
    """CSV lines of the whole table; written with df.write.text they are already ordered ranges."""
    listed = [csv_field(c) for c in ("p_partkey", "p_name", "p_brand", "p_size")]
    return t.part.select("p_partkey", F.concat_ws(",", *listed).alias("line")).orderBy("p_partkey")


@query(
    "q29_sitemap",
    """SELECT '/products/' || p_partkey || '-' || trim(regexp_replace(lower(p_name || ' ' || p_brand),
              '[^a-z0-9]+', '-', 'g'), '-') AS url FROM part""",
)
def q29_sitemap(t: Tables) -> DataFrame:
    slug = slugify(F.concat_ws(" ", "p_name", "p_brand"))
    return t.part.select(F.concat(F.lit("/products/"), F.col("p_partkey"), F.lit("-"), slug).alias("url")).orderBy("url")


@query(
    "q30_product_detail",
    """WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, l_shipdate,
                row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC,
                                   l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem),
       a AS (SELECT l_partkey, round(avg(l_quantity), 2) AS rating, count(*) AS reviews FROM lineitem GROUP BY 1)
       SELECT p_partkey, p_name, rating, coalesce(reviews, 0) AS reviews,
              coalesce((SELECT list(CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber ORDER BY rn) FROM r
                        WHERE r.l_partkey = p_partkey AND rn <= 10), []) AS recent
       FROM part LEFT JOIN a ON a.l_partkey = p_partkey""",
)
def q30(t: Tables, k: int = 10) -> DataFrame:
    """Products with their newest reviews and average rating."""
    newest = Window.partitionBy("l_partkey").orderBy(
        F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_quantity")
    )
    reviews = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    recent = reviews.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= k)
    name = F.concat_ws("/", "l_orderkey", "l_linenumber")
    recent = recent.groupBy("l_partkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", name.alias("name")))), lambda x: x["name"]).alias("recent")
    )
    rated = t.lineitem.groupBy("l_partkey").agg(
        F.round(F.avg("l_quantity"), 2).alias("rating"), F.count(F.lit(1)).alias("reviews")
    )
    joined = t.part.select("p_partkey", "p_name", F.col("p_partkey").alias("l_partkey"))
    return joined.join(rated, "l_partkey", "left").join(recent, "l_partkey", "left").select(
        "p_partkey", "p_name", "rating", F.coalesce("reviews", F.lit(0)).alias("reviews"),
        F.coalesce("recent", F.array().cast("array<string>")).alias("recent"),
    )


@query(
    "q31_moderation_queue",
    """SELECT l_orderkey, l_linenumber, l_quantity, p_name, l_shipdate FROM lineitem JOIN part ON p_partkey = l_partkey
       WHERE l_quantity <= 2 ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_quantity, p_name LIMIT 50""",
)
def q31(t: Tables, worst: int = 2) -> DataFrame:
    low = t.lineitem.where(F.col("l_quantity") <= worst)
    joined = low.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return (
        joined.select("l_orderkey", "l_linenumber", "l_quantity", "p_name", "l_shipdate")
        .orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_quantity", "p_name").limit(50)
    )


@query(
    "q32_conversation_meta",
    """SELECT conv_id, list(DISTINCT role ORDER BY role) AS roles, count(*) AS turns,
              max(turn) AS last_turn FROM conversations GROUP BY conv_id""",
)
def q32(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("turns"),
        F.max("turn").alias("last_turn"),
    )


@query(
    "q33_customer_orders_page",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 42 AND (o_orderdate, o_orderkey) <
         (SELECT (o_orderdate, o_orderkey) FROM orders WHERE o_custkey = 42 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
       ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5""",
)
def q33(t: Tables, customer: int = 42) -> DataFrame:
    mine = t.orders.where(F.col("o_custkey") == customer).select("o_orderkey", "o_orderdate", "o_totalprice")
    cursor = mine.agg(F.max(F.struct("o_orderdate", "o_orderkey"))).scalar()
    rest = after_cursor(mine, "o_orderdate", "o_orderkey", cursor)
    return rest.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5)
