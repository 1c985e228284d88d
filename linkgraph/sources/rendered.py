"""Tables as Markdown documents, one a row, so that the parser's results can be held against the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkgraph.sources.corpus import PARTS, Corpus
from linkgraph.sources.relational import table


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, type, id_pattern, text: nations, and customers that mention theirs; with decoys in code."""
    nations = table(spark, sf_dir, "nation").select(
        F.format_string("nation/%05d.md", "n_nationkey").alias("path"), F.lit("NAT").alias("type"), F.lit("NAT-{seq}").alias("id_pattern"),
        text("# Nation\n\n## NAT-", F.col("n_nationkey"), ": ", F.col("n_name"), "\n\nA nation of region ", F.col("n_regionkey"), ".\n").alias("text"),
    )
    orders = F.when(F.col("c_custkey") % 3 == 0, F.lit("### Orders\n\nSome.\n")).otherwise(F.lit(""))
    customers = table(spark, sf_dir, "customer").select(
        F.format_string("customer/%012d.md", "c_custkey").alias("path"), F.lit("CUS").alias("type"), F.lit("CUS-{seq}").alias("id_pattern"),
        text("# Customer\n\n## CUS-", F.col("c_custkey"), ": ", F.col("c_name"), "\n\nLives in NAT-", F.col("c_nationkey"), ", not in `NAT-7`.\n\n~~~\nNAT-8\n~~~\n\n### Account\n\n", F.when(F.col("c_acctbal") < 0, F.lit("In debt.")).otherwise(F.lit("")), "\n", orders).alias("text"),
    )
    return nations.unionByName(customers)


def corpus(spark: SparkSession, sf_dir: str, chain: tuple[str, ...] = ("NAT", "CUS")) -> Corpus:
    return Corpus(documents(spark, sf_dir), list(chain), ["NAT-{seq}", "CUS-{seq}"])


def joined(rows: DataFrame, by: str, order: list[str], piece: Column | Callable[[Column], Column]) -> DataFrame:
    """by, body: the pieces of each group in order, as one text; a function makes them of the columns, so that no text is moved."""
    if callable(piece):
        return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), piece), "").alias("body"))
    ordered = F.array_sort(F.collect_list(F.struct(*order, piece.alias("piece"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("body"))


def sales_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, repeated, skipped and undefined identifiers: a document for each customer, part and supplier, and a glossary.

    A customer's document has its orders, and below them their line items as dotted IDs: nested for odd orders, beside
    them for even ones. Orders whose key leaves 3 when divided by 7 are drafts, which have headings without IDs, and so
    have small parts. Items mention parts. Suppliers mention the items that they deliver much of, and the orders whose
    key 4 divides.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    below = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("items"))

    def order(o: Column) -> Column:
        k = o["o_orderkey"]
        draft, mark = k % 7 == 3, F.when(k % 2 == 1, "###").otherwise("##")
        head = F.when(draft, "## A draft").otherwise(text("## ORD-", k, ": ", o["o_orderpriority"]))
        name = lambda i: F.when(draft, " An item").otherwise(text(" ORD-", k, ".", i["l_linenumber"], ": ", i["l_returnflag"]))
        item = lambda i: text(mark, name(i), "\n\nNeeds PRT-", i["l_partkey"], ".\n\n")
        return text(head, "\n\nA plain order.\n\n", F.coalesce(F.array_join(F.transform(o["items"], item), ""), F.lit("")))

    by_customer = joined(orders.join(below, orders.o_orderkey == below.l_orderkey, "left"), "o_custkey", ["o_orderkey", "o_orderpriority", "items"], order)
    sales = by_customer.select(F.format_string("sales/%012d.md", "o_custkey").alias("path"), F.lit("ORD").alias("type"), F.lit("ORD-{seq}").alias("id_pattern"), text("# Orders\n\n", F.col("body")).alias("text"))
    name = F.when(F.col("p_size") > 5, text("PRT-", F.col("p_partkey"), ": ")).otherwise("")
    size = F.when(F.col("p_size") > 40, text("A merch part, PRT for short, not PRT-", F.col("p_partkey"), ".")).when(F.col("p_size") > 25, "A merch part.").otherwise("A part.")
    parts = table(spark, sf_dir, "part").select(
        F.format_string("part/%012d.md", "p_partkey").alias("path"), F.lit("PRT").alias("type"), F.lit("PRT-{seq}").alias("id_pattern"),
        text("## ", name, F.col("p_name"), "\n\n", size, "\n").alias("text"),
    )
    many = items.where("l_quantity > 25").select("l_suppkey", F.lit(0).alias("kind"), "l_orderkey", "l_linenumber").distinct()
    whole = items.where("l_orderkey % 4 = 0").select("l_suppkey", F.lit(1).alias("kind"), "l_orderkey", F.lit(0).alias("l_linenumber")).distinct()
    named = lambda x: F.when(x["kind"] == 0, text("Delivers ORD-", x["l_orderkey"], ".", x["l_linenumber"], "\n")).otherwise(text("Delivers ORD-", x["l_orderkey"], "\n"))
    lines = joined(many.unionByName(whole), "l_suppkey", ["kind", "l_orderkey", "l_linenumber"], named)
    makers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.format_string("supplier/%012d.md", "s_suppkey").alias("path"), F.lit("SUP").alias("type"), F.lit("SUP-{seq}").alias("id_pattern"),
        text("## SUP-", F.col("s_suppkey"), ": ", F.col("s_name"), "\n\n", F.coalesce("body", F.lit(""))).alias("text"),
    )
    terms = "# Terms\n\n## TRM-1: Merchandise\n\nWares\n(merch). What is sold.\n\n## TRM-2: Component\n\nPRT. Its short name.\n\n## TRM-3: Piece\n\nPiece (PRT). Its short name.\n"
    words = spark.createDataFrame([("terms.md", "glossary", "TRM-{seq}", terms)], "path string, type string, id_pattern string, text string")
    return sales.unionByName(parts).unionByName(makers).unionByName(words)


def sales_corpus(spark: SparkSession, sf_dir: str, *parts: str) -> Corpus:
    return Corpus(sales_documents(spark, sf_dir), ["ORD", "SUP"], ["ORD-{seq}", "SUP-{seq}", "PRT-{seq}", "TRM-{seq}"], parts or tuple(PARTS))


#: Two identifiers that contain one another, over two definitions each, and a third that only the second one of them contains.
LOOP = "## N-1000: One\n\n### N-1001: Two\n\nx\n\n## N-1001: Two again\n\n### N-1000: One again\n\n### N-1002: Three\n\nx\n"


def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages: the needs of regions four levels deep, the plans of nations, and the tasks of their orders.

    A need of a nation (N-region.nation) has one for each market segment and two below that. A nation's plan (P-nation)
    is for its need, and so is that of each customer (P-nation.customer) for a need at the bottom, but for customers in
    debt; every second customer's plan mentions the nation's, of which it is a part. Tasks mention customers' plans.
    """
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_mktsegment")
    lands = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    segments = customers.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    place = segments.select("c_mktsegment", F.row_number().over(Window.orderBy("c_mktsegment")).alias("s"))  # a row a market segment
    land = text("N-", F.col("n_regionkey"), ".", F.col("n_nationkey"))
    deep = text("#### ", land, ".", F.col("s"), ": ", F.col("c_mktsegment"), "\n\n##### ", land, ".", F.col("s"), ".1: Even\n\nx\n\n##### ", land, ".", F.col("s"), ".2: Odd\n\nx\n\n")
    inner = joined(nations.crossJoin(F.broadcast(place)), "n_nationkey", ["s"], deep).withColumnRenamed("n_nationkey", "of")
    each = joined(nations.join(inner, F.col("n_nationkey") == F.col("of"), "left"), "n_regionkey", ["n_nationkey"], text("### ", land, ": ", F.col("n_name"), "\n\n", F.coalesce("body", F.lit(""))))
    needs = table(spark, sf_dir, "region").join(each, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        F.format_string("needs/%05d.md", "r_regionkey").alias("path"), F.lit("NEED").alias("type"), F.lit("N-{seq}").alias("id_pattern"), text("# Needs\n\n## N-", F.col("r_regionkey"), ": ", F.col("r_name"), "\n\n", F.coalesce("body", F.lit(""))).alias("text"),
    )
    told = F.when(F.col("c_acctbal") >= 0, text("For ", land, ".", F.col("s"), ".", F.col("c_custkey") % 2 + 1, ".")).otherwise("In debt.")
    part = F.when(F.col("c_custkey") % 2 == 0, text(" Part of P-", F.col("c_nationkey"), ".")).otherwise("")
    own = joined(lands.join(F.broadcast(place), "c_mktsegment"), "c_nationkey", ["c_custkey"], text("### P-", F.col("c_nationkey"), ".", F.col("c_custkey"), ": ", F.col("c_name"), "\n\n", told, part, "\n\n"))
    plans = nations.join(own, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.format_string("plans/%05d.md", "n_nationkey").alias("path"), F.lit("PLAN").alias("type"), F.lit("P-{seq}").alias("id_pattern"), text("# Plans\n\n## P-", F.col("n_nationkey"), ": ", F.col("n_name"), "\n\nFor ", land, ".\n\n", F.coalesce("body", F.lit(""))).alias("text"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    done = joined(orders, "c_custkey", ["o_orderkey"], text("## T-", F.col("o_orderkey"), ": ", F.col("o_orderpriority"), "\n\nDoes P-", F.col("c_nationkey"), ".", F.col("c_custkey"), ".\n\n"))
    tasks = done.select(F.format_string("tasks/%012d.md", "c_custkey").alias("path"), F.lit("TASK").alias("type"), F.lit("T-{seq}").alias("id_pattern"), F.col("body").alias("text"))
    loop = spark.createDataFrame([("needs/loop.md", "NEED", "N-{seq}", LOOP)], "path string, type string, id_pattern string, text string")
    return needs.unionByName(plans).unionByName(tasks).unionByName(loop)


def plan_corpus(spark: SparkSession, sf_dir: str, *parts: str) -> Corpus:
    return Corpus(plan_documents(spark, sf_dir), ["NEED", "PLAN", "TASK"], ["N-{seq}", "P-{seq}", "T-{seq}"], parts or tuple(PARTS))
