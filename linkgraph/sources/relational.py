"""Tables as a corpus: a row defines an identifier, a foreign key mentions one."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.operators.graph import REFERENCE, LinkGraph

#: type -> (table, key columns, title column); the first five are the chain, parts and suppliers stand beside it.
TYPES = {
    "REG": ("region", ("r_regionkey",), "r_name"), "NAT": ("nation", ("n_nationkey",), "n_name"), "CUS": ("customer", ("c_custkey",), "c_name"),
    "ORD": ("orders", ("o_orderkey",), "o_orderpriority"), "LIN": ("lineitem", ("l_orderkey", "l_linenumber"), "l_returnflag"),
    "PRT": ("part", ("p_partkey",), "p_name"), "SUP": ("supplier", ("s_suppkey",), "s_name"),
}
CHAIN = ["REG", "NAT", "CUS", "ORD", "LIN"]
#: (mentioned type, foreign key, mentioning type)
MENTIONS = (("REG", "n_regionkey", "NAT"), ("NAT", "c_nationkey", "CUS"), ("CUS", "o_custkey", "ORD"), ("ORD", "l_orderkey", "LIN"), ("PRT", "l_partkey", "LIN"), ("SUP", "l_suppkey", "LIN"), ("NAT", "s_nationkey", "SUP"))


def ident(kind: str, *cols: str) -> Column:
    first, *more = (F.col(c).cast("string") for c in cols)
    return F.concat(F.lit(f"{kind}-"), first, *(F.concat(F.lit("."), c) for c in more))


#: An identifier as numbers: the type's place in TYPES, and one or two keys.
KEY = "struct<t:tinyint,a:bigint,b:int>"


def key(kind: str, *cols: str) -> Column:
    """All fields may be null as far as the analyser sees, so that all keys are of one type.

    Otherwise a join of keys that a union made nullable with others would cast one side, and move it again.
    """
    more = f"cast({cols[1]} as int)" if len(cols) > 1 else "0"
    fields = {"t": f"cast({[*TYPES].index(kind)} as tinyint)", "a": f"cast({cols[0]} as bigint)", "b": more}
    return F.expr(f"named_struct({', '.join(f"'{n}', if(false, null, {x})" for n, x in fields.items())})")


def label(x: Column) -> Column:
    """The text of such an identifier."""
    second = F.when(F.element_at(F.array(*(F.lit(len(t[1]) > 1) for t in TYPES.values())), x["t"].cast("int") + 1), F.concat(F.lit("."), x["b"].cast("string"))).otherwise("")
    return F.concat(F.element_at(F.array(*(F.lit(f"{t}-") for t in TYPES)), x["t"].cast("int") + 1), x["a"].cast("string"), second)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Read = Callable[[str], DataFrame]


def reader(spark: SparkSession, sf_dir: str) -> Read:
    """Opens each table once: a job looks its schema up each time."""
    return cache(lambda name: table(spark, sf_dir, name))


def definitions(spark: SparkSession, sf_dir: str, kinds=tuple(TYPES), ident=ident, read: Read | None = None) -> DataFrame:
    """id, type, path, line, level, title, pos of every row, duplicates kept; the key stands for document order."""
    out, read = None, read or reader(spark, sf_dir)
    for kind in TYPES:
        if kind not in kinds:
            continue
        rows = described(read(TYPES[kind][0]), kind, ident)
        out = rows if out is None else out.unionByName(rows)
    return out


def described(rows: DataFrame, kind: str, ident=ident) -> DataFrame:
    name, keys, title = TYPES[kind]
    place = F.array(F.lit([*TYPES].index(kind)).cast("long"), *(F.col(k).cast("long") for k in keys))
    return rows.select(ident(kind, *keys).alias("id"), F.lit(kind).alias("type"), F.lit(name).alias("path"), F.col(keys[-1]).cast("int").alias("line"), F.lit(2).alias("level"), F.col(title).alias("title"), place.alias("pos"))


def nodes(spark: SparkSession, sf_dir: str, kinds=tuple(TYPES), ident=ident, read: Read | None = None) -> DataFrame:
    """One row an identifier. Line items may repeat a key, and so a place in the order; the least title stands for all."""
    out, read = None, read or reader(spark, sf_dir)
    for kind in kinds:
        rows = definitions(spark, sf_dir, (kind,), ident, read)
        if kind == "LIN":  # on its key columns; what a query does not ask for is not aggregated
            name, keys, title = TYPES[kind]
            once = read(name).groupBy(*keys).agg(F.min(title).alias(title))
            rows = described(once, kind, ident)
        out = rows if out is None else out.unionByName(rows)
    return out


def mentions(spark: SparkSession, sf_dir: str, kinds=tuple(TYPES), once: bool = False, ident=ident, read: Read | None = None) -> DataFrame:
    """src (mentioned), dst (mentioning) and their types; a pair as often as there are rows, or once."""
    out, read = None, read or reader(spark, sf_dir)
    for src, key, dst in MENTIONS:
        if src not in kinds or dst not in kinds:
            continue
        name, keys, _ = TYPES[dst]
        rows = read(name).where(F.col(key).isNotNull()).select(*dict.fromkeys((key, *keys)))
        rows = rows.distinct() if once and dst == "LIN" else rows  # the other keys are unique
        own = rows.select(ident(src, key).alias("src"), ident(dst, *keys).alias("dst"), F.lit(src).alias("src_type"), F.lit(dst).alias("dst_type"))
        out = own if out is None else out.unionByName(own)
    return out


def graph(spark: SparkSession, sf_dir: str, chain: list[str] | None = None, kinds=tuple(TYPES), keyed: bool = True) -> LinkGraph:
    """The link graph of some types; the edges are mentions of defined identifiers, one a pair.

    ``keyed``: identifiers are structs of numbers until they are shown, so that no text is grouped, joined or sorted.
    """
    own, read = key if keyed else ident, reader(spark, sf_dir)
    edges = mentions(spark, sf_dir, kinds, True, own, read).select("src", "dst", F.lit(REFERENCE).alias("kind"))
    return LinkGraph(nodes(spark, sf_dir, kinds, own, read), edges, chain or CHAIN, typed=mentions(spark, sf_dir, kinds, ident=own, read=read), flat=True, label=label if keyed else None)
