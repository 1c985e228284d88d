"""Operators on lines of text, on numbers of identifiers, and on issues."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkgraph.functions.dialect import to_java
from linkgraph.functions.idgrammar import pattern_prefix


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line (from 1), text: the lines of each text; nothing stands after the last line end."""
    parts = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    return docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select(key, F.posexplode(parts).alias("line", "text")).withColumn("line", F.col("line") + 1)


def matches(pattern: str, fixed: bool = False, text: str = "text", cased: bool = False) -> Column:
    """Whether a line matches, in any letter case of any script; a blank or faulty pattern is an error, before any job runs.

    cased: a fixed pattern in its own letter case.
    """
    if not pattern.strip():
        raise ValueError("the pattern must not be blank")
    if cased:
        if not fixed:
            raise ValueError("only a fixed pattern is looked for in its own letter case")
        return F.contains(F.col(text), F.lit(pattern))
    if fixed:
        return F.contains(F.lower(text), F.lit(pattern.lower()))
    return F.col(text).rlike(to_java(pattern))


def search(rows: DataFrame, pattern: str, fixed: bool = False, cased: bool = False) -> DataFrame:
    """The lines that match."""
    return rows.where(matches(pattern, fixed, cased=cased))


def trimmed(text: Column | str) -> Column:
    """Without the blanks of any script around it; other white space stays."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def capped(hits: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first hits of each group."""
    if limit < 0:
        raise ValueError("a limit must not be negative")
    return hits.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_rank") <= limit).drop("_rank")


#: The characters that make one word with another of their class: ASCII words, Han, Katakana with its sign of length.
WORD_CLASSES = (r"[0-9A-Za-z_]", r"\p{Han}", r"[\p{Katakana}ー]")
#: Bytes of aliases that are sent to every task at once; of a larger glossary one part is looked for after the other.
SENT = 8 << 20


def word_class(c: str) -> int:
    """The class of a character, -1 for one that joins no other."""
    return next((k for k, x in enumerate(WORD_CLASSES) if regex.fullmatch(x, c)), -1)


def alias_hits(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lines in which an alias stands alone, once an alias and line; a null text has none, an empty alias is nowhere.

    A neighbour of the alias's own class joins it to a longer word and so is no match; any other does not. One automaton
    of all aliases reads each line once, whatever their number.
    """
    names = aliases.select("alias").where("alias <> ''").distinct()
    n = names.agg(F.coalesce(F.sum(F.octet_length("alias")), F.lit(0))).first()[0]
    parts, out = -(-n // SENT), rows.limit(0).withColumn("alias", F.lit(""))
    for k in range(parts):
        own = names if parts == 1 else names.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == k)
        found = searched(rows, [r.alias for r in own.collect()])  # of this part, no more bytes than ``SENT`` or so
        out = found if k == 0 else out.unionByName(found)
    return out


def searched(rows: DataFrame, aliases: list[str]) -> DataFrame:
    """The rows once for each of the aliases that stands alone in their text."""
    sent = rows.sparkSession.sparkContext.broadcast(aliases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for a in sent.value:
            machine.add_word(a, (len(a), word_class(a[0]), word_class(a[-1]), a))
        machine.make_automaton()
        kinds: dict[str, int] = {}

        def kind(c: str) -> int:
            if c not in kinds:
                kinds[c] = word_class(c)
            return kinds[c]

        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                met = set()
                for end, (size, first, last, a) in machine.iter(text) if text else ():
                    if a in met or first >= 0 and end >= size and kind(text[end - size]) == first or last >= 0 and end + 1 < len(text) and kind(text[end + 1]) == last:
                        continue
                    met.add(a)
                    at.append(i)
                    hits.append(a)
            if at:
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(hits)], names=[*own.schema.names, "alias"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("alias", StringType())]))


def sequence_gaps(used: DataFrame, pattern: str) -> DataFrame:
    """id of every number between the least and the greatest used one that is not used.

    Each number looks at the next used one, so no list of all numbers is made in one task.
    """
    bands = used.select("n", F.floor(F.col("n") / 10_000).alias("band"))
    edges = bands.groupBy("band").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    inside = bands.withColumn("after", F.lead("n").over(Window.partitionBy("band").orderBy("n")))
    between = edges.select(F.col("high").alias("n"), F.lead("low").over(Window.orderBy("band")).alias("after"))  # a row a band
    holes = inside.select("n", "after").unionByName(between).where(F.col("after") > F.col("n") + 1)
    return holes.select(F.explode(F.sequence(F.col("n") + 1, F.col("after") - 1)).alias("n")).select(F.concat(F.lit(pattern_prefix(pattern)), F.col("n").cast("string")).alias("id"))


def numbered(rows: DataFrame, counter: list[str], blocks: list[str | Column], order: str | Column) -> DataFrame:
    """n: the place of each row among those of its counter, by block and then by ``order``, from 1.

    A block (named columns; their order is the order of blocks) is numbered by itself, and only a row for each block is
    ordered within the counter, so a counter that holds most of the rows is not sorted by one task.
    """
    keys = [*counter, *blocks]
    inside = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*counter).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before).drop("_size")
    same = [inside[k].eqNullSafe(starts[k]) for k in keys]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    out = inside.join(starts, condition)
    return out.select(*(inside[c] for c in rows.columns), (F.col("_before") + F.col("_nth")).alias("n"))


def assign_ids(rows: DataFrame, counter: str, order: str, pattern: str, start: Column, band: int = 10_000) -> DataFrame:
    """Numbers the rows of each counter by a whole-number column, from ``start``; ``band`` values of it are sorted by one task at most."""
    banded = rows.withColumn("_band", F.floor(F.col(order) / band))
    n = numbered(banded, [counter], ["_band"], order)
    return n.withColumn("id", F.concat(F.lit(pattern_prefix(pattern)), (F.col("n") + start - 1).cast("string"))).drop("n", "_band")


def tally(issues: DataFrame, strict: bool = False) -> DataFrame:
    """Errors and warnings by kind; strict turns warnings into errors."""
    severity = F.lit("error") if strict else F.col("severity")
    return issues.groupBy("kind").agg(F.count_if(severity == "error").alias("errors"), F.count_if(severity == "warning").alias("warnings"))
