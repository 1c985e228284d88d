"""The write path: new identifiers for headings, and files replaced together or not at all."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgraph.functions.idgrammar import format_id, pattern_prefix, seq_of
from linkgraph.operators.prefix import running
from linkgraph.sources.corpus import Corpus


def last_number(definitions: DataFrame, pattern: str) -> DataFrame:
    """One row: top, the greatest number of the pattern's identifiers, null without any."""
    return definitions.agg(F.max(seq_of(pattern, "id")).alias("top"))


def assignments(corpus: Corpus, pattern: str, paths: list[str] | DataFrame, level: int | None = None, start: int = 1, levels: tuple[int, ...] = ()) -> DataFrame:
    """path, line, level, text, id: a number for each heading of the levels that has none, file by file.

    Files are numbered in the order in which they are named: as a list, or as a DataFrame of path and place (any number).
    Counting goes on from the greatest number of the pattern in any document. ``level`` goes before ``levels``; without
    either, each file's shallowest one from 2 on is numbered. Headings are counted by file, and a file's first number
    follows from the counts of the files before it, so no task holds more than the headings of a file.
    """
    wanted = (level,) if level is not None else tuple(levels)
    if any(not 1 <= x <= 6 for x in wanted) or start < 0:
        raise ValueError("a level is 1 to 6 and a start is not negative")
    format_id(pattern, 1)
    named = paths if isinstance(paths, DataFrame) else corpus.docs.sparkSession.createDataFrame([*enumerate(dict.fromkeys(paths))] or [(0, "")], "place long, path string")
    used = last_number(corpus.definitions.where(F.col("id_pattern") == pattern), pattern)
    heads = corpus.headings.where(F.col("id_pattern") == pattern).join(named.groupBy("path").agg(F.min("place").alias("place")), "path")
    if wanted:
        bare = heads.where(F.col("level").isin(*wanted) & F.col("id").isNull())
    else:
        least = heads.where("level >= 2").groupBy("path").agg(F.min("level").alias("least"))
        bare = heads.join(least, "path", "left").where((F.col("level") == F.coalesce("least", F.lit(2))) & F.col("id").isNull())
    bare = bare.select("path", "place", "ordinal", "line", "level", "text")
    sizes = running(bare.groupBy("place", "path").agg(F.count("*").alias("size")), [], ["place", "path"], "size").select("path", "before")
    inside = F.row_number().over(Window.partitionBy("path").orderBy("ordinal"))
    rows = bare.withColumn("nth", inside).join(sizes, "path").crossJoin(F.broadcast(used))  # one row
    before, after = pattern.split("{seq}") if "{seq}" in pattern else (pattern_prefix(pattern), "")
    number = F.col("before") + F.col("nth") + F.greatest(F.coalesce("top", F.lit(0)), F.lit(max(start, 1) - 1))
    return rows.select("path", "line", "level", "text", F.concat(F.lit(before), number.cast("string"), F.lit(after)).alias("id"))


def rewritten(corpus: Corpus, found: DataFrame) -> dict[str, str]:
    """New texts of the files that change; an ATX heading gets its ID, one with an underline keeps it.

    Lines end at line feeds, as the parser counts them; what stands before the heading (a quote's marks) stays.
    """
    out: dict[str, list[str]] = {}
    texts = {r.path: r.text for r in corpus.docs.join(found.select("path").distinct(), "path", "left_semi").collect()}  # files to be written by the driver
    for r in found.collect():
        lines = out.setdefault(r.path, re.findall(r"[^\n]*\n|[^\n]+\Z", texts[r.path]))
        raw = lines[r.line - 1]
        end = raw[len(raw.rstrip("\r\n")) :]
        quote = re.match(r"[ >]*", raw)[0] if raw.lstrip(" ").startswith(">") else ""
        head = f"{'#' * r.level} " if raw[len(quote) :].lstrip(" ").startswith("#") else ""
        lines[r.line - 1] = f"{quote}{head}{r.id}: {r.text}{end}"
    return {path: "".join(lines) for path, lines in out.items()}


def write_all(files: dict[str, str]) -> None:
    """Replaces files together: all are staged beside their targets first, and put back if one cannot be replaced."""
    real = [os.path.realpath(p) for p in files]
    if len(set(real)) < len(real):
        raise ValueError("a file is named twice")
    staged, done = [], []
    try:
        for path, text in zip(real, files.values(), strict=True):
            if os.path.exists(path) and not os.path.isfile(path):
                raise ValueError(f"{path} is not a regular file")
            if os.path.exists(path) and not os.access(path, os.W_OK):
                raise PermissionError(path)
            handle, name = tempfile.mkstemp(dir=os.path.dirname(path))
            staged.append((path, name))
            with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
                f.write(text)
            os.chmod(name, os.stat(path).st_mode & 0o777 if os.path.exists(path) else 0o644)
        for path, name in staged:
            old = open(path, "rb").read() if os.path.exists(path) else None
            os.replace(name, path)
            done.append((path, old))
    except BaseException:
        for path, old in done:
            if old is None:
                os.remove(path)
            else:
                with open(path, "wb") as f:
                    f.write(old)
        for _, name in staged:
            if os.path.exists(name):
                os.remove(name)
        raise
