"""Documents of a project as a data source of Spark: tasks list folders, tell declared files, and read them.

The planner counts the entries of folders and deals them to partitions; no file is named in the plan or on the driver.
The folders must be where driver and executors can reach them. A filter on ``type`` is taken over by the source, so that
files of other types are not opened.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

#: Entries of folders that one partition lists.
ENTRIES = 2_000
COLUMNS = "real string, path string, type string, id_pattern string"


def glob_regex(pattern: str) -> str:
    """A glob as an expression of whole paths: ``**`` crosses folders, ``{a,b}`` lists alternatives."""
    out, at, depth = "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at):
            out, at = out + "(?:[^/]+/)*", at + 3
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", at + 2)) > 0:
            body = pattern[at + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]"
            at = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        at += 1
    return out


def fixed_folder(pattern: str) -> str:
    """The folders of a glob before its first sign."""
    return os.path.dirname(re.split(r"[*?\[{]", pattern, maxsplit=1)[0])


@dataclass
class Share(InputPartition):
    """Folders, and of the names in them those whose checksum leaves ``rest``."""

    folders: list[str]
    of: int = 1
    rest: int = 0


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.text = options["base"], options.get("text", "true") == "true"
        self.specs = json.loads(options["specs"])  # [path or glob, whether it is a glob, type, id_pattern]
        self.roots = json.loads(options["roots"]) if options.get("roots") else None
        self.kind: str | None = None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",) and self.kind in (None, f.value):
                self.kind = f.value
            else:
                yield f

    def starts(self) -> list[str]:
        named = self.roots if self.roots is not None else [fixed_folder(p) if glob else os.path.dirname(p) for p, glob, *_ in self.specs]
        return sorted(set(named))

    def partitions(self) -> list[InputPartition]:
        """Folders by their number of entries: small ones together, a large one over several partitions."""
        out, held, n, met = [], [], 0, set()
        todo = [(s, self.roots is not None or any(g for p, g, *_ in self.specs if fixed_folder(p) == s)) for s in self.starts()]
        while todo:
            folder, deep = todo.pop()
            full = os.path.join(self.base, folder)
            real = os.path.realpath(full)
            if real in met or not os.path.isdir(full):
                continue
            met.add(real)
            size = 0
            with os.scandir(full) as entries:
                for e in entries:
                    size += 1
                    if deep and e.is_dir():
                        todo.append((os.path.join(folder, e.name), True))
            if size > ENTRIES:
                parts = -(-size // ENTRIES)
                out += [Share([folder], parts, k) for k in range(parts)]
            elif size:
                held, n = [*held, folder], n + size
                if n > ENTRIES:
                    out.append(Share(held))
                    held, n = [], 0
        return [*out, *([Share(held)] if held else [])] or [Share([])]

    def read(self, share: Share) -> Iterator[tuple]:
        base = os.path.realpath(self.base)
        single = {}
        for p, glob, kind, pattern in self.specs:
            if not glob:
                single.setdefault(os.path.realpath(os.path.join(base, p)), (kind, pattern))
        globs = [(re.compile(glob_regex(p)), kind, pattern) for p, glob, kind, pattern in self.specs if glob]
        for folder in share.folders:
            with os.scandir(os.path.join(base, folder)) as entries:
                names = [e.name for e in entries if e.is_file() and zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % share.of == share.rest]
            for name in names:
                path = os.path.normpath(os.path.join(folder, name))
                full = os.path.join(base, path)
                real = os.path.realpath(full)
                spec = single.get(real) or next(((kind, pattern) for regex, kind, pattern in globs if regex.fullmatch(path)), None)
                if spec is None and (self.roots is None or not name.endswith(".md")) or self.kind is not None and (spec is None or spec[0] != self.kind):
                    continue
                row = (real, path, *(spec or (None, None)))
                if self.text:
                    with open(full, encoding="utf-8", errors="replace", newline="") as f:
                        row = (*row, f.read())
                yield row


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_documents"

    def schema(self) -> str:
        return COLUMNS + (", text string" if self.options.get("text", "true") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(dict(self.options))


def documents(spark: SparkSession, base: str, specs: list[tuple[str, bool, str, str]], roots: list[str] | None = None) -> DataFrame:
    """path, type, id_pattern, text of the declared files; with ``roots``, of all Markdown below these folders.

    specs: path or glob, whether it is a glob, type, id_pattern; a file by its name goes before any glob, then the first
    glob wins. A file that several paths lead to is read once, by the least of them.
    """
    spark.dataSource.register(DocumentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("project_documents").options(base=base, specs=json.dumps(specs), **({} if roots is None else {"roots": json.dumps(roots)}))
    paths = source.option("text", "false").load().select("real", "path")
    several = paths.groupBy("real").agg(F.min("path").alias("least"), F.count("*").alias("n")).where("n > 1")
    again = paths.join(several, "real").where("path <> least").select("path")  # links to files that are there too
    return source.option("text", "true").load().join(again, "path", "left_anti").select("path", "type", "id_pattern", "text")
