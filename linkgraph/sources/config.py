"""Project configuration: a YAML file that declares the chain, the files with their types and ID patterns, and rules.

Types and patterns come from the declarations only and are never guessed from a file's name.
"""

from __future__ import annotations

import glob as globbing
import os
import re
from dataclasses import dataclass, field
from functools import cached_property

import yaml
from pyspark.sql import SparkSession

from linkgraph.functions.idgrammar import pattern_regex
from linkgraph.sources.corpus import Corpus
from linkgraph.sources.scan import documents
from linkgraph.sources.settings import ConfigError, Settings

#: Rule names with their options and defaults.
RULE_OPTIONS = {
    "ref_integrity": {"enabled": True}, "term_consistency": {"enabled": True, "glossary_type": "glossary"}, "required_sections": {"enabled": True, "config": "sections.yaml"},
    "id_uniqueness": {"enabled": True, "check_sequence": False}, "dep_order": {"enabled": True}, "id_hierarchy": {"enabled": True},
}
NAMES = ("linkgraph.yaml", "linkgraph.yml")
GLOB = re.compile(r"[*?\[{]")


@dataclass(frozen=True)
class FileSpec:
    path: str
    type: str
    id_pattern: str
    id_start: int = 1
    id_levels: tuple[int, ...] = ()
    depends_on: tuple[str, ...] = ()
    declared: str = ""


@dataclass
class Config:
    base: str
    chain: list[str]
    files: list[FileSpec]
    settings: Settings
    templates: dict[str, str] = field(default_factory=dict)
    preset: str = ""
    declarations: list[FileSpec] = field(default_factory=list)

    @cached_property
    def rules(self) -> dict[str, dict]:
        """Every rule's options; an unknown rule or option is an error with its line, wherever it was merged from."""
        s, out = self.settings, {name: dict(options) for name, options in RULE_OPTIONS.items()}
        for name, (key, node) in s.members(s.members(s.root, "the file").get("rules", (None, None))[1], "rules").items():
            if name not in out:
                raise s.fault(key, f"unknown rule {name}")
            for option, (at, value) in s.members(node, f"rule {name}").items():
                if option not in out[name]:
                    raise s.fault(at, f"unknown option {option} of rule {name}")
                given = s.value(value, f"{option} of rule {name}", type(out[name][option]))
                out[name][option] = out[name][option] if given is None or given == "" else given
        return out

    def glossary_type(self) -> str:
        """The type of glossary documents; unlike ``rules``, whatever else stands there."""
        s = self.settings
        try:
            rules = s.members(s.members(s.root, "the file").get("rules", (None, None))[1], "rules")
            options = s.members(rules.get("term_consistency", (None, None))[1], "a rule")
            return s.value(options.get("glossary_type", (None, None))[1], "the type", str) or RULE_OPTIONS["term_consistency"]["glossary_type"]
        except ConfigError:
            return RULE_OPTIONS["term_consistency"]["glossary_type"]

    def spec_of(self, path: str) -> FileSpec | None:
        real = os.path.realpath(os.path.join(self.base, path))
        return next((s for s in self.files if s.path == path or os.path.realpath(os.path.join(self.base, s.path)) == real), None)

    def depends(self) -> dict[str, list[str]]:
        """file -> files it depends on; globs become the files they match."""
        return {s.path: [f for d in s.depends_on for f in (expand(self.base, d) if is_glob(self.base, d) else [d])] for s in self.files}

    def empty_globs(self) -> dict[str, list[str]]:
        """file -> globs of its dependencies that match no file."""
        return {s.path: own for s in self.files if (own := [d for d in s.depends_on if is_glob(self.base, d) and not expand(self.base, d)])}


    def missing_files(self) -> dict[str, list[str]]:
        """file -> files it depends on that do not exist."""
        return {f: own for f, gs in self.depends().items() if (own := [g for g in gs if not os.path.exists(os.path.join(self.base, g))])}


def is_glob(base: str, path: str) -> bool:
    """Whether a path has glob characters and is not the name of a file that exists."""
    return bool(GLOB.search(path)) and not os.path.isfile(os.path.join(base, path))


def expand(base: str, pattern: str) -> list[str]:
    """Files that match, sorted; ``**`` crosses folders and ``{a,b}`` lists alternatives."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if m:
        return sorted({f for part in m[1].split(",") for f in expand(base, pattern[: m.start()] + part + pattern[m.end() :])})
    return sorted(os.path.normpath(f) for f in globbing.glob(pattern, root_dir=base, recursive=True) if os.path.isfile(os.path.join(base, f)))


def discover(path: str | None = None, folder: str = ".") -> str:
    if path:
        if not os.path.isfile(path):
            raise ConfigError(f"{path}: no such file")
        return path
    for name in NAMES:
        if os.path.isfile(os.path.join(folder, name)):
            return os.path.join(folder, name)
    raise ConfigError(f"no {' or '.join(NAMES)} in {folder}")


def checked_glob(s: Settings, node, pattern: str) -> None:
    """A glob must be well-formed and stay below the configuration's folder, where it is expanded."""
    if not GLOB.search(pattern):
        return
    clean = os.path.normpath(pattern)
    if os.path.isabs(clean) or clean == ".." or clean.startswith("../"):
        raise s.fault(node, f"{pattern} leads out of the configuration's folder")
    if re.search(r"\[[^\]]*$", pattern) or pattern.count("{") != pattern.count("}"):
        raise s.fault(node, f"{pattern} is no pattern of files")


def load(path: str, check_rules: bool = True) -> Config:
    """The declarations of a file, checked, and its rules too unless a caller has no use for them."""
    with open(path, encoding="utf-8") as f:
        s = Settings(path, f.read())
    top = {name: value for name, (_, value) in s.members(s.root, "the file").items()}
    base = os.path.dirname(os.path.abspath(path))
    declared: list[FileSpec] = []
    single: set[str] = set()
    for node in s.items(top.get("files"), "files"):
        own = s.members(node, "a file")
        value = lambda key, kind=str: s.value(own.get(key, (None, None))[1], f"{key} of a file", kind)  # noqa: E731, B023
        at = lambda key: own.get(key, (None, node))[1]  # noqa: E731, B023
        missing = [k for k in ("path", "type", "id_pattern") if not value(k)]
        if missing:
            raise s.fault(node, f"a file lacks {', '.join(missing)}")
        try:
            pattern_regex(value("id_pattern"))
        except ValueError as e:
            raise s.fault(at("id_pattern"), str(e)) from e
        checked_glob(s, at("path"), value("path"))
        name = os.path.normpath(value("path"))
        if not is_glob(base, name):
            real = os.path.realpath(os.path.join(base, name))
            if real in single:
                raise s.fault(at("path"), f"{name} is declared twice")
            single.add(real)
        depends = s.strings(own.get("depends_on", (None, None))[1], "depends_on")
        for d in depends:
            checked_glob(s, at("depends_on"), d)
        levels = tuple(s.value(x, "an item of id_levels", int) or 0 for x in s.items(own.get("id_levels", (None, None))[1], "id_levels"))
        start = value("id_start", int)
        if any(not 1 <= x <= 6 for x in levels) or (start or 0) < 0:
            raise s.fault(node, f"{name}: levels are 1 to 6 and a start is not negative")
        declared.append(FileSpec(name, value("type"), value("id_pattern"), start or 1, levels, tuple(os.path.normpath(d) for d in depends), name))
    chain = s.strings(top.get("chain"), "the chain")
    if not chain or (absent := [t for t in chain if t not in {d.type for d in declared}]):
        raise ConfigError(f"{path}: the chain is empty or has undeclared types: {chain and absent}")
    files: dict[str, FileSpec] = {}
    for one in (True, False):  # a file by its name goes before any glob, then the first glob wins
        for d in declared:
            if is_glob(base, d.path) != one:
                for f in [d.path] if one else expand(base, d.path):
                    files.setdefault(os.path.realpath(os.path.join(base, f)), FileSpec(f, d.type, d.id_pattern, d.id_start, d.id_levels, d.depends_on, d.declared))
    templates = {name: s.value(value, f"the template {name}", str) or "" for name, (_, value) in s.members(top.get("templates"), "templates").items()}
    own = Config(base, chain, sorted(files.values(), key=lambda d: d.path), s, templates, s.value(top.get("preset"), "preset", str) or "", declared)
    return own if not check_rules or own.rules else own


def section_specs(config: Config) -> dict[str, dict]:
    path = os.path.join(config.base, config.rules["required_sections"]["config"])
    try:
        with open(path, encoding="utf-8") as f:
            specs = yaml.safe_load(f)
    except OSError as e:
        raise ConfigError(f"{path}: {e.strerror}") from e
    if not specs or (absent := [t for t in config.chain if t not in specs]):
        raise ConfigError(f"{path}: no sections for {specs and absent or 'any type'}")
    return specs


def below(folder: str) -> list[str]:
    """Markdown files below a folder and the folders that it links to, each real folder once."""
    out, met = [], set()
    for d, inner, names in os.walk(folder, followlinks=True):
        inner[:] = [x for x in inner if (real := os.path.realpath(os.path.join(d, x))) not in met and not met.add(real)]
        out += [os.path.join(d, f) for f in names if f.endswith(".md")]
    return out


def targets(config: Config, args: list[str] | None = None) -> list[str]:
    """Files named, or below folders named; without any, the declared ones that exist. Sorted, each real file once."""
    if not args:
        found = [s.path for s in config.files if os.path.isfile(os.path.join(config.base, s.path))]
    else:
        found = []
        for a in args:
            full = os.path.join(config.base, a)
            if os.path.isdir(full):
                found += [os.path.relpath(f, config.base) for f in below(full)]
            elif os.path.isfile(full):
                found.append(os.path.normpath(a))
            else:
                raise ConfigError(f"{a}: no such file")
    once = {os.path.realpath(os.path.join(config.base, f)): f for f in sorted(found, reverse=True)}
    return sorted(once.values())


def in_turn(config: Config, args: list[str]) -> list[str]:
    """The files in the order in which they, or the folders that hold them, are named; each real file once."""
    out: dict[str, str] = {}
    for f in (f for a in args for f in targets(config, [a])):
        out.setdefault(os.path.realpath(os.path.join(config.base, f)), f)
    return [*out.values()]


def open_corpus(spark: SparkSession, config: Config, args: list[str] | None = None) -> Corpus:
    """The documents, listed and read by Spark's tasks; an undeclared one has references and no definitions.

    Without arguments, the declared files; folders bring the Markdown below them; files are named one by one.
    """
    specs = [(d.path, is_glob(config.base, d.path), d.type, d.id_pattern) for d in config.declarations]
    patterns = [d.id_pattern for d in config.declarations]
    for a in args or []:
        if not os.path.exists(os.path.join(config.base, a)):
            raise ConfigError(f"{a}: no such file")
    folders = [os.path.normpath(a) for a in args or [] if os.path.isdir(os.path.join(config.base, a))]
    named = targets(config, [a for a in args if not os.path.isdir(os.path.join(config.base, a))]) if args and len(folders) < len(args) else []
    docs = documents(spark, config.base, specs, folders if args else None) if folders or not args else None
    if named:  # as many as were typed
        own = [(f, s.type if s else None, s.id_pattern if s else None, read(os.path.join(config.base, f))) for f in named for s in [config.spec_of(f)]]
        rows = spark.createDataFrame(own, "path string, type string, id_pattern string, text string")
        docs = rows if docs is None else docs.join(rows.select("path"), "path", "left_anti").unionByName(rows)
    return Corpus(docs, config.chain, patterns)


def read(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        return f.read()
