"""Command line: verify, search, list, show, matrix, gaps, impact, graph, id, new, templates, init. Exit 1: a check failed; 2: anything else."""

from __future__ import annotations

import argparse
import os
import sys

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkgraph.functions.idgrammar import seq_of
from linkgraph.operators import graph as G
from linkgraph.operators import rules, scaffold, templates
from linkgraph.plans import render
from linkgraph.sources import config as C
from linkgraph.sources import corpus as K


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkgraph")
    top.add_argument("--config")
    sub = top.add_subparsers(dest="command", required=True)
    for name, formats, extra in (
        ("verify", ("text", "json"), ("--rules", "--strict")), ("search", ("text", "json"), ("pattern", "--type", "--limit", "--hits", "--fixed")), ("list", ("text", "tree", "json"), ("--type",)), ("show", (), ("ident",)),
        ("matrix", ("markdown", "json"), ("--from", "--filter")), ("gaps", ("text", "json"), ("--from",)), ("impact", ("text", "json"), ("ident", "--depth")), ("graph", (), ("--filter",)), ("id", (), ("--pattern", "--level", "--start", "--dry-run")),
    ):
        p = sub.add_parser(name)
        for x in extra:
            if x in ("--strict", "--fixed", "--dry-run"):
                p.add_argument(x, action="store_true")
            elif x in ("--limit", "--hits", "--depth", "--start", "--level"):
                p.add_argument(x, type=int, default=None if x == "--level" else 0)
            else:
                p.add_argument(x, **({"dest": "start_type"} if x == "--from" else {}))
        p.add_argument("files", nargs="+" if name == "id" else "*")
        if formats:
            p.add_argument("--format", type=lambda s: s.strip().lower(), choices=formats, default=formats[0])
        p.add_argument("-o", "--output")
    new = sub.add_parser("new")
    new.add_argument("type")
    new.add_argument("--output", "-o")
    new.add_argument("--based-on", nargs="*", default=[])
    new.add_argument("--feature", default="Feature")
    new.add_argument("--start", type=int, default=0)
    new.add_argument("--force", action="store_true")
    new.add_argument("--dry-run", action="store_true")
    sub.add_parser("templates")
    start = sub.add_parser("init")
    start.add_argument("--preset", required=True)
    start.add_argument("--docs-dir", default="docs")
    start.add_argument("--force", action="store_true")
    return top


def write_project(args: argparse.Namespace) -> str:
    """The files of a new project in the working folder; an existing configuration needs --force."""
    old = None
    if os.path.exists("linkgraph.yaml"):
        if not args.force:
            raise ValueError("linkgraph.yaml exists; use --force")
        with open("linkgraph.yaml", encoding="utf-8") as f:
            old = yaml.safe_load(f)
    files = templates.project(args.preset, args.docs_dir, old)
    scaffold.write_all(files)
    return "".join(f"{f}\n" for f in files)


def new_document(corpus: K.Corpus, config: C.Config, args: argparse.Namespace) -> str:
    """A document of a type from the project's own template or the preset's; its numbers go on from the corpus."""
    spec = next((s for s in config.files if s.type == args.type), None)
    built = templates.BUILT_IN.get(config.preset, {}).get(args.type)
    if args.type in config.templates:
        with open(os.path.join(config.base, config.templates[args.type]), encoding="utf-8") as f:
            built = (spec.id_pattern if spec else "", f.read())
    if built is None:
        raise ValueError(f"no template for {args.type}")
    pattern = spec.id_pattern if spec else built[0]
    top = corpus.definitions.where(F.col("id_pattern") == pattern).agg(F.max(seq_of(pattern, "id"))).first()[0] or 0
    mentioned = corpus.definitions.where(F.col("path").isin([os.path.normpath(p) for p in args.based_on])).select("id").distinct()
    refs = sorted((r.id for r in mentioned.collect()), key=render.natural_key_of)
    text = templates.render(built[1], pattern, max(top + 1, args.start, spec.id_start if spec else 1), args.feature, refs)
    if args.output and os.path.exists(args.output) and not args.force:
        raise ValueError(f"{args.output} exists; use --force")
    if args.dry_run:
        args.output = None
    return text


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[str, int]:
    if args.command == "init":
        return write_project(args), 0
    config = C.load(C.discover(args.config), check_rules=args.command == "verify")
    if args.command == "templates":
        return "".join(f"{n}\n" for n in templates.names(config.preset, config.templates)), 0
    if args.command == "new":
        return new_document(C.open_corpus(spark, config), config, args), 0
    corpus = C.open_corpus(spark, config, args.files)
    known_types = {s.type for s in config.files}
    if getattr(args, "type", None) and args.type not in known_types:
        raise ValueError(f"unknown type {args.type}")
    split = lambda s: [x.strip() for x in (s or "").split(",") if x.strip()]
    if args.command == "verify":
        only = split(args.rules) or [n for n, o in config.rules.items() if o["enabled"]]
        options = {"id_uniqueness": {"check_sequence": config.rules["id_uniqueness"]["check_sequence"]}, "term_consistency": {"kind": config.rules["term_consistency"]["glossary_type"]}, "dep_order": {"depends": config.depends(), "empty": config.empty_globs(), "missing": config.missing_files()}}
        if "required_sections" in only:
            options["required_sections"] = {"specs": C.section_specs(config)}
        text, bad = render.verification(rules.verify(corpus, options, only, args.strict), args.format, corpus.docs.count(), only)
        return text, int(bad)
    if args.command == "search":
        rows = sorted(K.search(corpus, args.pattern, args.type, args.limit, args.hits, args.fixed).collect(), key=lambda r: r.rank)  # no more than the limit
        if args.format == "json":
            shown = [{k: v for k, v in r.asDict(True).items() if k not in ("rank", "total", "truncated")} for r in rows]
            return render.as_json({"matches": shown, "total": rows[0].total if rows else 0, "truncated": bool(rows and rows[0].truncated)}), 0
        return "".join(f"{r.path}: {r.id or '-'} ({r.n_hits})\n" + "".join(f"  {h.line}: {h.text}\n" for h in r.hits) for r in rows), 0
    graph = corpus.graph
    if args.command == "list":
        found = sorted(K.index(corpus, args.type).collect(), key=lambda r: render.natural_key_of(r.id))
        if args.format == "json":
            files = sorted(r.path for r in (corpus.docs if not args.type else corpus.docs.where(F.col("type") == args.type)).select("path").collect())
            return render.as_json({"entries": [r.asDict(True) for r in found], "files": files}), 0
        if args.format == "tree":
            paths = sorted({r.path for r in found})
            return "".join(f"{p}\n" + "".join(f"  {r.id} {r.title}\n" for r in found if r.path == p) for p in paths), 0
        return "".join(f"{r.id} {r.title} ({r.path}:{r.line})\n" for r in found), 0
    if args.command == "show":
        row = K.section(corpus, args.ident).first()
        if row is None:
            raise ValueError(f"{args.ident} is not defined")
        return row.body, 0
    if args.command == "matrix":
        return render.matrix(graph, args.start_type, args.format, split(args.filter)), 0
    if args.command == "gaps":
        text, bad = render.gaps(graph, args.start_type, args.format)
        return text, int(bad)
    if args.command == "impact":
        return render.impact(graph, args.ident, args.depth, args.format), 0
    if args.command == "graph":
        keep = split(args.filter)
        G.check_ids(graph, keep)
        nodes = graph.nodes.where(F.col("id").isin(keep)) if keep else graph.nodes
        return render.mermaid(nodes, G.subgraph(graph, nodes)), 0
    spec = next((s for f in args.files if (s := config.spec_of(f))), None)
    pattern = args.pattern or (spec and spec.id_pattern)
    if not pattern or spec and args.pattern and args.pattern != spec.id_pattern:
        raise ValueError("no pattern is declared for the file, or another one")
    whole = C.open_corpus(spark, config)  # numbers go on from all declared documents
    found = scaffold.assignments(whole, pattern, C.in_turn(config, args.files), args.level, max(args.start, spec.id_start if spec else 1), spec.id_levels if spec else ())
    text = "".join(f"{r.path}:{r.line}: {r.id}\n" for r in found.orderBy("path", "line").collect())
    if not args.dry_run:
        scaffold.write_all({os.path.join(config.base, p): t for p, t in scaffold.rewritten(whole, found).items()})
    return text, 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        text, code = run(spark or SparkSession.builder.appName("linkgraph").getOrCreate(), args)
    except SystemExit as e:
        return 2 if e.code else 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if getattr(args, "output", None):
        scaffold.write_all({args.output: text})
    else:
        sys.stdout.write(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
