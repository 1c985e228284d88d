"""Reports as text, JSON, Markdown and Mermaid, from results that are small enough to read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from linkgraph.functions.idgrammar import natural_key_of
from linkgraph.operators import graph as G
from linkgraph.operators import rules

GLYPHS = {G.COMPLETE: "✓", G.PARTIAL: "△", G.MISSING: "✗"}
MEANINGS = {G.COMPLETE: "every walk reaches the last stage", G.PARTIAL: "some walks end before it", G.MISSING: "no walk leads on"}


def as_json(value) -> str:
    """Two-space indents and a line end; a missing list is empty, never null."""
    return json.dumps(value, ensure_ascii=False, indent=2, default=lambda r: r.asDict(recursive=True)) + "\n"


def placed(row) -> dict:
    """An identifier with its title and where it is defined."""
    return {"id": row.id, "title": row.title, "file": row.path, "line": row.line}


def matrix(graph: G.LinkGraph, start: str | None = None, kind: str = "markdown", ids: list[str] | None = None) -> str:
    """The rows of all roots, or of those that are named."""
    stage, only = G.stage_of(graph, start), G.chosen_roots(graph, start, ids or [])
    found = G.matrix_status(graph, start, only)
    rows = sorted(found.collect(), key=lambda r: natural_key_of(r.id))
    summary = G.matrix_summary(found).first().asDict()
    keep = (lambda df: df) if only is None else (lambda df: df.join(only, "id", "left_semi"))
    if kind == "json":
        paths: dict[str, list] = {}
        for r in keep(G.matrix_paths(graph, start)).collect():
            paths.setdefault(r.id, []).append(list(r.path))
        ordered = lambda x: sorted(x, key=lambda p: [natural_key_of(i) for i in p])
        return as_json({"chain": graph.chain[stage:], "rows": [{**placed(r), "paths": ordered(paths.get(r.id, [])), "status": r.status} for r in rows], "summary": summary})
    ids = {(r.id, r.stage): r.ids for r in G.stage_ids(graph, start, only).collect()}
    later = graph.chain[stage + 1 :]
    lines = [f"| {' | '.join([*graph.chain[stage:], 'status'])} |", f"|{'---|' * (len(later) + 2)}"]
    lines += [f"| {' | '.join([r.id, *(ids.get((r.id, s)) or '-' for s in later), GLYPHS[r.status]])} |" for r in rows]
    return "\n".join(lines) + "\n"


def gaps(graph: G.LinkGraph, start: str | None = None, kind: str = "text") -> tuple[str, bool]:
    """The report, and whether there is a gap."""
    rows = sorted(G.gaps(graph, start).collect(), key=lambda r: natural_key_of(r.id))
    summary = G.matrix_summary(G.matrix_status(graph, start)).first().asDict()
    if kind == "json":
        return as_json({"items": [{**placed(r), "status": r.status} for r in rows], "summary": summary}), bool(rows)
    broken = sorted(f"{r.branch} ({r.missing} missing)" for r in G.broken_branches(graph, start).collect())
    legend = [f"{GLYPHS[s]} {MEANINGS[s]}" for s in (G.PARTIAL, G.MISSING)]
    lines = ["Gaps", *(f"  {GLYPHS[r.status]} {r.id} {r.status}: {r.title} ({r.path}:{r.line})" for r in rows), *legend, "Broken branches", *(f"  {b}" for b in broken), f"Covered: {summary['complete']} of {summary['total']} ({summary['coverage_percent']}%)"]
    return "\n".join(lines) + "\n", bool(rows)


def impact(graph: G.LinkGraph, ident: str, depth: int = 0, kind: str = "text") -> str:
    rows = sorted(G.impact(graph, ident, depth).join(graph.nodes.select("id", "path", "line", "title"), "id").collect(), key=lambda r: (r.distance, natural_key_of(r.id)))
    parts = {"direct": [r for r in rows if r.distance == 1], "indirect": [r for r in rows if r.distance > 1]}
    if kind == "json":
        return as_json({"id": ident, **{k: [placed(r) for r in v] for k, v in parts.items()}, "summary": {k: len(v) for k, v in parts.items()}})
    return "".join(f"{k} ({len(v)})\n" + "".join(f"  {r.id} {r.title} ({r.path}:{r.line})\n" for r in v) for k, v in parts.items())


def mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    """A flow chart with a box for each type, solid arrows for references and dotted ones for containment."""
    escape = lambda s: s.replace('"', "&quot;").replace("[", "&#91;").replace("]", "&#93;")
    rows = sorted(nodes.collect(), key=lambda r: r.pos)
    number = {r.id: i for i, r in enumerate(rows)}
    types = sorted(dict.fromkeys(r.type or "" for r in rows), key=lambda t: not t)
    lines = ["flowchart LR"]
    for i, t in enumerate(types):
        lines += [f'  subgraph s{i}["{escape(t)}"]', *(f'    n{number[r.id]}["{escape(f"{r.id} {r.title}".strip())}"]' for r in rows if (r.type or "") == t), "  end"]
    for e in sorted(edges.collect(), key=lambda e: (number[e.src], e.dst)):
        lines.append(f"  n{number[e.src]} {'-->' if e.kind == G.REFERENCE else '-.->'} n{number[e.dst]}")
    return "\n".join(lines) + "\n"


def verification(issues: DataFrame, kind: str = "text", files: int = 0, only: list[str] | None = None) -> tuple[str, bool]:
    """The report rule by rule with each rule's tally and the number of files read, and whether there is an error."""
    rows = rules.in_order(issues)
    errors, warnings = ([r for r in rows if r.severity == s] for s in ("error", "warning"))
    tally = {n: {"errors": sum(r.rule == n for r in errors), "warnings": sum(r.rule == n for r in warnings)} for n in rules.RULES if only is None or n in only}
    if kind == "json":
        shown = lambda found: [{k: v for k, v in r.asDict().items() if k != "place"} for r in found]
        return as_json({"errors": shown(errors), "warnings": shown(warnings), "rules": [{"rule": n, **t} for n, t in tally.items()], "summary": {"files": files, "errors": len(errors), "warnings": len(warnings)}}), bool(errors)
    lines = [f"{r.file}:{r.line}: {r.severity}: {r.message} [{r.kind}]" for r in rows]
    lines += [f"{n}: {t['errors']} errors, {t['warnings']} warnings" for n, t in tally.items()]
    return "\n".join([*lines, f"{files} files, {len(errors)} errors, {len(warnings)} warnings"]) + "\n", bool(errors)
