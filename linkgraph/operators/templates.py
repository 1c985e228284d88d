"""New documents from templates, and new projects from presets."""

from __future__ import annotations

import re

import yaml

#: Documents of one type: ``{ID n}`` is the n-th new identifier, ``{refs}`` the identifiers of the documents it builds on.
BUILT_IN = {
    "waterfall": {
        "requirements": ("R-{seq}", "# Requirements\n\n## {ID 1}: {feature}\n\n### Overview\n\n### Acceptance\n"),
        "design": ("D-{seq}", "# Design\n\n## {ID 1}: {feature}\n\n{refs}\n\n### Behaviour\n\n### Decisions\n"),
        "implementation": ("I-{seq}", "# Implementation\n\n## {ID 1}: {feature}\n\n{refs}\n\n### Steps\n"),
        "glossary": ("T-{seq}", "# Glossary\n\n## {ID 1}: Term\n\nTerm (another name). What it means.\n"),
    },
    "small": {
        "specification": ("S-{seq}", "# Specification\n\n## {ID 1}: {feature}\n\n### Overview\n"),
        "tests": ("V-{seq}", "# Tests\n\n## {ID 1}: {feature}\n\n{refs}\n\n### Procedure\n"),
    },
}


def names(preset: str, custom: dict[str, str] | None = None) -> list[str]:
    if preset not in BUILT_IN and not custom:
        raise ValueError(f"no preset {preset}; there are {', '.join(BUILT_IN)}")
    return sorted({*BUILT_IN.get(preset, {}), *(custom or {})})


def render(template: str, pattern: str, first: int, feature: str = "Feature", refs: list[str] | None = None) -> str:
    """A document with numbers from ``first`` on; mentions one line each."""
    text = re.sub(r"\{ID (\d+)\}", lambda m: pattern.replace("{seq}", str(first + int(m[1]) - 1)), template)
    text = text.replace("{feature}", feature).replace("{refs}", "\n".join(f"- {r}" for r in refs or []))
    return re.sub(r"\n{3,}", "\n\n", text)


def required(template: str) -> list[str]:
    """Titles below the identifiers of a rendered template, which become its required sections."""
    return [m[1].strip() for m in re.finditer(r"^###\s+(.*)$", template, re.MULTILINE)]


def project(preset: str, docs: str = "docs", kept: dict | None = None) -> dict[str, str]:
    """The two files of a new project; templates, rules, starts and levels of a configuration it replaces are kept."""
    if preset not in BUILT_IN:
        raise ValueError(f"no preset {preset}; there are {', '.join(BUILT_IN)}")
    chain = [t for t in BUILT_IN[preset] if t != "glossary"]
    old = {f["type"]: f for f in (kept or {}).get("files") or []}
    files, before = [], None
    for kind, (pattern, _) in BUILT_IN[preset].items():
        entry = {"path": f"{docs}/{kind}.md", "type": kind, "id_pattern": pattern}
        entry |= {k: old[kind][k] for k in ("id_start", "id_levels") if k in old.get(kind, {})}
        if before and kind in chain:
            entry["depends_on"] = [before]
        before = entry["path"] if kind in chain else before
        files.append(entry)
    config = {"preset": preset, "chain": chain, "files": files} | {k: kept[k] for k in ("templates", "rules") if kept and k in kept}
    sections = {kind: {"required": required(t), "order": True} for kind, (_, t) in BUILT_IN[preset].items()}
    dump = lambda x: yaml.safe_dump(x, sort_keys=False, allow_unicode=True)
    return {"linkgraph.yaml": dump(config), "sections.yaml": dump(sections)}
