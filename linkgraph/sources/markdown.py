"""A small CommonMark block scanner: headings, code and prose of one document.

It knows block quotes and list items as containers, ATX and setext headings, fenced and indented code, HTML blocks,
thematic breaks, paragraphs with lazy continuation, and inline code spans. Nothing is rendered.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields
from string import ascii_letters

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
OPENING = re.compile(r"(#{1,6})[ \t]+")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}([-_*])[ \t]*(?:\1[ \t]*){2,}$")
ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
HTML = re.compile(r" {0,3}<(?:!--|\?|![A-Z]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
RUN = re.compile("`+")
UNDERLINE = re.compile(r"\s*(=+|-+)\s*$")
TAG = re.compile(r"</?[A-Za-z][^<>`]*(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*>|<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*>")


@dataclass(slots=True)
class Block:
    """line and column where each line of the block begins, from 1 and 0; raw text of each."""

    kind: str
    lines: list[tuple[int, int, str]] = field(default_factory=list)
    level: int = 0
    fence: str = ""
    info: str = ""
    first: int = 0


def atx(no: int, at: int, start: int, text: str, level: int) -> Block:
    text = text.strip()
    text = text if text.strip("#") else ""
    return Block("heading", [(no if text else 1, at + start, text)], level, first=no)


#: How the lines of a plain document begin: it has paragraphs and headings of one line only.
PLAIN = frozenset(("", "#", *ascii_letters))


def plain_headings(lines: list[str]) -> Iterator[Block]:
    """The headings of a document whose lines begin as in PLAIN."""
    for no, raw in enumerate(lines, 1):
        if raw[:1] == "#" and (m := (ATX if raw[-1] in "# \t" else OPENING).match(raw)):
            at = (m.start(2) if m[2] else 0) if m.re is ATX else m.end()
            yield atx(no, 0, at, (m[2] or "") if m.re is ATX else raw[at:], len(m[1]))


def blocks(lines: list[str]) -> Iterator[Block]:
    """The blocks one after the other, each when it has ended."""
    out: list[Block] = []  # what has ended, and the open leaf
    containers: list[int] = []  # -1: block quote, else the indent of a list item
    leaf: Block | None = None

    def close():
        nonlocal leaf
        if leaf is not None:
            if leaf.kind == "indented":
                while leaf.lines and not leaf.lines[-1][2].strip():
                    leaf.lines.pop()
            leaf = None

    for no, raw in enumerate(lines, 1):
        if len(out) > 1 or out and leaf is None:
            yield from out[: len(out) - (leaf is not None)]
            del out[: len(out) - (leaf is not None)]
        if not containers and (leaf is None or leaf.kind == "paragraph"):  # most lines: nothing but a paragraph or a heading
            c = raw[:1]
            if not c:
                leaf = None
                continue
            if c.isalpha():
                if leaf is None:
                    leaf = Block("paragraph", first=no)
                    out.append(leaf)
                leaf.lines.append((no, 0, raw.strip()))
                continue
            if c == "#" and raw[-1] not in "# \t" and (m := OPENING.match(raw)):
                leaf = None
                out.append(atx(no, 0, m.end(), raw[m.end() :], len(m[1])))
                continue
        line, at, matched = raw.expandtabs(4) if "\t" in raw[: len(raw) - len(raw.lstrip())] else raw, 0, 0
        for c in containers:
            rest = line[at:]
            if c < 0:
                m = re.match(r" {0,3}> ?", rest)
                if not m:
                    break
                at += m.end()
            elif rest.strip() and len(rest) - len(rest.lstrip(" ")) < c:
                break
            elif rest.strip():
                at += c
            matched += 1
        rest = line[at:]
        if matched < len(containers):
            opens = RULE.match(rest) or FENCE.match(rest) or ATX.match(rest) or re.match(r" {0,3}>", rest) or ITEM.match(rest) or HTML.match(rest)
            if leaf is not None and leaf.kind == "paragraph" and rest.strip() and not opens:
                leaf.lines.append((no, at, rest))
                continue
            close()
            del containers[matched:]
        if leaf is not None and leaf.kind == "fenced":
            m = FENCE.match(rest)
            if m and m[1][0] == leaf.fence[0] and len(m[1]) >= len(leaf.fence) and not m[2].strip():
                close()
            else:
                leaf.lines.append((no, at, rest))
            continue
        if leaf is not None and leaf.kind == "html":
            if rest.strip():
                leaf.lines.append((no, at, rest))
                continue
            close()
        while True:
            m = re.match(r" {0,3}> ?", rest)
            if m:
                close()
                containers.append(-1)
                at += m.end()
                rest = line[at:]
                continue
            m = ITEM.match(rest)
            if m and not RULE.match(rest):
                after = rest[m.end() :]
                if leaf is not None and leaf.kind == "paragraph" and (not after.strip() or m[3] and int(m[3]) != 1):
                    break
                close()
                space = len(after) - len(after.lstrip(" "))
                width = m.end() + (space if 0 < space <= 4 and after.strip() else 1)
                containers.append(width)
                at += min(width, len(rest))
                rest = line[at:]
                continue
            break
        if not rest.strip():
            if leaf is not None and leaf.kind == "indented":
                leaf.lines.append((no, at, rest))
            else:
                close()
            continue
        if leaf is not None and leaf.kind == "paragraph":
            m = SETEXT.match(rest)
            if m:
                leaf.kind, leaf.level = "heading", 1 if m[1][0] == "=" else 2
                leaf = None
                continue
        if rest.startswith("    ") and not (leaf is not None and leaf.kind == "paragraph"):
            if leaf is None or leaf.kind != "indented":
                close()
                leaf = Block("indented", first=no)
                out.append(leaf)
            leaf.lines.append((no, at + 4, rest[4:]))
            continue
        if leaf is not None and leaf.kind == "indented":
            close()
        m = FENCE.match(rest)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            close()
            leaf = Block("fenced", fence=m[1], info=m[2].strip(), first=no)
            out.append(leaf)
            continue
        m = ATX.match(rest)
        if m:
            close()
            out.append(atx(no, at, m.start(2) if m[2] else 0, m[2] or "", len(m[1])))
            continue
        if RULE.match(rest):
            close()
            continue
        if HTML.match(rest) and leaf is None:
            leaf = Block("html", [(no, at, rest)], first=no)
            out.append(leaf)
            continue
        if leaf is None:
            leaf = Block("paragraph", first=no)
            out.append(leaf)
        leaf.lines.append((no, at + len(rest) - len(rest.lstrip()), rest.strip()))
    yield from out


def inline_code(text: str) -> list[tuple[int, int]]:
    """Content ranges of the code spans of a paragraph; tags and escaped backticks do not open one."""
    spans, i = [], 0
    runs = {m.start(): m.end() for m in re.finditer("`+", text)}
    of_size: dict[int, list[int]] = {}
    for a, b in runs.items():
        of_size.setdefault(b - a, []).append(a)
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 2
        elif c == "<" and (m := TAG.match(text, i)):
            i = m.end()
        elif c == "`":
            end = runs.get(i) or RUN.match(text, i).end()
            same = of_size.get(end - i, [])
            k = bisect_left(same, end)
            if k < len(same):
                spans.append((end, same[k]))
                i = runs[same[k]]
            else:
                i = end
        else:
            i += 1
    return spans


@dataclass(slots=True)
class Heading:
    ordinal: int
    level: int
    text: str
    title: str
    id: str | None
    line: int
    end_line: int = 0
    has_body: bool = False
    parent_ordinal: int | None = None
    id_ancestor: str | None = None
    n_children: int = 0
    lineage: Sequence[str] = ()


class Parse:
    """One document: its headings are held, its mentions and its prose are made one by one from its lines."""

    HEADING = tuple(f.name for f in fields(Heading))
    REF = ("seq", "id", "line", "owner", "owner_line")
    PROSE = ("line", "text", "raw", "owner")

    def __init__(self, text: str, pattern: str | None):
        """pattern: regular expression of the identifiers that the document defines."""
        self.lines = text.split("\n")
        last = self.lines.pop()
        if "\r" in text:
            self.lines = [x.removesuffix("\r") for x in self.lines]
        if last:
            self.lines.append(last)
        first = text.find("\n")
        self.newline = "\r\n" if first > 0 and text[first - 1] == "\r" else "\n"
        self.code: dict[int, list[tuple[int, int]]] = {}
        self.blocked: set[int] = set()
        self.headings: list[Heading] = []
        self.plain = "\r" not in text and "`" not in text and PLAIN.issuperset({x[:1] for x in self.lines})
        self._outline(re.compile(pattern, re.ASCII) if pattern else None)

    def _outline(self, own: re.Pattern | None) -> None:
        lines, code, headings = self.lines, self.code, self.headings
        for b in plain_headings(lines) if self.plain else blocks(lines):
            if b.kind in ("fenced", "indented"):
                for no, at, part in b.lines:
                    code.setdefault(no, []).append((at, at + len(part)))
                if b.lines:
                    wide = b.kind == "fenced"
                    self.blocked.update(range(b.lines[0][0] - wide, b.lines[-1][0] + wide + 1))
                elif b.info:
                    self.blocked.update((b.first, b.first + 1))
            elif b.kind in ("paragraph", "heading"):
                joined = "" if self.plain else "\n".join(p for _, _, p in b.lines)
                for a, z in inline_code(joined) if "`" in joined else ():
                    start = 0
                    for no, at, part in b.lines:
                        x, y = max(a, start), min(z, start + len(part))
                        if x < y:
                            code.setdefault(no, []).append((at + x - start, at + y - start))
                        start += len(part) + 1
                if b.kind == "heading":
                    no, _, first = b.lines[0]
                    m = own.match(first) if own else None
                    ident = m[0] if m else None
                    title = first[len(ident) :].lstrip(":：-–—　 ").strip() if ident else first
                    headings.append(Heading(len(headings), b.level, first, title, ident, no))
        open_: list[Heading] = []  # headings that enclose the next one, by rising level
        for k, h in enumerate(headings):
            while open_ and open_[-1].level >= h.level:
                open_.pop().end_line = h.line - 1
            above = open_[-1] if open_ else None
            h.end_line = len(lines)
            if above:
                # from the nearest up; siblings share it
                last = headings[k - 1]
                h.lineage = last.lineage if last.parent_ordinal == above.ordinal else (above.id, *above.lineage) if above.id else above.lineage
                h.parent_ordinal, h.id_ancestor = above.ordinal, h.lineage[0] if h.lineage else None
                above.n_children += 1
            open_.append(h)
            at, end = h.line, headings[k + 1].line - 1 if k + 1 < len(headings) else len(lines)
            if at < end and not self.plain and UNDERLINE.match(lines[at]):
                at += 1
            while at < end and (not lines[at] or lines[at].isspace()):
                at += 1
            h.has_body = at < end
        self.named = [h for h in headings if h.id]
        self.starts = [h.line for h in self.named]
        # the one that encloses the line of each heading with an ID
        self.outer: list[int] = []
        stack: list[int] = []
        for k, h in enumerate(self.named):
            while stack and self.named[stack[-1]].end_line < h.line:
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(k)

    def owner(self, no: int) -> Heading | None:
        """The nearest heading with an ID that encloses a line."""
        k = bisect_right(self.starts, no) - 1
        while k >= 0 and self.named[k].end_line < no:
            k = self.outer[k]
        return self.named[k] if k >= 0 else None

    def outline(self) -> Iterator[tuple]:
        """HEADING of each heading."""
        for h in self.headings:
            yield h.ordinal, h.level, h.text, h.title, h.id, h.line, h.end_line, h.has_body, h.parent_ordinal, h.id_ancestor, h.n_children, h.lineage

    def refs(self, known: list[tuple[str, re.Pattern]]) -> Iterator[tuple]:
        """REF of each mention, in text order. known: regular expressions, each with what all its matches begin with."""
        heads, seq = {h.line: h.id for h in self.named}, 0
        for no, line in enumerate(self.lines, 1):
            found = []
            for part, p in known:
                if not part:
                    found += [(m.start(), m[0]) for m in p.finditer(line)]
                    continue
                at = line.find(part)
                while at >= 0:
                    m = p.match(line, at)
                    if m:
                        found.append((at, m[0]))
                    at = line.find(part, m.end() if m else at + 1)
            if not found:
                continue
            own, code, h = heads.get(no), self.code.get(no, ()), self
            for start, ident in sorted(found) if len(found) > 1 else found:
                if code and any(a <= start < z for a, z in code):
                    continue
                if own != ident:
                    h = self.owner(no) if h is self else h
                    yield seq, ident, no, h and h.id, h and h.line
                seq += 1

    def prose(self, holding: Sequence[str] | None = None) -> Iterator[tuple]:
        """PROSE of each line that is no code block, its code spans blank; holding: only of lines that hold one of these, as they stand."""
        for no, whole in enumerate(self.lines, 1):
            if no in self.blocked or holding is not None and not any(x in whole for x in holding):
                continue
            line = whole
            for a, z in self.code.get(no, ()):
                line = line[:a] + " " * (z - a) + line[z:]
            h = self.owner(no)
            yield no, line.rstrip("\r"), whole.strip(), h and h.id


def parse(text: str, pattern: str | None, known: list[str]) -> dict:
    """Tables of one document as lists of dicts. ``pattern`` and ``known`` are regular expressions of identifiers."""
    doc = Parse(text, pattern)
    table = lambda names, rows: [dict(zip(names, row, strict=True)) for row in rows]
    found = doc.refs([("", re.compile(p, re.ASCII)) for p in known])
    return {"n_lines": len(doc.lines), "newline": doc.newline, "headings": table(Parse.HEADING, doc.outline()), "refs": table(Parse.REF, found), "prose": table(Parse.PROSE, doc.prose())}
