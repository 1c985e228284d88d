r"""Search patterns of the linear-time dialect (no back-references, no look-around) as Java's regular expressions.

What the two dialects write alike but mean differently is written out: \\b, \\d, \\s and \\w are those of ASCII, ``$`` is
the end of the text, only a line feed ends a line, and what Java alone knows is refused.
"""

from __future__ import annotations

import re

from linkgraph.functions.idgrammar import BOUNDARY

#: The named classes of brackets, all of ASCII.
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
PERL = {"d": "0-9", "s": r"\t\n\f\r ", "w": "0-9A-Za-z_"}
CONTROLS = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B"}
MOST = 1000


def to_java(pattern: str) -> str:
    """The pattern for Java, in any letter case; ValueError if it is faulty, refers back, or looks around."""
    return "(?iud)" + Reader(pattern).whole()


#: The letters outside ASCII that are one with s and with k, whatever the case.
FOLDED = {"s": 0x17F, "k": 0x212A}


def other(spec: str) -> str:
    """What is in none of these ranges of ASCII, as ranges again: brackets within brackets mean different things."""
    inside = {c for c in range(128) if re.match(f"[{spec}]", chr(c))} | {code for c, code in FOLDED.items() if re.match(f"[{spec}]", c)}
    out, start = [], 0
    for c in [*sorted(inside), 0x110000]:
        if start < c:
            out.append(f"\\x{{{start:X}}}-\\x{{{c - 1:X}}}")
        start = c + 1
    return "".join(out)


def quoted(c: str) -> str:
    return c if c.isalnum() or not c.isascii() else f"\\x{ord(c):02X}"


class Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.names = pattern, 0, set()

    def fail(self, what: str) -> ValueError:
        return ValueError(f"{self.pattern}: {what} at {self.at}")

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        if len(out) < n:
            raise self.fail("the pattern ends too early")
        self.at += n
        return out

    def until(self, end: str) -> str:
        stop = self.pattern.find(end, self.at)
        if stop < 0:
            raise self.fail(f"{end} is missing")
        out, self.at = self.pattern[self.at : stop], stop + len(end)
        return out

    def whole(self) -> str:
        out = self.choice("i")
        if self.at < len(self.pattern):
            raise self.fail("a parenthesis too many")
        return out

    def choice(self, flags: str) -> str:
        """Alternatives up to a closing parenthesis; flags may change on the way, to the end of the group."""
        out, may_repeat = [], False
        while self.at < len(self.pattern) and self.peek() != ")":
            c = self.take()
            if c in "*+?" or c == "{" and self.counted():
                if not may_repeat:
                    raise self.fail("nothing to repeat")
                out.append(self.repeat(c))
                may_repeat = False
                continue
            may_repeat = True
            if c == "|":
                out.append("|")
                may_repeat = False
            elif c == "(":
                piece, flags, may_repeat = self.group(flags)
                out.append(piece)
            elif c == "[":
                out.append(self.bracket())
            elif c == "\\":
                out.append(self.escape())
            elif c == "$":
                out.append(r"(?=\n|\z)" if "m" in flags else r"\z")
            elif c == "^":
                out.append(r"(?:\A|(?<=\n))" if "m" in flags else r"\A")
            elif c == ".":
                out.append(r"[\s\S]" if "s" in flags else r"[^\n]")
            else:
                out.append(quoted(c))
        return "".join(out)

    def counted(self) -> bool:
        """Whether a number of times stands here; a brace without one is a plain character."""
        body, closed, _ = self.pattern[self.at :].partition("}")
        low, comma, high = body.partition(",")
        return bool(closed) and low.isdecimal() and low.isascii() and (not comma or not high or high.isdecimal() and high.isascii())

    def repeat(self, c: str) -> str:
        if c == "{":
            body = self.until("}")
            low, comma, high = body.partition(",")
            if max(int(low), int(high or 0)) > MOST or high and int(high) < int(low):
                raise self.fail("a bad number of times")
            c = f"{{{body}}}"
        lazy = self.take() if self.peek() == "?" else ""
        if self.peek() and self.peek() in "*+?" or self.peek() == "{" and self.pattern[self.at + 1 :] and self.doubled():
            raise self.fail("a repeat of a repeat")
        return c + lazy

    def doubled(self) -> bool:
        self.at += 1
        try:
            return self.counted()
        finally:
            self.at -= 1

    def group(self, flags: str) -> tuple[str, str, bool]:
        """A group, the flags that hold after it, and whether it is something to repeat."""
        own = flags
        if self.peek() == "?":
            self.take()
            if self.peek(2) == "P<" or self.peek() == "<" and self.peek(2) not in ("<=", "<!"):
                self.until("<")
                name = self.until(">")
                if not (name.isidentifier() or name.isalnum()) or not name.isascii() or name in self.names:
                    raise self.fail(f"a bad group name {name}")
                self.names.add(name)
            elif self.peek() == ":":
                self.take()
            else:
                own, whole = self.flags(flags)
                if whole:
                    return f"(?{'i' if 'i' in own else '-i'})", own, False
        inside = self.choice(own)
        if self.peek() != ")":
            raise self.fail("a parenthesis is open")
        self.take()
        case = "" if ("i" in own) == ("i" in flags) else "i" if "i" in own else "-i"
        return f"(?{case}:{inside})", flags, True

    def flags(self, flags: str) -> tuple[str, bool]:
        """Flags after ``(?``, and whether they hold for the rest of the group."""
        on, minus, set_ = True, False, set(flags)
        while (c := self.take()) not in ":)":
            if c == "-" and not minus:
                on, minus = False, True
            elif c in "imsU":
                (set_.add if on else set_.discard)(c)
            else:
                raise self.fail("look-around and the like are not known")
        return "".join(sorted(set_)), c == ")"

    def escape(self) -> str:
        c = self.take()
        if c in PERL or c.lower() in PERL:
            return f"[{'^' * c.isupper()}{PERL[c.lower()]}]"
        if c == "b":
            return BOUNDARY
        if c == "B":
            return f"(?!{BOUNDARY})"
        if c in "Az":
            return f"\\{c}"
        if c == "Q":
            body, _, _ = self.pattern[self.at :].partition("\\E")
            self.at = min(len(self.pattern), self.at + len(body) + 2)
            return "".join(map(quoted, body))
        return self.character(c)

    def character(self, c: str) -> str:
        """An escape that may stand in brackets too."""
        if c in CONTROLS:
            return CONTROLS[c]
        if c in "pP":
            name = self.until("}") if self.take() == "{" else self.pattern[self.at - 1]
            name = name.removeprefix("{")
            turned, name = name.startswith("^"), name.removeprefix("^")
            if not name.isascii() or not name.replace("_", "").isalpha():
                raise self.fail(f"a bad class {name}")
            return f"\\{'pP'[(c == 'P') != turned]}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if c == "x":
            code = self.until("}") if self.peek() == "{" else self.take(2)
            try:
                code = int(code.removeprefix("{"), 16)
            except ValueError:
                raise self.fail("a bad code") from None
            if code > 0x10FFFF:
                raise self.fail("a bad code")
            return f"\\x{{{code:X}}}"
        if c == "0" or c in "1234567" and self.peek() and self.peek() in "01234567":
            code = c
            while len(code) < 3 and self.peek() and self.peek() in "01234567":
                code += self.take()
            return f"\\x{{{int(code, 8):X}}}"
        if c.isalnum() or not c.isascii():
            raise self.fail(f"\\{c} is not known")
        return quoted(c)

    def bracket(self) -> str:
        out = ["[^" if self.peek() == "^" else "["]
        if out[0] == "[^":
            self.take()
        first = True
        while first or self.peek() != "]":
            first = False
            if self.peek(2) == "[:" and ":]" in self.pattern[self.at + 2 :]:
                self.take(2)
                name = self.until(":]")
                turned, name = name.startswith("^"), name.removeprefix("^")
                if name not in CLASSES:
                    raise self.fail(f"no class {name}")
                out.append(other(CLASSES[name]) if turned else CLASSES[name])
                continue
            low, single = self.member()
            if single and self.peek() == "-" and self.peek(2) not in ("-]", "-"):
                self.take()
                high, single = self.member()
                if not single or self.code(high) < self.code(low):
                    raise self.fail("a bad range")
                low = f"{low}-{high}"
            out.append(low)
        self.take()
        return "".join(out) + "]"

    def member(self) -> tuple[str, bool]:
        """One member of brackets, and whether it is a single character."""
        c = self.take()
        if c != "\\":
            return quoted(c), True
        c = self.take()
        if c.lower() in PERL:
            return (PERL[c] if c in PERL else other(PERL[c.lower()])), False
        return self.character(c), c not in "pP"

    @staticmethod
    def code(piece: str) -> int:
        if len(piece) == 1:
            return ord(piece)
        if piece.startswith("\\x"):
            return int(piece[2:].strip("{}"), 16)
        return ord({"\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t"}[piece])
