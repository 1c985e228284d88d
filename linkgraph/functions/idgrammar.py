"""The grammar of identifiers: patterns with ``{seq}`` or a plain regular expression, and functions of an identifier.

Word boundaries are those of ASCII words, so an identifier may follow a letter of another script.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQ = r"\d+(?:\.\d+)*"
#: An ASCII word boundary for Java's and Python's regular expressions alike.
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def pattern_regex(pattern: str) -> str:
    """The expression of a pattern; ValueError if it is empty, holds ``{seq}`` twice or is no expression."""
    if not pattern:
        raise ValueError("an ID pattern must not be empty")
    if pattern.count("{seq}") > 1:
        raise ValueError(f"{pattern}: {{seq}} may stand once only")
    if "{seq}" in pattern:
        before, after = pattern.split("{seq}")
        body = re.escape(before) + SEQ + re.escape(after)
    else:
        body = f"(?:{pattern})" + r"(?:\.\d+)*"
    start = BOUNDARY if is_word(pattern[0]) else ""
    end = BOUNDARY if is_word(pattern[-1]) or pattern.endswith(("{seq}", r"\d", r"\d+")) else ""
    try:
        re.compile(body, re.ASCII)
    except re.error as e:
        raise ValueError(f"{pattern}: {e}") from e
    return f"{start}{body}{end}"


def pattern_prefix(pattern: str) -> str:
    """What stands before the number: before ``{seq}``, else before the first ``\\d``; else the pattern itself."""
    return re.split(r"\{seq\}" if "{seq}" in pattern else r"\\d", pattern)[0]


def format_id(pattern: str, n: int) -> str:
    return pattern.replace("{seq}", str(n)) if "{seq}" in pattern else f"{pattern_prefix(pattern)}{n}"


def after_prefix(pattern: str, c: Column) -> Column:
    """What follows the prefix; null for an identifier that does not begin with it."""
    prefix = pattern_prefix(pattern)
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1)))


def seq_of(pattern: str, ident: Column | str) -> Column:
    """Number of the top level after the prefix, null if there is none."""
    rest = after_prefix(pattern, F.col(ident) if isinstance(ident, str) else ident)
    return F.nullif(F.regexp_extract(rest, r"^(\d+)", 1), F.lit("")).try_cast("long")


def parent_id(pattern: str, ident: Column | str) -> Column:
    """The identifier without its last dotted part (any suffix stays), null if it has no dot or another prefix."""
    rest = after_prefix(pattern, F.col(ident) if isinstance(ident, str) else ident)
    shorter = F.regexp_replace(rest, r"^(\d+(?:\.\d+)*)\.\d+", "$1")
    return F.when(shorter != rest, F.concat(F.lit(pattern_prefix(pattern)), shorter))


def natural_key(ident: Column | str) -> Column:
    """An orderable array in which runs of digits compare as numbers: the number of digits goes before them."""
    runs = F.regexp_extract_all(F.col(ident) if isinstance(ident, str) else ident, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))).otherwise(x))


def natural_key_of(ident: str) -> list[str]:
    """The same outside Spark."""
    digits = lambda x: x.lstrip("0") or "0"
    return [f"{len(digits(x)):010}{digits(x)}" if x[0] in "0123456789" else x for x in re.findall(r"[0-9]+|[^0-9]+", ident)]
