"""Text functions with Unicode white space, regular expressions and time formats in the style of the rule language."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of truth in rules.
TRUE_WORDS = ["true", "yes", "1", "on", "t", "y"]
FALSE_WORDS = ["false", "no", "0", "off", "f", "n", ""]

# Directives of time formats and their pattern letters here.
TIME_DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%z": "xx", "%%": "%"}


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space becomes one space; ends are kept."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def to_int(c: Column) -> Column:
    """Whole number of a stripped text; ``'3.7'`` is none. Null where it cannot be read."""
    return F.when(strip(c).rlike(r"^[+-]?[0-9]+$"), strip(c).try_cast("bigint"))


def to_float(c: Column) -> Column:
    """Number of a text, with nan and inf; null where it cannot be read."""
    return strip(c).try_cast("double")


def to_bool(c: Column) -> Column:
    """Truth of a text by its spelling; null where it has none."""
    w = F.lower(strip(c))
    return F.when(w.isin(TRUE_WORDS), F.lit(True)).when(w.isin(FALSE_WORDS), F.lit(False))


def time_pattern(directives: str) -> str:
    """Pattern letters for a format with % directives; literal letters are quoted."""
    out, i = "", 0
    while i < len(directives):
        two = directives[i : i + 2]
        if two in TIME_DIRECTIVES:
            out, i = out + TIME_DIRECTIVES[two], i + 2
        else:
            ch = directives[i]
            out, i = out + (f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch), i + 1
    return out


def to_date(c: Column, directives: str = "%Y-%m-%d") -> Column:
    """Date of a text by format; null where it does not fit."""
    return F.try_to_timestamp(strip(c), F.lit(time_pattern(directives))).cast("date")


def java_replacement(replacement: str) -> str:
    """A replacement with backslash groups in the notation with dollar signs."""
    escaped = replacement.replace("$", r"\$")
    return re.sub(r"\\g<(\d+)>|\\(\d+)", lambda m: "$" + (m[1] or m[2]), escaped)


def flagged(pattern: str, ignore_case: bool = False, multi_line: bool = False, dot_all: bool = False) -> str:
    flags = "".join(f for f, on in (("i", ignore_case), ("m", multi_line), ("s", dot_all)) if on)
    return f"(?{flags}){pattern}" if flags else pattern


def regex_extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def finite(c: Column) -> Column:
    """Zero for NaN and infinities, as results are shown."""
    d = c.cast("double")
    return F.when(F.isnan(d) | d.isin(float("inf"), float("-inf")), F.lit(0.0)).otherwise(d)


def identifier(name: str, prefix: str = "c_") -> str:
    """A name of letters, digits and underscores that does not begin with a digit."""
    bare = re.sub(r"[^a-zA-Z0-9_]", "_", str(name)) or "_"
    return prefix + bare if bare[0].isdigit() else bare


def identifiers(names: list[str], prefix: str = "c_") -> list[str]:
    """Distinct identifiers for a list of names; later ones that collide get _2, _3, ..."""
    out: list[str] = []
    for name in names:
        base = identifier(name, prefix)
        pick, k = base, 2
        while pick in out:
            pick, k = f"{base}_{k}", k + 1
        out.append(pick)
    return out
