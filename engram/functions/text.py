"""Tokens, query clean-up and snippets, all native expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "([\\p{L}\\p{N}]+)"
#: Latin letters with diacritics and the letters that they are folded to, by their Unicode decompositions.
_FOLDS = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}
FOLD_FROM, FOLD_TO = "".join(_FOLDS), "".join(_FOLDS.values())
#: Marks that stand after their letter in decomposed text.
MARKS = "[\\x{0300}-\\x{036F}]"


def tokens(text: Column, fold: bool = False) -> Column:
    """Lower-case runs of letters and digits; ``fold`` drops diacritics of Latin letters, composed or not."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(F.regexp_replace(F.translate(low, FOLD_FROM, FOLD_TO), MARKS, "") if fold else low, F.lit(TOKEN), F.lit(1))


def clean_query(query: Column) -> Column:
    """Only ASCII letters, digits, underscore and space stay; all else is deleted, not replaced."""
    return F.regexp_replace(query, "[^A-Za-z0-9_ ]", "")


def query_terms(query: str) -> list[dict[str, list]]:
    """A cleaned query as alternatives of required and excluded phrases.

    ``need`` holds phrases that must all occur; a group of ``without`` excludes a
    text in which all of the group's phrases occur.  Adjacent words belong together; NOT binds next, then AND, then OR.  A word
    with underscores is a phrase.  Raises ValueError where an operator lacks a side."""
    cleaned = re.sub("[^A-Za-z0-9_ ]", "", query)
    if not cleaned.strip():
        return []
    out = []
    for branch in re.split(r"(?:^|\s)OR(?=\s|$)", cleaned):
        need: list[list[str]] = []
        without: list[list[list[str]]] = []
        for part in re.split(r"(?:^|\s)AND(?=\s|$)", branch):
            first, *rest = (p.split() for p in re.split(r"(?:^|\s)NOT(?=\s|$)", part))
            if not first or not all(rest):
                raise ValueError(f"an operator lacks a side: {query!r}")
            need += [[w for w in word.lower().split("_") if w] for word in first]
            without += [[[w for w in word.lower().split("_") if w] for word in words] for words in rest]
        out.append({"need": [p for p in need if p], "without": without})
    return out


def byte_slice(value: Column, offset: Column, length: Column) -> Column:
    """The part of a text that a span in bytes names."""
    data = F.encode(value, "UTF-8")
    return F.decode(F.substring(data, (offset + 1).cast("int"), length.cast("int")), "UTF-8")


def has_extension(path: Column, extensions: str = "md,mdx") -> Column:
    """Whether the part after the last dot is in the comma list (ASCII case aside)."""
    wanted = [e for e in (x.strip(" ").lower() for x in extensions.split(",")) if e]
    dot = F.length(path) - F.instr(F.reverse(path), ".") + 1
    found = F.lower(F.substring(path, dot + 1, F.length(path)))
    return (F.instr(path, ".") > 0) & (dot > 1) & found.isin(wanted)
