"""Reduce markdown to the text that is indexed.

Line rules come first (open tag, code fence, blank line, rule, table rule,
quote, heading or list marker), then the inline rules of what is left.  No
escapes and no entities are decoded.  State runs across lines, so this is one
Arrow-batched function; everything around it stays native.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_BLANK = re.compile(r"[ \t]*")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}")
_QUOTE = re.compile(r" {0,3}(?:> ?)*")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+|$)")
_LIST = re.compile(r" {0,3}(?:[-*+]|[0-9]+[.)])[ \t]+")
_PLAIN = re.compile(r"[^<!\[`*_~|]+")
_TICKS = re.compile("`+")
_BRACKET = re.compile(r"[\[\]]")
_MARKS = re.compile(r"\*+|_+")


def _brackets(text: str) -> dict[int, int]:
    """Position of each opening bracket that is closed -> that of its closing one."""
    open_at: list[int] = []
    pairs: dict[int, int] = {}
    for found in _BRACKET.finditer(text):
        if found[0] == "[":
            open_at.append(found.start())
        elif open_at:
            pairs[open_at.pop()] = found.start()
    return pairs


def _tick_runs(text: str) -> dict[int, list[int]]:
    """Starts of the runs of backticks, by length."""
    runs: dict[int, list[int]] = {}
    for found in _TICKS.finditer(text):
        runs.setdefault(len(found[0]), []).append(found.start())
    return runs


def _inline(text: str, skip_html: bool) -> tuple[str, bool]:
    """Inline text without its marks, and whether a tag is left open."""
    out: list[str] = []
    at = ticks_end = 0
    pairs, runs = _brackets(text), _tick_runs(text)
    while at < len(text):
        if plain := _PLAIN.match(text, at):
            out.append(plain[0])
            at = plain.end()
            continue
        char = text[at]
        if char == "<" and skip_html:
            end = text.find(">", at + 1)
            if end < 0:
                return "".join(out), True
            at = end + 1
            continue
        opens = at if char == "[" else at + 1 if text.startswith("![", at) else -1
        if (end := pairs.get(opens, -1)) >= 0:
            out.append(text[opens + 1 : end])
            at = end + 1
            if text[at : at + 1] in ("(", "["):
                stop = text.find(")" if text[at] == "(" else "]", at + 1)
                at = stop + 1 if stop >= 0 else len(text)
            continue
        if char == "`":
            if at >= ticks_end:
                ticks_end = _TICKS.match(text, at).end()
            size = ticks_end - at
            like = runs.get(size, [])
            close = bisect_left(like, ticks_end)
            if close < len(like):
                out.append(text[ticks_end : like[close]])
                at = like[close] + size
                continue
        if marks := _MARKS.match(text, at):
            out.append(marks[0] if len(marks[0]) > 3 else "")
            at = marks.end()
        elif text.startswith("~~", at):
            at += 2
        else:
            out.append("" if char == "|" else char)
            at += 1
    return "".join(out), False


def strip(text: str, skip_html: bool = True) -> str:
    """``text`` without markdown marks."""
    out: list[str] = []
    fence: re.Pattern | None = None
    in_tag = False
    for line in text.removesuffix("\n").split("\n") if text else ():
        if in_tag:
            _, closed, line = line.partition(">")
            in_tag = not closed
            if not line or in_tag:
                continue
        if fence is not None:
            if fence.fullmatch(line):
                fence = None
            else:
                out.append(line + "\n")
            continue
        if opened := _OPEN_FENCE.match(line):
            fence = re.compile(rf" {{0,3}}{re.escape(opened[1][0])}{{{len(opened[1])},}}[ \t]*")
            continue
        if _BLANK.fullmatch(line):
            out.append("\n")
            continue
        if _RULE.fullmatch(line) or ("-" in line and not line.strip("-|: \t")):
            continue
        line = line[_QUOTE.match(line).end() :]
        if heading := _HEADING.match(line):
            line = line[heading.end() :]
            line = line.rstrip(" \t").rstrip("#").rstrip(" \t")
        elif marker := _LIST.match(line):
            line = line[marker.end() :]
        body, in_tag = _inline(line, skip_html)
        body = body.rstrip(" ")
        if body or not in_tag:
            out.append(body + "\n")
    return "".join(out).rstrip("\n ")


def strip_markdown(text: Column, skip_html: bool = True) -> Column:
    """Column of stripped texts; null stays null."""

    @F.pandas_udf("string")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda t: strip(t, skip_html), na_action="ignore")

    return run(text)
