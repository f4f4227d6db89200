"""Secret scans by assignment-aware lexing.

A small lexer reads source and configuration syntax (``name = literal``,
``"name": "literal"``, ``name := a + "b"``) into name-literal pairs, keeps the
constants it has seen so that ``password = KEY`` finds the literal behind
``KEY``, and scores each literal by how sensitive its target's name is and by
how random it looks.  Three fixed patterns (kinds ``assign``, ``access`` and
``hex``) run beside it and always stay.

A constant keeps references to the constants it is made of and a profile of fixed
size of its whole text, so ``x = x + x`` on every line costs no more than any other
line, however many different characters ``x`` holds.

Positions are code points, end exclusive.  A null or empty text has no spans;
repeated rows are scanned alike; columns besides the two named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "lex")
#: The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: How strongly a word of a target's name points to a secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "private": 0.4, "access": 0.3, "auth": 0.5, "bearer": 0.7, "key": 0.5, "signing": 0.3, "encryption": 0.3, "client": 0.1, "api": 0.4, "session": 0.2, "pin": 0.4, "salt": 0.4,
}
#: Literals that stand for a secret without being one.
PLACEHOLDERS = re.compile(r"(?i)^(true|false|null|none|nil|undefined|changeme|change_me|example|placeholder|todo|xxx+|\*+|\.+|-+|your[_-].*|<.*>|\$\{.*\}|%.*%)$")
THRESHOLD = 1.0
#: Characters up to which a whole value may be a placeholder, and where lengths stop growing.
SHORT, LONGEST = 200, 1e15
#: Kinds that a profile tells apart besides the ASCII characters.
OTHERS = 32
_PAIR = re.compile(r"""(?<![\w$])(?:"(?P<dq>[^"\n]{1,80})"|'(?P<sq>[^'\n]{1,80})'|(?P<id>[A-Za-z_$][\w$.\-]{0,80}))[ \t]*(?::=|=>|=(?![=>])|:(?![:/=]))[ \t]*""", re.ASCII)
_OPERAND = re.compile(r'''"(?P<dq>(?:[^"\\\n]|\\.)*)"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|(?P<name>[A-Za-z_$][\w$.]*)(?![\w+/=-])|(?P<bare>[^\s,;"'(){}\[\]]+)''', re.ASCII)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\|\||&)[ \t]*|[ \t]+(?=[\"'])")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def sensitivity(name: str) -> float:
    """Sum of the weights of the words of a name (snake, kebab, dotted or camel case)."""
    return sum(NAME_WEIGHTS.get(p.lower(), 0.0) for p in _NAME_PART.findall(name))


@dataclass(slots=True)
class Value:
    """What a name stands for: literals of its own, values it is made of, and a profile of the whole text.

    Only references to earlier values are kept, never their literals, so a text of
    ``n`` operands needs O(n) memory however its constants refer to each other."""

    name: str
    literals: list[tuple[int, int]]
    parts: list[Value]
    length: float = 0.0
    #: Share of each kind of character in the whole; never changed in place, so values may share one.
    shares: dict[str, float] = field(default_factory=dict)
    #: The whole itself, as long as it is short enough to stand for a placeholder.
    whole: str | None = ""

    def add(self, length: float, shares: dict[str, float], whole: str | None) -> None:
        total = self.length + length
        if not length:
            return
        if not self.length:
            self.shares = shares
        elif shares is not self.shares:
            mixed = {c: s * (self.length / total) for c, s in self.shares.items()}
            for c, s in shares.items():
                mixed[c] = mixed.get(c, 0.0) + s * (length / total)
            self.shares = mixed
        self.length = min(total, LONGEST)
        self.whole = self.whole + whole if self.whole is not None and whole is not None and len(self.whole) + len(whole) <= SHORT else None

    def add_literal(self, start: int, end: int, value: str) -> None:
        self.literals.append((start, end))
        self.add(len(value), profile(value), value)

    def add_value(self, value: Value) -> None:
        self.parts.append(value)
        self.add(value.length, value.shares, value.whole)


def profile(value: str) -> dict[str, float]:
    """Share of each character; other characters than ASCII fall into ``OTHERS`` kinds."""
    counts = Counter(value)
    if not value.isascii():
        counts, of = Counter(), counts
        for c, k in of.items():
            counts[c if c < "\x80" else chr(256 + ord(c) % OTHERS)] += k
    return {c: k / len(value) for c, k in counts.items()}


def entropy(shares: dict[str, float]) -> float:
    """Bits a character carries under the letter frequencies ``shares``."""
    return -sum(s * math.log2(s) for s in shares.values() if s > 0)


def randomness(length: float, shares: dict[str, float]) -> float:
    """0 for a plain word, about 1 for a long mixed literal."""
    classes = len({0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in shares})
    return min(1.0, length / 20) * 0.3 + min(1.0, entropy(shares) / 4) * 0.4 + (classes - 1) * 0.1


def pairs(text: str) -> Iterator[Value]:
    """The assignments of a text in order; names that stand for earlier constants are resolved."""
    constants: dict[str, Value] = {}
    at = 0
    while found := _PAIR.search(text, at):
        made = Value(found["id"] or found["dq"] or found["sq"], [], [])
        at = found.end()
        pieces: list[Value | tuple[int, int, str]] = []
        while operand := _OPERAND.match(text, at):
            kind = operand.lastgroup
            value = operand[kind]
            if kind == "name" and value in constants:
                pieces.append(constants[value])
            elif kind in ("dq", "sq") and value.startswith("${") and value[2:-1] in constants:
                pieces.append(constants[value[2:-1]])
            elif value and not (kind == "name" and pieces):
                pieces.append((operand.start(kind), operand.end(kind), value))
            if kind in ("name", "bare") and _PAIR.match(text, operand.start()):
                pieces = pieces[:-1]  # the next pair begins here
                break
            at = operand.end()
            joined = _JOIN.match(text, at)
            if not joined:
                break
            at = joined.end()
        for piece in pieces:
            made.add_value(piece) if isinstance(piece, Value) else made.add_literal(*piece)
        if pieces:
            if found["id"]:
                constants[made.name] = made
            yield made
        at = max(at, found.end())


def lexed(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals that score at least ``threshold``.

    A literal takes the best score of all sensitive targets that it reaches; values
    refer to earlier ones alone, so one walk backwards hands the scores down."""
    values = list(pairs(text))
    best: dict[int, tuple[float, int, str]] = {}
    for i, value in enumerate(values):
        weight = sensitivity(value.name)
        if weight and value.length >= 6 and not (value.whole and PLACEHOLDERS.match(value.whole)):
            score = weight + randomness(value.length, value.shares) - 0.4
            if score >= threshold:
                best[id(value)] = (score, -i, value.name)
    found: dict[tuple[int, int], tuple[float, int, str]] = {}
    for value in reversed(values):
        mark = best.get(id(value))
        if mark is None:
            continue
        for part in value.parts:
            best[id(part)] = max(best.get(id(part), mark), mark)
        for span in value.literals:
            if span[1] > span[0]:
                found[span] = max(found.get(span, mark), mark)
    return [(start, end, name, score) for (start, end), (score, _, name) in sorted(found.items())]


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, str, float]]:
    """All findings (kind, start, end, name, score) by start, then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int, str, float]] = []
    folded = text.lower()
    if any(k in folded for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), "", 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), "", 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        found += [("lex", start, end, name, score) for start, end, name, score in lexed(text, threshold)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: its key and its findings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "findings": [[dict(zip(("kind", "start", "end", "name", "score"), f, strict=True)) for f in scan(t, threshold)] for t in pdf["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")
    schema = f"key {kind}, findings array<struct<kind:string,start:long,end:long,name:string,score:double>>"
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every finding of ``text`` replaced by ``mark``; all rows and columns stay."""
    columns = docs.columns

    def clean(t: str | None) -> str | None:
        spans = scan(t, threshold)
        if not spans:
            return t
        out, at = [], 0
        for _, start, end, _, _ in spans:
            if end > at:
                out += [t[at:start], mark] if start >= at else []
                at = end
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([clean(t) for t in series], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    cleaned = F.pandas_udf(run, "string")(F.col(f"`{text}`"))
    return docs.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in columns])


def secret_scan(docs: DataFrame) -> DataFrame:
    """The digest that query op6 returns."""
    found = find_secrets(docs)
    spelled = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.transform(F.filter("findings", lambda x: x["kind"] != "lex"), spelled)
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", spelled), ",").alias("spans"),
        count("lex").alias("n_lex"),
    )
