"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row (name, measure, least, most).  ``compile_rules`` turns the
table into one Boolean column over measures of length, symbols, stop words and
lines, all of them built-in expressions: no user function runs.

Defined results: a null or empty text has no words and fails the base; repeated
rows are judged alike; an empty table gives an empty result; columns of the
input that clash with a measure's name are left alone, because measures live in
one struct column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is that for with as on be are this it was by at from or an a "
    "der die das und zu von mit ist den des nicht ein eine für auf sich dem im als auch er ich sie "
    "le la les de et un une est en que pour dans du au aux il pas plus sur ce "
    "el los las y se por con una su para del lo no al es como"
).split()
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``least <= measure <= most`` (None: no bound)."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Measures that rules may use, as SQL over the struct of raw counts ``q``.
MEASURES = {
    "n_words": "q.n_words",
    "mean_word_chars": "q.word_chars / greatest(q.n_words, 1)",
    "symbols_per_word": "q.n_symbols / greatest(q.n_words, 1)",
    "marks_per_word": "q.n_marks / greatest(q.n_words, 1)",
    "stop_word_share": "q.n_stop_words / greatest(q.n_words, 1)",
    "dup_line_share": "q.n_dup_lines / greatest(q.n_lines, 1)",
}
RULES = (
    Rule("length", "n_words", least=20),
    Rule("word_length", "mean_word_chars", least=2.5, most=12),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("marks", "marks_per_word", most=0.5),
    Rule("stop_words", "stop_word_share", least=0.02),
    Rule("lines", "dup_line_share", most=0.5),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One Boolean expression: true where every rule holds."""
    parts = []
    for rule in rules:
        measure = MEASURES[rule.measure]
        parts += [f"({measure}) >= {rule.least}D"] * (rule.least is not None)
        parts += [f"({measure}) <= {rule.most}D"] * (rule.most is not None)
    return F.expr(" AND ".join(parts) or "true")


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur at least twice in ``words``.

    Hashes of the windows decide the usual case (all different: 0) alone; where
    two hashes agree, the windows themselves are compared.
    """
    n_windows = F.size(words) - (WINDOW - 1)
    at = F.sequence(F.lit(1), n_windows)
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    spelled = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(WINDOW)), " ").alias("w"), i.alias("i"))))

    def covered(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda x, k: F.coalesce(F.get(sorted_windows, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(sorted_windows, k + 1)["w"] == x["w"], F.lit(False)),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  evaluates value once
    exact = once(spelled, covered)
    return F.when(n_windows < 2, F.lit(0)).otherwise(once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact)))


def _once(*columns: Column) -> Column:
    return F.explode(F.array(F.struct(*columns)))


def measured(docs: DataFrame, text: str = "text", to: str = "q") -> DataFrame:
    """``docs`` with a struct column ``to`` of raw counts of the whole text.

    Both steps go through ``explode`` of one element: a later filter on the
    counts then cannot be moved below them, which would split a text again for
    each of its words."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn(
        to,
        _once(
            F.filter(F.split(body, SPACE_RUN), lambda w: w != "").alias("words"),
            F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"),
        ),
    )
    words, lines = F.col(f"{to}.words"), F.col(f"{to}.lines")
    return split.withColumn(
        to,
        _once(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(body, SPACE, "")).cast("long").alias("word_chars"),
            _count_of(body, SYMBOLS).cast("long").alias("n_symbols"),
            _count_of(body, "!?").cast("long").alias("n_marks"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        ),
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts ``q`` and the Booleans ``base_failed`` and ``kept``."""
    failed = (F.col("q.n_words") < 20) | (100 * F.col("q.n_repeat_words") > 30 * F.col("q.n_words"))
    return measured(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with the columns of ``docs``."""
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("body"))
    return judged(body, rules, "body").filter("kept").select("row.*")


def quality_rules(docs: DataFrame) -> DataFrame:
    """The digest that query op2 returns: one row for each document."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"q.{c}").alias(c) for c in counts], "base_failed", "kept", *[F.col(f"q.{c}").alias(c) for c in ("n_marks", "n_lines", "n_stop_words")])


_WORD_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE_SQL = f"""
with split as (
  select doc_id, coalesce(text, '') as body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) as lines
  from documents
), windows as (
  select *, case when len(words) < {WINDOW} then [] else list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(words[i:i+{WINDOW - 1}], ' ')) end as grams from split
), twice as (
  select doc_id, body, words, lines,
         case when len(list_distinct(grams)) = len(grams) then [] else
         list_filter(range(1, len(grams) + 1), lambda i: len(list_filter(grams, lambda g: g = grams[i])) > 1) end as starts
  from windows
), counts as (
  select doc_id, len(words)::bigint as n_words,
    length(translate(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
    (length(body) - length(translate(body, '{SYMBOLS}', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(list_sum(list_transform(range(1, len(starts) + 1), lambda k: case when k = len(starts) then {WINDOW} else least({WINDOW}, starts[k + 1] - starts[k]) end)), 0)::bigint as n_repeat_words,
    (length(body) - length(translate(body, '!?', '')))::bigint as n_marks,
    len(lines)::bigint as n_lines,
    len(list_filter(words, lambda w: lower(w) in ({_WORD_LIST})))::bigint as n_stop_words
  from twice
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)
    and word_chars / greatest(n_words, 1) between 2.5 and 12
    and n_symbols / greatest(n_words, 1) <= 0.1
    and n_marks / greatest(n_words, 1) <= 0.5
    and n_stop_words / greatest(n_words, 1) >= 0.02
    and n_dup_lines / greatest(n_lines, 1) <= 0.5 as kept,
  n_marks, n_lines, n_stop_words
from counts
"""
