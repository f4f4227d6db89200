"""Small inputs and brute-force versions."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q string, size string, spans string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"word{i % 977} and the {i}" for i in range(60_000))
    rows = [
        (1, "the cat and the dog of the house " * 8, "en", "a"),
        (1, "the cat and the dog of the house " * 8, "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \n\t ", None, "b"),
        (None, "a text without an id and the rest of it", "en", "b"),
        (5, long_text, "en", "b"),
        (6, long_text, "en", None),
        (7, "x" * 300_000, None, "c"),
        (8, 'password = "abcdefgh12345"\nmail a.b@c.org', "de", "c"),
        (9, "Ünïcödé 日本語 \U0001f600 ß", "de", "c"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "q", "s", "x") for r in rows], SCHEMA)


def documents(spark, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/documents.parquet")


def word_set(text, n):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def exact_components(sets, percent):
    """Component of each key of ``sets`` by looking at all pairs."""
    keys = sorted(k for k in sets if sets[k])
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) if k in parent else k for k in sets}
