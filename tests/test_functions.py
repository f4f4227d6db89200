"""Pure functions against fixed examples and invariants."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.config import MemoryConfig
from engram.functions.chunking import raw_spans, split_text, with_overlay
from engram.functions.hashing import hash_texts
from engram.functions.markdown import strip
from engram.functions.text import query_terms

#: Texts about a boat, and what the rules of markdown leave of them.
GOLDEN = [
    ("The harbour is quiet", "The harbour is quiet"),
    ("## Tides\nHigh **twice** a day", "Tides\nHigh twice a day"),
    ("See [the chart](sea.html) first", "See the chart first"),
    ("See [the chart][c1] first", "See the chart first"),
    ("See [the chart] first", "See the chart first"),
    ("Log:\n```text\nwind 4\n```\nEnd", "Log:\nwind 4\nEnd"),
    ("Log:\n~~~\nwind *5*\n~~~\nEnd", "Log:\nwind *5*\nEnd"),
    ("+ rope\n+ anchor\n7) sail\n8. mast", "rope\nanchor\nsail\nmast"),
    (">> deep\n> shallow", "deep\nshallow"),
    ("port <span>side</span> up", "port side up"),
    ('north\n<p\nid="n">\nsouth</p>\neast', "north\nsouth\neast"),
    ("call `reef(2)` now", "call reef(2) now"),
    ("a ```knot `` in``` it", "a knot `` in it"),
    ("![red buoy](buoy.jpg) ahead", "red buoy ahead"),
    ("a ~~slow~~ ship", "a slow ship"),
    ("bow\n_ _ _\nstern", "bow\nstern"),
    ("| knots | force |\n|:--|--:|\n| 12 | 4 |", " knots  force\n 12  4"),
    ("***very*** __wet__ _deck_", "very wet deck"),
    ("one\n\n\ntwo\n", "one\n\n\ntwo"),
    ("main_sail", "mainsail"),
    ("# F#", "F"),
    ("x < 3\ny > 4", "x\n4"),
    ("rise *****", "rise *****"),
    ("[_keel_](k)", "_keel_"),
    ("#### Crew ##  \ntwo", "Crew\ntwo"),
    ("", ""),
]


@pytest.mark.parametrize(("source", "stripped"), GOLDEN)
def test_strip(source, stripped):
    assert strip(source) == stripped


def test_strip_keeps_html_when_asked():
    assert strip("port <span>side</span> up", skip_html=False) == "port <span>side</span> up"


def test_hash():
    # Hashes that stored memories hold.
    expected = [-7046029254386353131, -158853927131775606, -7763688715830331823, 8066759011090351684]
    texts = [b"", b"X", b"Hello world", b"# My Note\nSome content."]
    assert hash_texts(texts).tolist() == expected
    assert hash_texts(texts[::-1]).tolist() == expected[::-1]
    assert hash_texts([]).tolist() == []


def test_chunk_examples():
    boards = "\n".join(["z" * 69] * 5)
    assert [c["length"] for c in split_text(boards, 40, 0, 4)] == [140, 140, 69]
    assert [c["length"] for c in split_text("y" * 95, 10, 0, 4)] == [40, 40, 15]
    found = split_text("alpha\nbeta\ngamma\ndelta", 3, 2, 4)
    assert [(c["offset"], c["length"]) for c in found] == [(0, 11), (11, 11)]
    assert found[1]["text"] == "beta\n\ngamma\ndelta"
    assert len(split_text("Tiny", 3, 50, 4)) == 1
    assert len(split_text(boards, 0, 0, 4)) == 1
    assert [c["text"] for c in split_text("# Bow\nx\n# Stern\ny", overlay_tokens=0, sectioning="heading")] == ["Bow\nx", "Stern\ny"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n é日", max_size=200), st.integers(1, 40))
def test_raw_spans_cover_the_text(text, most):
    data = text.encode()
    spans = raw_spans(data, most)
    assert b"".join(data[a:b] for a, b in spans) == data
    assert all(b - a <= most for a, b in spans)
    if most >= 3:
        assert all(data[a:b].decode() is not None for a, b in spans)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab\n#*é", max_size=300), st.integers(1, 20), st.integers(0, 10))
def test_spans_are_monotone(text, most, overlay):
    found = split_text(text, most, overlay, 4)
    edges = [c["offset"] for c in found]
    assert edges == sorted(edges)
    assert all(c["offset"] + c["length"] <= len(text.encode()) for c in found)
    assert [c["seq"] for c in found] == list(range(len(found)))


def test_overlay_uses_the_overlaid_chunk_before():
    assert with_overlay([b"a\nbb\n", b"cc\n", b"dd"], 4) == [b"a\nbb\n", b"bb\n\ncc\n", b"cc\n\ndd"]


def test_query_terms():
    assert query_terms("a b NOT c OR d_e AND f") == [{"need": [["a"], ["b"]], "without": [[["c"]]]}, {"need": [["d", "e"], ["f"]], "without": []}]
    assert query_terms("state-of-art café") == [{"need": [["stateofart"], ["caf"]], "without": []}]
    assert query_terms("  ") == []
    for bad in ("a AND", "NOT", "a OR", "NOT b"):
        with pytest.raises(ValueError):
            query_terms(bad)


def test_options():
    config = MemoryConfig()
    assert (config.vector_weight, config.text_weight, config.min_score, config.max_results) == (0.6, 0.4, 0.7, 20)
    assert config.with_option("MAX_TOKENS", "512").max_tokens == 512
    assert config.with_option("max_tokens", 0).max_tokens == 400
    assert config.with_option("min_score", 0.0).min_score == 0.7
    assert config.with_option("fts_enabled", 0).fts_enabled is False
    assert config.with_option("cache_max_entries", 0).cache_max_entries == 0
    assert config.with_option("unknown", 1) == config
    assert config.with_option("search_oversample", 4).search_oversample == 4
    assert re.match("md", config.extensions)


@pytest.mark.parametrize("part", ["[", "![", "`", "[a](", "*", "~~", "<", "- ", "# ", "[x`"])
def test_long_lines_of_marks(part):
    import time

    start = time.perf_counter()
    strip("x " + part * 50_000 + " y\n# " + part * 50_000 + " z")
    strip("x" + "".join("`" * i + part for i in range(500)))
    assert time.perf_counter() - start < 5
