"""Whitening, collocations and archives against brute force, their SQL and round trips."""

import collections
import itertools
import random
import re
import tempfile
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest

from engram.llm import collocations, neardup, pii, secrets, warc, whitening
from tests.llm.helpers import odd_documents

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


# 11 Whitening


def brute_whitening(x):
    n = len(x)
    exact = x.astype(object)
    s = exact.sum(axis=0)
    centred = ((n * exact - s) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return ((n * exact - s) ** 2).sum(axis=1), centred, values[::-1], vectors[:, ::-1]


def check_whitening(spark, matrix, least=1e-9):
    ids = range(100, 100 + len(matrix))
    docs = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, matrix, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    found = whitening.whitening(docs).toPandas()
    x = np.floor(np.asarray(matrix) * 64).astype(np.int64) + 1_000_000
    deviation, centred, values, vectors = brute_whitening(x)
    k = min(32, x.shape[1])
    assert len(found) == len(x) * k and (found.n == len(x)).all() and found.identity_error.nunique() == 1
    z = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert found[found.component == 1].sort_values("vec_id").deviation.tolist() == deviation.tolist()
    live = values[:k] > least * values[0]
    explained = found.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained[live], (values / values.sum())[:k][live], rtol=1e-6)
    assert found.identity_error.iloc[0] < 1e-8
    assert np.isnan(z[:, ~live]).all() and not np.isnan(z[:, live]).any()
    expected = centred @ vectors[:, :k][:, live] / np.sqrt(values[:k][live])
    signs = np.sign((expected * z[:, live]).sum(axis=0))
    assert np.allclose(z[:, live] * signs, expected, atol=1e-5)


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(spark, np.array([r.embedding for r in rows], dtype=float))


def test_whitening_of_many_scales(spark):
    rng = np.random.default_rng(4)
    check_whitening(spark, rng.normal(size=(400, 5)) * 10.0 ** np.arange(5) + 1e4)


def test_whitening_without_full_rank(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 6))
    m[:, 3], m[:, 5] = m[:, 0], 2.0
    check_whitening(spark, m)
    check_whitening(spark, rng.normal(size=(4, 9)) * 8)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.5]), (None, [0.5, 9.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1e300, 1.0]), (8, [1.0]), (9, [])]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, n long, whitened string")
    found = whitening.whitening(docs).collect()
    assert collections.Counter(r.vec_id for r in found) == {1: 4, 2: 2, None: 2} and {r.n for r in found} == {4}
    same = whitening.whitening(docs.filter("vec_id = 1")).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in same} == {(None, 0.0, 0.0, 0)}
    assert whitening.whitening(docs.filter("vec_id >= 9")).count() == whitening.whitening(docs.limit(0)).count() == 0


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[1 << 40, 3], [5, 1 << 41]], dtype=np.int64)
    off = whitening._deviations(x, 1 << 30, [7, 9])
    assert off.dtype == object and off.tolist() == [[(1 << 70) - 7, (3 << 30) - 9], [(5 << 30) - 7, (1 << 71) - 9]]


# 12 Collocations


def brute_collocations(rows, least, percent, top):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            for m in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(k for g, k in f.items() if len(g) == 1)
        candidates = {g: k for g, k in f.items() if len(g) > 1 and k >= least}
        best = collections.Counter()
        for g, k in candidates.items():
            for inner in {g[i:j] for i in range(len(g)) for j in range(i + 2, len(g) + 1)} - {g}:
                best[inner] = max(best[inner], k)
        made = []
        for g, a in candidates.items():
            if 100 * best[g] < percent * a:
                score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                made.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, phrase.decode(), -a, left, right, n, -score) for i, (score, a, phrase, left, right) in enumerate(sorted(made)[:top])]
    return sorted(out)


def texts(seed, size=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "The", "ÉTÉ", "été", "x" * 300, "日本", "c-d", "e"]
    fixed = ["new york city hall", "a a a a a", "b. the b, the", "the b\nthe b\tc-d"]
    return [(rng.choice(["en", "en", None, "und", "de"]), " ".join(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(size))) for _ in range(50)]


@pytest.mark.parametrize("quota, held", [(4_000_000, 2_000_000), (20, 40), (300, 300)])
def test_collocations(spark, monkeypatch, quota, held):
    monkeypatch.setattr(collocations, "QUOTA", quota)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "BUCKET", held)
    rows = texts(quota)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for least, percent, top in ((5, 80, 2000), (3, 50, 7), (30, 100, 2000)):
        found = collocations.collocations(docs, least, percent, top)
        assert sorted(map(tuple, found.collect())) == brute_collocations(rows, least, percent, top)


def test_collocations_match_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = collocations.collocations(spark.read.parquet(f"{SF}/documents.parquet"))
    assert plain(found.collect()) == plain(c.sql(collocations.ORACLE_SQL).fetchall())


def test_collocations_of_two_words(spark):
    rows = texts(3)
    found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 5, longest=2)
    pairs = {(r[0], r[2]): r[3:6] for r in brute_collocations(rows, 5, 1000, 10**6) if len(r[2].split()) == 2}
    assert {(r.lang, r.phrase): (r.a, r.l, r.r) for r in found.collect()} == pairs


def test_collocations_when_the_filter_is_full(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 64)
    rows = texts(9)
    found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 5)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, 5, 80, 2000)


def test_a_frequent_key_is_dealt_into_parts():
    stripes = collocations._Stripes(1, 10)
    n = 1000
    nexts = collocations.mix(np.arange(1, n + 1, dtype=np.uint64))
    stripes.add([np.full(n, 5, np.uint64), np.zeros(n, np.int64), np.full(n, 9, np.uint64), nexts, np.ones(n, np.int64)])
    rows = [r for b in stripes.batches(["en"], (np.array([5], np.uint64), np.array([6], np.uint64))) for r in b.to_pylist()]
    assert len(rows) == 64 and sum(sum(r["counts"]) for r in rows) == n and max(len(r["nexts"]) for r in rows) < 40


def test_collocations_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute_collocations(rows, 30, 80, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0


# 13 Archives


ODD_PAGES = [(1, "u", "a"), (1, "u", "a"), (1, "v", "a"), (2, None, "a"), (3, "x\ny", None), (4, "x", ""), (None, "z", "b"), (None, "z", "b"), (5, "", "é日本\r\n\r\nx"), (7, "big", "w" * 300_000), (8, "urn:page:9", "ww")]


def odd_pages(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ODD_PAGES], "page_id long, url string, html string, digest string, offset long")


def brute_archives(rows):
    groups = collections.defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = []
    for html, pages in groups.items():
        top, *others = sorted(pages, key=lambda p: (p is None, -(p or 0)))
        of = (len(html.encode()), warc.base64.b32encode(warc.hashlib.sha1(html.encode()).digest()).decode())
        out += [(top, *of, "response", None), *((p, *of, "revisit", top) for p in others)]
    return plain(out)


def test_archives_of_the_table(spark):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = plain(warc.archive_round_trip(pages, spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert found == plain(c.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.ORACLE_SQL})").fetchall())
    assert found == brute_archives([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_archives_of_odd_pages(spark):
    assert plain(warc.archive_round_trip(odd_pages(spark), spark).collect()) == brute_archives(ODD_PAGES)
    assert warc.archive_round_trip(odd_pages(spark).limit(0), spark).count() == 0


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 700)
    folder = tempfile.mkdtemp()
    index = warc.write_archives(odd_pages(spark).repartition(3), folder)
    back = warc.with_payloads(index, index).collect()
    assert plain((r.page_id, r.url, bytes(r.payload).decode()) for r in back) == plain((p, u, h or "") for p, u, h in ODD_PAGES)
    revisits = warc.with_payloads(index, index.filter("record_type = 'revisit' and digest is not null")).collect()
    assert len(revisits) == 5 and {bytes(r.payload) for r in revisits} == {b"", b"a", b"b"}
    assert plain(warc.read_records(index.filter("page_id = 7")).select("page_id", "url", "payload_bytes").collect()) == ["(7, 'big', 300000)"]
    told = sum(r.length for r in index.collect())
    assert told == sum(f.stat().st_size for f in Path(folder, "archives").glob("*.warc.gz"))


def test_small_payloads_are_never_shared(spark):
    index = warc.write_archives(odd_pages(spark), tempfile.mkdtemp(), least_bytes=2)
    assert index.count() == len(ODD_PAGES) and {r.record_type for r in index.collect()} == {"response"}


def test_records_are_standard():
    row = {"page_id": 3, "url": "http://a/ b", "digest": warc.base64.b32encode(warc.hashlib.sha1(b"xyz").digest()).decode(), "n": 3, "copy": 0, "payload": b"xyz", "top_id": None, "top_url": None}
    text = warc.zlib.decompress(warc.record(row), 31)
    head, _, block = text.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:") and text.endswith(b"\r\n\r\n")
    assert int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) == len(block) - 4
    assert warc.record(row) == warc.record(row) and warc.parsed(warc.record(row))["url"] == "http://a/ b"
    with pytest.raises(warc.DamagedRecord):
        warc.parsed(warc.record(row | {"digest": "A" * 32}))


def test_neighbours_are_one_read():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 40, 5), ("a", 100, 50), ("b", 150, 10), ("b", 160, 500), ("b", 700, 1)]
    assert warc.ranges(rows, gap=20, most=100) == [(0, 3), (3, 4), (4, 5), (5, 6), (6, 7)]
    assert warc.ranges(rows, gap=1000, most=10_000) == [(0, 4), (4, 7)] and warc.ranges([]) == []


# Near duplicates and secrets, beside test_operators.py


def test_repeated_ids_in_any_order(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdef", k=7))
    a, b = [[word() for _ in range(200)] for _ in range(2)]
    near = [*a[:100], "other", *a[101:]]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near)), (3, " ".join([*b[:50], "more", *b[51:]]))]
    for order in list(itertools.permutations(rows))[:: 6] + [tuple(reversed(rows))]:
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        found = neardup.near_dup_groups(docs)
        assert sorted((r.doc_id, r.component_id, r.kept) for r in found.collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
        if order in (tuple(rows), tuple(reversed(rows))):
            assert [r.doc_id for r in neardup.drop_near_duplicates(docs, 3, 85).collect()] == [1]
            apart = docs.filter("doc_id <> 1").unionByName(docs.filter("doc_id = 1 and length(text) > 0"))
            assert neardup.drop_near_duplicates(apart, 3, 85).select("text").distinct().count() == 1


def test_words_that_polynomials_mix_up_are_no_near_duplicates(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    docs = spark.createDataFrame([(1, one), (2, one.translate({97: 98, 98: 97}))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_dup_groups(docs).collect()} == {1: 1, 2: 2}


def test_constants_of_many_characters_take_linear_time():
    for made in ('x = "' + "".join(chr(0x4E00 + i) for i in range(20_000)) + '"\n' + "x = x + x\n" * 100_000, 'x = "' + "".join(map(chr, range(0x4E00, 0x9000))) + '"\ny = "Abc123"\n' + "x = x + y\n" * 90_000):
        began = time.time()
        secrets.scan(made)
        assert len(made) > 900_000 and time.time() - began < 15


def test_profiles_count_ascii_apart():
    found = secrets.profile("aab" + chr(0x4E00) + chr(0x4E00 + secrets.OTHERS))
    assert found == {"a": 0.4, "b": 0.2, chr(256 + 0x4E00 % secrets.OTHERS): 0.4}


def test_names_of_a_document_all_over_it(spark):
    texts = [
        "Mr. J. Smith, Mr Smith, Smith said. Smithson and blacksmith stay; Smith's house. Dr. Wei Zhang met Zhang.",
        "Prof Olivia O'Brien-Smith wrote; O'Brien-Smith left. Jean K. Dupont-Roux, then Dupont-Roux and Jean.",
        "Smith is not named here.",
        "Send it to DE89 3704 0044 0532 0130 00, GB82 WEST 1234 5698 7654 32 or DE00 3704 0044 0532 0130 00.",
    ]
    found = [r.text for r in pii.anonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for gone, text in zip((["Smith,", "Smith ", "Smith'", "Zhang", "Wei ", " J."], ["O'Brien", "Olivia", "Dupont", "Roux", "Jean"]), found):
        assert not [g for g in gone if g in text], text
    assert "Smithson and blacksmith stay" in found[0] and found[2] == texts[2]
    family = re.findall("Mr ([A-Z][a-z]+),", found[0])[0]
    assert f"{family} said" in found[0] and f"{family}'s house" in found[0] and re.match(f"Mr. [A-Z]\\. {family}, ", found[0])
    zhang = re.findall("met ([A-Z][a-z]+)", found[0])[0]
    assert re.search(f"Dr. [^ ]+ {zhang} met", found[0])
    value = lambda a: int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97
    accounts = [a.replace(" ", "") for a in re.findall("[A-Z]{2}\\d\\d(?: [A-Z0-9]{4}){4,5}(?: [A-Z0-9]{1,3})?", found[3])]
    assert [value(a) == 1 for a in accounts[:2]] == [True, True] and len(accounts) == 3
    assert accounts[0][:2] == "DE" and not set(accounts) & {a.replace(" ", "") for a in texts[3].split(", ")}
