"""Web archives (WARC 1.1): written with an index first, read back by byte ranges.

Writing.  Payloads are told apart by length and SHA-1.  Of equal payloads the row of
the largest id becomes a ``response`` record that holds the payload, all others become
``revisit`` records that refer to it and hold none.  Rows of equal payloads meet as
grouped maxima (each task sends one payload of a group on, not its copies), and the
few facts a revisit needs are joined by digest; so a payload that a third of all pages
share costs no task more than others.  Each task writes archives of its own, a gzip
member for each record, and returns an index row for each: file, offset, length, URL,
digest.  Only what a task that succeeded has written is in the index, so a lost
executor or a second attempt leaves a file that nothing refers to.

Reading.  Any selection of index rows is dealt by stretches of the archives, sorted by
file and offset, and neighbours are read as one range.  Payloads are checked against
the digest of their record.

Defined results: a null payload is an empty one, and empty payloads are equal.  A null
id is smaller than all others; ids that repeat are rows of their own, and of rows that
agree in payload and id the one with the greatest URL is the response (of rows that agree
in that too, any one, which makes no difference).  Null URLs are kept null by the index.
An empty table makes no archive and an empty index.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.session import cut, shared_folder

#: Bytes of an archive after which the task begins another one.
ARCHIVE_BYTES = 1 << 30
#: Records that are read at once lie at most ``GAP`` bytes apart and fill at most ``RANGE`` bytes.
GAP, RANGE = 64 << 10, 8 << 20
#: Bytes of an archive that one task of reading is meant to get.
STRETCH = 16 << 20
#: Rows that a task turns into Python objects at once.
ROWS = 64
#: A page has no time of its own.
DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the alphabet of base 32, and the digits that Spark's ``conv`` gives.
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Fixed value: what a revisit of an equal payload names as its profile.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, payload_bytes long, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base 32 SHA-1 of bytes: 160 bits are eight times twenty, four digits each."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), DIGITS, BASE32)


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))


# Records


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {copy} {digest} {url}')}>"


def _field(value: str) -> str:
    """A value that stays on its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """A record as a gzip member.  ``row``: page_id, url, digest, n (bytes), copy, payload (null: a revisit), top_id and top_url."""
    page, url, digest = row["page_id"], row["url"], row["digest"]
    revisit = row["payload"] is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page, url, digest, row["copy"])),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _field(url) if url else f"urn:page:{page}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page is not None:
        fields.append(("Page-ID", str(page)))
    if url is not None and (fields[3][1] != url or url.startswith("urn:page:")):
        fields.append(("Page-URL", base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(row["top_id"], row["top_url"], digest, 0))]
        if row["top_id"] is not None:
            fields.append(("Refers-To-Page-ID", str(row["top_id"])))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class DamagedRecord(ValueError):
    """A record isn't what the index or its own digest says."""


def parsed(data: bytes) -> dict:
    """What a record says; raises ``DamagedRecord`` where its payload isn't that of its digest."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not version.startswith("WARC/1.") or not revisit and base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != said:
        raise DamagedRecord(fields.get("WARC-Record-ID", "a record"))
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    url = fields["WARC-Target-URI"]
    url = base64.b64decode(fields["Page-URL"]).decode("utf-8", "surrogatepass") if "Page-URL" in fields else None if url.startswith("urn:page:") else url
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("Page-ID"),
        "url": url,
        "payload_bytes": size,
        "payload_digest": said,
        "record_type": fields["WARC-Type"],
        "refers_to": number("Refers-To-Page-ID"),
        "payload": None if revisit else payload,
    }


# Writing


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records to write (page_id, url, digest, n, copy, payload, top_id, top_url); payloads
    of fewer than ``least_bytes`` bytes are never shared."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": base32_sha1(F.col("payload")), "n": F.octet_length("payload").cast("long")})
    shared = base.filter(F.col("n") >= least_bytes)
    counted = cut(shared.groupBy("digest", "n", "page_id", "url").agg(F.count("*").alias("m")))
    row = F.struct("page_id", "url")
    tops = counted.groupBy("digest", "n").agg(F.max(row).alias("top")).select("digest", "n", F.col("top.page_id").alias("top_id"), F.col("top.url").alias("top_url"))
    is_top = F.col("page_id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    others = counted.join(tops, ["digest", "n"]).withColumn("first", F.when(is_top, 1).otherwise(0)).filter("m > first")
    revisits = others.select("page_id", "url", "digest", "n", F.explode(F.sequence(F.col("first").cast("long"), F.col("m") - 1)).alias("copy"), F.lit(None).cast("binary").alias("payload"), "top_id", "top_url")
    none = [F.lit(None).cast("long").alias("top_id"), F.lit(None).cast("string").alias("top_url")]
    responses = shared.groupBy("digest", "n").agg(F.max(row).alias("top"), F.first("payload").alias("payload"))
    responses = responses.select("top.page_id", "top.url", "digest", "n", F.lit(0).cast("long").alias("copy"), "payload", *none)
    small = base.filter(F.col("n") < least_bytes).select("page_id", "url", "digest", "n", F.monotonically_increasing_id().alias("copy"), "payload", *none)
    both = responses.unionByName(revisits)
    return both.unionByName(small) if least_bytes > 0 else both


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        stream, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in (r for k in range(0, batch.num_rows, ROWS) for r in batch.slice(k, ROWS).to_pylist()):
                    if stream is None or at >= most:
                        if stream is not None:
                            stream.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        stream = files.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(row)
                    stream.write(data)
                    rows.append((f"{folder}/{name}", at, len(data), row["url"], row["digest"], row["page_id"], row["n"], "revisit" if row["payload"] is None else "response"))
                    at += len(data)
                names = [f.split(" ")[0] for f in INDEX.split(", ")]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        finally:
            if stream is not None:
                stream.close()

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``, which driver and
    executors share, and their index as Parquet; the index (``INDEX``)."""
    folder = folder.rstrip("/")
    files, root = opened(folder)
    files.create_dir(f"{root}/archives", recursive=True)
    index = planned(pages, least_bytes).mapInArrow(_writer(f"{folder}/archives", ARCHIVE_BYTES), INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


# Reading


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[int, int]]:
    """Runs [first, last) of the sorted (file, offset, length) that one read fetches."""
    out: list[tuple[int, int]] = []
    for i, (file, offset, length) in enumerate(rows):
        if out:
            first = out[-1][0]
            known, _, before = rows[first][0], rows[first][1], rows[i - 1][1] + rows[i - 1][2]
            if file == known and offset - before <= gap and offset + length - rows[first][1] <= most:
                out[-1] = (first, i + 1)
                continue
        out.append((i, i + 1))
    return out


def _reader(with_payload: bool):
    names = [f.split(" ")[0] for f in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name = None, None
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True))
            for first, last in ranges(rows):
                if rows[first][0] != name:
                    if file is not None:
                        file.close()
                    name = rows[first][0]
                    files, path = opened(name)
                    file = files.open_input_file(path)
                begin = rows[first][1]
                data = memoryview(file.read_at(rows[last - 1][1] + rows[last - 1][2] - begin, begin))
                found = [parsed(data[offset - begin : offset - begin + length]) for _, offset, length in rows[first:last]]
                columns = [[None if c == "payload" and not with_payload else r[c] for r in found] for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        if file is not None:
            file.close()

    return run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name (page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload; a revisit's payload is null)."""
    stretch = F.floor(F.col("offset") / STRETCH)
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # an index is small, what it points to is not
    dealt = index.select("file", "offset", "length", stretch.alias("stretch")).repartition(total // STRETCH + 1, "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(_reader(with_payload), RECORDS)


def with_payloads(index: DataFrame, selected: DataFrame) -> DataFrame:
    """The records of ``selected`` index rows, revisits with the payload of the response they refer to."""
    found = read_records(selected)
    asked = found.filter("record_type = 'revisit'").select(F.col("payload_digest").alias("digest"), "payload_bytes").distinct()
    held = read_records(index.filter("record_type = 'response'").join(asked, ["digest", "payload_bytes"], "left_semi"))
    held = held.groupBy("payload_digest", "payload_bytes").agg(F.first("payload").alias("_held"))
    both = found.join(held, ["payload_digest", "payload_bytes"], "left")
    return both.select(*[F.coalesce("payload", "_held").alias(c) if c == "payload" else c for c in found.columns])


def archive_round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """The digest that query op13 returns: all pages written, and all records read back."""
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_records(write_archives(pages, folder), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> {}) % 32 + 1, 1)"
#: The same in DuckDB.
ORACLE_SQL = f"""
with p as (select page_id, url, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
d as (select page_id, url, strlen(payload)::bigint as n, array_to_string(list_transform(range(8),
    lambda i: list_transform([('0x' || substr(hex, (5 * i + 1)::int, 5))::int], lambda v: {' || '.join(_DIGIT.format(s) for s in (15, 10, 5, 0))})[1]), '') as digest from p),
t as (select *, row_number() over g as nth, first_value(page_id) over g as top from d window g as (partition by digest, n order by page_id desc nulls last, url desc nulls last rows between unbounded preceding and unbounded following))
select page_id, n as payload_bytes, digest as payload_digest, case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then top end as refers_to from t
"""
