"""The pure functions under names for Spark SQL: scalar functions and the chunker as a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from engram import __version__
from engram.functions.chunking import CHUNKS, split_text
from engram.functions.hashing import hash_texts
from engram.functions.markdown import strip

#: Columns of a chunk as a row.
CHUNK = "seq int, chunk string, start long, length long"


@F.udtf(returnType=CHUNK, useArrow=True)
class MemoryChunk:
    """The chunks of a text as rows: ``select d.id, c.* from docs d, lateral memory_chunk(d.text) c``.

    Further arguments, all optional and by name or place: bytes of a chunk and of its overlay in
    tokens, whether marks are stripped, and "heading" for a new run of chunks at each heading.
    Null and empty texts have no rows."""

    def eval(self, text: str, max_tokens: int = 400, overlay_tokens: int = 80, strip_marks: bool = True, sectioning: str = "none"):
        for c in split_text(text, max_tokens, overlay_tokens, strip_marks=strip_marks, sectioning=sectioning) if text else []:
            yield c["seq"], c["text"], c["offset"], c["length"]


def register(spark: SparkSession) -> None:
    """memory_hash(text), memory_strip(text), memory_chunks(text), memory_version() and the
    table function memory_chunk(text, ..)."""

    @F.pandas_udf("long")
    def memory_hash(series: pd.Series) -> pd.Series:
        hashes = hash_texts([(t or "").encode("utf-8", "surrogatepass") for t in series])
        return pd.Series(hashes, dtype="Int64").mask(series.isna().to_numpy())

    @F.pandas_udf("string")
    def memory_strip(series: pd.Series) -> pd.Series:
        return series.map(strip, na_action="ignore")

    @F.pandas_udf(CHUNKS)
    def memory_chunks(series: pd.Series) -> pd.Series:
        return series.map(lambda t: split_text(t) if t else [])

    for f in (memory_hash, memory_strip, memory_chunks):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("memory_chunk", MemoryChunk)
    spark.sql(f"create or replace temporary function memory_version() returns string return '{__version__}'")
