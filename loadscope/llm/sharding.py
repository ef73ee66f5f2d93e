"""Operator 10: Hilbert-curve sharding.

Each metadata dimension is quantised to ``BITS`` bits (strings by the rank of their value among all
values, by its position in code-point order; numbers by their logarithm), the cell's index on the
Hilbert curve of that many dimensions is computed, rows are ordered by (index, crc32 of the text,
doc_id) and the order is cut into runs: shards. A shard then covers a compact region of all
dimensions at once, so per-file minima and maxima prune filters on any of them.

Laws: ``rows`` (shard sizes at most one row apart) and ``bytes`` (cuts at equal sums of sizes; a
row belongs to the shard where its first byte falls). Null dimension: the lowest cell. Null text:
no bytes. Null doc_id sorts first. Repeated rows are rows of their own; fully equal rows may swap
places. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import dropped, positions, saved

BITS = 10
#: What a row costs besides its text.
ROW_BYTES = 16


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each column of ``axes`` (dimensions x points, integers below 2^bits).

    From the highest bit down: a dimension whose bit is set inverts the lower bits of the first one,
    else the two exchange the lower bits in which they differ; then Gray decoding across dimensions,
    and the bits interleaved, first dimension highest."""
    x = axes.astype(np.uint64).copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(n):
            on = (x[i] >> np.uint64(b)) & np.uint64(1) == 1
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] >> np.uint64(b)) & np.uint64(1) == 1, t ^ np.uint64((1 << b) - 1), t)
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def curve(dims: list[Column], bits: int) -> Column:
    if len(dims) * bits > 62:
        raise ValueError("dimensions x bits must fit 62 bits")

    @F.pandas_udf("long")
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns]), bits))

    return index(*dims)


def ranked(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Adds ``_q<column>``: the cell of a string value: its rank among the values, spread over 2^bits."""
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    places = positions(values, ["_v"], "values")
    n = places.agg(F.max("pos")).first()[0]
    cell = (F.col("pos") * ((1 << bits) - 1) / F.lit(max(1, n or 0))).cast("long")
    places = places.select("_v", cell.alias("_q"))
    return rows.join(places, F.col(column) == F.col("_v"), "left").drop("_v").withColumnRenamed("_q", f"_q{column}").fillna(0, [f"_q{column}"])


def shards(docs: DataFrame, n_shards: int, law: str = "rows", doc_id: str = "doc_id", text: str = "text",
           strings: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, the string dimensions, hilbert, shard (from 0) and slot (from 0)."""
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                             F.crc32(body.cast("binary")).alias("text_crc32"),
                             *[F.col(c).cast("string").alias(f"d_{c}") for c in strings]), "slim")
    out = rows
    for c in strings:
        out = ranked(out, f"d_{c}", BITS)
    scale = F.least(F.lit((1 << BITS) - 1), (F.log2(F.col("size").cast("double")) * ((1 << BITS) / 40)).cast("long"))
    out = out.withColumn("hilbert", curve([*[F.col(f"_qd_{c}") for c in strings], scale], BITS)).drop(*[f"_qd_{c}" for c in strings])
    placed = positions(out, ["hilbert", "text_crc32", "doc_id"], "curve", before="size")
    total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    # Exact integers: the shard whose share of the whole the row's start falls into.
    at, whole = ("pos", total[0]) if law == "rows" else ("before", total[1] or 1)
    placed = placed.withColumn("shard", F.expr(f"CAST(({at} * CAST({n_shards} AS DECIMAL(20,0))) DIV {max(1, whole)} AS INT)"))
    placed = saved(placed, "sharded")
    starts = placed.groupBy("shard").agg(F.min("pos").alias("first"))  # n_shards rows
    dropped(docs.sparkSession, rows)
    return (placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("pos") - F.col("first"))
            .select("doc_id", "size", "text_crc32", *[F.col(f"d_{c}").alias(c) for c in strings], "hilbert", "shard", "slot"))


def digest(docs: DataFrame, n_shards: int) -> DataFrame:
    return (shards(docs, n_shards).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert"))
