"""Operator 8: exact top-k inner-product search with block-at-a-time pruning.

Vectors are ordered by id and cut into blocks of ``BLOCK`` rows (id ranges); a block keeps a forward
index (its integer matrix) and, for each term (dimension), the largest and smallest value. A
query's score in a block is at most the sum over terms of its weight times the block's maximum
(minimum for a negative weight). For each query the blocks are visited by descending bound and
scored whole, until the next bound is below the query's k-th score so far (a bound equal to it is
still visited, as a smaller id would win the tie).

The stated query set meets all rows tile by tile: ``QUERIES`` queries x ``TILE`` blocks, each tile
with bounded memory, giving at most k rows a query; the best k of all tiles are then kept by rank.

Vectors that are null or hold null or non-finite components take no part; ones of different lengths
are compared as if the shorter went on with zeros. Rows that repeat an id are candidates of their
own (but not for the query of that id; a repeated query is answered once per row). Null ids take no
part. Empty table: no rows. Extra columns are not read. Scores are exact while they fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscope.llm.common import positions, saved

BLOCK = 1_024
TILE = 16
QUERIES = 2_048
SCALE = 64


def integer_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(vector)
    fine = v.isNotNull() & F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"),
                                   F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"))


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """(block, width, ids, matrix, top, low): int64 arrays as bytes, rows of a block in id order."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        width = int(pdf["v"].map(len).max())
        m = np.zeros((len(pdf), width), np.int64)
        for i, row in enumerate(pdf["v"]):
            m[i, : len(row)] = row
        b = lambda a: a.astype("<i8").tobytes()
        return pd.DataFrame([(int(pdf["block"].iloc[0]), width, b(pdf["vec_id"].to_numpy()), b(m),
                              b(m.max(0)) if width else b"", b(m.min(0)) if width else b"")], columns=["block", "width", "ids", "matrix", "top", "low"])

    placed = positions(vectors, ["vec_id"], name).withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    return saved(placed.groupBy("block").applyInPandas(pack, "block long, width int, ids binary, matrix binary, top binary, low binary"), name)


def array(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(shape)


def padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[-1] == width else np.concatenate([m, np.zeros((*m.shape[:-1], width - m.shape[-1]), np.int64)], -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; by floating point where every partial sum is an exact double."""
    largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if largest < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search_tile(q_ids: np.ndarray, q: np.ndarray, tiles: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score) of the k best of the tile for each query."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = product(up, np.stack([t[2] for t in tiles])) + product(down, np.stack([t[3] for t in tiles]))
    order = np.argsort(-bound, 1, kind="stable")
    none = np.iinfo(np.int64).min
    score = np.full((len(q), k), none)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    alive = np.arange(len(q))
    for step in range(len(tiles)):
        at = order[alive, step]
        alive_bound = bound[alive, at]
        kth = score[alive, -1]
        on = (kth == none) | (alive_bound >= kth)  # bounds only fall from here on
        alive, at = alive[on], at[on]
        if not len(alive):
            break
        for block in np.unique(at):
            own = alive[at == block]
            c_ids, matrix = tiles[block][0], tiles[block][1]
            got = product(q[own], matrix)
            got[q_ids[own][:, None] == c_ids[None, :]] = none
            better = got >= score[own, -1][:, None]
            better &= got != none
            for i, row in enumerate(own):  # few rows of a block reach a query's k-th score
                hit = np.flatnonzero(better[i])
                if len(hit):
                    s = np.concatenate([score[row], got[i, hit]])
                    d = np.concatenate([ids[row], c_ids[hit]])
                    best = np.lexsort((d, -s.astype(np.float64) if np.abs(s[s != none]).max(initial=0) < 2 ** 52 else ~s))[:k]
                    score[row], ids[row] = s[best], d[best]
    row, col = np.nonzero(score != none)
    return row, ids[row, col], score[row, col]


def top_k(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best other rows of every row where ``is_query``
    (an expression over vec_id)."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, vec_id, vector)
    index = blocks(vectors, BLOCK, "vector-blocks").withColumn("tile", F.floor(F.col("block") / TILE).cast("long"))
    asked = blocks(vectors.where(is_query), QUERIES, "query-blocks")
    tiles = (index.agg(F.max("tile")).first()[0] or 0) + 1
    groups = asked.agg(F.max("block")).first()[0]
    if groups is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    left = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>"))).withColumnRenamed("block", "qblock")
    right = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(groups)).cast("array<bigint>")))

    def run(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame({"query_no": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        r = queries.iloc[0]
        width = int(max(r["width"], found["width"].max()))
        q_ids = array(r["ids"], -1)
        q = padded(array(r["matrix"], len(q_ids), int(r["width"])), width)
        parts = []
        for b in found.sort_values("block").itertuples():
            ids = array(b.ids, -1)
            m = padded(array(b.matrix, len(ids), b.width), width)
            parts.append((ids, m, m.max(0), m.min(0)))
        row, ids, score = search_tile(q_ids, q, parts, k)
        return pd.DataFrame({"query_no": row + int(r["qblock"]) * QUERIES, "query_id": q_ids[row], "vec_id": ids, "score": score})

    tiled = left.groupBy("qblock", "tile").cogroup(right.groupBy("qblock", "tile")).applyInPandas(
        run, "query_no long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return (tiled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def digest(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 20 == 0, 20)
