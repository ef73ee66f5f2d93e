"""Operator 13: Merkle manifest of a table, by checkpoint and recompute.

Every row is a leaf: SHA-256 over its fields, each with its byte count in front. The rows of a tree
(a language) stand in the order of their id; every ``ARITY`` consecutive nodes become the hash of
their digests until one is left, and the trees' roots make a tree of their own in the same way. Only
every ``STEP``-th level is stored. A proof walks down: the block of stored nodes below a stored node
(ARITY^STEP at most) is gathered in one task, the levels between are hashed again, the siblings of
every stored node's way up are emitted and the levels are let go; the siblings above a block are
handed down once a block, not once a row. So a tree of any size is built and proved in blocks, and a
tree that holds a third of all rows is as many blocks.

Null fields count as ``-``; a null tree key is a tree of its own and comes first. Equal ids stand in
the order of their digests; a null id comes first; fully equal rows are leaves of their own in
any order (a tie breaker spreads them). Very long texts are hashed by the JVM and never gathered. A
tree of one row is that leaf. Empty table: no rows and the root is null. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loadscope.llm.common import partitions, saved

ARITY = 8
#: Levels from one stored level to the next.
STEP = 3
BLOCK = ARITY ** STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def hashed(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def depth(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def levels(nodes: list[str], up: int) -> list[list[str]]:
    """The nodes and the ``up`` levels over them."""
    out = [nodes]
    for _ in range(up):
        out.append([hashed(out[-1][i:i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def siblings(rows: list[list[str]], at: int) -> list[dict]:
    """The runs' other nodes left and right of the way from node ``at`` of the lowest level up."""
    path = []
    for level in rows[:-1]:
        first = at - at % ARITY
        path.append({"left": "".join(level[first:at]), "right": "".join(level[at + 1:first + ARITY])})
        at //= ARITY
    return path


def fold(node: str, path: list[dict]) -> str:
    for step in path:
        node = hashed([step["left"], node, step["right"]])
    return node


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: of each field ``-`` if null, else its byte count, ``:`` and its value."""
    def said(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[said(c) for c in fields]), 256)


def tree_key(c: Column) -> Column:
    """A text that is never null and sorts as ``c`` does, null first."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def _placed(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds idx (place in the row's tree, from 0) and n (leaves of the tree) to rows with a ``tree``. The
    rows are range-shuffled, so a large tree spans tasks; only counts per task and tree are summed up."""
    spark = leaves.sparkSession
    cut = saved(leaves.repartitionByRange(partitions(spark), "tree", *order).withColumn("part", F.spark_partition_id()), name)
    cells = cut.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("c"))
    tree = Window.partitionBy("tree")
    before = F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("part", "tree", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(tree).alias("n"))
    here = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order)) - 1
    return cut.join(cells, ["part", "tree"]).withColumn("idx", here + F.col("before")).drop("part", "before")


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """The stored nodes under each node of the stored level above, in order: at most ``BLOCK`` a row."""
    block = F.expr(f"idx DIV {BLOCK}").alias("block")
    return (nodes.select("tree", block, "n", F.struct("idx", "node", *more).alias("node"))
            .groupBy("tree", "block", "n").agg(F.sort_array(F.collect_list("node")).alias("nodes")))


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of the batches, a few blocks at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 16):
            yield batch.slice(i, 16).to_pydict()


def _risen(base: int):
    def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _some(batches):
            tops = [levels([x["node"] for x in nodes], min(STEP, max(0, depth(n) - base)))[-1][0] for n, nodes in zip(c["n"], c["nodes"])]
            yield pa.RecordBatch.from_pydict({"tree": c["tree"], "idx": c["block"], "n": c["n"], "node": tops})
    return rise


def _stored(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The stored levels over placed leaves (tree, idx, n, node), leaves first; each tree's last node ends it."""
    out = [leaves]
    highest = depth(leaves.agg(F.max("n")).first()[0] or 0)
    for base in range(0, highest, STEP):
        out.append(saved(_blocks(out[-1]).mapInArrow(_risen(base), "tree string, idx long, n long, node string"), f"{name}-{base + STEP}"))
    return out


@dataclass
class Manifest:
    """Written tables: ``trees`` and ``top`` hold the stored levels (tree, idx, n, node) of the trees and
    of the tree over their roots, the lowest first; the lowest of ``trees`` also has the rows' doc_id."""

    trees: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def build(leaves: DataFrame) -> Manifest:
    """The manifest of rows (doc_id, key: the tree's key or null, node: the digest, what else is to be kept)."""
    # The tie breaker is written with the rows, so that no later run of a task changes it.
    rows = leaves.withColumn("tree", tree_key(F.col("key"))).withColumn("tie", F.monotonically_increasing_id())
    rows = saved(rows.drop("key"), "leaves")
    trees = _stored(saved(_placed(rows, ["doc_id", "node", "tie"], "ordered"), "placed"), "level")
    roots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("under"), "node")
    top = _stored(saved(_placed(roots, ["under"], "roots"), "top"), "top-level")
    last = top[-1].first()
    return Manifest(trees, top, last and last.node)


def save(manifest: Manifest, path: str) -> None:
    """Writes the stored levels under ``path``: one folder a level."""
    for kind, tables in (("trees", manifest.trees), ("top", manifest.top)):
        for k, t in enumerate(tables):
            t.write.parquet(f"{path}/{kind}/{k}")
        manifest.trees[0].sparkSession.createDataFrame([(kind, len(tables), manifest.root)], "kind string, levels int, root string") \
            .write.mode("append").parquet(f"{path}/levels")


def load(spark: SparkSession, path: str) -> Manifest:
    rows = {r.kind: r for r in spark.read.parquet(f"{path}/levels").collect()}  # two rows
    tables = {k: [spark.read.parquet(f"{path}/{k}/{i}") for i in range(r.levels)] for k, r in rows.items()}
    return Manifest(tables["trees"], tables["top"], rows["trees"].root)


def _handed_down(base: int):
    """Of each block and the way up from its top: the way up from each of its nodes."""
    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _some(batches):
            for tree, n, nodes, path, subroot in zip(c["tree"], c["n"], c["nodes"], c["path"], c["subroot"]):
                rows = levels([x["node"] for x in nodes], min(STEP, max(0, depth(n) - base)))
                found = [siblings(rows, i) + path for i in range(len(nodes))]
                yield pa.RecordBatch.from_pydict({"tree": [tree] * len(nodes), "idx": [x["idx"] for x in nodes], "path": found,
                                                  "subroot": [subroot] * len(nodes)}, schema=WAY)
    return ways


WAY = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
                 ("subroot", pa.string())])


def _tops(stored: list[DataFrame], ways: DataFrame) -> DataFrame:
    """The ways up from the lowest stored level but the leaves' own, given those from the highest (idx 0)."""
    for base in range((len(stored) - 2) * STEP, 0, -STEP):
        under = _blocks(stored[base // STEP]).join(ways.withColumnRenamed("idx", "block"), ["tree", "block"])
        ways = under.mapInArrow(_handed_down(base), f"tree string, idx long, path {PATH}, subroot string")
    return ways


def _rows_of(stored: list[DataFrame], ways: DataFrame, *more: str) -> DataFrame:
    """The leaves' blocks (with the columns ``more`` of the leaves) and each one's way up."""
    upper = _tops(stored, ways) if len(stored) > 1 else ways
    return _blocks(stored[0], *more).join(upper.withColumnRenamed("idx", "block"), ["tree", "block"])


def _ways(manifest: Manifest) -> DataFrame:
    """(tree, idx 0, path, subroot): the way from each tree's root up to the root of all."""
    start = manifest.top[-1].select("tree", F.lit(0).cast("long").alias("idx"), F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    blocks = _rows_of(manifest.top, start, "under")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _some(batches):
            for n, nodes, path in zip(c["n"], c["nodes"], c["path"]):
                rows = levels([x["node"] for x in nodes], min(STEP, depth(n)))
                yield pa.RecordBatch.from_pydict({"tree": [x["under"] for x in nodes], "idx": [0] * len(nodes), "subroot": [x["node"] for x in nodes],
                                                  "path": [siblings(rows, i) + path for i in range(len(nodes))]}, schema=WAY)

    return saved(blocks.mapInArrow(ways, f"tree string, idx long, path {PATH}, subroot string"), "ways")


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, path (siblings left and right, level by level up to the root) of every row."""
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, digests, _, rows, path, subroot in _leaves(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": doc, "leaf": digests, "subroot": [subroot] * len(doc),
                                              "path": [siblings(rows, i) + path for i in range(len(doc))]}, schema=out)

    schema, out = _with_id(manifest, [("leaf", "string", pa.string()), ("subroot", "string", pa.string()), ("path", PATH, WAY.field("path").type)])
    return _rows_of(manifest.trees, _ways(manifest), "doc_id").mapInArrow(prove, schema)


def _with_id(manifest: Manifest, columns: list[tuple]) -> tuple[str, pa.Schema]:
    """Spark's and Arrow's schema of doc_id and ``columns`` (name, type, Arrow type)."""
    kind = manifest.trees[0].schema["doc_id"].dataType
    return (", ".join([f"doc_id {kind.simpleString()}", *[f"{c} {t}" for c, t, _ in columns]]),
            pa.schema([("doc_id", to_arrow_type(kind)), *[(c, a) for c, _, a in columns]]))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for c in _some(batches):
        for n, nodes, path, subroot in zip(c["n"], c["nodes"], c["path"], c["subroot"]):
            digests = [x["node"] for x in nodes]
            yield [x["doc_id"] for x in nodes], digests, nodes, levels(digests, min(STEP, depth(n))), path, subroot


def checked(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, proof_sha256 and folded_root, of a manifest whose leaves carry ``found``: the
    digest as it is met later (null: as the leaf), folded with the leaf's siblings."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, digests, nodes, rows, path, subroot in _leaves(batches):
            proof, folded = [], []
            for i, x in enumerate(nodes):
                way = siblings(rows, i) + path
                proof.append(hashed([s["left"] + s["right"] for s in way]))
                folded.append(fold(x["found"] or x["node"], way))
            yield pa.RecordBatch.from_pydict({"doc_id": doc, "leaf": digests, "subroot": [subroot] * len(nodes), "proof_sha256": proof,
                                              "folded_root": folded}, schema=out)

    schema, out = _with_id(manifest, [(c, "string", pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")])
    return _rows_of(manifest.trees, _ways(manifest), "doc_id", "found").mapInArrow(check, schema)


def digest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The proofs of all rows against the same table with some texts lower-cased."""
    lowered = [F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in fields]
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(F.col(doc_id).alias("doc_id"), F.col(tree).alias("key"), leaf([F.col(c) for c in fields]).alias("node"),
                         F.when(hit, leaf(lowered)).alias("found"))
    manifest = build(leaves)
    root = F.lit(manifest.root)
    return checked(manifest).select("doc_id", "leaf", "subroot", root.cast("string").alias("root"), "proof_sha256", "folded_root",
                                    (F.col("folded_root") == root).alias("verified"))
