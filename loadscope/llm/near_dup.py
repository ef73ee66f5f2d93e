"""Operator 3: MinHash near-dedup with sequential Bayesian verification.

A document's set is that of its distinct k-word shingles (lower-cased A-Z; fewer than k words: the
whole sequence as one), each a 64-bit hash. Documents with equal sets form a class, known by a
128-bit digest of the set, and one member stands for it, so thousands of copies cost one class.

Candidates: MinHash signatures in bands; bands and rows per band follow from the threshold so that
a pair at the threshold shares no band with probability ``MISS`` at most. Two classes that share a
band (are in one of its buckets) are candidates, unless they are in one component already:

* First each bucket pairs its members with one of them, that which shares most buckets with others
  (of copies of one text, that is the text itself), which connects most large groups.
* Then the members of buckets that still hold several components are compared in blocks: a bucket is
  cut into blocks of ``BLOCK`` members (and ``SET_SHINGLES`` shingles), each two blocks meet in one task. A
  first pass compares signatures and names the members of surviving pairs of different components; a
  second one brings the full sets of those members, verifies the surviving pairs exactly, the likeliest
  first, and hands on a spanning forest of the links: pairs whose components the task has already
  connected need no verification and no row. It runs within blocks, then, over the components so found,
  between blocks, in as many rounds as the number of blocks has bits. So a bucket of thousands makes fewer rows than it has
  members, no pair is capped, and no link between two components is left out.

Verification: signatures (one byte per hash function) are compared ``STEP`` functions at a time; a
pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the
threshold is below its step's share of ``PRUNE``. Survivors have their full shingle sets compared exactly.

Components: smallest doc_id reachable over links and classes. Null or wordless text: the empty set,
linked with nothing, kept. Repeated rows are in one class; rows equal in doc_id share all answers.
A null doc_id comes last in a class; a class of null ids only has a null component and is compared like
any other. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.llm.common import components, dropped, fresh, held, saved

#: A pair at the threshold shares no band; a pair is pruned, in any of the steps, although it reaches the threshold.
MISS, PRUNE = 1e-5, 1e-4
#: Hash functions: those of the bands at most, and all that verification compares.
MOST_HASHES, FUNCTIONS = 240, 400
STEP = 40
ROWS = 500
#: Members and shingles of a block; two blocks are in one task.
BLOCK, SET_SHINGLES = 2048, 1 << 22
#: Members of a block compared with the other block at a time.
SLAB = 128
SEED = 20240229

_U = np.uint64
_RNG = np.random.default_rng(SEED)
#: One random odd 64-bit number a byte value, for word hashes.
BYTE_KEYS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = _U(0x9E3779B97F4A7C15)
BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SHIFT_KEYS = (_RNG.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint64) | _U(1)).astype(np.uint32)
XOR_KEYS = _RNG.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[32, *range(9, 14)]] = True

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    raw = LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    if not len(raw):
        return np.zeros(0, np.uint64)
    gap = BREAK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_KEYS[raw] * up[:-1], dtype=np.uint64)])
    word = mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    n = len(word)
    m = min(n, k)
    acc = np.full(max(1, n - k + 1), m, np.uint64)
    for i in range(m):
        acc = acc * BASE + word[i:i + len(acc)]
    return np.unique(mixed(acc))


def shape(threshold: float) -> tuple[int, int]:
    """(bands, rows per band): the most rows whose bands fit MOST_HASHES functions at the MISS bound."""
    best = (math.ceil(math.log(MISS) / math.log(1 - threshold)), 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(MISS) / math.log1p(-threshold ** rows))
        if bands * rows <= MOST_HASHES:
            best = (bands, rows)
    return best


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions over the set (32 bits)."""
    x = mixed(hashes * _U(0xD6E8FEB86659FD93))
    x = (x >> _U(32)).astype(np.uint32)
    low = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        part = (x[at:at + 512, None] ^ XOR_KEYS) * SHIFT_KEYS
        np.minimum(low, part.min(0), out=low)
    return low


def least_matches(threshold: float) -> list[tuple[int, int]]:
    """(functions compared, fewest matches at which the pair goes on) for every step. With a uniform
    prior and k matches of m, P(similarity >= t) = P(Binomial(m + 1, t) <= k) <= P(Binomial(m, t) <= k), the
    probability that a pair at the threshold has so few, which is compared. One-byte values match by
    chance once in 256, which raises t. The steps share PRUNE, so that all together prune a pair at the threshold
    with that probability at most."""
    t = threshold + (1 - threshold) / 256
    each = PRUNE / (FUNCTIONS // STEP)
    out = []
    for m in range(STEP, FUNCTIONS + 1, STEP):
        below, k = 0.0, -1
        while below < each and k < m:
            k += 1
            below += math.comb(m, k) * t ** k * (1 - t) ** (m - k)
        out.append((m, k))
    return out


def profiles(docs: DataFrame, k: int, threshold: float, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), sig (one byte a function) and bands (64-bit keys)."""
    bands, rows = shape(threshold)
    weights = np.array([pow(int(BASE), i + 1, 1 << 64) for i in range(rows)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("shingles",), list)  # lets go of what an earlier operator kept in this worker
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                n, d1, d2, sigs, keys = [], [], [], [], []
                for t in b.column("text").to_pylist():
                    s = shingles(t or "", k)
                    n.append(len(s))
                    d1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    d2.append(int(mixed(s ^ BASE).sum(dtype=np.uint64).astype(np.int64)))
                    if len(s):
                        low = signature(s)
                        key = (low[:bands * rows].reshape(bands, rows).astype(np.uint64) * weights).sum(1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)
                        keys.append(mixed(key).astype(np.int64))
                        sigs.append(low.astype(np.uint8).tobytes())
                    else:
                        keys.append([])
                        sigs.append(b"")
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                     pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "sig", "bands"])

    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sig binary, bands array<bigint>")


def class_id() -> Column:
    return F.xxhash64("n", "d1", "d2")


def likely(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose signatures pass every Bayesian step."""
    steps = least_matches(threshold)
    with_u = pairs.join(sigs.select(F.col("cid").alias("u"), F.col("sig").alias("su")), "u")
    both = with_u.join(sigs.select(F.col("cid").alias("v"), F.col("sig").alias("sv")), "v").select("u", "v", "su", "sv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, FUNCTIONS) for c in ("su", "sv"))
            alive, same, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for m, least in steps:
                same = same + (a[alive, done:m] == b[alive, done:m]).sum(1)
                on = same >= least
                alive, same, done = alive[on], same[on], m
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("u", "v")], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def survivors(a: dict, b: dict, same: bool, steps: list[tuple[int, int]], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Members x of ``a`` and y of ``b`` in different components whose sizes allow a link and whose signatures
    pass every Bayesian step, with their matches, slab by slab. A pair that shares an earlier bucket is left to
    that one, as the bands' whole keys (``before``) tell."""
    for at in range(0, len(a["cid"]), SLAB):
        part = slice(at, at + SLAB)
        na, nb = a["n"][part, None], b["n"][None, :]
        x, y = np.nonzero((a["comp"][part, None] != b["comp"][None, :]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
        x += at
        if same:
            x, y = x[x < y], y[x < y]
        match, done = np.zeros(len(x), np.int32), 0
        for m, least in steps:
            match = match + (a["sig"][x, done:m] == b["sig"][y, done:m]).sum(1)
            on = match >= least
            x, y, match, done = x[on], y[on], match[on], m
        for earlier in range(a["before"].shape[1]):
            on = a["before"][x, earlier] != b["before"][y, earlier]
            x, y, match = x[on], y[on], match[on]
        yield x, y, match


def block_counts(state: DataFrame) -> DataFrame:
    """(key, blocks) of each bucket."""
    return state.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SET_SHINGLES)).cast("int").alias("blocks"))


def _in_blocks(state: DataFrame, members: DataFrame, of_task, schema: str, which: str = "true") -> DataFrame:
    """Runs ``of_task(band, key, one block, another or the same)`` for each two blocks of each bucket, or those that
    ``which`` says of ``own`` and ``other``. ``state``: band, key, cid, comp, n; ``members``: cid, sig, bands and
    what else a block's columns are to hold."""
    more = [c for c in members.columns if c not in ("cid", "sig", "bands")]
    sizes = block_counts(state)
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    rows = state.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(which)
    rows = rows.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "comp", "n")
    before = F.slice("bands", F.lit(1), F.col("band"))  # the keys of the bands before this one
    rows = rows.join(members, "cid").select("band", "key", "i", "j", "own", "cid", "comp", "n", "sig", before.alias("before"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cid", "comp", "n", "sig", "before", *more]

        def out(group: tuple, held: list) -> pa.RecordBatch:
            def side(block: int) -> dict:
                c = dict(zip(names, zip(*(h[1:] for h in held if h[0] == block)))) or {k: () for k in names}
                n = len(c["cid"])
                return c | {"cid": np.array(c["cid"], np.int64), "comp": np.array(c["comp"], np.int64), "n": np.array(c["n"], np.int64),
                            "sig": np.frombuffer(b"".join(c["sig"]), np.uint8).reshape(n, FUNCTIONS),
                            "before": np.array(c["before"], np.int64).reshape(n, group[0])}
            band, key, i, j = group
            one = side(i)
            return of_task(band, key, one, one if i == j else side(j))

        now, held = None, []
        for batch in batches:
            at, keys = batch.column("before").offsets.to_numpy(), batch.column("before").values.to_numpy()
            before = [keys[a:b] for a, b in zip(at[:-1], at[1:])]
            columns = (batch.column(c).to_pylist() for c in ("band", "key", "i", "j", "own", "cid", "comp", "n", "sig"))
            for r in zip(*columns, before, *(batch.column(c).to_pylist() for c in more)):
                if r[:4] != now:
                    if len(held) > 1:
                        yield out(now, held)
                    now, held = r[:4], []
                held.append(r[4:])
        if len(held) > 1:
            yield out(now, held)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def in_question(state: DataFrame, sigs: DataFrame, threshold: float, percent: int) -> DataFrame:
    """(band, key, cid) of the members of ``state`` that have a surviving pair in the bucket."""
    steps = least_matches(threshold)

    def of_task(band: int, key: int, a: dict, b: dict) -> pa.RecordBatch:
        ids: set = set()
        for x, y, _ in survivors(a, b, a is b, steps, percent):
            ids.update(a["cid"][x].tolist(), b["cid"][y].tolist())
        return pa.RecordBatch.from_arrays([pa.array([band] * len(ids), pa.int32()), pa.array([key] * len(ids), pa.int64()), pa.array(list(ids), pa.int64())],
                                          ["band", "key", "cid"])

    return _in_blocks(state, sigs, of_task, "band int, key long, cid long").distinct()


def rounds(state: DataFrame) -> list[str]:
    """The order of a bucket's block pairs: each block by itself, then blocks that differ in the last bit of their
    number only, then in the bit before it, and so on. A round starts from the components of the rounds
    before, in which the blocks then differ in few components, and so makes few links."""
    most = block_counts(state).agg(F.max("blocks")).first()[0] or 1
    return ["own = other", *[f"shiftright(own ^ other, {g}) = 1" for g in range((most - 1).bit_length())]]


def forest(state: DataFrame, members: DataFrame, threshold: float, percent: int, which: str) -> DataFrame:
    """(u, v): of each two blocks that ``which`` says (``rounds``), links of full sets that connect all
    components which any of their links connects, fewer than the components. ``members``: cid, sig, bands, hashes."""
    steps = least_matches(threshold)

    def of_task(band: int, key: int, a: dict, b: dict) -> pa.RecordBatch:
        sets = [[np.frombuffer(h, np.uint64) for h in side["hashes"]] for side in (a, b)]
        pairs = list(survivors(a, b, a is b, steps, percent))
        x, y, match = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, np.int64) for k in range(3))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for k in np.argsort(-match, kind="stable").tolist():
            one, two = find(int(a["comp"][x[k]])), find(int(b["comp"][y[k]]))
            if one == two:
                continue
            s, t = sets[0][x[k]], sets[1][y[k]]
            common = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * common >= percent * (len(s) + len(t) - common):
                root[one] = two
                links.append(sorted((int(a["cid"][x[k]]), int(b["cid"][y[k]]))))
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in links], pa.int64()), pa.array([e[1] for e in links], pa.int64())], ["u", "v"])

    return _in_blocks(state, members, of_task, "u long, v long", which).distinct()


def full_sets(docs: DataFrame, ids: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(cid, hashes) of the classes of ``ids`` (cid, rep): the shingle set of a document of the class."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(ids.select(F.col("rep").alias("_r")).distinct(), F.expr("doc_id <=> _r"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                sets = [shingles(t or "", k) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(s) for s in sets], pa.int64()), pa.array([int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64()),
                     pa.array([int(mixed(s ^ BASE).sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["n", "d1", "d2", "hashes"])

    made = rows.mapInArrow(run, "n long, d1 long, d2 long, hashes binary").select(class_id().alias("cid"), "hashes")
    return made.join(ids.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""
    with_u = pairs.join(sets.select(F.col("cid").alias("u"), F.col("hashes").alias("hu")), "u")
    both = with_u.join(sets.select(F.col("cid").alias("v"), F.col("hashes").alias("hv")), "v").select("u", "v", "hu", "hv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("hu"), batch.column("hv")):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) and class_size of every row."""
    spark, threshold = docs.sparkSession, percent / 100
    every = saved(profiles(docs, k, threshold, doc_id, text), "profiles")
    classes = saved(every.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"))
                    .withColumn("cid", class_id()), "classes")
    # One row for each class: of its members, those of the smallest id, which are alike.
    c = classes.select(F.col("rep").alias("_r"), F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "cid")
    stand = (every.where("n > 0").join(c, F.expr("doc_id <=> _r and n = _n and d1 = _d1 and d2 = _d2"))
             .select("cid", "n", "sig", "bands").dropDuplicates(["cid"]))
    stand = saved(stand, "standing")
    dropped(spark)
    band_rows = saved(stand.select("cid", "n", F.posexplode("bands").alias("band", "key")), "bands")
    shared = band_rows.groupBy("key").count().where("count > 1").select("key")
    live = saved(band_rows.join(shared, "key", "left_semi"), "buckets")
    dropped(spark, band_rows)
    sigs = stand.select("cid", "sig", "bands")
    shares = live.join(live.groupBy("key").count(), "key").groupBy("cid").agg(F.sum("count").alias("shares"))
    live = live.join(shares, "cid")

    def opened(label: DataFrame | None) -> DataFrame:
        """The members of the buckets that hold several components."""
        state = live.withColumn("comp", F.col("cid")) if label is None else live.join(label, "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
        state = state.select("cid", "n", "band", "key", "shares", "comp")
        open_keys = state.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
        return saved(state.join(open_keys, "key", "left_semi"), "open")

    def sets_of(ids: DataFrame) -> DataFrame:
        return saved(full_sets(docs, ids.join(classes.select("cid", "rep"), "cid"), k, doc_id, text), "sets")

    def labelled(links: DataFrame) -> DataFrame:
        return saved(components(links, "u", "v").select(F.col("id").alias("cid"), "component"), "labels")

    label = None
    state = opened(label)
    if state.limit(1).count():
        # max_by is aggregated map-side: a bucket's middle is found without bringing the bucket together.
        middle = state.groupBy("key").agg(F.max_by(F.struct("cid", "n"), F.struct("shares", "cid")).alias("p")).select("key", F.col("p.cid").alias("p"), F.col("p.n").alias("p_n"))
        sized = 100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n")
        pairs = (state.join(middle, "key").where((F.col("cid") != F.col("p")) & sized)
                 .select(F.least("cid", "p").alias("u"), F.greatest("cid", "p").alias("v")).distinct())
        pairs = saved(likely(pairs, sigs, threshold), "pairs")
        sets = sets_of(pairs.select(F.col("u").alias("cid")).union(pairs.select("v")).distinct())
        links = saved(confirmed(pairs, sets, percent), "links")
        dropped(spark, sets, pairs, state)
        label = labelled(links)
        state = opened(label)
        asked = saved(in_question(state, sigs, threshold, percent), "asked")
        if asked.limit(1).count():
            sets = sets_of(asked.select("cid").distinct())
            state = saved(state.join(asked, ["band", "key", "cid"], "left_semi"), "asked-state")
            for which in rounds(state):
                state = state.drop("comp").join(label, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
                links = links.union(saved(forest(state, sigs.join(sets, "cid"), threshold, percent, which), "forest"))
                label = labelled(links)
            dropped(spark, sets)
    if label is None:
        named = classes.select("n", "d1", "d2", "class_size", F.col("rep").alias("component_id"))
    else:
        joined = classes.join(label, "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
        least = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = joined.join(least, "comp").select("n", "d1", "d2", "class_size", "component_id")
    named = saved(named, "components")
    dropped(spark, stand)
    out = every.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      component.eqNullSafe(F.col("doc_id")).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def kept_rows(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns. Of rows
    that repeat both doc_id and text one stays."""
    def key(i: Column) -> Column:
        return F.coalesce(i.cast("string"), F.lit("null"))

    name, body = fresh(docs, "_kept_key"), fresh(docs, "_kept_text")
    stay = near_duplicates(docs, k, percent, doc_id, text).where("kept").select(key(F.col("doc_id")).alias(name)).distinct()
    held = docs.withColumns({name: key(F.col(doc_id)), body: F.xxhash64(F.col(text))}).join(stay, name, "left_semi")
    return held.dropDuplicates([name, body]).drop(name, body)


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3, 85)
