"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text: str | None, k: int) -> set:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def near_components(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    """(doc_id, n, component) of (doc_id, text) rows."""
    sets = [shingle_set(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least: dict = {}
    for x, (d, _) in zip(label, rows):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted(((d, len(s), d if not s else least.get(x)) for (d, _), s, x in zip(rows, sets, label)), key=str)


def stripped(texts: list[str | None], window: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, sha256 of what is left) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        mark = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                mark[i] += 1
                mark[i + window] -= 1
        gone = np.cumsum(mark)[:len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text: str | None) -> list[str]:
    return PLAIN.findall(lowered(text))


def contaminated(rows: list[tuple], items: list[tuple], size: int) -> list[tuple]:
    """(doc_id, n_words, n_hit, names) of (doc_id, text) rows against (item_id, text) items."""
    windows: dict = {}
    for item, text in items:
        words = plain_words(text)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        words, hit, names = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                owners = windows.get(tuple(words[i:i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    names |= owners
        out.append((doc, len(words), len(hit), tuple(sorted(str(x) for x in names if x is not None))))
    return out


def covers(words: list[str], wanted: list[str], span: int) -> set:
    """(start, size) of the runs of at most ``span`` words that hold all wanted ones and contain no shorter such run."""
    need = set(wanted)
    runs = {(i, n) for n in range(1, span + 1) for i in range(len(words) - n + 1) if need <= set(words[i:i + n])}
    return {(i, n) for i, n in runs if (i + 1, n - 1) not in runs and (i, n - 1) not in runs}


def crc32(data: bytes) -> int:
    """CRC-32 bit by bit."""
    c = 0xFFFFFFFF
    for byte in data:
        c ^= byte
        for _ in range(8):
            c = 0xEDB88320 ^ (c >> 1) if c & 1 else c >> 1
    return c ^ 0xFFFFFFFF


def resampled(rows: list[tuple], target: list, n_max: int, buckets: int, seed: int, percent: int, least: int) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    known: dict = {}

    def features(text) -> list[int]:
        words = plain_words(text)
        runs = [" ".join(words[i:i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]
        return [known[r] if r in known else known.setdefault(r, crc32(r.encode()) % buckets) for r in runs]

    corpus, wanted = Counter(b for _, t in rows for b in features(t)), Counter(b for t in target for b in features(t))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    scored = []
    for doc, text in rows:
        found = features(text)
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= least))
    order = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = Counter(order[:percent * len(order) // 100])
    places: dict = {}
    for i, r in enumerate(order, 1):
        places.setdefault(r, []).append(i)
    return [(*r[:4], places[r].pop(0) if r[4] and drawn[r] > 0 and not drawn.subtract([r]) else None) for r in scored]


def merkle(rows: list[tuple], lower: int) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of rows; field ``lower`` is lower-cased in the
    copy. The third field is the tree's key."""
    def sha(*parts: str) -> str:
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row) -> str:
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def tree(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in groups[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            found = list(r)
            if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 and r[lower] is not None:
                found[lower] = lowered(r[lower])
            node, proof = leaf(found), []
            for levels, at in ((trees[k], i), (top, g)):
                for level in levels[:-1]:
                    run = level[at - at % 8:at - at % 8 + 8]
                    proof += run[:at % 8] + run[at % 8 + 1:]
                    node = sha(*run[:at % 8], node, *run[at % 8 + 1:])
                    at //= 8
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], sha(*proof), node))
    return out
