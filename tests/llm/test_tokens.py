import hashlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from loadscope.llm import bpe, token_file

RANDOM = random.Random(5)
LETTERS = "ab é\n\t  　\x1c\x85'sre<|endoftext|>1２१ßñ!!.. ​漢字🙂́\x00  "
TEXTS = ["", "a" * 3000, "ab" * 2000 + " x", " " * 50, "<|endoftext|>", "x<|endoftext|> y <|endoftext|>"] + [
    "".join(RANDOM.choice(LETTERS) for _ in range(RANDOM.randint(0, 40))) for _ in range(3000)]


def test_bpe_equals_the_library(tokenizer):
    own, lib = bpe.Bpe(tokenizer), Tokenizer.from_file(tokenizer)
    for text in TEXTS:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text
        assert own.decode(own.encode(text)) == lib.decode(ids, skip_special_tokens=False), text
        assert np.frombuffer(token_file.library_ids(tokenizer, text), "<u2").tolist() == ids, text


def test_many_texts_equal_the_library_and_a_word_is_made_once(tokenizer, monkeypatch):
    lib = Tokenizer.from_file(tokenizer)
    texts = TEXTS + ["word word, word. Straße! Straße x", "it's, it'; (a). 12, 12 \"q\". ..., 日本, é;", "z" * 400 + ", " + "z" * 400]
    for at_once in (token_file.AT_ONCE, 50):
        monkeypatch.setattr(token_file, "AT_ONCE", at_once)
        for text, ids in zip(texts, token_file.all_ids(tokenizer, texts)):
            assert np.frombuffer(ids, "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids, text
    known, made = token_file.Known(np.dtype("<u2")), []
    monkeypatch.setattr(token_file, "library", lambda path, got=token_file.library(tokenizer): (
        *got[:4], known, lambda new: made.extend(new) or got[5](new)))
    for _ in range(3):
        token_file.all_ids(tokenizer, ["a word, a word. Word!", "the word; word"])
    assert sorted(made) == ["Word", "a", "word"] and known.words.to_pylist() == made
    monkeypatch.setattr(token_file, "CACHE", 4)
    for _ in range(2):  # a worker keeps so many words; others are made again
        token_file.all_ids(tokenizer, [" one two three"])
    assert len(known.words) == 4 and made[3:] == ["one", "two", "three", "two", "three"]


def test_short_and_long_merges_agree(tokenizer):
    own = bpe.Bpe(tokenizer)
    for text in ("abracadabra" * 20, "the" * 80, "ééé" * 30):
        ids = [own.of_byte[b] for b in text.encode()]
        assert own.merge_short(list(ids)) == own.merge_long(list(ids))


def test_decode_of_broken_utf8(tokenizer):
    own, lib = bpe.Bpe(tokenizer), Tokenizer.from_file(tokenizer)
    for _ in range(300):
        ids = [RANDOM.randrange(50257) for _ in range(8)]
        assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids, skip_special_tokens=False)


def expected(rows, tokenizer):
    lib = Tokenizer.from_file(tokenizer)
    out = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out.append((d, ids, lib.decode(ids, skip_special_tokens=False)))
    return out


def test_bpe_query(spark, edge, none, docs, tokenizer):
    for df in (edge, docs):
        want = sorted([(d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                       for d, i, t in expected(df.select("doc_id", "text").collect(), tokenizer)], key=str)
        got = sorted([tuple(r) for r in bpe.digest(df, tokenizer).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()], key=str)
        assert got == want
    assert bpe.digest(none, tokenizer).count() == 0


def test_token_file_round_trip(spark, edge, none, docs, tokenizer):
    got = {r.doc_id: r for r in token_file.digest(docs, tokenizer, 2).collect()}
    start = 0
    for d, ids, _ in sorted(expected(docs.select("doc_id", "text").collect(), tokenizer)):
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        start += r.n_tokens
    rows = token_file.digest(edge, tokenizer, 2).collect()
    want = sorted([(d, len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for d, i, _ in expected(edge.select("doc_id", "text").collect(), tokenizer)], key=str)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], key=str) == want
    ordered = sorted(rows, key=lambda r: (r.start, r.n_tokens))
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    ids = [r.doc_id for r in ordered]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert token_file.digest(none, tokenizer, 2).collect() == []


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 300):
        counts = (rng.pareto(1, n) * 10 + 1).astype(np.int64)
        for limit in (9, 20):
            bits = token_file.code_lengths(counts, limit)
            assert bits.max() <= limit and (n == 1 or sum(2.0 ** -bits) <= 1)
        heap = sorted(counts.tolist())  # the cost of Huffman's tree, without a limit
        cost = 0
        while len(heap) > 1:
            a, b = heap[0], heap[1]
            cost += a + b
            heap = sorted(heap[2:] + [a + b])
        if n > 2:
            assert (token_file.code_lengths(counts, 60) * counts).sum() == cost


def test_block_round_trip():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 5000), 49999).astype(np.int64)
    used, counts = np.unique(ids, return_counts=True)
    bits = token_file.code_lengths(counts, token_file.MAX_BITS)
    code, length = np.zeros(50000, np.uint64), np.zeros(50000, np.int64)
    code[used], length[used] = token_file.canonical(used, bits), bits
    payload, marks = token_file.coded(ids, code, length)
    assert (token_file.decoded(payload, marks, len(ids), token_file.decode_table(used, bits)) == ids).all()
