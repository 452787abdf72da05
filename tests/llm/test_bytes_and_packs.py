"""BPE against the public library, packing against its rules."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from dayloom.llm import byte_pairs, packing, subwords
from dayloom.llm.queries import BYTE_BPE, WORD_BPE
from dayloom.llm.subwords import WordTokenizer

SIGNS = "ab th e \n\t  'sré'llÀİΣσ\x1c\x1d\x85\xa0​　中文😀é́ß1½²٣Ⅷ$%#<|endoftext|>\x00\x7f﻿"


def texts(n=3000, seed=3):
    rng = random.Random(seed)
    made = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return ["", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "the" * 700, "a" * 3000, *made]


def test_ranks_equal_the_library_and_round_trip():
    want, got = Tokenizer.from_file(BYTE_BPE), byte_pairs.RankArrayBpe(BYTE_BPE)
    for t in texts():
        ids = got.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode(t, add_special_tokens=False).ids
        assert got.decode(ids) == t == want.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_scan_and_heap_agree():
    bpe, rng = byte_pairs.RankArrayBpe(BYTE_BPE), random.Random(5)
    for _ in range(300):
        parts = [bpe.of_byte[ord(rng.choice("abcdethin "))] for _ in range(rng.randint(1, 200))]
        assert bpe._scan(list(parts)) == bpe._heap(list(parts))


def test_bytes_that_are_no_text():
    bpe = byte_pairs.RankArrayBpe(BYTE_BPE)
    ids = np.array([bpe.of_byte[0xC3], bpe.of_byte[0x41]], "<u4").tobytes()
    assert bpe.decode(ids) == "�A"


def test_digests_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "abc", "y"), (2, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in byte_pairs.digest_texts(df, BYTE_BPE).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert {(1, 0, none), (2, 0, none)} < out and len(out) == 3
    assert byte_pairs.digest_texts(df, BYTE_BPE).count() == 4
    assert byte_pairs.digest_texts(df.limit(0), BYTE_BPE).count() == 0
    back = byte_pairs.encode_texts(df, BYTE_BPE).filter("doc_id is null").first()
    assert back.decoded == "abc"


def test_words_one_by_one_equal_whole_texts():
    want, got = Tokenizer.from_file(WORD_BPE), WordTokenizer(WORD_BPE)
    some = texts(seed=4)
    for t, ids in zip(some, got.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_merges_side_by_side_equal_the_library(path):
    rng, want = random.Random(7), Tokenizer.from_file(path)
    words = {"a", "aaaaaaa", "banana", "the", "ß", "übergröße", "tion" * 50}
    words |= {"".join(rng.choice("aeinorst" if i % 2 else "abcdefghijklmnopqrstuvwxyzäéß") for _ in range(rng.randint(1, 30))) for i in range(3000)}
    words = sorted(words)
    got = subwords.Merges(path).encode([w.encode() for w in words])
    for w, ids, e in zip(words, got, want.encode_batch(words, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, w
    assert subwords.Merges(path).encode([]) == []


def test_parts_of_letters_do_not_go_to_the_library():
    words = WordTokenizer(WORD_BPE)
    real, asked = words.tokenizer, []

    class Counting:
        def encode_batch_fast(self, parts, **options):
            asked.extend(parts)
            return real.encode_batch_fast(parts, **options)

    words.tokenizer = Counting()
    text = "Invented haanthing, über 12 reoush's " + "x" * 300
    ids = next(words.encode([text]))
    assert np.frombuffer(ids, "<u4").tolist() == real.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == ["'s", ",", "1", "2", "x" * 300]


@pytest.mark.parametrize("limit", [7, 64])
def test_places_fill_and_fit(limit):
    rng = random.Random(limit)
    counts = {n: rng.choice([0, 1, 2, 50, 10_000]) for n in range(1, limit + 1)}
    slots = packing.place({n: c for n, c in counts.items() if c}, limit)
    placed, ends = defaultdict(int), defaultdict(list)
    for r in slots.itertuples():
        assert r.first == placed[r.length]
        placed[r.length] += r.n
        if r.n < 200:
            for s in range(r.n):
                ends[r.sequence + s].append((r.offset, r.length))
    assert dict(placed) == {n: c for n, c in counts.items() if c}
    assert all(sum(n for _, n in sorted(x)) <= limit for x in ends.values())


def check_packs(rows, docs, limit, end=2):
    want = Tokenizer.from_file(WORD_BPE)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for key, text in docs:
        ids = np.array([*want.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        at = 0
        for start, length, crc, total in sorted(pieces[key]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_pack_keeps_every_id_once(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["ab", "the", "x."]) for _ in range(rng.choice([0, 3, 3, 3, 40, 400])))) for i in range(300)]
    docs.append((300, None))
    df = spark.createDataFrame([(*d, 5, "o") for d in docs], "doc_id long, text string, start int, length string")
    rows = packing.pack(df, WORD_BPE, limit=64, bucket_rows=16).collect()
    check_packs(rows, docs, 64)
    used = sum(r.length for r in rows)
    assert used / (64 * (1 + max(r.sequence_id for r in rows))) > 0.97
    assert packing.pack(df.limit(0), WORD_BPE).count() == 0
    twice = packing.pack(df.filter("doc_id < 2").union(df.filter("doc_id < 2")), WORD_BPE, limit=64).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
