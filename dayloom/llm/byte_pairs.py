"""BPE encoding and decoding with a contiguous rank array.

A short word keeps its parts and the ranks of neighbouring parts in two lists. The
smallest rank is looked for again and again; its right boundary is deleted and the two
neighbouring ranks are refreshed. Long words (over ``SHORT`` bytes) take the same merges
from a heap, because scanning them would be quadratic.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Bytes up to which the scan is used.
SHORT = 256
#: Words remembered by one Python worker.
REMEMBERED = 1 << 19
NEVER = 1 << 60
#: White space of the splitting pattern, written out because libraries differ in ``\s``.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others are numbered from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankArrayBpe:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.pieces = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.of_byte = [vocab[c] for c in sorted(letters, key=letters.get)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.joined.append(vocab[a + b])
        added = spec.get("added_tokens") or []
        self.added = {t["content"]: t["id"] for t in added}
        self.pieces |= {t["id"]: t["content"].encode() for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words = regex.compile(SPLIT)
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.of_byte[b] for b in word]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, joined = self.ranks.get, self.joined
        near = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        while near:
            least = min(near)
            if least == NEVER:
                break
            i = near.index(least)
            parts[i] = joined[least]
            del parts[i + 1], near[i]
            if i < len(near):
                near[i] = rank((parts[i], parts[i + 1]), NEVER)
            if i:
                near[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        """Parts in a linked list; heap entries that no longer hold are skipped."""
        n, rank = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]), NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank((parts[i], parts[j]), NEVER) != r:
                continue
            parts[i], parts[j] = self.joined[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank((parts[a], parts[b]), NEVER)) < NEVER:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode()), dtype="<u4").tobytes()
        if len(word) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        known, word = self.known.get, self._word
        return b"".join([known(w) or word(w) for w in self.words.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.added_split is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(
            np.array([self.added[x]], dtype="<u4").tobytes() if x in self.added else self._plain(x)
            for x in self.added_split.split(text)
            if x
        )

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_OPEN: dict[str, RankArrayBpe] = {}


def encoder(path: str) -> RankArrayBpe:
    """One encoder per worker and file."""
    if path not in _OPEN:
        _OPEN[path] = RankArrayBpe(path)
    return _OPEN[path]


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids, decoded)``: ids as binary, little-endian 32-bit, and their text.

    One narrow pass, no shuffle. A null text counts as empty, repeated rows stay
    repeated, a null key stays null, further columns are not read.
    """
    return docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(
        lambda batches: (_encoded(b, path, key) for b in batches),
        f"`{key}` {dict(docs.dtypes)[key]}, ids binary, decoded string",
    )


def _encoded(batch: pd.DataFrame, path: str, key: str) -> pd.DataFrame:
    bpe = encoder(path)
    ids = [bpe.encode(t) for t in batch["_text"]]
    return pd.DataFrame({key: batch[key].to_numpy(), "ids": ids, "decoded": [bpe.decode(i) for i in ids]})


def digest_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its count of tokens and SHA-256 digests of ids and decoded text.

    The digests are taken beside the encoder, so that ids never leave the worker.
    Nulls and repeated rows as in ``encode_texts``.
    """

    def digests(batches):
        bpe = encoder(path)
        for b in batches:
            rows = []
            for t in b["_text"]:
                ids = bpe.encode(t)
                back = bpe.decode(ids).encode("utf-8", "replace")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, key, b[key].to_numpy())
            yield out

    return docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(
        digests, f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
