"""Ids of a public tokenizer file, with the ids of words remembered between texts.

The splitting of ``word_bpe_49k.json`` never joins characters across white space, nor
letters with other signs, so a text's ids are those of its parts in order; a part is sent
to the tokenizers library when a worker first meets it. Texts of the first 256 characters
have no combining marks: they are lower-cased and split by the file's own pattern here.
All other texts are split at spaces only. Parts of letters take the file's merges here, many
parts side by side; all others go to the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from dayloom.llm.byte_pairs import byte_letters

#: Parts remembered by one worker, in two generations; longer parts are not kept.
REMEMBERED, LONGEST = 1 << 18, 200
#: The file's splitting pattern within the first 256 characters, after lower-casing.
PARTS = re.compile(
    r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)
#: A part of letters only, with a space before it or not.
LETTERS, SPACED = re.compile("[a-zªµºß-öø-ÿ]+"), re.compile(" ?[a-zªµºß-öø-ÿ]+")
#: Characters that are looked at together, and parts that take their merges together.
TOGETHER, MERGED = 1 << 20, 1 << 14


def split(text: str) -> list[str]:
    """Parts whose ids, one after the other, are the text's."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            return PARTS.findall(text.lower())
    return text.replace("\n", " ").split(" ")


class Merges:
    """The merges of a byte-pair file, taken by many words side by side: in every round each
    word joins its leftmost pair of the lowest rank."""

    NONE = 1 << 30

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocab, end = spec["vocab"], spec.get("end_of_word_suffix") or ""
        self.ended = bool(end)
        letters = sorted(byte_letters().items(), key=lambda x: x[1])
        self.inner = np.array([vocab[c] for c, _ in letters], np.int64)
        self.final = np.array([vocab[c + end] for c, _ in letters], np.int64)
        pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.joined = np.zeros(len(spec["merges"]), np.int64)
        self.joined[[r for r, _ in pairs.values()]] = [i for _, i in pairs.values()]
        # pairs and ranks in a table by hash; a taken place moves a pair to the next
        self.pairs, self.ranks, self.steps = np.full(1 << 20, -1), np.full(1 << 20, self.NONE), 1
        codes, ranks = np.array([*pairs], np.int64), np.array([r for r, _ in pairs.values()], np.int64)
        at = self._place(codes)
        while len(codes):
            free = np.flatnonzero(self.pairs[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.pairs[at[put]], self.ranks[at[put]] = codes[put], ranks[put]
            codes, ranks, at = (np.delete(x, put) for x in (codes, ranks, at))
            at = (at + 1) & 0xFFFFF
            self.steps += len(codes) > 0

    @staticmethod
    def _place(codes: np.ndarray) -> np.ndarray:
        return (codes * 0x1E3779B97F4A7C15 >> 40) & 0xFFFFF

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` if it is never joined."""
        codes = a << 20 | b
        at = self._place(codes)
        found = self.pairs[at]
        out = np.where(found == codes, self.ranks[at], self.NONE)
        more = np.flatnonzero((found != codes) & (found >= 0))
        for _ in range(self.steps - 1):
            if not len(more):
                break
            at[more] = (at[more] + 1) & 0xFFFFF
            found = self.pairs[at[more]]
            same = found == codes[more]
            out[more[same]] = self.ranks[at[more[same]]]
            more = more[~same & (found >= 0)]
        return out

    def encode(self, words: list[bytes], kind: str = "<u4") -> list[bytes]:
        """Ids of each word, none of them empty, as integers of a ``kind``."""
        size = np.dtype(kind).itemsize
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        ids[ends - 1] = self.final[raw[ends - 1]]
        near = np.full(len(ids), self.NONE)
        near[:-1] = self.rank(ids[:-1], ids[1:])
        near[ends - 1] = self.NONE
        word = np.arange(len(words))
        out = [b""] * len(words)
        while len(word):
            starts = np.cumsum(lengths) - lengths
            # the lowest rank of every word, and where it comes first
            least = np.minimum.reduceat(near << 32 | np.arange(len(ids)), starts)
            done = least >> 32 == self.NONE
            if done.any():
                over = np.repeat(done, lengths)
                cuts = (size * np.r_[0, np.cumsum(lengths[done])]).tolist()
                whole = ids[over].astype(kind).tobytes()
                for i, a, b in zip(word[done].tolist(), cuts, cuts[1:]):
                    out[i] = whole[a:b]
                left = ~done
                before = np.cumsum(over)[starts[left]]  # positions that go before each word left
                least = least[left]
                at = (least & 0xFFFFFFFF) - before
                ids, near, lengths, word = ids[~over], near[~over], lengths[left], word[left]
                if not len(word):
                    break
                starts = np.cumsum(lengths) - lengths
            else:
                at = least & 0xFFFFFFFF
            ids[at] = self.joined[least >> 32]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, near = ids[kept], near[kept]
            gone = np.arange(len(word))
            at, starts, lengths = at - gone, starts - gone, lengths - 1
            near[at] = self.NONE
            i = at[at + 1 < starts + lengths]
            near[i] = self.rank(ids[i], ids[i + 1])
            i = at[at > starts] - 1
            near[i] = self.rank(ids[i], ids[i + 1])
        return out


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Parts met lately and before; a part that is met again moves to the first.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.merges = Merges(path)
        #: Parts that take the merges here; a byte-level file's may begin with a space.
        self.whole = LETTERS if self.merges.ended else SPACED

    def learned(self, new: list[str], kind: str = "<u4") -> dict[str, bytes]:
        """Ids of parts not remembered, looked up anew."""
        letters, rest = [], []
        for p in new:
            (letters if len(p) <= LONGEST and self.whole.fullmatch(p) else rest).append(p)
        out = {}
        for start in range(0, len(letters), MERGED):
            some = letters[start : start + MERGED]
            out.update(zip(some, self.merges.encode([p.encode() for p in some], kind)))
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        out.update((p, np.array(e.ids, dtype=kind).tobytes()) for p, e in zip(rest, found))
        return out

    def _ids(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of all parts of a group of texts."""
        young, old = self.young, self.old
        got = dict(zip(parts, map(young.get, parts)))
        if new := [p for p, i in got.items() if i is None]:
            again = {p: i for p in new if (i := old.get(p)) is not None}
            learned = self.learned([p for p in new if p not in again] if again else new)
            got |= again
            got |= learned
            young.update(again)
            young.update((p, i) for p, i in learned.items() if len(p) <= LONGEST)
            if 2 * len(young) > REMEMBERED:
                self.young, self.old = {}, young
        return got

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(split(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[bytes]:
        ids = self._ids(set().union(*group)).__getitem__ if group else None
        for parts in group:
            yield b"".join(map(ids, parts))


_OPEN: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker and file."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]
