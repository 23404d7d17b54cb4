"""Byte-level BPE encoding and decoding by merge replay.

The distinct words (matches of the pattern) of a batch form one corpus. An inverted index leads from the rank of a
pair of neighbouring tokens to the positions where the pair stands. Ranks are taken from a heap, lowest first; each is
applied at all its positions, and only the two neighbours of a merged pair are looked at again. A merge can open a
pair of lower rank (vocabularies allow it); the rest of that word then waits until the lower rank is done, so that
every word gets its merges in the order that a word alone would. Words seen before are looked up.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trailmark.llm.tables import text_rows
from trailmark.llm.words import slices

KNOWN_BYTES = 160 << 20  # of words that a worker remembers before it forgets them all; sways speed only
WORD_COST = 180  # bytes that a remembered word takes besides its own and its ids


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file: a base64 token and a rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of each word."""
    parts: list[bytes | None] = []
    after: list[int] = []
    before: list[int] = []
    word_of: list[int] = []
    begins: list[int] = []
    places: dict[int, list[int]] = {}
    for w, word in enumerate(words):
        begin, n = len(parts), len(word)
        begins.append(begin)
        if word in ranks or not word:  # a word that is a token needs no merges
            parts.append(word)
            after.append(-1)
            before.append(-1)
            word_of.append(w)
            continue
        parts.extend(word[k:k + 1] for k in range(n))
        after.extend(range(begin + 1, begin + n))
        after.append(-1)
        before.append(-1)
        before.extend(range(begin, begin + n - 1))
        word_of.extend([w] * n)
        for k in range(n - 1):
            rank = ranks.get(word[k:k + 2])
            if rank is not None:
                places.setdefault(rank, []).append(begin + k)
    heap = list(places)
    heapq.heapify(heap)
    get = ranks.get
    while heap:
        rank = heapq.heappop(heap)
        at = places.pop(rank, None)
        if at is None:
            continue
        at.sort()
        waits, late = -1, []
        for i in at:
            left, j = parts[i], after[i]
            if left is None or j < 0:
                continue
            token = left + parts[j]
            if get(token) != rank:
                continue
            if word_of[i] == waits:
                late.append(i)
                continue
            parts[i], parts[j] = token, None
            nxt = after[i] = after[j]
            fresh = []
            if nxt >= 0:
                before[nxt] = i
                fresh.append((get(token + parts[nxt]), i))
            if before[i] >= 0:
                fresh.append((get(parts[before[i]] + token), before[i]))
            for new, place in fresh:
                if new is None:
                    continue
                if new < rank:
                    waits = word_of[i]
                if new in places:
                    places[new].append(place)
                else:
                    places[new] = [place]
                    heapq.heappush(heap, new)
        if late:
            places.setdefault(rank, []).extend(late)
            heapq.heappush(heap, rank)
    out = []
    for w, begin in enumerate(begins):
        ids, k = [], begin
        while k >= 0 and parts[k]:
            ids.append(ranks[parts[k]])
            k = after[k]
        out.append(ids)
    return out


class Codec:
    """The ranks of a file, the splitting pattern, and the words met so far."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.taken = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        words = [self.split(text) for text in texts]
        if self.taken > KNOWN_BYTES:
            self.known, self.taken = {}, 0
        known = self.known
        new = [w for w in set(chain.from_iterable(words)) if w not in known]
        for word, made in zip(new, replay([w.encode() for w in new], self.ranks)):
            known[word] = ids = np.array(made, dtype="<u4").tobytes()
            self.taken += len(word) + len(ids) + WORD_COST
        return [b"".join(map(known.__getitem__, ws)) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(documents: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """Of each row: doc_id, ids (binary, little-endian unsigned 32-bit integers) and, with `decode`, bytes (what the ids
    stand for, from the ids alone, in the same pass).

    A null text counts as empty; an empty text has no ids. `path` is the rank file, which every executor must have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            for low, high, _, _ in slices(batch.column("text")):
                ids = use.encode(batch.column("text").slice(low, high - low).fill_null("").to_pylist())
                columns = {"doc_id": batch.column("doc_id").slice(low, high - low), "ids": pa.array(ids, pa.binary())}
                yield pa.RecordBatch.from_pydict(columns | ({"bytes": pa.array(map(use.decode, ids), pa.binary())} if decode else {}))

    return text_rows(documents).mapInArrow(run, "doc_id long, ids binary" + (", bytes binary" if decode else ""))


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """Of each row of `encoded`: doc_id, ids, bytes (what the ids stand for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            for low, high, _, _ in slices(batch.column("ids")):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "ids": part.column("ids"),
                    "bytes": pa.array(map(use.decode, part.column("ids").to_pylist()), pa.binary())})

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")
