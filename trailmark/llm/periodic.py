"""Runs of repeated word sequences, caught online.

Words arrive one after another, or many at once, which gives the same. For every power of two there is a catcher over
the last completed block of that many words: each word that arrives ends a suffix of the block's length, and where the
suffix equals the block, the words from the block on repeat with the distance between the two. A distance from 2^k up to
2^(k+1) is caught by blocks of 2^k words, distances below 16 by blocks of 8 (a run is at least 24 words long). So every
word is compared once a level, by hashes of suffixes that are made from those of half the length.

A catch is compared word by word, then carried to the left and right as far as the words repeat, which joins the squares
of one run; a run that touches the last word goes on when more words arrive. A distance is dropped where a run known
with a divisor of it covers the catch: then it is not the smallest period. As a run is three periods long or more, one
of its blocks lies in its first two periods, so no run is missed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailmark.llm.tables import text_rows
from trailmark.llm.words import BASE, mixed, slices

LEAST_WORDS = 24
LEAST_PERIODS = 3
FIRST_LEVEL = 3  # blocks of 8 words: 8 + 15 < 24, so that a run holds a block and its next place at any distance below 16

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.held, self.size = np.zeros(64, dtype=kind), 0

    def append(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.held):
            wider = np.zeros(2 * (self.size + len(more)), dtype=self.held.dtype)
            wider[:self.size] = self.held[:self.size]
            self.held = wider
        self.held[self.size:self.size + len(more)] = more
        self.size += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.held[:self.size]


class SquareCatcher:
    """Words as numbers go in by `append`; `runs` gives the runs so far. `longest`: no run is longer than this."""

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self.words = Grown(np.int64)
        self.levels: list[Grown] = []  # of level k, hashes of the 2^k words from each place on
        self.starts: dict[int, list[int]] = defaultdict(list)  # by period, in order: stretches that repeat
        self.ends: dict[int, list[int]] = defaultdict(list)

    def append(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Takes more words; gives the (start, period) of squares that they complete and no known run holds."""
        before = self.words.size
        self.words.append(words)
        if before:
            for period, ends in self.ends.items():
                if ends[-1] == before:
                    ends[-1] += self._alike_after(before - period, before)
        caught = []
        for level, low in self._new_hashes():
            for block, period in self._catches(level, low):
                if (start := self._follow(block, period, 1 << level)) is not None:
                    caught.append((start, period))
        return caught

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, in this order."""
        found = [(start, end - start, period) for period in self.starts
                 for start, end in zip(self.starts[period], self.ends[period])
                 if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period)]
        return sorted(found, key=lambda run: (run[0], run[2]))

    def _new_hashes(self) -> Iterator[tuple[int, int]]:
        """Brings each level up to date; gives it with the first place whose hash is new."""
        most = min(self.longest or self.words.size, self.words.size) // LEAST_PERIODS
        level = 0
        while level <= FIRST_LEVEL or (1 << level) <= most:
            if level == len(self.levels):
                self.levels.append(Grown(np.uint64))
            own = self.levels[level]
            low, high = own.size, max(own.size, self.words.size - (1 << level) + 1)
            if level == 0:
                own.append(mixed(self.words.all[low:high].view(np.uint64) * BASE + np.uint64(1)))
            else:
                half, far = self.levels[level - 1].all, 1 << (level - 1)
                own.append(mixed(half[low:high] * BASE + half[low + far:high + far]))
            if level >= FIRST_LEVEL and low < high:
                yield level, low
            level += 1

    def _catches(self, level: int, low: int) -> Iterator[tuple[int, int]]:
        """(block, period), least periods first, where the words of a new place equal the block before its own; on the
        first level, also those where they equal its own block."""
        hashes, width = self.levels[level].all, 1 << level
        places = np.arange(max(low, width), len(hashes))
        blocks = (places >> level) - 1 << level
        found = places[hashes[places] == hashes[blocks]]
        blocks = (found >> level) - 1 << level
        if level == FIRST_LEVEL:
            places = np.arange(low, len(hashes))
            own = places >> level << level
            near = (own < places) & (hashes[places] == hashes[own])
            found, blocks = np.append(found, places[near]), np.append(blocks, own[near])
        periods = found - blocks
        for known in [p for p in self.starts if len(periods)]:  # most catches of long runs go at once
            open_ = ~((periods % known == 0) & self._covered(known, blocks, blocks + periods + width))
            periods, blocks = periods[open_], blocks[open_]
        order = np.lexsort((blocks, periods))
        periods, blocks = periods[order], blocks[order]
        cuts = np.flatnonzero(np.diff(periods)) + 1
        for period, group in zip(periods[np.append(0, cuts)].tolist() if len(periods) else [], np.split(blocks, cuts)):
            yield from ((int(b), period) for b in self._uncovered(group, period, width))

    def _uncovered(self, blocks: np.ndarray, period: int, width: int) -> np.ndarray:
        """The blocks whose catch no run known with a divisor of the period covers."""
        for known in [p for p in self.starts if period % p == 0]:
            blocks = blocks[~self._covered(known, blocks, blocks + period + width)]
        return blocks

    def _covered(self, period: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a stretch known to repeat with the period covers each from start to end."""
        at = np.searchsorted(self.starts[period], starts, "right") - 1
        return (at >= 0) & (np.array(self.ends[period])[at] >= ends)

    def _follow(self, block: int, period: int, width: int) -> int | None:
        """Verifies a catch and carries it both ways; the start of a new square, or None."""
        starts, ends, words = self.starts[period], self.ends[period], self.words.all
        at = bisect_right(starts, block) - 1
        if at >= 0 and ends[at] >= block + period + width:
            return None
        end = block + period + width
        if not np.array_equal(words[block:block + width], words[block + period:end]):
            return None
        start = block - self._alike_before(block, block + period)
        end += self._alike_after(block + width, end)
        starts.append(start)
        ends.append(end)
        return start if end - start >= 2 * period else None

    def _alike_after(self, a: int, b: int) -> int:
        """How many words from a and from b on are the same."""
        words, done, step = self.words.all, 0, 64
        while b + done < len(words):
            x, y = words[a + done:a + done + step], words[b + done:b + done + step]
            differ = np.flatnonzero(x[:len(y)] != y)
            if len(differ):
                return done + int(differ[0])
            done += len(y)
            step *= 2
        return done

    def _alike_before(self, a: int, b: int) -> int:
        """How many words before a and before b are the same."""
        words, done, step = self.words.all, 0, 64
        while done < a:
            step = min(step, a - done)
            differ = np.flatnonzero(words[a - done - step:a - done] != words[b - done - step:b - done])
            if len(differ):
                return done + step - 1 - int(differ[-1])
            done += step
            step *= 2
        return done


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words. Lists of about one length go through one catcher, each closed by a word of its
    own."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    alike = defaultdict(list)
    for k, words in enumerate(texts):
        if len(words) >= LEAST_WORDS:
            alike[(len(words) // LEAST_PERIODS).bit_length()].append(k)
    for members in alike.values():
        words = pa.array([w for k in members for w in texts[k]], pa.large_binary())
        numbers = words.dictionary_encode().indices.to_numpy()
        length = np.array([len(texts[k]) for k in members])
        ends = np.cumsum(length)
        stream = np.insert(numbers.astype(np.int64), ends, -1 - np.arange(len(members)))
        first = ends - length + np.arange(len(members))
        catcher = SquareCatcher(int(length.max()))
        catcher.append(stream)
        for start, size, period in catcher.runs():
            at = bisect_right(first.tolist(), start) - 1 if len(members) > 1 else 0
            out[members[at]].append((start - int(first[at]), size, period))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with most periods, then the first, then that of the smallest period."""
    return min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]))


def planted_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, from some word on the same few again and again; a null id stays as it is."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    again = words[start:start + period]
    return words[:start] + (again * ((n - start) // period + 1))[:n - start]


def periodic_runs(documents: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period by start, then period), strongest (the run with
    most periods, or null), collapsed (the words joined by one space, repeats within runs left out).

    `documents` needs doc_id and text; other columns are ignored. A null, empty or wordless text has no runs and the
    collapsed text ''. Words are compared as they are. `rewrite` may change a document's words before. Repeated rows are
    rows of their own; an empty table gives an empty result. Each text is looked at by itself, in one task.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ("start", "length", "period")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(low, high - low)
                raw, cuts = data.tobytes(), offsets.tolist()
                texts = [raw[a:b].split() for a, b in zip(cuts, cuts[1:])]
                if rewrite:
                    texts = [rewrite(k, words) for k, words in zip(ids.to_pylist(), texts)]
                runs = runs_of(texts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids, "runs": pa.array([[dict(zip(names, r)) for r in rs] for rs in runs], pa.list_(run_type)),
                    "strongest": pa.array([dict(zip(names, strongest(rs))) if rs else None for rs in runs], run_type),
                    "collapsed": pa.array([without_repeats(w, rs).decode() for w, rs in zip(texts, runs)], pa.large_string())})

    kind = "struct<start: long, length: long, period: long>"
    return text_rows(documents).mapInArrow(run, f"doc_id long, runs array<{kind}>, strongest {kind}, collapsed string")
