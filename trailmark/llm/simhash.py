"""SimHash near duplicates with tables of pivot distances.

A fingerprint of 64 bits holds, bit by bit, whether over half of a text's shingle hashes have the bit set. Two
fingerprints are linked when few bits differ. Distances to fixed reference fingerprints (pivots) tell most pairs apart
without comparing them: by the triangle inequality linked fingerprints are about as far from every pivot, so a pair
whose largest difference over the table of pivot distances exceeds the limit is discarded, and only survivors are
verified.

The pivots are rows of the 64 x 64 Walsh matrix. Their distances are, but for a factor, independent coordinates of the
fingerprint, so each of them discards about half of the unrelated pairs that the ones before it left.

Spark needs equal keys to bring pairs together: fingerprints are cut into segments, of which a linked pair has all but
`most` equal, so they meet in a bucket for each choice of equal segments; how many segments there are follows from the
number of fingerprints, by cost, never the result. Equal fingerprints are one node. Inside a bucket the table is
sorted by the first pivot's distance, and only rows in reach of each other are looked at. A bucket gives the edges of a
forest that joins what is linked in it, never all its pairs.

Large buckets are cut into blocks by a hash. Their blocks are joined first each by itself, and then members that are
still in another component than the bucket's largest one meet all blocks, so that no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.ngram_join import components
from trailmark.llm.tables import text_rows, written
from trailmark.llm.words import slices

WIDTH = 4
SEED = 42
MOST = 4
BITS = 64
PIVOTS = 16
BLOCK = 2048  # members of a bucket that are compared in one go
PAIRS = 1 << 20  # pairs held at once
STRETCH = 1 << 16  # shingles hashed at once
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# --- fingerprints ---------------------------------------------------------------------------------------------------

def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """The XXH64 values of a text's shingles, repeats included, a stretch at a time."""
    words = text.translate(LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    width = min(width, len(words))
    starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(starts), STRETCH):
        cuts = zip(starts[low:low + STRETCH].tolist(), ends[low:low + STRETCH].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in cuts], dtype=np.uint64)


def bits_set(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many of each row's hashes have each bit set: a histogram of each byte, then the bits of byte values."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(row * 256 + octets[:, k], minlength=rows * 256).reshape(rows, 256) @ BYTE_BITS
                           for k in range(8)], axis=1)


def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    """The fingerprint of each text; 0 for one without words."""
    total, count = np.zeros((len(texts), BITS), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    held, rows, waiting = [], [], 0

    def settle() -> None:
        nonlocal waiting
        if held:
            row = np.repeat(np.array(rows), [len(h) for h in held])
            first, last = rows[0], rows[-1] + 1
            total[first:last] += bits_set(np.concatenate(held), row - first, last - first)
        held.clear(), rows.clear()
        waiting = 0

    for r, text in enumerate(texts):
        for hashes in shingle_hashes(text, width):
            held.append(hashes)
            rows.append(r)
            count[r] += len(hashes)
            waiting += len(hashes)
            if waiting >= STRETCH:
                settle()
    settle()
    return np.packbits(2 * total > count[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                raw, cuts = data.tobytes(), offsets.tolist()
                found = fingerprints_of([raw[a:b] for a, b in zip(cuts, cuts[1:])], width)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(low, high - low), "fp": pa.array(found.view(np.int64), pa.int64())})

    return text_rows(documents).mapInArrow(run, "doc_id long, fp long")


# --- buckets --------------------------------------------------------------------------------------------------------

def segments_for(number: int, most: int) -> int:
    """Segments at which the rows to deal out and the pairs to look at cost least, for fingerprints in general position.
    A row is dealt, sorted and placed at about a hundred times the cost of looking at a pair."""

    def cost(segments: int) -> float:
        tables = comb(segments, most)
        return 100.0 * number * tables + tables * float(number) ** 2 / 2 ** (BITS * (segments - most) / segments + 1)

    return min(range(most + 1, 2 * most + 3), key=cost)


def bucket_masks(segments: int, most: int) -> list[int]:
    """The bits that each table of buckets compares: all segments but `most`."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    masks = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(masks, segments - most)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bucket_keys(fp: Column, segments: int, most: int) -> Column:
    """The keys of a fingerprint's buckets. Keys are hashes: two buckets in one only means more to look at."""
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(mask)).cast("long")))
                     for k, mask in enumerate(bucket_masks(segments, most))))


def walsh_rows(count: int) -> np.ndarray:
    """`count` rows of the Walsh matrix of order 64, spread over it, as 64-bit words: bit k of row j is the parity of j & k."""
    places = np.arange(BITS, dtype=np.uint8)
    rows = (np.arange(count) * (BITS // count)).astype(np.uint8) if count < BITS else places
    parity = np.bitwise_count(rows[:, None] & places[None, :]) & 1
    return np.packbits(parity, axis=1, bitorder="little").view("<u8").reshape(-1)


def forest(group: np.ndarray, fp: np.ndarray, root: np.ndarray | None, pivots: np.ndarray, most: int):
    """Edges (a, b) as places in `fp` that join all that is linked inside a group; groups stand together. With `root`,
    only pairs of different roots are looked at."""
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    fp, table = fp[order], table[order]
    reach = group[order].astype(np.int64) * 4 * BITS + table[:, 0]
    rows = np.arange(len(fp))
    ahead = np.searchsorted(reach, reach + most, "right") - rows - 1
    until = np.cumsum(ahead)
    label, low = rows.copy(), 0
    while low < len(rows):
        before = int(until[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(until, before + PAIRS, "right")))
        a = np.repeat(rows[low:high], ahead[low:high])
        b = np.arange(len(a)) - np.repeat(until[low:high] - ahead[low:high] - before, ahead[low:high]) + a + 1
        low = high
        apart = label[a] != label[b]
        if root is not None:
            apart &= root[order[a]] != root[order[b]]
        a, b = a[apart], b[apart]
        for k in range(1, table.shape[1]):
            if not len(a):
                break
            near = np.abs(table[a, k] - table[b, k]) <= most
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= most
        label = merged(label, a[near], b[near])
    joined = np.flatnonzero(label != rows)
    return order[joined], order[label[joined]]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member of each component) after joining the pairs."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def bucket_forests(placed: DataFrame, most: int, by_root: bool = False) -> DataFrame:
    """(a, b): edges that join what is linked inside a (key, block) of `placed`; only whole groups are looked at, as
    many at once as a batch holds."""
    names = ["key", "block", "fp", *(["root"] if by_root else [])]
    pivots = walsh_rows(PIVOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, block, fp = columns[:3]
            change = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            group = np.append(0, np.cumsum(change))
            a, b = forest(group, fp.view(np.uint64), columns[3] if by_root else None, pivots, most)
            return pa.RecordBatch.from_pydict({"a": pa.array(fp[a]), "b": pa.array(fp[b])})

        held = [np.zeros(0, dtype=np.int64) for _ in names]
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, names)]
            if len(held[0]):
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                cut = len(last) if last.all() else int(np.flatnonzero(~last)[-1]) + 1
                if cut < len(last):
                    yield edges([x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield edges(held)

    dealt = placed.select("key", F.col("block").cast("long").alias("block"), *names[2:])
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "a long, b long")


def across_blocks(cut: DataFrame, roots: DataFrame, most: int, block: int) -> DataFrame:
    """Edges between blocks of the cut buckets: members outside the bucket's largest component meet every block of it.

    Both sides are cut, so a task holds two blocks at most. Rows: members x blocks of outsiders, outsiders x blocks.
    """
    placed = written(cut.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "cut")
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    major = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), (F.sum("n") - F.max("n")).alias("others"))
    open_ = placed.join(major.where("others > 0"), "key").withColumn("groups", F.ceil(F.col("others") / block))
    visit = F.pmod(F.xxhash64("fp", F.lit("visit")), F.col("groups"))
    members = open_.select("key", "fp", "root", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("visit"))
    guests = open_.where("root <> major").select(
        "key", "fp", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), visit.alias("visit"))
    cells = members.unionByName(guests).distinct()
    return bucket_forests(cells.select(F.xxhash64("key", "visit").alias("key"), "block", "fp", "root"), most, by_root=True)


def simhash_components(documents: DataFrame, width: int = WIDTH, most: int = MOST, segments: int | None = None,
                       block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id reachable by links, itself included).

    `documents` needs doc_id and text; other columns are ignored. A null or wordless text has fingerprint 0 and links
    like any other; a text of fewer words than `width` is one shingle. Rows with one doc_id are documents of their own;
    a null doc_id is a component's id only if all its ids are null. An empty table gives an empty result.
    """
    rows = written(fingerprints(documents, width), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    segments = segments or segments_for(nodes.count(), most)
    entries = nodes.select("fp", F.explode(bucket_keys(F.col("fp"), segments, most)).alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / block)
    placed = entries.join(shared, "key").select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("block"))
    placed = written(placed, "buckets")
    links = written(bucket_forests(placed, most), "links")
    roots = components(links)
    cut = placed.where("blocks > 1")
    if not cut.isEmpty():
        more = written(across_blocks(cut, roots, most, block), "links")
        roots = components(links.union(more))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
