"""N-gram Jaccard join: a size-aware heavy-light join.

Documents are sets of hashed word shingles. Equal sets are one class. Shingles have one global order, rare ones
first, taken from a fixed-size count sketch (it sways the cost only, never the result). By the prefix principle, two
sets of similarity t and sizes a >= b share at least ceil(t * a) shingles, so they share d of the first
`a - ceil(t * a) + d`:

* small (light) sets enumerate every pair (d = 2) of their prefix: a bucket is a pair of shingles;
* large (heavy) sets scan the inverted lists of their prefix (d = 1): a bucket is one shingle. Small sets that a large
  one can reach are in these lists too.

The boundary is the size at which the cost over all sets, from their sizes and the sketch, is least.

Nothing is made for all pairs of a bucket: each bucket first compares its members with one pivot. Members linked to it
are one component then, and pairs inside a component need no comparison; only members of a bucket that are still in
different components are compared in a second round. The pivot is the member in whose order the shingle stands first. The links found so connect exactly the documents that all links
connect. A pair of a bucket counts only where the shared shingle stands early enough in both prefixes for their sizes,
and its prefixes must allow the similarity before its sets are fetched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.tables import FILTER_BITS, marked, text_rows, unmatched, written
from trailmark.llm.words import shingle_sets, slices

WIDTH = 3
SIMILARITY = (90, 100)
SCANNED = 32  # entries of a list that are looked at for the cost of moving and sorting one
SKETCH_BITS = 20  # 2^20 counters: 4 MB as counts, 1 MB as broadcast ranks, whatever the corpus
BLOCK = 1 << 12


def least_shared(size: np.ndarray | int, similarity: tuple[int, int]):
    """Fewest shingles that a set of this size shares with any set it is linked to."""
    top, bottom = similarity
    return -((-size * top) // bottom)


# --- the sketch -----------------------------------------------------------------------------------------------------

def count_sketch(texts: DataFrame, width: int) -> np.ndarray:
    """How often shingles of each residue occur (once per document), for all documents."""
    size = 1 << SKETCH_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                sets = list(shingle_sets(data, offsets, width))
                if sets:
                    counts += np.bincount((np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), minlength=size)
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1)).tolist()
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(used, pa.int32()), "salt": pa.array([salt] * len(used), pa.int32()),
            "counts": pa.array([packed_counts(blocks[k]) for k in used], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        total = sum(unpacked_counts(x) for x in table["counts"].to_pylist())
        return pa.table({"block": table["block"].slice(0, 1), "salt": table["salt"].slice(0, 1),
                         "counts": pa.array([packed_counts(np.minimum(total, 2**31 - 1))], pa.binary())})

    kind = "block int, salt int, counts binary"
    parts = texts.select("text").mapInArrow(partial, kind)
    once = parts.groupBy("block", "salt").applyInArrow(summed, kind)
    rows = once.groupBy("block").applyInArrow(summed, kind).collect()  # 256 rows of at most 16 KB
    out = np.zeros((size // BLOCK, BLOCK), dtype=np.int64)
    for row in rows:
        out[row["block"]] = unpacked_counts(row["counts"])
    return out.reshape(-1)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counters byte by byte of all, compressed: few have more than a byte."""
    return zlib.compress(counts.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_counts(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(block), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The sketch in half powers of two: a byte per counter."""
    return np.minimum(2 * np.log2(counts + 1), 255).astype(np.uint8)


def list_length(counts: np.ndarray) -> float:
    """Expected length of the list of a random shingle: variance over mean of the counters, without the frequent."""
    usual = counts[counts <= np.quantile(counts, 0.99)]
    return max(1.0, float(usual.var() / usual.mean())) if len(usual) and usual.mean() > 0 else 1.0


def boundary(histogram: dict[int, int], length: float, similarity: tuple[int, int]) -> int:
    """Largest size that enumerates pairs of its prefix; `histogram`: sets by size (in steps of an eighth power of 2).

    Costs are in entries of buckets, which are moved, sorted and held on disk. A list also has its entries looked at, at much
    less each, so that entries do not grow with the lists as the corpus grows."""
    if not histogram:
        return 0
    sizes = np.array(sorted(histogram), dtype=np.int64)
    number = np.array([histogram[s] for s in sizes.tolist()], dtype=float)
    first = sizes - least_shared(sizes, similarity) + 1
    light = number * first * (first + 1) / 2
    heavy = number * first * (1 + length / SCANNED)
    total = np.concatenate([[0.0], np.cumsum(light)]) + np.append(np.cumsum(heavy[::-1])[::-1], 0.0)
    best = int(np.argmin(total))
    return int(sizes[best - 1]) if best else 0


# --- signatures -----------------------------------------------------------------------------------------------------

def in_order(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where a sorted set's shingles stand in the global order."""
    return np.argsort(ranks[(shingles & np.uint64(len(ranks) - 1)).astype(np.int64)], kind="stable")


def prefix_of(shingles: np.ndarray, ranks: np.ndarray, light_most: int, similarity: tuple[int, int]):
    """Prefix of a set in the global order, the shingle after it if pairs of these are its buckets, whether the prefix's lists hold it."""
    size, (top, bottom) = len(shingles), similarity
    spare = size - int(least_shared(size, similarity))
    if spare == 0 and size * bottom < (size + 1) * top:
        return (), None, False  # linked with equal sets only
    first = shingles[in_order(shingles, ranks)[:spare + 2]].view(np.int64)
    listed = size > light_most or size * bottom >= (light_most + 1) * top
    return first[:spare + 1], int(first[-1]) if size <= light_most else None, listed


def signatures(texts: DataFrame, ranks: Broadcast, light_most: int, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Of each row: doc_id, n_shingles, digest of its set, prefix, the shingle after it (null if not light), listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                sizes, digests, prefixes, after, listed = [], [], [], [], []
                for found in shingle_sets(data, offsets, width):
                    sizes.append(len(found))
                    digests.append(blake2b(found.tobytes(), digest_size=16).digest())
                    for held, x in zip((prefixes, after, listed), prefix_of(found, ranks.value, light_most, similarity)):
                        held.append(x)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(low, high - low), "n_shingles": pa.array(sizes, pa.int64()),
                    "digest": pa.array(digests, pa.binary()), "prefix": pa.array(prefixes, longs),
                    "after": pa.array(after, pa.int64()), "listed": pa.array(listed, pa.bool_())})

    return texts.mapInArrow(run, "doc_id long, n_shingles long, digest binary, prefix array<long>, after long, listed boolean")


def size_histogram(texts: DataFrame, width: int) -> dict[int, int]:
    """Rows by number of words less width - 1, rounded down to eighth powers of two: a few hundred rows at most."""
    words = F.size(F.split(F.trim(F.col("text")), "[ \t\n\x0b\x0c\r]+")) - (width - 1)
    step = F.floor(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(words, F.lit(1))) * 8) / 8)).cast("long")
    return {r["step"]: r["n"] for r in texts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
            if r["step"] is not None}


# --- checking pairs -------------------------------------------------------------------------------------------------

def filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for each residue of the hashed ids: at most 2^18 words of 64 bits reach the driver."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def sets_of(texts: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted classes, from the texts of their first documents."""
    wanted = classes.join(nodes, "node", "left_semi")
    bits = texts.sparkSession.sparkContext.broadcast(np.packbits(filter_of(wanted.select(F.col("rep").alias("doc_id")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(keep[batch.column("place").to_numpy()]))
            for _, _, data, offsets in slices(batch.column("text")):
                sets = list(shingle_sets(data, offsets, width))
                yield pa.RecordBatch.from_pydict({
                    "digest": pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    found = texts.select(place.alias("place"), "text").mapInArrow(run, "digest binary, shingles array<long>")
    return found.dropDuplicates(["digest"]).join(wanted.select("digest", "node"), "digest").select("node", "shingles")


def with_both(pairs: DataFrame, sides: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with columns of both: left_x, right_x."""
    for end, side in (("b", "right"), ("a", "left")):
        pairs = pairs.join(sides.select(F.col("node").alias(end), *(F.col(c).alias(f"{side}_{c}") for c in columns)), end)
    return pairs


def likely(pairs: DataFrame, sides: DataFrame, ranks: Broadcast, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose prefixes allow the similarity. Up to the earlier of the two prefixes' ends, the shared shingles
    are known; beyond it, at most the rest of the smaller set is shared."""
    top, bottom = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value

        def places(prefix: pa.Scalar) -> np.ndarray:
            x = prefix.values.to_numpy().view(np.uint64)
            rank = table[(x & np.uint64(len(table) - 1)).astype(np.int64)].astype(np.uint64)
            return rank << np.uint64(56) | x >> np.uint64(8)

        for batch in batches:
            keep = []
            sizes = zip(batch.column("left_n").to_pylist(), batch.column("right_n").to_pylist())
            left, right = batch.column("left_prefix"), batch.column("right_prefix")
            for k, (n, m) in enumerate(sizes):
                x, y = places(left[k]), places(right[k])
                end = min(x[-1], y[-1])
                x, y = x[:np.searchsorted(x, end, "right")], y[:np.searchsorted(y, end, "right")]
                most = len(np.intersect1d(x, y)) + min(n - len(x), m - len(y))
                keep.append(bottom * most >= top * (n + m - most))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = marked(sides.select("node", "n", "prefix"), ends_of(pairs), "node").where("found").select("row.*")
    got = with_both(pairs, own, "n", "prefix").select("a", "b", "left_n", "left_prefix", "right_n", "right_prefix")
    return got.mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    top, bottom = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column("left_shingles"), batch.column("right_shingles")
            for k in range(batch.num_rows):
                x, y = left[k].values.to_numpy(), right[k].values.to_numpy()
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(bottom * shared >= top * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    got = with_both(pairs, sets, "shingles").select("a", "b", "left_shingles", "right_shingles")
    return got.mapInArrow(run, "a long, b long")


# --- components -----------------------------------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots, root the smallest node of the component.

    Alternating stars: every node passes the least node it knows to its larger, then to its smaller neighbours, until
    nothing changes. Each step is an aggregation and a join; no neighbourhood is gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(),
                    "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v and u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.union(least.where("v > m").select("v", F.col("m").alias("u"))).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = written(small.union(least.select("v", F.col("m").alias("u"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now


# --- the join -------------------------------------------------------------------------------------------------------

def jaccard_components(documents: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY,
                       links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included);
    with `links` also n_links, the number of other documents that it is linked to.

    `documents` needs doc_id and text; other columns are ignored. A null or wordless text has no shingles and its own
    id as component. Rows with one doc_id are documents of their own; a null doc_id is never a component's id unless
    all its ids are null. An empty table gives an empty result.

    Links are counted between different sets and weighted by how many documents have each: copies are never expanded,
    but every pair of different sets in a bucket is looked at, whatever its component.

    `similarity` is above one half: below, two different sets may be linked by one shared shingle, and light sets are
    found by two.
    """
    if 2 * similarity[0] <= similarity[1]:
        raise ValueError("the similarity must be above one half")
    spark = documents.sparkSession
    texts = text_rows(documents)
    counts = count_sketch(texts, width)
    light_most = boundary(size_histogram(texts, width), list_length(counts), similarity)
    ranks = spark.sparkContext.broadcast(ranks_of(counts))
    made = signatures(texts, ranks, light_most, width, similarity)
    rows = written(made.withColumn("node", F.monotonically_increasing_id()), "signatures")
    # a class is its row with the smallest doc_id
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("digest", F.col("first.doc_id").alias("rep"), "copies", F.col("first.node").alias("node")), "classes")
    copies = rows.where("n_shingles > 0").select("digest", F.col("node").alias("row")).join(
        classes.where("copies > 1").select("digest", "node"), "digest").where("row <> node")
    copies = written(copies.select(F.col("row").alias("node")), "copies")
    sides = rows.where(F.size("prefix") > 0).select("node", F.col("n_shingles").alias("n"), "prefix", "after", "listed")
    sides = unmatched(sides, copies, "node")
    # the pivot has the fewest rarer shingles: of near copies it is the one with the fewest edits
    bucket = Window.partitionBy("key")
    shared = postings_of(sides).select("key", "place", "node", "n").repartition("key").withColumns({
        "at": F.min(F.struct("place", "node", "n")).over(bucket), "members": F.count(F.lit(1)).over(bucket)})
    shared = shared.where("members > 1").select(
        "key", "node", "n", "place", F.col("at.node").alias("pivot"), F.col("at.n").alias("pivot_n"), F.col("at.place").alias("pivot_place"))
    shared = written(shared, "shared")

    def checked(pairs: DataFrame) -> DataFrame:
        hopeful = written(likely(pairs, sides, ranks, similarity), "likely")
        sets = written(sets_of(texts, classes, ends_of(hopeful), width), "sets")
        return linked(hopeful, sets, similarity)

    stars = written(shared.where((F.col("node") != F.col("pivot")) & may_link("n", "place", "pivot_n", "pivot_place", similarity))
                    .select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    near = written(checked(stars), "links")
    roots = components(near)

    placed = shared.select("key", "node", "n", "place").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"))
    mixed_keys = parts.groupBy("key").agg(F.max_by("root", "members").alias("major"), F.count(F.lit(1)).alias("parts"))
    open_ = placed.join(mixed_keys.where("parts > 1"), "key").select("key", "node", "n", "place", "root", (F.col("root") != F.col("major")).alias("minor"))
    open_ = written(open_, "open")
    # one of a pair is outside the bucket's largest component, and the smaller set has the shingle early
    smaller = open_.where(is_early("n", "place", similarity)).toDF("key", "x", "x_n", "x_place", "x_root", "x_minor")
    open_link = (F.col("root") != F.col("x_root")) & (F.col("x_n") <= F.col("n")) & may_link("n", "place", "x_n", "x_place", similarity)
    rest = smaller.where("x_minor").join(open_, "key").where(open_link).unionByName(
        smaller.where("not x_minor").join(open_.where("minor"), "key").where(open_link))
    rest = rest.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    rest = written(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = components(near.union(checked(rest)))

    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if links:
        pairs = written(pairs_within(shared, similarity), "pairs")
        ends = written(checked(pairs), "all-links")
        ends = ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        weights = classes.select(F.col("node").alias("b"), "copies")
        counts = ends.join(weights, "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
        named = named.join(counts, "node", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
        alone = alone.withColumn("n_links", F.lit(0).cast("long"))
    named = named.select("digest", *alone.columns[2:])
    out = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(named, "digest")
    return out.select(alone.columns).union(alone)


def pairs_within(shared: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): the pairs of different sets in a bucket that may be linked, the smaller one having the shingle early."""
    members = shared.select("key", "node", "n", "place")
    smaller = members.where(is_early("n", "place", similarity)).toDF("key", "x", "x_n", "x_place")
    both = smaller.join(members, "key").where((F.col("x") != F.col("node")) & (F.col("x_n") <= F.col("n")) &
                                              may_link("n", "place", "x_n", "x_place", similarity))
    return both.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def postings_of(sides: DataFrame) -> DataFrame:
    """(node, n, key, place): the buckets of each set, with the shingle's place in its prefix (for pairs of shingles
    the second's, less one: that many others may stand before a shared pair). Pairs are made here, and never held."""
    entry = "transform(prefix, (k, i) -> struct(k as key, cast(i as bigint) as place))"
    first = "concat(prefix, array(after))"  # shingles that the pairs are of
    pair = "struct(xxhash64(h, k) as key, cast(i + j as bigint) as place)"
    pairs = f"if(after is null, array(), flatten(transform(prefix, (h, i) -> transform(slice({first}, i + 2, size(prefix)), (k, j) -> {pair}))))"
    entries = F.expr(f"concat({pairs}, if(listed, {entry}, array()))")
    return sides.select("node", "n", F.explode(entries).alias("e")).select("node", "n", "e.key", "e.place")


def shared_by(n: Column, m: Column, similarity: tuple[int, int]) -> Column:
    """Fewest shingles that linked sets of these sizes share."""
    top, bottom = similarity
    return F.floor(((n + m) * top + (top + bottom - 1)) / (top + bottom))


def may_link(n: str, place: str, m: str, other: str, similarity: tuple[int, int]) -> Column:
    """Whether the sizes allow a link, and whether the shared shingle stands early enough in both for enough to follow."""
    n, m = F.col(n), F.col(m)
    least = shared_by(n, m, similarity)
    near = F.least(n, m) * similarity[1] >= F.greatest(n, m) * similarity[0]
    return near & (F.col(place) <= n - least) & (F.col(other) <= m - least)


def is_early(n: str, place: str, similarity: tuple[int, int]) -> Column:
    """Whether a shingle stands early enough for a link to a set of the same size or a larger one."""
    return F.col(place) <= F.col(n) - shared_by(F.col(n), F.col(n), similarity)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
