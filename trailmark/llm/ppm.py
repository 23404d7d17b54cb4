"""Language-model scoring by prediction by partial matching (PPM).

A text is its words (A-Z lowered), each closed by a space, and an end symbol: a stream of bytes over whole texts, in
which contexts cross words. The context of a symbol is the last ORDER, ORDER - 1, ..., 0 symbols; before a text stand
start symbols. A context gives a seen symbol (n - 1/2) / T and the escape D / 2T (T: symbols seen, D: different ones);
symbols of a context that was escaped from are excluded below it; the last resort is uniform over the symbols left. So
the probabilities of all texts sum to one.

A context of ORDER bytes and its symbol are one 64-bit number, exactly, the nearest byte first (a gram). So the sorted
grams are the trie of all orders: the grams of a shorter context stand together, and its counts are sums over them.
The trie grows with the corpus and stays distributed: chunks of documents count their distinct grams, which are split
at range bounds and sent as sorted blocks; a range holds the trie of its grams, and only contexts that a bound
falls into (prefixes of the bound) need counts of other ranges. A gram is scored once for the whole corpus; each chunk gets
back the scores of its own grams, in their order, and sums them over the positions of its documents. Words go the same way,
dealt by a hash. A chunk is what one task reads in a row, so documents are moved once, compressed.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.tables import fold_of, written
from trailmark.llm.words import slices

END = 256
SYMBOLS = 257
ORDER = 7
START_BYTE, END_BYTE = 13, 10  # in grams; neither is a byte of the stream
CHUNK_BYTES = 24 << 20  # text that is scored together in one task
TEXT_LEVEL = 6  # of zstd, for the texts
PART_WORDS = 1_000_000  # grams of a range, over all chunks
SLICE = 2 << 20  # bytes of text whose grams are made together
BLOCK = 250_000  # grams of a written block
SPREAD = np.uint64(0x9E3779B97F4A7C15)
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- counting -------------------------------------------------------------------------------------------------------

def dealt(documents: DataFrame, held_out: Column) -> tuple[DataFrame, int]:
    """The rows, in partitions that are not much smaller than CHUNK_BYTES of text, and how many chunks their text fills."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                            held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    return rows.coalesce(max(2 * chunks, documents.sparkSession.sparkContext.defaultParallelism)), chunks


def packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte of all, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpacked(block: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(block), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Which of a block's sorted grams are the first of their context."""
    context = keys >> np.uint64(8)
    return np.append(True, context[1:] != context[:-1])[:len(keys)]


def packed_scores(keys: np.ndarray, lp: np.ndarray, times: np.ndarray, totals: np.ndarray) -> bytes:
    """What tells the log10 probabilities of a block's grams: of grams seen, how often; of each context, its number; of the
    others, the probability itself."""
    starts = np.flatnonzero(starts_of(keys))
    parts = packed(times), packed(np.maximum.reduceat(totals, starts)), packed(lp[times == 0])
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def unpacked_scores(keys: np.ndarray, block: bytes) -> np.ndarray:
    """The log10 probabilities of the grams that stand first among `keys`."""
    parts, at = [], 0
    while at < len(block):
        end = at + 4 + int.from_bytes(block[at:at + 4], "little")
        parts.append(block[at + 4:end])
        at = end
    times = unpacked(parts[0], np.int64)
    totals = unpacked(parts[1], np.int64)[np.cumsum(starts_of(keys[:len(times)])) - 1]
    out, seen = np.empty(len(times)), times > 0
    out[seen] = np.log10((times[seen] - 0.5) / totals[seen])
    out[~seen] = unpacked(parts[2], np.float64)
    return out


def packed_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", TEXT_LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_rows(blocks: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blocks])


def in_buckets(words: Iterable[bytes], buckets: int) -> dict[int, list[bytes]]:
    """Sorted words by bucket."""
    out: dict[int, list[bytes]] = defaultdict(list)
    for word in sorted(words):
        out[zlib.crc32(word) % buckets].append(word)
    return out


def filled(schema: pa.Schema, chunk: int, rows: int, **columns: list) -> pa.RecordBatch:
    columns["chunk"] = [chunk] * rows
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema],
                                      schema=schema)


def packed_keys(keys: np.ndarray) -> bytes:
    """A sorted block of grams: differences, byte by byte of all, compressed."""
    if not len(keys):
        return b""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(block: bytes) -> np.ndarray:
    if not block:
        return np.zeros(0, dtype=np.uint64)
    return np.cumsum(unpacked(block, np.uint64), dtype=np.uint64)


def reduced(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def merged(known: np.ndarray, counts: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with counts (changed in place), and others of them put in; little memory besides."""
    at = np.searchsorted(known, keys)
    old = at < len(known)
    old[old] = known[at[old]] == keys[old]
    counts[at[old]] += n[old]
    return np.insert(known, at[~old], keys[~old]), np.insert(counts, at[~old], n[~old])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def grams_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of texts given by their words, and the number of each text's."""
    start = bytes([START_BYTE]) * ORDER
    streams = [start + b" ".join([*words, bytes([END_BYTE])]) for words in texts]
    lengths = np.array([len(x) for x in streams], dtype=np.int64)
    data = np.frombuffer(b"".join(streams), dtype=np.uint8).astype(np.uint64)
    out = data[ORDER:].copy()
    for back in range(1, ORDER + 1):
        out |= data[ORDER - back:len(data) - back] << np.uint64(8 * (8 - back))
    firsts = np.cumsum(lengths) - lengths
    inside = np.ones(len(data), dtype=bool)
    inside[(firsts[:, None] + np.arange(ORDER)).ravel()] = False
    return out[inside[ORDER:]], lengths - ORDER


def texts_of(docs: pa.Table) -> Iterator[tuple[list[list[bytes]], list[bool]]]:
    """The words of documents and whether they are held out, by stretches of their text."""
    for batch in docs.combine_chunks().to_batches():
        held = batch.column("held_out").to_pylist()
        for low, high, data, offsets in slices(batch.column("text"), SLICE):
            raw, where = data.tobytes().translate(FOLD), offsets.tolist()
            yield [raw[a:b].split() for a, b in zip(where, where[1:])], held[low:high]


def chunk_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk its documents (chunk, docs), its distinct words by bucket, the end token among them (chunk, bucket, words,
    counts), and its distinct grams in sorted blocks (chunk, grams, counts, size), with their counts in training rows."""
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("bucket", pa.int32()), ("words", pa.binary()),
                        ("grams", pa.binary()), ("counts", pa.binary()), ("size", pa.int64())])

    def closed(chunk: int, seen: Counter, known: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for bucket, words in in_buckets(seen, buckets).items():
            n = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
            yield filled(schema, chunk, 1, bucket=[bucket], words=[zlib.compress(b" ".join(words), 1)], counts=[packed(n)])
        for k in range(0, len(known), BLOCK):
            keys, n = known[k:k + BLOCK], counts[k:k + BLOCK]
            yield filled(schema, chunk, 1, grams=[packed_keys(keys)], counts=[packed(n)], size=[len(keys)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty() -> tuple[Counter, np.ndarray, np.ndarray]:
            return Counter(), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        chunk, taken, (seen, known, counts) = TaskContext.get().partitionId() << 32, 0, empty()
        for batch in batches:
            for low, high, data, _ in slices(batch.column("text"), min(SLICE, CHUNK_BYTES)):
                part = batch.slice(low, high - low)
                yield filled(schema, chunk, 1, docs=[packed_rows(part)])
                for texts, held in texts_of(pa.Table.from_batches([part])):
                    for is_held in (False, True):
                        some = [words for words, h in zip(texts, held) if bool(h) == is_held]
                        if not some:
                            continue
                        for words in some:
                            words = [*words, b""]
                            seen.update(dict.fromkeys(words, 0) if is_held else words)
                        keys, n = counted(grams_of(some)[0])
                        known, counts = merged(known, counts, keys, 0 * n if is_held else n)
                taken += len(data) + 16 * (high - low)
                if taken >= CHUNK_BYTES:
                    yield from closed(chunk, seen, known, counts)
                    chunk, taken, (seen, known, counts) = chunk + 1, 0, empty()
        if taken:
            yield from closed(chunk, seen, known, counts)

    return rows.select("doc_id", "held_out", "text").mapInArrow(
        count, "chunk long, docs binary, bucket int, words binary, grams binary, counts binary, size long")


def word_counts(lists: DataFrame) -> DataFrame:
    """(chunk, bucket, c, tokens, different): of each chunk's words of a bucket the counts in all chunks, in their order; with
    one row of a bucket the training tokens of the bucket and the different words among them."""

    def look(group: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for words, counts in zip(group["words"].to_pylist(), group["counts"].to_pylist()):
            for word, n in zip(zlib.decompress(words).split(b" "), unpacked(counts, np.int64).tolist()):
                total[word] = total.get(word, 0) + n
        found = []
        for words in group["words"].to_pylist():
            own = zlib.decompress(words).split(b" ")
            found.append(packed(np.fromiter(map(total.__getitem__, own), dtype=np.int64, count=len(own))))
        others = [0] * (len(found) - 1)
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "c": pa.array(found, pa.binary()),
                         "tokens": pa.array([sum(total.values()), *others], pa.int64()),
                         "different": pa.array([sum(n > 0 for n in total.values()), *others], pa.int64())})

    return lists.groupBy("bucket").applyInArrow(look, "chunk long, bucket int, c binary, tokens long, different long")


# --- the trie -------------------------------------------------------------------------------------------------------

def context_of(keys: np.ndarray, order: int) -> np.ndarray:
    """The last `order` bytes of the grams' contexts, as numbers."""
    return keys >> np.uint64(8 * (8 - order)) if order else np.zeros_like(keys)


def shorter(pairs: np.ndarray) -> np.ndarray:
    """(context, symbol) numbers without the farthest byte of the context."""
    return pairs >> np.uint64(16) << np.uint64(8) | pairs & np.uint64(255)


def bounds_of(blocks: DataFrame, parts: int, size: int) -> np.ndarray:
    """Gram values that cut all grams into about so many ranges of equal size, from about 100 grams a range."""
    step = max(1, size // (100 * parts))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("grams").to_pylist():
                keys = unpacked_keys(block)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(keys[len(keys) % step // 2::step].view(np.int64), pa.int64())})

    if parts == 1:
        return np.zeros(0, dtype=np.uint64)
    sample = np.sort(blocks.select("grams").mapInArrow(some, "gram long").toArrow()["gram"].to_numpy().view(np.uint64))
    return np.unique(sample[np.linspace(0, len(sample), parts + 1).astype(int)[1:-1]])


def shared_counts(blocks: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(part, length, pair, n): what follows contexts that a bound falls into, for the ranges on either side."""
    spark = blocks.sparkSession
    cuts = spark.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))] * (ORDER + 1)
        edges = [np.unique(context_of(cuts.value, order)) for order in range(ORDER + 1)]
        for batch in batches:
            for block, numbers in zip(batch.column("grams").to_pylist(), batch.column("counts").to_pylist()):
                keys, n = unpacked_keys(block), unpacked(numbers, np.int64)
                keys, n = keys[n > 0], n[n > 0]
                for order in range(ORDER, -1, -1):
                    if order < ORDER:  # a longer context that a bound falls into is part of a shorter one
                        keys, n = reduced(shorter(keys), n)
                    own = np.isin(keys >> np.uint64(8), edges[order])
                    held[order] = reduced(np.concatenate([held[order][0], keys[own]]), np.concatenate([held[order][1], n[own]]))
        for order, (pairs, n) in enumerate(held):
            yield pa.RecordBatch.from_pydict({"length": pa.array([order] * len(pairs), pa.int32()), "pair": pa.array(pairs.view(np.int64), pa.int64()),
                                              "n": pa.array(n, pa.int64())})

    totals = blocks.select("grams", "counts").mapInArrow(run, "length int, pair long, n long").groupBy("length", "pair").agg(F.sum("n").alias("n"))
    near = [(part, order, int(x)) for order in range(ORDER + 1) for k, x in enumerate(context_of(bounds, order).view(np.int64).tolist())
            for part in (k, k + 1)]
    near = spark.createDataFrame(sorted(set(near)), "part int, length int, context long")
    return totals.withColumn("context", F.shiftrightunsigned("pair", 8)).join(near, ["length", "context"]).select("part", "length", "pair", "n")


def positions(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where numbers stand in a sorted array, -1 where they do not."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, shared: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[
        np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each of a range's sorted distinct grams, how often it was seen, and its whole context; `shared`: by order, (context, symbol) and counts of
    the contexts that other ranges hold parts of."""
    out, times, totals = np.zeros(len(keys)), np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    todo = np.arange(len(keys))
    pairs, n = keys[counts > 0], counts[counts > 0]
    symbol = keys & np.uint64(255)
    above = None  # the order above: its pairs, contexts, different symbols, and where the grams' contexts are
    for order in range(ORDER, -1, -1):
        if order < ORDER:
            pairs, n = reduced(shorter(pairs), n)
        table, number = pairs, n
        if order in shared:
            whole, m = shared[order]
            own = ~np.isin(pairs >> np.uint64(8), whole >> np.uint64(8))
            table, number = reduced(np.concatenate([pairs[own], whole]), np.concatenate([n[own], m]))
        contexts, first = np.unique(table >> np.uint64(8), return_index=True)
        total = np.add.reduceat(number, first) if len(first) else number
        different = np.diff(np.append(first, len(table)))
        context = context_of(keys[todo], order)
        at = positions(contexts, context)
        rest, left = np.where(at >= 0, total[at], 0) if len(total) else np.zeros(len(at)), np.where(at >= 0, different[at], 0) if len(total) else np.zeros(len(at))
        if above is not None and len(above[0]):
            longer, starts, several, place = above
            gone = np.add.reduceat(number[positions(table, shorter(longer))], starts)
            rest = rest - np.where(place >= 0, gone[place], 0)
            left = left - np.where(place >= 0, several[place], 0)
        seen = positions(table, context << np.uint64(8) | symbol[todo])
        open_ = left > 0
        hit = open_ & (seen >= 0)
        if order == ORDER:
            times[todo[hit]], totals[todo[hit]] = number[seen[hit]], rest[hit]
        out[todo[hit]] += np.log10((number[seen[hit]] - 0.5) / rest[hit])
        miss = open_ & ~hit
        out[todo[miss]] += np.log10(left[miss] / (2 * rest[miss]))
        todo, at = todo[~hit], at[~hit]
        above = table, first, different, at
    out[todo] -= math.log10(SYMBOLS - len(above[0]))
    return out, times, totals


def scored_blocks(blocks: DataFrame) -> DataFrame:
    """(chunk, first, lp): of each chunk and range, the log10 probabilities of the chunk's grams in the range, in order."""
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bounds = bounds_of(blocks, max(1, -(-size // PART_WORDS)), size)
    cuts = blocks.sparkSession.sparkContext.broadcast(bounds)
    shared = shared_counts(blocks, bounds)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block, numbers in zip(*(batch.column(c).to_pylist() for c in ("chunk", "grams", "counts"))):
                keys, n = unpacked_keys(block), unpacked(numbers, np.int64)
                ends = np.searchsorted(keys, cuts.value).tolist()
                found = [(part, a, b) for part, (a, b) in enumerate(zip([0, *ends], [*ends, len(keys)])) if a < b]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([x[0] for x in found], pa.int32()), "chunk": pa.array([chunk] * len(found), pa.int64()),
                    "first": pa.array(keys[[a for _, a, _ in found]].view(np.int64), pa.int64()),
                    "grams": pa.array([packed_keys(keys[a:b]) for _, a, b in found], pa.binary()),
                    "counts": pa.array([packed(n[a:b]) for _, a, b in found], pa.binary())})

    def score(group: pa.Table, nodes: pa.Table) -> pa.Table:
        keys = [unpacked_keys(x) for x in group["grams"].to_pylist()]
        if not keys:
            return pa.table({"chunk": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "lp": pa.array([], pa.binary())})
        distinct, counts = reduced(np.concatenate(keys), np.concatenate(
            [unpacked(x, np.int64) for x in group["counts"].to_pylist()]))
        length, pair, n = (nodes[c].to_numpy() for c in ("length", "pair", "n"))
        whole = {int(k): reduced(pair[length == k].view(np.uint64), n[length == k]) for k in np.unique(length)}
        scored = log_probabilities(distinct, counts, whole)
        found = [packed_scores(x, *(y[np.searchsorted(distinct, x)] for y in scored)) for x in keys]
        return pa.table({"chunk": group["chunk"], "first": group["first"], "lp": pa.array(found, pa.binary())})

    dealt = blocks.select("chunk", "grams", "counts").mapInArrow(split, "part int, chunk long, first long, grams binary, counts binary")
    return dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(score, "chunk long, first long, lp binary")


class Scores:
    """The log10 probabilities of a chunk's grams, found by the grams."""

    def __init__(self, firsts: np.ndarray, blocks: list[bytes], keys: np.ndarray) -> None:
        order = np.argsort(firsts.view(np.uint64))
        lp, at = [], 0
        for k in order.tolist():
            lp.append(unpacked_scores(keys[at:], blocks[k]))
            at += len(lp[-1])
        spread = keys * SPREAD  # an odd factor: different grams stay different
        order = np.argsort(spread)
        self.spread, self.lp = spread[order], np.concatenate(lp)[order]
        self.shift = np.uint64(64 - max(1, len(keys).bit_length() - 1))
        slots = np.bincount((self.spread >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.starts = (np.cumsum(slots) - slots).astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        spread = keys * SPREAD
        at = self.starts[(spread >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.spread[at] != spread)
        while len(todo):
            at[todo] += 1
            todo = todo[self.spread[at[todo]] != spread[todo]]
        return self.lp[at]


# --- scoring --------------------------------------------------------------------------------------------------------

def ppm_scores(documents: DataFrame, held_out: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows where `held_out` (by default: crc32 of the id's text mod 10 is 0) is false. A null text
    is empty: the end token alone. Repeated rows count as often as they stand. Without training rows nothing is known
    and bytes are uniform. An empty table gives an empty result.
    """
    held_out = held_out if held_out is not None else fold_of(F.col("doc_id"), 10) == 0
    rows, buckets = dealt(documents, held_out)
    found = written(chunk_counts(rows, buckets), "chunk-counts")
    words = written(word_counts(found.where("words is not null").select("chunk", "bucket", "words", "counts")), "words")
    tokens, different = words.agg(F.sum("tokens"), F.sum("different")).first()
    tokens = tokens or 0
    floor = tokens + 0.1 * ((different or 0) + 1)
    blocks = scored_blocks(found.where("grams is not null").select("chunk", "grams", "counts", "size"))
    docs = found.where("docs is not null").select("chunk", "docs")
    parts = docs.unionByName(words.select("chunk", "bucket", "c"), allowMissingColumns=True).unionByName(blocks, allowMissingColumns=True)

    def score(group: pa.Table) -> pa.Table:
        docs = unpacked_rows(group.filter(pc.is_valid(group["docs"]))["docs"].to_pylist())
        keys, seen = np.zeros(0, dtype=np.uint64), set()
        for texts, _ in texts_of(docs):
            seen.update([b""], *texts)
            more = counted(grams_of(texts)[0])[0]
            at = np.searchsorted(keys, more)
            new = at == len(keys)
            new[~new] = keys[at[~new]] != more[~new]
            keys = np.insert(keys, at[new], more[new])
        own = group.filter(pc.is_valid(group["c"]))
        by_bucket = dict(zip(own["bucket"].to_pylist(), own["c"].to_pylist()))
        place: dict[bytes, int] = {}
        c = []
        for bucket, words_ in in_buckets(seen, buckets).items():
            place.update(zip(words_, range(len(place), len(place) + len(words_))))
            c.append(unpacked(by_bucket[bucket], np.int64))
        c, seen = np.concatenate(c), None
        base = np.log10((c + 0.1) / floor)
        own = group.filter(pc.is_valid(group["lp"]))
        lps = Scores(own["first"].to_numpy(), own["lp"].to_pylist(), keys)
        counts, known, bases, scores = [], [], [], []
        for texts, _ in texts_of(docs):
            grams, lengths = grams_of(texts)
            scores += np.add.reduceat(lps.of(grams), np.cumsum(lengths) - lengths).tolist()
            for words_ in texts:
                words_ = [*words_, b""]
                at = np.fromiter(map(place.__getitem__, words_), dtype=np.int64, count=len(words_))
                counts.append(len(at))
                known.append(int(np.count_nonzero(c[at])))
                bases.append(float(base[at].sum()))
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(counts, pa.int64()),
                         "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([tokens] * len(counts), pa.int64()),
                         "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64())})

    return parts.groupBy("chunk").applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


# --- words by themselves: not used by ppm_scores, kept for the test of their probabilities ----------------------------

ORDERS = (4, 3, 2, 1, 0)
TRUSTED = 2


class LowOrders:
    """Probabilities from the short contexts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.contexts: dict[int, tuple[int, dict[int, int]]] = {}
        order = np.argsort(codes)
        keys, symbols, counts = codes[order] >> 9, codes[order] & 511, counts[order]
        edges = np.flatnonzero(np.diff(keys, prepend=-1, append=-1))
        symbols, counts = symbols.tolist(), counts.tolist()
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            follow = dict(zip(symbols[a:b], counts[a:b]))
            self.contexts[int(keys[a])] = (sum(follow.values()), follow)
        self.known: dict[tuple[bytes, int], float] = {}

    @staticmethod
    def key(context: bytes, order: int) -> int:
        value = int.from_bytes(context[len(context) - order:], "big")
        if order > 2:
            value = (value * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48
        return order << 16 | value

    def log10(self, context: bytes, symbol: int, excluded: set[int] | None = None) -> float:
        """Of a symbol after a context (the word's start is a space), some symbols being impossible."""
        if excluded is None:
            context = context[-4:]
            got = self.known.get((context, symbol))
            if got is None:
                if len(self.known) > 1_000_000:
                    self.known.clear()
                got = self.known[context, symbol] = self.computed(context, symbol, set())
            return got
        return self.computed(context, symbol, set(excluded))

    def computed(self, context: bytes, symbol: int, excluded: set[int]) -> float:
        out = 0.0
        for order in ORDERS:
            if order > len(context):
                continue
            node = self.contexts.get(self.key(context, order))
            if node is None:
                continue
            total, follow = node
            gone = excluded & follow.keys()
            different = len(follow) - len(gone)
            if not different:
                continue
            total -= sum(follow[x] for x in gone)
            seen = follow.get(symbol)
            if seen:
                return out + math.log10((seen - 0.5) / total)
            out += math.log10(different / (2 * total))
            excluded |= follow.keys()
        return out - math.log10(SYMBOLS - len(excluded))


def score_words(words: list[bytes], counts: list[int], shared: dict[bytes, dict[int, int]], low: LowOrders) -> list[float]:
    """log10 probability of each of the sorted distinct words of a partition; `shared`: nodes whose counts also come
    from other partitions."""
    out = [0.0] * len(words)
    sums = [0]
    for c in counts:
        sums.append(sums[-1] + c)
    todo = [(0, len(words), 0, 0.0)]
    while todo:
        a, b, depth, before = todo.pop()
        prefix = words[a][:depth]
        follow = shared.get(prefix)
        total = sums[b] - sums[a] if follow is None else sum(follow.values())
        if total < TRUSTED:
            for k in range(a, b):
                word, value = words[k], before
                line = b" " + word
                for j in range(depth, len(word)):
                    value += low.log10(line[max(0, j - 3):j + 1], word[j])
                out[k] = value + low.log10(line[-4:], END)
            continue
        groups, k = [], a
        if len(words[a]) == depth:
            groups.append((END, a, a + 1))
            k += 1
        while k < b:
            symbol, first = words[k][depth], k
            while k < b and words[k][depth] == symbol:
                k += 1
            groups.append((symbol, first, k))
        if follow is None:
            follow = {s: sums[y] - sums[x] for s, x, y in groups if sums[y] > sums[x]}
        base = math.log10(total)
        for symbol, x, y in groups:
            seen = follow.get(symbol)
            if seen:
                value = before + math.log10(seen - 0.5) - base
            else:
                value = before + math.log10(len(follow) / 2) - base + low.log10((b" " + prefix)[-4:], symbol, set(follow))
            if symbol == END:
                out[x] = value
            else:
                todo.append((x, y, depth + 1, value))
    return out
