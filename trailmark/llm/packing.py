"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition packs its own pieces: longest first, each into the open bin with the least room that still holds it.
Bins that are nearly full are emitted. The rest become items themselves: partitions are merged by a fan-in, their bins
are packed again by best fit, nearly full ones are emitted, and so on up the tree. A task never holds more than a block
of items, and the tree stops where one partition, or partitions of a full block each, remain.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.tables import text_rows, written
from trailmark.llm.words import IS_SPACE, slices

CAPACITY = 4096
END_ID = 1
FAN_IN = 8
BLOCK = 200_000  # items packed together in a task
ROOM = 8  # a bin with at most this much room is full
KNOWN_BYTES = 32 << 20
SLICE = 2 << 20  # bytes of texts whose words are sorted out at once
WORD_COST = 180  # bytes that a remembered word takes besides its own and its ids
TOGETHER = 256  # new words given to the tokenizer in one text
BETWEEN = b"|"  # a word that is one token, put between them
MARK = b"<|"  # begins the strings of special tokens, which are looked for before letters are lowered
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_TAIL = np.isin(np.arange(256), list(b".,"))
IS_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


# --- tokens ---------------------------------------------------------------------------------------------------------

class Remembered:
    """Ids of words met before, in two generations of bounded size: words that are met again stay. A worker keeps them for
    its next task."""

    def __init__(self, limit: int = KNOWN_BYTES) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.taken, self.limit = 0, limit

    def update(self, found: dict[bytes, bytes]) -> None:
        self.young.update(found)
        self.taken += sum(map(len, found)) + sum(map(len, found.values())) + WORD_COST * len(found)

    def get(self, words: list[bytes]) -> list[bytes | None]:
        out = list(map(self.young.get, words))
        if self.old:
            missing = [k for k, ids in enumerate(out) if ids is None]
            again = {}
            for k, ids in zip(missing, map(self.old.get, [words[k] for k in missing])):
                if ids is not None:
                    again[words[k]] = out[k] = ids
            self.update(again)
        return out

    def settle(self) -> None:
        """Between two slices: lets go of what was not met for a generation."""
        if self.taken > self.limit:
            self.young, self.old, self.taken = {}, self.young, 0


class Encoder:
    """A lower-casing tokenizer whose tokens end at white space, run once per distinct word of a slice."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.lettered = Tokenizer(self.tokenizer.model)  # shares the model: for words of a-z, which nothing splits or changes
        self.lettered.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known = Remembered()
        between = self.tokenizer.encode(BETWEEN.decode(), add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words. Most go through the tokenizer many at once, with a known token between them."""
        together = [w for w in words if BETWEEN not in w] if self.between is not None else []
        alone = [w for w in words if BETWEEN in w] if together else words
        sep = b" " + BETWEEN + b" "
        found: dict[bytes, bytes] = {}
        for tokenizer, some in ((self.lettered, [w for w in together if w.isalpha()]), (self.tokenizer, [w for w in together if not w.isalpha()])):
            groups = [some[k:k + TOGETHER] for k in range(0, len(some), TOGETHER)]
            encodings = tokenizer.encode_batch_fast([sep.join(g).decode() for g in groups], add_special_tokens=False)
            for group, encoding in zip(groups, encodings):
                ids = np.array(encoding.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.between)
                if len(cuts) + 1 != len(group):
                    alone = alone + group
                    continue
                bounds = zip(np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist())
                raw = ids.tobytes()
                found.update((w, raw[4 * a:4 * b]) for w, (a, b) in zip(group, bounds))
        for word, encoding in zip(alone, self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)):
            found[word] = np.array(encoding.ids, dtype="<u4").tobytes()
        return found

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        out = self.known.get(words)
        new = [words[k] for k, ids in enumerate(out) if ids is None]
        if new:
            made = self.learn(new)
            self.known.update(made)
            out = [made[w] if ids is None else ids for w, ids in zip(words, out)]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice (see `words.slices`), and where each text's ids begin and end."""
        lowered = FOLD[data]
        solid = ~IS_SPACE[lowered]
        before = np.append(False, solid[:-1]) if len(solid) else solid
        first = np.zeros(len(data), dtype=bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins = solid & (~before | first)
        if len(data):  # a full stop or comma that ends a word after a letter is a token of its own
            tail = IS_TAIL[lowered[1:]] & IS_LETTER[lowered[:-1]] & ~first[1:]
            tail[:-1] &= ~solid[2:] | first[2:]
            begins[1:] |= tail
        starts = np.flatnonzero(begins)
        for at in found_at(data.tobytes(), MARK):  # as it is: the tokenizer lowers what is no special token
            k = int(np.searchsorted(starts, at, "right")) - 1
            end = at
            while end < len(data) and solid[end] and (end == at or not first[end]):
                end += 1
            lowered[starts[k]:end] = data[starts[k]:end]
        length = np.add.reduceat(solid, starts) if len(starts) else np.zeros(0, dtype=np.int64)
        bounds = np.append(0, np.cumsum(length)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(lowered[solid])])
        coded = words.dictionary_encode()
        ids = self.ids_of(coded.dictionary.to_pylist())
        self.known.settle()
        found = pa.array(ids, pa.large_binary()).take(coded.indices)
        _, where, raw = found.buffers()
        total = np.frombuffer(where, dtype=np.int64)[:len(found) + 1] if len(found) else np.zeros(1, dtype=np.int64)
        each = np.frombuffer(raw, dtype="<u4", count=int(total[-1]) // 4) if total[-1] else np.zeros(0, dtype="<u4")
        return each, total[np.searchsorted(starts, offsets)] // 4


def found_at(data: bytes, mark: bytes) -> Iterator[int]:
    at = data.find(mark)
    while at >= 0:
        yield at
        at = data.find(mark, at + 1)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit) of each document's ids and end id.

    Only documents longer than `capacity` are cut, into pieces of that length but the last. A null or empty text is
    the end id alone. Strings of special tokens in a text become those tokens, as the tokenizer has it.
    """
    step, end = 4 * capacity, int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text"), SLICE):
                docs = batch.column("doc_id").slice(low, high - low).to_pylist()
                found, cuts = use.encode(data, offsets)
                raw, cuts = found.tobytes(), (4 * cuts).tolist()
                rows = [(doc, at // step, at // 4, ids[at:at + step]) for doc, a, b in zip(docs, cuts, cuts[1:])
                        for ids in [raw[a:b] + end] for at in range(0, len(ids), step)]
                doc, piece, start, ids = (list(x) for x in zip(*rows))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary())})

    return text_rows(documents).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


# --- packing --------------------------------------------------------------------------------------------------------

def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin: longest items first, each into the fullest bin that holds it."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms = 0  # bit r: some bin has room r
    for k in order:
        need = lengths[k]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        left = room - need
        open_[left].append(at)
        rooms |= 1 << left
    return bins


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (with a column `length` of 1 to `capacity`) with sequence_id and offset, the place in its sequence.

    Sequences have no gaps. Equal rows are packed each for itself. An empty table gives an empty result.
    """
    item = pieces.schema
    whole = T.StructType([T.StructField("bin", T.LongType()), T.StructField("load", T.LongType()),
                          T.StructField("full", T.BooleanType()),
                          T.StructField("items", T.ArrayType(T.StructType([*item.fields, T.StructField("offset", T.LongType())])))])

    def merged(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, made, held, count = TaskContext.get().partitionId(), 0, [], 0

            def emit() -> pa.RecordBatch:
                nonlocal made
                rows = pa.Table.from_batches(held).to_pylist()
                out = []
                for chosen in best_fit([r["load"] for r in rows], capacity):
                    items, at = [], 0
                    for k in chosen:
                        items.extend(x | {"offset": x["offset"] + at} for x in rows[k]["items"])
                        at += rows[k]["load"]
                    out.append({"bin": (level << 56) | (part << 32) | made, "load": at,
                                "full": last or capacity - at <= ROOM, "items": items})
                    made += 1
                return pa.RecordBatch.from_pylist(out, schema=held[0].schema)

            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK):
                    held.append(batch.slice(low, BLOCK))
                    count += held[-1].num_rows
                    if count >= BLOCK:
                        yield emit()
                        held, count = [], 0
            if count:
                yield emit()

        return run

    fields = [F.col(f"`{c}`") for c in pieces.columns]
    bins = pieces.select(F.lit(0).cast("long").alias("bin"), F.col("length").cast("long").alias("load"), F.lit(False).alias("full"),
                         F.array(F.struct(*fields, F.lit(0).cast("long").alias("offset"))).alias("items"))
    ready, level, parts = [], 1, None
    while True:
        last = parts is not None and parts <= 1
        made = written(bins.mapInArrow(merged(level, last), whole), f"bins-{level}")
        ready.append(made.where("full"))
        open_ = made.where("not full")
        left = 0 if last else open_.count()
        if left <= 1:
            ready.append(open_)
            break
        before, parts = parts or max(2, made.rdd.getNumPartitions(), pieces.rdd.getNumPartitions()), None
        parts = max(-(-left // BLOCK), before // FAN_IN, 1)
        if parts >= before > 1:  # blocks are full: merging more would not fit a task
            ready.append(open_)
            break
        level += 1
        bins = open_.repartition(parts)
    out = ready[0]
    for more in ready[1:]:
        out = out.union(more)
    return out.select(F.col("bin").alias("sequence_id"), F.explode("items").alias("item")).select("item.*", "sequence_id")
