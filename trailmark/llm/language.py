"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces of the product of their probabilities, by the forward algorithm; pieces do not
cross words, so a text's is the product over its words (longest runs of letters, lowered). Piece probabilities are
learned by expectation maximisation on the word counts of each language, which Spark gathers; a step's expectations
are at most one number per piece and language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.tables import fold_of, text_rows, with_doc, written
from trailmark.llm.words import slices

LETTERS = regex.compile(r"\p{L}+").findall
START = "▁"  # what the vocabulary writes before a word
LONGEST_PIECE = 16
STRETCH = 40  # letters of a word that are segmented together; longer words are scored in stretches
STEPS = 2
SMOOTHING = 0.01
SCALE = 10.0  # per character, keeps products of a stretch within a double
KNOWN_WORDS = 500_000
FLUSH = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


# --- the vocabulary -------------------------------------------------------------------------------------------------

class Pieces:
    """The vocabulary's pieces by length, for looking up many substrings at once. The last id is a character that no
    piece covers."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(k) for k in range(model.get_piece_size())
                 if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        texts = sorted({t for t in texts if len(t) <= LONGEST_PIECE})
        self.count = len(texts) + 1
        self.lengths = np.array([len(t) for t in texts] + [1])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted(set(map(len, texts))):
            ids = np.array([k for k, t in enumerate(texts) if len(t) == n])
            keys = hashes(codes([texts[k] for k in ids.tolist()], n))
            order = np.argsort(keys)
            self.by_length[n] = keys[order], ids[order]

    def find(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Ids of substrings of a length by their hashes, -1 where there is no such piece."""
        if length not in self.by_length:
            return np.full(len(keys), self.count - 1 if length == 1 else -1)
        known, ids = self.by_length[length]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, ids[at], self.count - 1 if length == 1 else -1)


def codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length).astype(np.uint64)


def hashes(chars: np.ndarray) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.uint64)
    for k in range(chars.shape[1]):
        out = out * BASE + chars[:, k] + np.uint64(1)
    return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def lattice(pieces: Pieces, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, piece ids) of every piece in words of one length, by start."""
    length = chars.shape[1]
    for i in range(length):
        key = np.zeros(len(chars), dtype=np.uint64)
        for k in range(1, min(LONGEST_PIECE, length - i) + 1):
            key = key * BASE + chars[:, i + k - 1] + np.uint64(1)
            ids = pieces.find(key, k)
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                yield i, i + k, rows, ids[rows]


def stretches(words: list[str]) -> tuple[dict[int, list[str]], dict[int, list[int]]]:
    """Stretches of the words by length, and the word of each."""
    texts: dict[int, list[str]] = {}
    owners: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        word = START + word
        for at in range(0, len(word), STRETCH):
            part = word[at:at + STRETCH]
            texts.setdefault(len(part), []).append(part)
            owners.setdefault(len(part), []).append(k)
    return texts, owners


def log_scores(pieces: Pieces, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log probability of each word in each language; `probabilities` by piece and language."""
    out = np.zeros((len(words), probabilities.shape[1]))
    scaled = probabilities * SCALE ** pieces.lengths[:, None]
    texts, owners = stretches(words)
    for length, group in texts.items():
        forward = np.zeros((length + 1, len(group), probabilities.shape[1]))
        forward[0] = 1
        for i, j, rows, ids in lattice(pieces, codes(group, length)):
            forward[j, rows] += forward[i, rows] * scaled[ids]
        np.add.at(out, owners[length], np.log(np.maximum(forward[length], 1e-300)) - length * np.log(SCALE))
    return out


def expectations(pieces: Pieces, probabilities: np.ndarray, words: list[str], lang: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected number of each piece, by language, over counted words."""
    languages = probabilities.shape[1]
    total = np.zeros(pieces.count * languages)
    scaled = probabilities * SCALE ** pieces.lengths[:, None]
    texts, owners = stretches(words)
    for length, group in texts.items():
        own = np.array(owners[length])
        l, n = lang[own], count[own]
        edges = [(i, j, rows, ids, scaled[ids, l[rows]]) for i, j, rows, ids in lattice(pieces, codes(group, length))]
        forward, backward = np.zeros((2, length + 1, len(group)))
        forward[0] = backward[length] = 1
        for i, j, rows, _, p in edges:
            forward[j, rows] += forward[i, rows] * p
        for i, j, rows, _, p in reversed(edges):
            backward[i, rows] += backward[j, rows] * p
        whole = np.maximum(forward[length], 1e-300)
        for i, j, rows, ids, p in edges:
            total += np.bincount(ids * languages + l[rows], weights=n[rows] * forward[i, rows] * p * backward[j, rows] / whole[rows],
                                 minlength=len(total))
    return total.reshape(pieces.count, languages)


# --- learning -------------------------------------------------------------------------------------------------------

def word_counts(training: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text) with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def emit():
            for lang, words in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()),
                                                  "word": pa.array(list(words), pa.string()),
                                                  "n": pa.array(list(words.values()), pa.int64())})
            held.clear()

        for batch in batches:
            for low, high, _, _ in slices(batch.column("text")):
                part = batch.slice(low, high - low)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    held.setdefault(lang, Counter()).update(LETTERS(text.lower()))
                if sum(map(len, held.values())) > FLUSH:
                    yield from emit()
        yield from emit()

    known = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return known.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(training: DataFrame, path: str, steps: int = STEPS) -> tuple[list[str], np.ndarray]:
    """Languages, and probabilities by piece and language. Size: the vocabulary times the languages."""
    spark = training.sparkSession
    counts = written(word_counts(training), "language-words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    number = {lang: k for k, lang in enumerate(languages)}
    size = pieces_of(path).count
    now = np.full((size, len(languages)), 1 / size)
    for _ in range(steps if languages else 0):
        shared = spark.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, total = pieces_of(path), np.zeros((size, len(languages)))
            for batch in batches:
                for low in range(0, batch.num_rows, 20_000):
                    part = batch.slice(low, 20_000)
                    lang = np.array([number[x] for x in part.column("lang").to_pylist()])
                    total += expectations(pieces, shared.value, part.column("word").to_pylist(), lang,
                                          part.column("n").to_numpy(zero_copy_only=False).astype(float))
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "lang": pa.array(lang, pa.int32()),
                                              "n": pa.array(total[piece, lang], pa.float64())})

        got = counts.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros_like(now)
        expected[got["piece"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
        now = (expected + SMOOTHING) / (expected.sum(axis=0) + SMOOTHING * size)
    return languages, now


# --- predicting -----------------------------------------------------------------------------------------------------

def identified(documents: DataFrame, path: str, held_out: Column | None = None, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; with `carry` also doc, the whole row.

    Learns from rows with a language where `held_out` (by default: crc32 of the id's text mod 4 is 2) is false; a
    prediction sees the text alone. `score` is the predicted language's posterior with equal priors. A text that is
    null or has no letter is `und` with score 0, and so is every text where no language could be learned. Ties go to
    the first language by name. Repeated rows are judged alike; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    held_out = held_out if held_out is not None else fold_of(F.col("doc_id"), 4) == 2
    held = "_held"
    while held in documents.columns:
        held += "_"
    rows = text_rows(documents.withColumn(held, held_out), carry=True).withColumn("held_out", F.col(f"doc.{held}"))
    languages, model = learn(rows.where("not held_out").select("text", F.col("doc.lang").cast("string").alias("lang")), path)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = pieces_of(path), {}
        scores = np.zeros((0, len(languages)))
        for batch in batches:
            for low, high, _, _ in slices(batch.column("text")):
                part = batch.slice(low, high - low)
                words = [LETTERS(t.lower()) if t else [] for t in part.column("text").to_pylist()]
                if len(known) > KNOWN_WORDS:
                    known, scores = {}, scores[:0]
                new = [w for w in set(chain.from_iterable(words)) if w not in known]
                if new and languages:
                    known.update(zip(new, range(len(scores), len(scores) + len(new))))
                    fresh = [log_scores(pieces, shared.value, new[k:k + 20_000]) for k in range(0, len(new), 20_000)]
                    scores = np.concatenate([scores, *fresh])
                names, sure = [], []
                for ws in words:
                    if not ws or not languages:
                        names.append(UNKNOWN)
                        sure.append(0.0)
                        continue
                    total = scores[np.fromiter(map(known.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0)
                    best = int(np.argmax(total))
                    names.append(languages[best])
                    sure.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(sure, pa.float64()),
                     *part.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", "doc"][:4 + carry])

    whole = [F.struct(*(F.col(f"doc.`{c}`") for c in documents.columns)).alias("doc")] if carry else []
    kind = "doc_id long, held_out boolean, lang_pred string, score double"
    return rows.select("doc_id", "held_out", "text", *whole).mapInArrow(run, with_doc(kind, documents, carry))
