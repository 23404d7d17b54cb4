from __future__ import annotations

import base64
import os
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import AWKWARD, WORD, awkward

from trailmark.llm import byte_bpe, entries, language, packing, quality, secret_scan
from trailmark.llm.tables import text_rows

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# --- secrets --------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
OTHERS = {"access": (r"AKIA[A-Z0-9]+", 20), "hex": (r"[0-9a-f]+", 24), "github": (r"gh[pousr]_[A-Za-z0-9]+", 40), "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0)}
ORDER = [r.kind for r in secret_scan.RULES]


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), ORDER.index("assign"), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    for kind, (pattern, least) in OTHERS.items():
        found += [(m.start(), ORDER.index(kind), m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found)


def test_secrets_query(spark, sf_dir, texts):
    for row in entries.QUERIES["op10_secret_scan"](spark, sf_dir).collect():
        base = [s for s in plain_spans(texts[row.doc_id]) if s[1] < 3]
        listed = ",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b in base)
        assert row.base_sha256 == sha256(listed.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))


SCANNER = secret_scan.compile_scanner()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"tokenTOKEN:= \"'passwdAKIA09af-,\n_é", "token=", "secret: ", "AKIA", "ghp_", "0123456789abcdef" * 2]), max_size=60).map("".join))
def test_automata_agree_with_regular_expressions(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = secret_scan.marked(SCANNER.together, data, np.array([0, len(data)]))
    found = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        found += [(len(data[:a + x].tobytes().decode()), k, len(data[:a + y].tobytes().decode()))
                  for x, k, y in secret_scan.spans_in(SCANNER, data[a:b].tobytes())]
    kinds = {ORDER.index(k) for k in ("assign", *OTHERS)}
    assert sorted(s for s in found if s[1] in kinds) == plain_spans(text)


def test_secrets_awkward_and_redaction(spark):
    rows = {(r.doc_id, r.text): r.spans for r in secret_scan.secret_spans(awkward(spark)).collect()}
    assert all(not spans for (i, _), spans in rows.items() if i != 12)
    assert [s.kind for s in rows[12, AWKWARD[-1][1]]] == ["assign", "access", "assign", "hex"]
    docs = awkward(spark)
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    changed = out.where("doc_id = 12").first()
    assert changed.text == "[assign] [access] é [assign]\"" and changed.n_chars == len(changed.text)
    assert secret_scan.redacted(docs.limit(0)).count() == 0


# --- byte-level BPE -------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, sf_dir, texts, tik):
    for row in entries.QUERIES["op7_byte_bpe"](spark, sf_dir).collect():
        ids = np.array(tik.encode_ordinary(texts[row.doc_id]), dtype="<u4")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha256(ids.tobytes()).hexdigest())
        assert row.decoded_sha256 == sha256(texts[row.doc_id].encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4), st.text("ab ", max_size=200))
def test_bpe_any_text(tik, some, repeats):
    codec = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip([*some, repeats], codec.encode([*some, repeats])):
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_replay_takes_a_lower_rank_that_a_merge_opens():
    ranks = {bytes([b]): 300 + b for b in range(256)} | {b"ab": 5, b"abc": 1, b"abab": 9}
    assert byte_bpe.replay([b"ababc", b"abab", b""], ranks) == [[5, 1], [9], []]


def test_bpe_awkward(spark, tik):
    rows = byte_bpe.encoded(awkward(spark), RANKS, public_tokenizers.PATTERN, decode=True)
    got = sorted((r.doc_id or 0, r.ids) for r in rows.collect())
    assert sorted(bytes(r.bytes) for r in rows.collect()) == sorted((r[1] or "").encode() for r in AWKWARD)
    apart = byte_bpe.decoded(rows.select("doc_id", "ids"), RANKS, public_tokenizers.PATTERN)
    assert sorted(map(repr, apart.collect())) == sorted(map(repr, rows.collect()))
    want = sorted((r[0] or 0, np.array(tik.encode_ordinary(r[1] or ""), "<u4").tobytes()) for r in AWKWARD)
    assert got == want


# --- packing --------------------------------------------------------------------------------------------------------

def check_packing(rows, documents):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    total, want = 0, []
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for at in range(0, len(ids), 4096):
            piece = np.array(ids[at:at + 4096], dtype="<u4")
            want.append((doc_id or 0, at // 4096, at, len(piece), zlib.crc32(piece.tobytes())))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        ends = 0
        for offset, length in sorted(held):
            assert offset == ends
            ends += length
        assert ends <= 4096
    return len(sequences), -(-total // 4096)


def test_packing_query(spark, sf_dir, texts):
    used, least = check_packing(entries.QUERIES["op2_best_fit_packing"](spark, sf_dir).collect(), texts.items())
    assert used <= least + 1


SPECIAL = ["x<|endoftext|>y", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "A<|startoftext|>B.", "<| endoftext|>", "<|", "|", "a|b", " | ", "<|endoftext|>."]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(WORDS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from([*SPECIAL, "Don't ", "w,", "w. ", "É", " ", "\n"]), max_size=8).map("".join)), max_size=5), st.booleans())
def test_ids_are_those_of_the_tokenizer(encoder, some, forget):
    encoder.known.limit = 1000 if forget else packing.KNOWN_BYTES  # letting go of words changes nothing
    column = packing.pa.array([*some, "tail <|"], packing.pa.string())
    for _, _, data, offsets in packing.slices(column):
        ids, cuts = encoder.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [
            encoder.tokenizer.encode(text, add_special_tokens=False).ids for text in column.to_pylist()]


def test_packing_remembers_words_without_the_stop_that_ends_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.Encoder(path)
    texts = ["Foo foo. foo, (foo.) foo..", ".foo a", ".", "", "b", ".", "a, .", "x.y. é. 7. Z.", "<|endoftext|>. <|Foo.", "a.\x00 b.", "end."]
    column = packing.pa.array(texts)
    for low, high, data, offsets in packing.slices(column):
        ids, cuts = encoder.encode(data, offsets)
        for text, a, b in zip(texts[low:high], cuts, cuts[1:]):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert b"foo" in encoder.known.young and not {b"foo.", b"foo,", b"z.", b"end."} & encoder.known.young.keys()


def test_special_strings_become_their_tokens(spark):
    rows = [(n, text, "en", "s") for n, text in enumerate([*SPECIAL, " ".join(SPECIAL), "".join(SPECIAL)])]
    found = entries.packed_documents(awkward(spark, rows)).collect()
    check_packing(found, [r[:2] for r in rows])
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.token_pieces(awkward(spark, rows), WORDS).collect()}
    assert ids[1] == [49407, 1] and ids[2] == [49406, 1] and 49407 not in ids[3]


def test_packing_awkward_and_tree(spark):
    check_packing(entries.packed_documents(awkward(spark)).collect(), [r[:2] for r in AWKWARD])
    assert entries.packed_documents(awkward(spark, [])).count() == 0
    lengths = spark.range(0, 3000, 1, 12).selectExpr("id", "1 + pmod(id * 7919, 100) as length")
    out = packing.packed(lengths, capacity=128).collect()
    loads = defaultdict(int)
    for r in out:
        loads[r.sequence_id] += r.length
    assert len(out) == 3000 and max(loads.values()) <= 128
    assert len(loads) <= 1.02 * sum(loads.values()) / 128


# --- language -------------------------------------------------------------------------------------------------------

def test_language_query(spark, sf_dir):
    got = {r.doc_id: r for r in entries.QUERIES["op4_language_id"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_forward_sums_all_segmentations():
    pieces = language.pieces_of(PIECES)
    rng = np.random.default_rng(1)
    p = rng.random((pieces.count, 2)) / 100
    known = {}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = sorted({model.id_to_piece(k) for k in range(model.get_piece_size())
                    if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)) and len(model.id_to_piece(k)) <= language.LONGEST_PIECE})
    known.update(zip(texts, range(len(texts))))

    def total(text, lang):
        if not text:
            return 1.0
        out = 0.0
        for k in range(1, len(text) + 1):
            at = known.get(text[:k], pieces.count - 1 if k == 1 else None)
            if at is not None:
                out += p[at, lang] * total(text[k:], lang)
        return out

    for word in ("the", "straße", "qzj", "漢a"):
        got = language.log_scores(pieces, p, [word])[0]
        assert np.allclose(got, [np.log(total("▁" + word, lang)) for lang in (0, 1)])


def test_language_awkward(spark):
    rows = {(r.doc_id, r.lang_pred) for r in language.identified(awkward(spark), PIECES).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= rows
    nothing = language.identified(awkward(spark).limit(0), PIECES)
    assert nothing.count() == 0
    from pyspark.sql import functions as F

    no_language = language.identified(awkward(spark).withColumn("lang", F.lit(None).cast("string")), PIECES).collect()
    assert {(r.lang_pred, r.score) for r in no_language} == {("und", 0.0)}
    clash = awkward(spark).withColumn("_held", F.lit("x"))
    kept = language.identified(clash, PIECES, carry=True)
    assert kept.schema["doc"].dataType == clash.schema and {(r.doc_id, r.lang_pred) for r in kept.collect()} == rows


# --- quality --------------------------------------------------------------------------------------------------------

def plain_quality(text):
    found = WORD.findall(text or "")
    places = defaultdict(list)
    for k in range(len(found) - 7):
        places[tuple(found[k:k + 8])].append(k)
    repeated = len({j for p in places.values() if len(p) > 1 for k in p for j in range(k, k + 8)})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(found) < 20 or 100 * repeated > 30 * len(found)
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated, failed)


def plain_features(text):
    found = [w.encode() for w in WORD.findall(text or "")]
    signed = lambda x: (x - (1 << 64) if x >> 63 else x) % quality.FEATURES
    out = [signed(xxhash.xxh64_intdigest(w, 42)) for w in found]
    return out + [0 if a == b else signed(xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42))) for a, b in zip(found, found[1:])]


def test_quality_query(spark, sf_dir, texts):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    raw, trusted = np.zeros(quality.FEATURES), np.zeros(quality.FEATURES)
    features = {i: plain_features(t) for i, t in texts.items()}
    for i, f in features.items():
        np.add.at(raw, f, 1)
        if i in good:
            np.add.at(trusted, f, 1)
    share = lambda x: (x + 0.5) / (x.sum() + 0.5 * len(x))
    ratios = np.log(share(trusted) / share(raw))
    for r in entries.QUERIES["op6_quality_rules"](spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(texts[r.doc_id])
        score = ratios[features[r.doc_id]].mean() if features[r.doc_id] else 0
        assert abs(r.score - score) < 1e-4
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(6, 1, 0), (None, 1, 0), (7, None, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.quality(awkward(spark), labels).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(
        (r[0] or 0, *plain_quality(r[1])) for r in AWKWARD)
    assert quality.quality(awkward(spark).limit(0), labels).count() == 0
    assert {r.score for r in quality.quality(awkward(spark), labels.limit(0)).collect()} == {0.0}


def test_quality_is_native(spark, sf_dir):
    plan = entries.QUERIES["op6_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_text_rows_ignores_other_columns(spark):
    assert text_rows(awkward(spark)).columns == ["doc_id", "text"]
