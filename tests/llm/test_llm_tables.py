from __future__ import annotations

import io
import math
import os
import sys
import zlib
from collections import Counter, defaultdict
from hashlib import sha1

import duckdb
import numpy as np
import pytest
from llm_helpers import AWKWARD, awkward, words

from trailmark.llm import chat, entries, hilbert, ngram_join, ppm, warc
from trailmark.llm.tables import written

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))


# --- n-gram Jaccard join --------------------------------------------------------------------------------------------

def shingles(text):
    found = words(text)
    return frozenset(tuple(found[k:k + 3]) for k in range(len(found) - 2)) if len(found) >= 3 else frozenset([tuple(found)] if found else [])


def plain_components(documents):
    """(doc_id, set size, component) by comparing every pair."""
    sets = [shingles(t) for _, t in documents]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * min(len(sets[a]), len(sets[b])) >= 9 * max(len(sets[a]), len(sets[b])):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared):
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(documents):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(documents)), key=repr)


def joined(documents):
    return sorted(map(tuple, ngram_join.jaccard_components(documents).collect()), key=repr)


def test_join_refuses_similarities_it_cannot_keep_whole(spark):
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(awkward(spark), similarity=(50, 100))


def test_join_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, entries.QUERIES["op1_ngram_jaccard_join"](spark, sf_dir).collect()), key=repr) == plain_components(docs)


@pytest.mark.parametrize("light_most", [0, 60, 10**6])
def test_join_near_copies_on_both_sides_of_the_boundary(spark, monkeypatch, light_most):
    """Chains of edits around the threshold, many copies, and one passage in every text, with any boundary."""
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(12)]
    rows = []
    for base in range(12):
        text = [f"b{base}w{k}" for k in range(int(rng.integers(8, 120)))] + passage * (base % 2)
        for copy in range(6):
            text = list(text)
            for _ in range(int(rng.integers(0, 3))):
                text[int(rng.integers(len(text)))] = f"e{rng.integers(10**6)}"
            rows += [(len(rows) + k, " ".join(text)) for k in range(1 + 2 * (copy == 0))]
    monkeypatch.setattr(ngram_join, "boundary", lambda *_: light_most)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == plain_components(rows)


def plain_links(documents):
    """(doc_id, links) by comparing every pair."""
    sets = [shingles(t) for _, t in documents]
    count = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared):
                count[a] += 1
                count[b] += 1
    return sorted(((i, n) for (i, _), n in zip(documents, count)), key=repr)


@pytest.mark.parametrize("light_most", [0, 60, 10**6])
def test_join_counts_links(spark, sf_dir, monkeypatch, light_most):
    """Links inside a component are counted, copies by their number."""
    rng = np.random.default_rng(4)
    rows = [tuple(r[:2]) for r in AWKWARD if r[0] not in (7, 8, 9)]  # too long for pairs of all prefixes
    for base in range(6):
        text = [f"b{base}w{k}" for k in range(int(rng.integers(30, 120)))]
        for copy in range(7):
            text = list(text)
            text[int(rng.integers(len(text)))] = f"e{rng.integers(10**6)}"
            rows += [(1000 + len(rows) + k, " ".join(text)) for k in range(1 + copy % 3)]
    monkeypatch.setattr(ngram_join, "boundary", lambda *_: light_most)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(df, links=True).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == plain_links(rows)
    assert sorted((tuple(r)[:3] for r in got), key=repr) == plain_components(rows)
    assert ngram_join.jaccard_components(df.limit(0), links=True).count() == 0


def test_join_awkward(spark):
    assert joined(awkward(spark)) == plain_components([r[:2] for r in AWKWARD])
    assert joined(awkward(spark, [])) == []
    assert joined(spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")) == [(None, 2, None)] * 2


def test_join_moves_prefixes_once(spark, sf_dir, monkeypatch):
    """Buckets are told apart and counted in one exchange, sets come from the signatures where they lie, and only counters
    that are used are sent."""
    made = {}

    def noted(df, label):
        made.setdefault(label, df)
        return written(df, label)

    monkeypatch.setattr(ngram_join, "written", noted)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ngram_join.jaccard_components(documents, 5, (80, 100)).count()
    assert "sides" not in made
    plan = made["shared"]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert sum("hashpartitioning(key#" in line and "Exchange" in line for line in plan.splitlines()) <= 2  # and one for copies
    few = np.zeros(ngram_join.BLOCK, dtype=np.int64)
    few[[3, 77]] = 5, 2**31 - 1
    assert len(ngram_join.packed_counts(few)) < 200
    assert np.array_equal(ngram_join.unpacked_counts(ngram_join.packed_counts(few)), few)


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 60).selectExpr("id as a", "id + 1 as b").union(spark.range(100, 105).selectExpr("id as a", "100 as b"))
    got = {r.node: r.root for r in ngram_join.components(written(links, "test")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 105)}}


def test_boundary_weighs_both_costs():
    assert ngram_join.boundary({}, 2.0, (90, 100)) == 0
    sizes = {10: 100, 50: 100, 500: 100}
    assert ngram_join.boundary(sizes, 1.0, (90, 100)) <= ngram_join.boundary(sizes, 4.0, (90, 100)) <= ngram_join.boundary(sizes, 40.0, (90, 100))


def test_bucket_entries_do_not_grow_with_the_lists():
    """As a corpus grows, so do the lists of its shingles; what is moved for a document stays about the same."""
    sizes = {22: 300, 58: 300, 122: 1000, 254: 1500, 493: 1200, 995: 500, 4846: 50}

    def entries(length):
        first = {s: s - int(ngram_join.least_shared(s, (90, 100))) + 1 for s in sizes}
        most = ngram_join.boundary(sizes, length, (90, 100))
        return sum(n * (first[s] * (first[s] + 1) // 2 if s <= most else first[s]) for s, n in sizes.items())

    assert entries(72.0) <= 1.2 * entries(6.0)
    assert entries(6.0) <= 1.2 * entries(1.0)


def test_signatures_hold_no_pairs(spark):
    texts = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(400)))], "doc_id long, text string")
    ranks = spark.sparkContext.broadcast(np.zeros(1 << 10, dtype=np.uint8))
    row = ngram_join.signatures(texts, ranks, 10**6, 3, (90, 100)).first()
    assert sum(len(v) for v in row if isinstance(v, list)) == row.n_shingles - int(ngram_join.least_shared(398, (90, 100))) + 1
    sides = ngram_join.signatures(texts, ranks, 10**6, 3, (90, 100)).selectExpr("1L as node", "n_shingles as n", "prefix", "after", "listed")
    found = ngram_join.postings_of(sides).collect()
    spare = len(row.prefix)
    assert len({r.key for r in found}) == len(found) == spare * (spare + 1) // 2
    assert sorted(r.place for r in found) == sorted(j - 1 for j in range(spare + 1) for _ in range(j))


def test_written_tables_leave_no_shuffle_files(spark):
    import glob
    import time

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    held = lambda: set(glob.glob(f"{folder}/*/shuffle_*.data"))
    before, setting = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    table = written(spark.range(100000).selectExpr("id % 1000 as k", "id").groupBy("k").sum("id"), "test")
    end = time.time() + 20
    while held() - before and time.time() < end:
        time.sleep(0.2)
    assert not held() - before and table.count() == 1000 and spark.conf.get(setting) == was


# --- chat -----------------------------------------------------------------------------------------------------------

def listed_masks(df):
    from pyspark.sql import functions as F

    return df.withColumns({m: F.array_join(F.transform(m, lambda x: F.concat(x["start"], F.lit(":"), x["end"])), ",")
                           for m in ("chosen_mask", "rejected_mask")})


def test_chat_query_against_sql(spark, sf_dir):
    from check import compare, connect

    df = entries.QUERIES["op3_preference_format"](spark, sf_dir)
    result = connect(sf_dir).execute(entries.ORACLES["op3_preference_format"])
    rows = df.collect()
    assert rows and any(r.n_prompt_turns for r in rows) and any(r.rejected_mask for r in rows)
    assert compare(df.columns, rows, [d[0] for d in result.description], result.fetchall()) is None


def test_chat_awkward_against_sql(spark):
    from check import compare

    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "A"), (1, 2, None, None), (1, 3, "assistant", "B 漢"), (2, 0, "user", "only"),
             (3, None, "assistant", "x"), (3, 0, "assistant", "x"), (3, 0, "assistant", "y"), (None, 1, "user", "u"), (None, 2, "assistant", ""),
             (4, 0, "assistant", "same"), (4, 1, "assistant", "same")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    db = duckdb.connect()
    db.register("arrow_turns", df.toArrow())
    db.execute("CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM arrow_turns")
    result = db.execute(chat.PREFERENCES_SQL)
    got = listed_masks(chat.preferences(chat.contrasted(chat.conversations(df))))
    rows = got.collect()
    assert compare(got.columns, rows, [d[0] for d in result.description], result.fetchall()) is None
    for r in rows:
        for stretch in filter(None, r.rejected_mask.split(",")):
            a, b = map(int, stretch.split(":"))
            assert r.rejected[a:b].endswith("<|end|>") and r.rejected[:a].endswith("<|assistant|>\n")
    assert chat.preferences(chat.contrasted(chat.conversations(df.limit(0)))).count() == 0


def test_chat_pairs_of_any_lengths(spark):
    rows = [(1, [("user", "q"), ("assistant", "a")], [("user", "q")]), (2, None, [("user", "q")]), (3, [("user", "q")], [("user", "r"), ("assistant", "s")])]
    got = {r.pair_id: r for r in chat.preferences(spark.createDataFrame(rows, f"pair_id long, chosen {chat.TURNS}, rejected {chat.TURNS}")).collect()}
    assert (got[1].n_prompt_turns, got[1].prompt, got[1].rejected) == (1, "<|user|>\nq<|end|>\n", "")
    assert got[1].chosen[slice(*got[1].chosen_mask[0])] == "a<|end|>"
    assert (got[2].prompt, got[2].chosen, got[3].n_prompt_turns) == ("", "", 0)


# --- WARC -----------------------------------------------------------------------------------------------------------

def test_warc_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    largest = defaultdict(int)
    for p in pages:
        largest[p.html or ""] = max(largest[p.html or ""], p.page_id)
    want = []
    for p in pages:
        body = (p.html or "").encode()
        keeper = largest[p.html or ""]
        want.append((p.page_id, len(body), warc.base32_sha1(body), "response" if keeper == p.page_id else "revisit", None if keeper == p.page_id else keeper, True))
    assert sorted(map(tuple, entries.QUERIES["op5_warc"](spark, sf_dir).collect())) == sorted(want)


def test_warc_awkward(spark):
    rows = [(1, "http://a/\r\nX: y", None, 1), (2, None, "", 1), (3, "u", "same é", 1), (4, "u", "same é", 1), (4, "v", "same é", 1),
            (None, "u", "same é", 1), (None, "u", "alone", 1), (5, "u", "\r\n\r\nHTTP" * 50_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    manifest = warc.write_archives(pages, archive_bytes=1)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() > 1
    got = warc.read_archives(manifest).collect()
    assert all(r.intact for r in got)
    assert Counter((r.page_id, r.type, r.refers_to, r.payload_bytes) for r in got) == Counter(
        [(1, "revisit", 2, 0), (2, "response", None, 0), (3, "revisit", 4, 7), (4, "response", None, 7), (4, "response", None, 7),
         (None, "revisit", 4, 7), (None, "response", None, 5), (5, "response", None, 400_000)])
    assert {r.payload for r in got if r.page_id == 5} == {rows[-1][2].encode()}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_reader_is_incremental_and_strict():
    records = [warc.record(k, "http://x", os.urandom(k * 1000), None, False) for k in range(5)]
    archive = b"".join(map(warc.member, records))
    for piece in (1, 7, 1000, 1 << 20):
        assert [r["page_id"] for r in warc.records_of(io.BytesIO(archive), "x", piece)] == list(range(5))
    with pytest.raises(EOFError):
        list(warc.records_of(io.BytesIO(archive[:-5]), "x"))
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(warc.member(records[2] + b"more")), "x"))
    spoilt = bytearray(records[3])
    spoilt[-10] ^= 1
    assert [r["intact"] for r in warc.records_of(io.BytesIO(warc.member(bytes(spoilt))), "x")] == [False]
    assert zlib.decompress(archive, 31) == records[0] and sha1(records[0]).digest()


# --- nearest neighbours ---------------------------------------------------------------------------------------------

def test_hilbert_keys_walk_neighbouring_cells():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def plain_nearest(vectors, ids, k):
    out = {}
    for q in (i for i in ids if i % 20 == 0):
        best = {}
        for i, v in zip(ids, vectors):
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(v @ vectors[ids.index(q)]))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def test_nearest_query_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = plain_nearest([np.array(r.embedding, dtype=float) for r in table], [r.vec_id for r in table], 20)
    got = defaultdict(list)
    for r in entries.QUERIES["op8_hilbert_neighbours"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(x) == 20 and x == sorted(x) for x in got.values())
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_nearest_awkward(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, -1.0]), (40, [-0.5, 0.5]), (4, None), (60, [0.0, 0.0]), (5, [inf, 1.0]),
            (6, [nan, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in hilbert.nearest(df, df.vec_id % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    assert got[0] == [(2, 2.0, 1), (1, 1.0, 2), (20, 1.0, 3), (3, 0.0, 4), (40, -0.5, 5)]
    assert got[20] == [(2, 2.0, 1), (0, 1.0, 2), (1, 1.0, 3), (3, 0.0, 4), (40, -0.5, 5)]
    assert got.keys() == {0, 20, 40}
    assert hilbert.nearest(df.limit(0), df.vec_id % 20 == 0).count() == 0


# --- language model -------------------------------------------------------------------------------------------------

def test_ppm_query(spark, sf_dir):
    docs = {r.doc_id: [w.encode() for w in words(r.text)] + [b""] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    count = Counter(w for i, ws in docs.items() if i not in held for w in ws)
    total, floor = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    rows = entries.QUERIES["op9_ppm_score"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        ws = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(ws), sum(w in count for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / floor) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    uniform = sum(-(len(w) + 1) * math.log10(257) for r in rows if r.held_out for w in docs[r.doc_id])
    assert sum(r.score for r in rows if r.held_out) > 0.5 * uniform


def test_ppm_partitions_do_not_change_scores(spark, monkeypatch):
    """A vocabulary over many range partitions scores as in one, and as the plain model does."""
    rng = np.random.default_rng(5)
    syllables = ["th", "er", "on", "an", "é", "st"]
    rows = [(k, " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(30))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.score for r in ppm.ppm_scores(df).collect()}
    monkeypatch.setattr(ppm, "PART_WORDS", 20)
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 1000)
    many = {r.doc_id: r.score for r in ppm.ppm_scores(df).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-12) for k in one)


def test_ppm_probabilities_sum_to_one():
    vocabulary = sorted({b"": 9, b"the": 7, b"then": 2, b"an": 3, b"a": 1, b"th": 1}.items())
    codes = Counter()
    for word, n in vocabulary:
        line = b" " + word
        for j in range(len(word) + 1):
            for order in range(min(4, j + 1) + 1):
                codes[ppm.LowOrders.key(line[:j + 1], order) << 9 | (word[j] if j < len(word) else ppm.END)] += n
    low = ppm.LowOrders(np.array(list(codes)), np.array(list(codes.values())))
    for context in (b" ", b" th", b" the", b" zz", b" thethe"):
        assert math.isclose(sum(10 ** low.log10(context, s) for s in range(257)), 1, rel_tol=1e-9)
        assert math.isclose(sum(10 ** low.log10(context, s, {101, 97}) for s in set(range(257)) - {101, 97}), 1, rel_tol=1e-9)
    known = dict(vocabulary)
    for prefix in (b"", b"t", b"the"):  # every byte after a prefix, then any end
        words_ = sorted({prefix + bytes([b]) for b in range(256)} | {prefix} | set(known))
        lp = dict(zip(words_, ppm.score_words(words_, [known.get(w, 0) for w in words_], {}, low)))
        assert sum(10 ** x for x in lp.values()) < 1


def plain_ppm(training, text):
    """Symbol by symbol, every context of whole texts counted."""
    def stream(t):
        return [-1] * ppm.ORDER + [b for w in words(t) for b in w.encode() + b" "] + [256]

    follow = defaultdict(Counter)
    for t in training:
        x = stream(t)
        for k in range(ppm.ORDER, len(x)):
            for order in range(ppm.ORDER + 1):
                follow[tuple(x[k - order:k])][x[k]] += 1
    x, out = stream(text), 0.0
    for k in range(ppm.ORDER, len(x)):
        gone = set()
        for order in range(ppm.ORDER, -1, -1):
            left = {s: n for s, n in follow.get(tuple(x[k - order:k]), {}).items() if s not in gone}
            if left and x[k] in left:
                out += math.log10((left[x[k]] - 0.5) / sum(left.values()))
                break
            if left:
                out += math.log10(len(left) / (2 * sum(left.values())))
                gone |= left.keys()
        else:
            out -= math.log10(257 - len(gone))
    return out


@pytest.mark.parametrize("part, chunk", [(10**6, 10**6), (300, 600)])
def test_ppm_contexts_cross_words(spark, monkeypatch, part, chunk):
    """Scores are those of the plain model, whatever the ranges, and a shuffled passage scores worse than the passage."""
    monkeypatch.setattr(ppm, "PART_WORDS", part)
    monkeypatch.setattr(ppm, "CHUNK_BYTES", chunk)
    rng = np.random.default_rng(8)
    vocabulary = ["on", "the", "hill", "Über", "stood", "a", "house", "of", "stone", "漢字"]
    texts = [" ".join(rng.choice(vocabulary, 12)) for _ in range(40)] + [None, " A "]
    passage = texts[0].split()
    texts += [" ".join(passage), " ".join(passage[::-1]), "never seen\tqqq \n a"]
    held = len(texts) - 3
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm.ppm_scores(df, F.col("doc_id") >= held).collect()}
    assert got[held] > got[held + 1]
    for i, text in enumerate(texts):
        assert math.isclose(got[i], plain_ppm(texts[:held], text), rel_tol=1e-9)


def test_ppm_moves_texts_once(spark, sf_dir, monkeypatch):
    """Counting needs no exchange; texts, words and probabilities are packed. The packing is exact."""
    made = {}

    def noted(df, label):
        made[label] = df
        return written(df, label)

    monkeypatch.setattr(ppm, "written", noted)
    out = ppm.ppm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert "Exchange" not in made["chunk-counts"]._jdf.queryExecution().executedPlan().toString()
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(chunk#") == 1
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 24, 20_000).astype(np.uint64))
    totals = rng.integers(1, 90, 1 << 16)[(keys >> np.uint64(8)).astype(np.int64)]
    times = rng.integers(0, totals + 1)
    lp = np.where(times > 0, np.log10(np.maximum(times - 0.5, 0.5) / totals), -rng.random(len(keys)))
    block = ppm.packed_scores(keys, lp, times, np.where(times > 0, totals, 0))
    assert np.array_equal(ppm.unpacked_scores(keys, block), lp) and len(block) < 4 * len(keys)
    counts = rng.integers(0, 2**40, 1000)
    assert np.array_equal(ppm.unpacked(ppm.packed(counts), np.int64), counts)


def test_ppm_awkward(spark):
    rows = sorted(ppm.ppm_scores(awkward(spark)).collect(), key=repr)
    assert len(rows) == len(AWKWARD)
    assert sorted(r.n_tokens for r in rows) == sorted(len(words(r[1])) + 1 for r in AWKWARD)
    assert ppm.ppm_scores(awkward(spark, [])).count() == 0
    from pyspark.sql import functions as F

    untrained = ppm.ppm_scores(awkward(spark), F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)}
    assert all(math.isclose(r.score, -sum(len(w.encode()) + 1 for w in [*words(dict((x[0], x[1]) for x in AWKWARD)[r.doc_id]), ""]) * math.log10(257))
               for r in untrained if r.doc_id in (1, 2, 4, 9))
