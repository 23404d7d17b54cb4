"""SimHash links, periodic runs and conversation repair against plain versions."""

from __future__ import annotations

import heapq
import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import AWKWARD, WORD, awkward, words

from trailmark.llm import entries, periodic, repair, simhash


# --- SimHash --------------------------------------------------------------------------------------------------------

def plain_fingerprint(text: str | None) -> int:
    found = words(text)
    shingles = [" ".join(found[k:k + 4]) for k in range(max(1, len(found) - 3))] if found else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_links(rows: list[tuple[int | None, int]]) -> list[tuple]:
    """(doc_id, fingerprint, component) of (doc_id, fingerprint) rows, every pair compared."""
    fps = np.array([fp for _, fp in rows], dtype=np.uint64)
    label = np.arange(len(rows))
    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[:k] ^ fps[k]) <= 4):
            label[label == label[k]] = label[j]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    return sorted(((i, fp, least.get(label[k])) for k, (i, fp) in enumerate(rows)), key=repr)


def unsigned(rows):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in rows), key=repr)


def test_simhash_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = entries.QUERIES["op11_simhash_pivots"](spark, sf_dir).collect()
    want = plain_links([(d.doc_id, plain_fingerprint(d.text)) for d in docs])
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got), key=repr) == want
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)


def test_simhash_takes_awkward_documents(spark):
    want = plain_links([(r[0], plain_fingerprint(r[1])) for r in AWKWARD])
    assert unsigned(simhash.simhash_components(awkward(spark)).collect()) == want
    assert simhash.simhash_components(awkward(spark).limit(0)).count() == 0


def crowd(seed: int) -> list[tuple[int, int]]:
    """Fingerprints in a ball, in a chain of small steps, with six bits between, and anywhere."""
    draw = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << k for k in draw.sample(range(64), n))
    centre = draw.getrandbits(64)
    found = [flip(centre, draw.randint(0, 4)) for _ in range(150)] + [flip(centre, draw.randint(5, 9)) for _ in range(80)]
    for _ in range(60):
        found.append(flip(found[-1], draw.randint(3, 5)))
    found += [draw.getrandbits(64) for _ in range(100)] + [0, (1 << 64) - 1, 1 << 63]
    draw.shuffle(found)
    return list(enumerate(found))


@pytest.mark.parametrize("segments, block", [(None, 2048), (5, 8), (6, 3), (7, 16)])
def test_simhash_links_cross_blocks(spark, monkeypatch, segments, block):
    rows = crowd(block)
    given_ = spark.createDataFrame([(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda documents, width: given_)
    assert unsigned(simhash.simhash_components(given_, segments=segments, block=block).collect()) == plain_links(rows)


def test_pivots_discard_far_pairs():
    draw = np.random.default_rng(1)
    fps, pivots = draw.integers(0, 2**64, 2000, dtype=np.uint64), simhash.walsh_rows(64)
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(int)
    for a, b in draw.integers(0, len(fps), (500, 2)):
        apart, most = int(np.bitwise_count(fps[a] ^ fps[b])), int(np.abs(table[a] - table[b]).max())
        assert most <= apart and (apart <= 16 or most > 4)  # never discards a linked pair; all pivots discard every far one


def test_segments_grow_with_the_fingerprints():
    chosen = [simhash.segments_for(n, 4) for n in (10, 10**5, 10**7, 10**10)]
    assert chosen == sorted(chosen) and chosen[0] == 5 < chosen[-1]
    for segments in (5, 6, 8):
        masks = simhash.bucket_masks(segments, 4)
        pair = 0b1011 << 20 | 1 << 63
        assert any(mask & pair == 0 for mask in masks)


# --- runs -----------------------------------------------------------------------------------------------------------

def plain_runs(found: list) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(found) // 3 + 1):
        k = 0
        while k + q < len(found):
            if found[k] != found[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(found) and found[k] == found[k + q]:
                k += 1
            end = k + q
            if end - start >= max(24, 3 * q) and not any(
                    q % p == 0 and all(found[i] == found[i + p] for i in range(start, end - p)) for p in range(1, q)):
                out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


PARTS = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=20), st.integers(1, 8), st.integers(1, 160), st.text("defgh", max_size=12))


def spread(parts) -> list[bytes]:
    return [w.encode() for base, times, cut, tail in parts for w in [*(base * times)[:cut], *tail]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=5).map(spread), min_size=1, max_size=4))
def test_runs_of_texts(texts):
    assert periodic.runs_of(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(PARTS, max_size=5).map(spread), st.randoms(use_true_random=False))
def test_words_may_come_one_by_one(text, draw):
    numbers = np.array([w[0] for w in text], dtype=np.int64)
    single, several, at = periodic.SquareCatcher(), periodic.SquareCatcher(), 0
    for k in range(len(numbers)):
        for start, period in single.append(numbers[k:k + 1]):  # a catch is a square that is there already
            assert start + 2 * period <= k + 1 and text[start:start + period] == text[start + period:start + 2 * period]
        assert k % 37 or single.runs() == plain_runs(text[:k + 1])
    while at < len(numbers):
        step = draw.randint(1, 40)
        several.append(numbers[at:at + step])
        at += step
    assert single.runs() == several.runs() == plain_runs(text)


def test_long_periodic_texts_are_caught():
    word = ["a", "ab"]
    while len(word[-1]) < 1500:
        word.append(word[-1] + word[-2])
    text = [c.encode() for c in word[-1]]
    assert periodic.runs_of([text])[0] == plain_runs(text)
    assert periodic.runs_of([[b"a", b"b"] * 100_000, [b"x"] * 100_000]) == [[(0, 200_000, 2)], [(0, 100_000, 1)]]


def plain_row(doc_id: int | None, text: str | None) -> tuple:
    found = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(found), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(found)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            sha256(" ".join(w for i, w in enumerate(found) if i not in dropped).encode()).hexdigest())


def test_runs_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = entries.QUERIES["op12_periodic_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_row(d.doc_id, d.text) for d in docs), key=repr)
    assert got.where("n_runs > 0").count() > 5


def test_runs_take_awkward_documents(spark):
    rows = {(r.doc_id, r.collapsed): r.runs for r in periodic.periodic_runs(awkward(spark)).collect()}
    assert (1, "") in rows and (2, "") in rows and (3, "") in rows and not any(rows.values())
    again = awkward(spark, [(1, "so it goes " * 9 + "on", None, None), (None, "x " * 30, None, None)])
    out = {r.doc_id: r for r in periodic.periodic_runs(again).collect()}
    assert out[1].collapsed == "so it goes on" and tuple(out[1].strongest) == (0, 27, 3)
    assert out[None].collapsed == "x" and periodic.planted_repeats(None, [b"x"]) == [b"x"]
    assert periodic.periodic_runs(awkward(spark).limit(0)).count() == 0


# --- conversation repair --------------------------------------------------------------------------------------------

def plain_repair(turns: list[tuple[str, str, str]]) -> tuple[int, str, str]:
    """Cost, audit and digest of (role, text, fault) turns: cheapest first, then by the audit, states by turns done."""
    after = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    heap, done = [(0, "", 0, 0, ())], {}
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done[k, state] = cost, audit, lines
        role, to = after[state]
        heapq.heappush(heap, (cost + 2, audit + "I", k, to, (*lines, f"{role}:")))
        if k < len(turns):
            own, text, fault = turns[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if own[:1] == role[0] or own[:1] == "s" and state == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, to if own[:1] == role[0] else 1, (*lines, f"{own}:{text}")))
                heapq.heappush(heap, (cost + more + 2, audit + "R", k + 1, to, (*lines, f"{role}:{text}")))
    cost, audit, lines = min(done[len(turns), s] for s in (0, 3))
    return cost, audit, sha256("\n".join(lines).encode()).hexdigest()


TURN = st.tuples(st.sampled_from(["user", "assistant", "system", "user", "assistant", "tool", " ", ""]), st.sampled_from(["a.", "b", ""]),
                 st.sampled_from(["", "", "", "blank", "duplicate", "truncated"]))


@pytest.mark.parametrize("every", [1, 3, 1024])
@settings(max_examples=150, deadline=None)
@given(turns=st.lists(TURN, max_size=14))
def test_cheapest_edits(every, turns):
    before, repair.SETTLE_EVERY = repair.SETTLE_EVERY, every
    conversation = repair.Repair()
    for k, (role, text, fault) in enumerate(turns):
        conversation.add(k, role, text, fault)
    got = conversation.result()
    repair.SETTLE_EVERY = before
    assert (got["cost"], got["audit"], got["repaired_sha256"]) == plain_repair(turns)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from("DIKR")), max_size=40), st.booleans())
def test_audits_compare_like_texts(grown, collide):
    base, repair.BASE = repair.BASE, 0 if collide else repair.BASE  # base 0 makes almost every hash collide
    texts, nodes = [""], [repair.Audit(None, "")]
    for at, edit in grown:
        texts.append(texts[at % len(texts)] + edit)
        nodes.append(repair.Audit(nodes[at % len(nodes)], edit))
    wrong = [(x, y) for x, a in zip(texts, nodes) for y, b in zip(texts, nodes) if repair.precedes(a, b) != (x < y)]
    repair.BASE = base
    assert not wrong


def plain_conversations(rows: list[tuple]) -> list[tuple]:
    kept, out = {}, []
    for conv_id, turn, role, text in rows:
        spaced = [" " if x is None else x for x in (conv_id, turn, role, text)]
        case = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = "user" if case == 4 else spaced[2], {1: "", 2: re.sub("[.!?]", "", spaced[3])}.get(case, spaced[3])
        kept.setdefault(conv_id, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(case, 1))
    for conv_id, turns in kept.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        count, seen, judged = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in turns:
            solid = WORD.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1][-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                count[fault] += 1
        initials = [role[:1] for _, role, _ in turns]
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv_id, gaps, *count.values(), illegal, *plain_repair(judged)))
    return sorted(out, key=repr)


def test_repair_query(spark, sf_dir):
    rows = list(map(tuple, spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    got = entries.QUERIES["op13_conversation_repair"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_conversations(rows)


def test_repair_takes_awkward_turns(spark):
    texts = ["a.", "b", None, "", " \t", "end! ", "last ", " ", "same.", "same.", "x" * 100_000]
    draw = random.Random(5)
    rows = [(c, draw.choice([None, 0, 1, 2, 2, 5, 9]), draw.choice(["user", "assistant", "system", None, "", "tool"]), draw.choice(texts))
            for c in [None, *range(40)] for _ in range(draw.randint(1, 9))]
    frame = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, present int, seen string")
    got = repair.repaired(repair.damaged(frame), entries.F.col("kept"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_conversations(rows)
    assert repair.repaired(frame.limit(0)).count() == 0
    plain = repair.repaired(frame.limit(30)).collect()
    assert sum(len(r.audit) for r in plain) >= 30
