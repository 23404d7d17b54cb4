"""Repair of the turns of a conversation, with an audit of cheapest edits.

A conversation should be an optional system turn and then pairs of user and assistant turns, or nothing. Its turns go
one by one through a dynamic program over what may come next: nothing yet, a system turn seen, a user turn seen, a pair
complete. Each of the four states holds the cheapest audit that leads there. An audit is a persistent list: a node adds
one edit to the node it goes on from, so audits share their beginnings. Nodes have binary-lifting ancestors and a
rolling hash of their edits. Of audits of one cost the ASCII-least stays; two audits compare by a search for their
longest common prefix along the ancestors. Equal hashes of different nodes are verified edit by edit.

The text of the repaired turns is hashed along, one running SHA-256 a state, so texts are never held. Edits that all
four audits share are written out and dropped from the lists from time to time. Turns of a conversation stream through
one task in order, as the digest of their texts demands; that a turn was seen earlier is found before, by a window over
equal turns, so memory does not grow with texts or with distinct turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
EMPTY, SYSTEM, USER, PAIR = range(4)
NEXT = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIR), PAIR: ("user", USER)}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
SOLID = r"[^ \t-\r]"
CUT_OFF = r"[^ \t-\r.!?][ \t-\r]*\z"
MODULUS, BASE = (1 << 61) - 1, 0x5DEECE66D1F2A9B
SETTLE_EVERY = 1024


class Audit:
    """The last edit of an audit and, through its ancestors, all before it. `ups[k]` is 2^k edits back."""

    __slots__ = ("edit", "depth", "hash", "ups")

    def __init__(self, before: Audit | None, edit: str):
        self.edit = edit
        self.depth = before.depth + 1 if before else 0
        self.hash = (before.hash * BASE + ord(edit)) % MODULUS if before else 0
        ups = []
        while before is not None:
            ups.append(before)
            k = len(ups) - 1
            before = before.ups[k] if k < len(before.ups) else None
        self.ups = ups

    def back(self, steps: int) -> Audit:
        node = self
        while steps:
            k = steps.bit_length() - 1
            node = node.ups[k]
            steps -= 1 << k
        return node


def same(x: Audit, y: Audit) -> bool:
    """Whether two audits of one length are equal. Equal hashes are verified back to a shared node."""
    if x is y:
        return True
    if x.hash != y.hash:
        return False
    while x is not y:
        if x.edit != y.edit:
            return False
        x, y = x.ups[0], y.ups[0]
    return True


def common(x: Audit, y: Audit) -> int:
    """Length of the longest common prefix of two audits."""
    depth = min(x.depth, y.depth)
    x, y = x.back(x.depth - depth), y.back(y.depth - depth)
    if same(x, y):
        return depth
    for k in reversed(range(len(x.ups))):
        if k < len(x.ups) and not same(x.ups[k], y.ups[k]):
            x, y = x.ups[k], y.ups[k]
    return x.depth - 1


def precedes(x: Audit, y: Audit) -> bool:
    """Whether audit x comes before y in ASCII order."""
    depth = common(x, y)
    if depth == x.depth or depth == y.depth:
        return x.depth < y.depth
    return x.back(x.depth - depth - 1).edit < y.back(y.depth - depth - 1).edit


class Repair:
    """The dynamic program over one conversation's turns."""

    def __init__(self):
        self.settled = bytearray()
        self.rows = self.turns = self.gap_turns = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.least_turn = self.last_turn = self.last_initial = None
        self.best: list = [(0, Audit(None, ""), None), None, None, None]  # of each state: cost, audit, digest of its turns
        self._insert(self.best)

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.rows and (self.last_initial, initial) not in LEGAL:
            self.faults["illegal"] += 1
        self.last_initial = initial
        self.rows += 1
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            self.least_turn = turn if self.least_turn is None else self.least_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        self._edit(role, initial, text, fault)
        if self.rows % SETTLE_EVERY == 0:
            self._settle()

    def _edit(self, role: str, initial: str, text: str, fault: str) -> None:
        extra = TRUNCATED_COST if fault == "truncated" else 0
        after: list = [None] * 4
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, audit, digest = held
            self._offer(after, state, cost + DELETE_COST, audit, DELETE, digest, None)
            if fault in ("blank", "duplicate"):
                continue
            wanted, to = NEXT[state]
            if initial == wanted[0]:
                self._offer(after, to, cost + extra, audit, KEEP, digest, (role, text))
            elif initial == "s" and state == EMPTY:
                self._offer(after, SYSTEM, cost + extra, audit, KEEP, digest, (role, text))
            self._offer(after, to, cost + extra + REROLE_COST, audit, REROLE, digest, (wanted, text))
        self.best = [self._made(x) for x in after]
        self._insert(self.best)
        self._drop_outdone()

    def _drop_outdone(self) -> None:
        """A complete pair can go on like a system turn, and like nothing once it deletes one system turn: states that
        cost more than that end no cheapest audit."""
        if (pair := self.best[PAIR]) is not None:
            for state, spare in ((EMPTY, DELETE_COST), (SYSTEM, 0)):
                if (held := self.best[state]) is not None and held[0] > pair[0] + spare:
                    self.best[state] = None

    def _insert(self, best: list) -> None:
        """Empty turns put in before the next turn, as long as they help."""
        changed = True
        while changed:
            changed = False
            for state in (EMPTY, SYSTEM, USER, PAIR):
                if best[state] is None:
                    continue
                cost, audit, digest = best[state]
                wanted, to = NEXT[state]
                offers = list(best)
                self._offer(offers, to, cost + INSERT_COST, audit, INSERT, digest, (wanted, ""))
                if offers[to] is not best[to]:
                    best[to] = self._made(offers[to])
                    changed = True

    @staticmethod
    def _offer(best: list, state: int, cost: int, before: Audit, edit: str, digest, line) -> None:
        """Puts an audit, cheapest or of least order, at a state; its digest is made when it stays."""
        held = best[state]
        if held is not None and held[0] < cost:
            return
        node = Audit(before, edit)
        if held is None or held[0] > cost or precedes(node, held[1]):
            best[state] = (cost, node, digest, line)

    @staticmethod
    def _made(held):
        if held is None or len(held) == 3:
            return held
        cost, node, digest, line = held
        if line is not None:
            between = "\n" if digest else ""
            digest = digest.copy() if digest else hashlib.sha256()
            digest.update(f"{between}{line[0]}:{line[1]}".encode())
        return cost, node, digest

    def _settle(self) -> None:
        """Writes out the edits that all audits share; the rest of each list starts anew behind them."""
        nodes = [held[1] for held in self.best if held]
        depth = min(common(nodes[0], x) for x in nodes)
        if 2 * depth < max(x.depth for x in nodes):
            return
        self.settled += edits_of(nodes[0].back(nodes[0].depth - depth))
        again: dict[int, Audit] = {}

        def moved(node: Audit) -> Audit:
            path = []
            while node.depth > depth and id(node) not in again:
                path.append(node)
                node = node.ups[0]
            if node.depth == depth:
                again.setdefault(id(node), again.setdefault(0, Audit(None, "")))
            new = again[id(node)]
            for old in reversed(path):
                new = again[id(old)] = Audit(new, old.edit)
            return new

        self.best = [held and (held[0], moved(held[1]), held[2]) for held in self.best]

    def result(self) -> dict:
        ends = [held for held in (self.best[EMPTY], self.best[PAIR]) if held]
        cost, audit, digest = ends[0]
        if len(ends) > 1 and (ends[1][0] < cost or ends[1][0] == cost and precedes(ends[1][1], audit)):
            cost, audit, digest = ends[1]
        gaps = 0 if self.least_turn is None else self.last_turn - self.least_turn + 1 - self.turns
        return {"gaps": gaps, **self.faults, "cost": cost, "audit": (self.settled + edits_of(audit)).decode(),
                "repaired_sha256": (digest or hashlib.sha256()).hexdigest()}


def edits_of(node: Audit) -> bytes:
    out = bytearray()
    while node.ups:
        out += node.edit.encode()
        node = node.ups[0]
    out.reverse()
    return bytes(out)


# --- on Spark -------------------------------------------------------------------------------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def with_faults(turns: DataFrame) -> DataFrame:
    """Adds `fault`, the first of blank, duplicate and truncated that a turn has, or '', and `seen`."""
    equal = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    seen = F.row_number().over(equal) > 1
    fault = (F.when(~F.col("text").rlike(SOLID), "blank").when(F.col("seen"), "duplicate")
             .when(F.col("text").rlike(CUT_OFF), "truncated").otherwise(""))
    return turns.withColumn("seen", seen).withColumn("fault", fault)


def repaired(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps in the turn numbers, turns that are blank, duplicate or truncated,
    neighbours in illegal order, the cost of the cheapest edits, their audit (K keep, R change role, D delete, I insert;
    of audits of one cost the ASCII-least) and the SHA-256 of the repaired `role:text` lines.

    `turns` needs conv_id, turn, role and text; other columns are ignored. A null role or text counts as one space. Turns
    go by number, null numbers first, then by role and text. Rows that `present` is not true for only name their
    conversation, so one without turns has a row of zeros. A null conv_id is a conversation of its own.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"))
    judged = with_faults(rows.where("present")).select("conv_id", "turn", "role", "text", "fault", "seen", "present")
    only_named = rows.where("not present").select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("fault"),
        F.lit(False).alias("seen"), "present").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conversation, done = None, None, []
        for batch in batches:
            for conv_id, turn, role, text, fault, _, here in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if conversation is None or conv_id != current:
                    if conversation is not None:
                        done.append({"conv_id": current, **conversation.result()})
                    current, conversation = conv_id, Repair()
                if here:
                    conversation.add(turn, role, text, fault)
            if done:
                yield pa.RecordBatch.from_pylist(done, RESULT)
                done = []
        if conversation is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, **conversation.result()}], RESULT)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen"]
    dealt = judged.unionByName(only_named).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with planted faults, by a hash of conversation and turn: dropped (`kept` is false), emptied, without
    sentence ends, repeated, or given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("case") != 0).alias("kept"), F.explode(times).alias("time")).drop("time")
