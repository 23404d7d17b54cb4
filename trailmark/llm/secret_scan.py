"""Secret scans with one combined automaton.

The rules' regular expressions become one non-deterministic automaton over bytes, subset construction makes it
deterministic, partition refinement makes it minimal, and what remains is an array of transitions between states by
byte class. One pass over the bytes of a batch runs all rules at once. Texts are cut for the pass only after bytes
that bring every state back to the start (no match crosses one), so thousands of stretches of all texts advance
together, a byte a step. Stretches that reach an accepting state are then searched by each rule's own automaton,
leftmost first and without overlap, for the exact spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.tables import text_rows, with_doc
from trailmark.llm.words import slices

STRETCH = 1024  # bytes between cuts of a text in the pass


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern of ASCII bytes, whose matches are the longest. A match of fewer than `least` bytes
    is dropped, but still consumed; with `head`, what follows the head is measured. Lengths are left out of the
    patterns where they can be: automata that count several lengths at once have a state for each combination."""

    kind: str
    pattern: str
    head: str | None = None
    least: int = 0


HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
# The first three are the base rules; spans that start together are listed in this order.
RULES = (
    Rule("assign", HEAD + r"[A-Za-z0-9+/_.=-]+", HEAD, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", least=32),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=36),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# --- compiling ------------------------------------------------------------------------------------------------------

class Nfa:
    """Thompson's construction; a transition's label is a 256-bit mask of bytes."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.steps: list[tuple[int, int] | None] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.free.append([])
        self.steps.append(None)
        return len(self.free) - 1

    def add_rule(self, pattern: str, number: int) -> int:
        start = self.state()
        self.accepts[self.sequence(sre_parser.parse(pattern), start, False)] = number
        return start

    def sequence(self, items, at: int, any_case: bool) -> int:
        for item in items:
            at = self.item(item, at, any_case)
        return at

    def item(self, item, at: int, any_case: bool) -> int:
        op, value = item
        if op is sre.SUBPATTERN:
            _, flags, _, inner = value
            return self.sequence(inner, at, any_case or bool(flags & re.IGNORECASE))
        if op is sre.BRANCH:
            end = self.state()
            for branch in value[1]:
                start = self.state()
                self.free[at].append(start)
                self.free[self.sequence(branch, start, any_case)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, inner = value
            for _ in range(least):
                at = self.sequence(inner, at, any_case)
            if most is sre.MAXREPEAT:
                loop = self.state()
                self.free[at].append(loop)
                self.free[self.sequence(inner, loop, any_case)].append(loop)
                return loop
            end = self.state()
            for _ in range(most - least):
                self.free[at].append(end)
                at = self.sequence(inner, at, any_case)
            self.free[at].append(end)
            return end
        to = self.state()
        start = self.state()
        self.free[at].append(start)
        self.steps[start] = (self.bytes_of(op, value, any_case), to)
        return to

    @staticmethod
    def bytes_of(op, value, any_case: bool) -> int:
        mask = 0
        for kind, what in value if op is sre.IN else [(op, value)]:
            if kind is sre.LITERAL:
                mask |= 1 << what
            elif kind is sre.RANGE:
                mask |= sum(1 << b for b in range(what[0], what[1] + 1))
            else:
                raise ValueError(f"rules take literals, ranges, groups, branches and repeats only, not {kind}")
        if any_case:
            letters = [b for b in range(256) if mask >> b & 1 and chr(b).isascii() and chr(b).isalpha()]
            mask |= sum({1 << (b ^ 32) for b in letters if not mask >> (b ^ 32) & 1})
        return mask

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if self.steps[s] is not None or s in self.accepts)


@dataclass(frozen=True)
class Automaton:
    """State 0 is the start. `after[state * classes + class]` is the next state times `classes`; accepting states have
    the largest numbers, from `first_accept` on (times `classes`)."""

    class_of: bytes
    classes: int
    after: np.ndarray
    first_accept: int
    resets: np.ndarray  # classes that bring every state to the start

    @property
    def states(self) -> int:
        return len(self.after) // self.classes


def compile_rules(patterns: list[str], restart: bool) -> Automaton:
    """The minimal automaton of the patterns; with `restart`, a match may begin at every byte."""
    nfa = Nfa()
    starts = [nfa.add_rule(p, n) for n, p in enumerate(patterns)]
    masks = sorted({step[0] for step in nfa.steps if step})
    shapes: dict[tuple, int] = {}
    class_of = bytes(shapes.setdefault(tuple(m >> b & 1 for m in masks), len(shapes)) for b in range(256))
    examples = [class_of.index(c) for c in range(len(shapes))]

    def bits(states) -> int:
        return sum(1 << s for s in states)

    # of each state: the classes it leaves by, and where they lead, closure included
    moves = [([c for c, b in enumerate(examples) if step[0] >> b & 1], bits(nfa.closure({step[1]}))) if step else ([], 0)
             for step in nfa.steps]
    ends, begin = bits(nfa.accepts), bits(nfa.closure(starts))
    number, todo, table, accept = {begin: 0}, [begin], [], []
    for now in todo:  # grows as new subsets are found
        accept.append(bool(now & ends))
        row, rest = [begin if restart else 0] * len(examples), now
        while rest:
            low = rest & -rest
            rest ^= low
            leaves, to = moves[low.bit_length() - 1]
            for c in leaves:
                row[c] |= to
        for to in row:
            if to not in number:
                number[to] = len(number)
                todo.append(to)
        table.append([number[to] for to in row])
    after, label = np.array(table), np.array(accept, dtype=np.int64)
    while True:  # refine the partition until states of a class agree on all classes of successors
        found, finer = np.unique(np.column_stack([label, label[after]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if len(found) == len(np.unique(label)):
            break
        label = finer
    _, first, label = np.unique(label, return_index=True, return_inverse=True)
    small, ends = label.reshape(-1)[after[first]], np.array(accept)[first]
    order = sorted(range(len(first)), key=lambda s: (ends[s], s != label.reshape(-1)[0]))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    final = place[small[order]]
    width = len(shapes)
    return Automaton(class_of, width, (final * width).astype(np.int32).reshape(-1), int((~ends).sum()) * width,
                     np.array([(final[:, c] == 0).all() for c in range(width)]))


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    together: Automaton
    alone: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]


def compile_scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules, compile_rules([r.pattern for r in rules], restart=True),
                   tuple(compile_rules([r.pattern], restart=False) for r in rules),
                   tuple(compile_rules([r.head], restart=False) if r.head else None for r in rules))


# --- scanning -------------------------------------------------------------------------------------------------------

def longest(auto: Automaton, classes: bytes, at: int, end: int, dead: int) -> int:
    """End of the longest match from `at`, or -1."""
    state, found = 0, -1
    after = auto.after
    for k in range(at, end):
        state = after[state + classes[k]]
        if state == dead:
            break
        if state >= auto.first_accept:
            found = k + 1
    return found


def dead_state(auto: Automaton) -> int:
    """The state without a way out, or -1."""
    table = auto.after.reshape(-1, auto.classes)
    stuck = [s for s in range(len(table)) if (table[s] == s * auto.classes).all() and s * auto.classes < auto.first_accept]
    return stuck[0] * auto.classes if stuck else -1


def spans_in(scanner: Scanner, data: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) of every kept match in a stretch of bytes."""
    out = []
    for number, (rule, auto, head) in enumerate(zip(scanner.rules, scanner.alone, scanner.heads)):
        classes, dead = data.translate(auto.class_of), dead_state(auto)
        opens = np.flatnonzero(auto.after[:auto.classes][np.frombuffer(classes, np.uint8)] != dead)
        done = 0
        for at in opens.tolist():
            if at < done:
                continue
            end = longest(auto, classes, at, len(data), dead)
            if end < 0:
                continue
            done = end
            value = at if head is None else longest(head, data.translate(head.class_of), at, end, dead_state(head))
            if end - value < rule.least:
                continue
            out.append((at, number, end))
    return out


def marked(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches in which some rule matches."""
    classes = np.frombuffer(data.tobytes().translate(auto.class_of), dtype=np.uint8)
    calm = np.flatnonzero(auto.resets[classes]) + 1
    cuts = calm[np.minimum(np.searchsorted(calm, np.arange(STRETCH, len(data), STRETCH)), len(calm) - 1)] if len(calm) else calm
    edges = np.unique(np.concatenate([offsets, cuts]))
    starts, lengths = edges[:-1], np.diff(edges)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    if not len(starts):
        return starts, starts
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # lanes longer than the step
    state, most = np.zeros(len(starts), dtype=np.int32), np.zeros(len(starts), dtype=np.int32)
    for step, lanes in enumerate(active.tolist()):
        now = auto.after[state[:lanes] + classes[starts[:lanes] + step]]
        state[:lanes] = now
        np.maximum(most[:lanes], now, out=most[:lanes])
    hit = np.sort(np.flatnonzero(most >= auto.first_accept))
    return starts[hit], starts[hit] + lengths[hit]


def secret_spans(documents: DataFrame, rules: tuple[Rule, ...] = RULES, carry: bool = False) -> DataFrame:
    """Of each row: doc_id, text and spans, an array of (kind, start, end) in code points, end exclusive, by start and
    then by the order of the rules; with `carry` also doc, the whole row.

    Null and empty texts have no spans. Every row is its own document, ties and repeats included.
    """
    scanner = documents.sparkSession.sparkContext.broadcast(compile_scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = scanner.value
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                found: list[list[dict]] = [[] for _ in range(high - low)]
                for start, end in zip(*(x.tolist() for x in marked(use.together, data, offsets))):
                    row = int(np.searchsorted(offsets, start, "right")) - 1
                    inner = spans_in(use, data[start:end].tobytes())
                    if inner:
                        found[row].extend((start + a, rule, start + b) for a, rule, b in inner)
                points = []
                for row, spans in enumerate(found):
                    base, done, known = int(offsets[row]), int(offsets[row]), 0
                    place = {base: 0}
                    for byte in sorted({p for s in spans for p in (s[0], s[2])}):  # count leading bytes of characters
                        known += int(np.count_nonzero((data[done:byte] & 0xC0) != 0x80))
                        done = byte
                        place[byte] = known
                    points.append([{"kind": use.rules[rule].kind, "start": place[a], "end": place[b]}
                                   for a, rule, b in sorted(spans)])
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(points, pa.list_(pa.struct(
                        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), *part.columns[2:]],
                    names=["doc_id", "text", "spans", "doc"][:3 + carry])

    kind = "doc_id long, text string, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return text_rows(documents, carry).mapInArrow(run, with_doc(kind, documents, carry))


def redacted(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with each stretch of text that spans cover replaced by `[kind]` of its first span; no row is dropped.

    Other columns stay as they are, but n_chars, where there is one, counts the new text.
    """
    pieces = """
      aggregate(spans, named_struct('at', 0L, 'out', array('')),
        (a, s) -> named_struct('at', greatest(a.at, s.end),
          'out', if(s.start >= a.at, concat(a.out, array(substring(text, int(a.at) + 1, int(s.start - a.at)), concat('[', s.kind, ']'))), a.out)),
        a -> concat(array_join(a.out, ''), substring(text, int(a.at) + 1)))"""
    text = F.when(F.size("spans") > 0, F.expr(pieces)).otherwise(F.col("text"))
    rows = secret_spans(documents, rules, carry=True).select(text.alias("_text"), "spans", "doc")
    new = {"text": F.col("_text"), "n_chars": F.when(F.size("spans") > 0, F.length("_text").cast("long")).otherwise(F.col("doc.n_chars"))
           if "n_chars" in documents.columns else None}
    return rows.select(*((new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in documents.columns))
