"""Secret scan by one combined deterministic automaton.

All rules are compiled together: regular expressions over bytes become one
non-deterministic automaton, subset construction makes it deterministic,
partition refinement makes it minimal, and the result is a flat array of
transitions by (state, byte class).  One pass over the bytes finds the places
where any rule can end.  Many stretches of a batch advance in step, each from
the start state; a stretch whose true entry state differs is run again from
that state, so the answer is that of a sequential pass.

From an end the rule's reversed automaton finds the leftmost start.  A rule is
a pattern whose matches, once begun, are extended only by its last repeated
class, and that can't begin inside its own part before that class; for such
patterns this gives the leftmost, longest, non-overlapping matches.

Defined cases: a null text counts as empty and gives no spans; repeated rows
give repeated results; very long texts are scanned whole; other columns of the
input, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import textbatch as tb
from plumbline.llm.shared import small_batches


@dataclass(frozen=True)
class Rule:
    """``pattern``: literals, classes, groups, ``|`` and ``? * + {m,n}`` over ASCII.

    A match shorter than ``least`` is dropped; ``value``, an ordinary regular
    expression, then gives the part (group 1) that must have ``value_least``.
    """

    kind: str
    pattern: str
    least: int = 1
    value: str | None = None
    value_least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
_GAP = "[\"']?\\x20*[:=]\\x20*[\"']?"
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", f"({_KEYS}){_GAP}[A-Za-z0-9+/_.=-]+", 1, f"(?:{_KEYS}){_GAP}([A-Za-z0-9+/_.=-]+)", 6),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted_git", "gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("map_key", "AIza[A-Za-z0-9_-]+", 39),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
)


# --- regular expressions to automata -------------------------------------


def parse(pattern: str) -> tuple:
    """A tree of ("set", bytes), ("cat", ...), ("alt", ...), ("rep", tree, least, most or None)."""
    i = 0

    def escape() -> int:
        nonlocal i
        i += 1
        if pattern[i] == "x":
            i += 3
            return int(pattern[i - 2 : i], 16)
        i += 1
        return ord(pattern[i - 1])

    def char() -> int:
        nonlocal i
        if pattern[i] == "\\":
            return escape()
        i += 1
        return ord(pattern[i - 1])

    def charset() -> tuple:
        nonlocal i
        i, found = i + 1, set()
        while pattern[i] != "]":
            low = high = char()
            if pattern[i] == "-" and pattern[i + 1] != "]":
                i += 1
                high = char()
            found.update(range(low, high + 1))
        i += 1
        return ("set", frozenset(found))

    def alternatives() -> tuple:
        nonlocal i
        options = [sequence()]
        while i < len(pattern) and pattern[i] == "|":
            i += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", *options)

    def sequence() -> tuple:
        nonlocal i
        parts = []
        while i < len(pattern) and pattern[i] not in "|)":
            if pattern[i] == "(":
                i += 1
                part = alternatives()
                i += 1
            elif pattern[i] == "[":
                part = charset()
            else:
                part = ("set", frozenset([char()]))
            while i < len(pattern) and pattern[i] in "?*+{":
                if pattern[i] == "{":
                    end = pattern.index("}", i)
                    low, _, high = pattern[i + 1 : end].partition(",")
                    most = int(high) if high else None if "," in pattern[i:end] else int(low)
                    part, i = ("rep", part, int(low), most), end + 1
                else:
                    least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[i]]
                    part, i = ("rep", part, least, most), i + 1
            parts.append(part)
        return ("cat", *parts)

    return alternatives()


def reverse(tree: tuple) -> tuple:
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "rep":
        return (kind, reverse(rest[0]), *rest[1:])
    return (kind, *map(reverse, rest if kind == "alt" else rest[::-1]))


def longest(tree: tuple) -> float:
    """The most bytes that a match can have."""
    kind, *rest = tree
    if kind == "set":
        return 1
    if kind == "rep":
        return float("inf") if rest[2] is None else rest[2] * longest(rest[0])
    return (max if kind == "alt" else sum)(map(longest, rest))


def lead(rule: Rule) -> float:
    """The most bytes of a match before its last repeated class; no bound where it doesn't end with one."""
    tree = parse(rule.pattern)
    last = tree[-1]
    return sum(map(longest, tree[1:-1])) if tree[0] == "cat" and last[0] == "rep" and last[1][0] == "set" and last[2] <= 1 else float("inf")


@dataclass
class Automaton:
    """``table[state * classes + class]`` is the next state times ``classes``; ``accepts`` has a bit for each rule."""

    table: np.ndarray
    of_byte: np.ndarray
    classes: int
    accepts: np.ndarray
    start: int
    dead: int | None


def compile_rules(trees: list[tuple], search: bool) -> Automaton:
    """``search``: a match may start anywhere.  Class ``classes - 1`` leads every state to the start."""
    free: list[list[int]] = []
    moves: list[tuple[frozenset, int] | None] = []

    def state() -> int:
        free.append([])
        moves.append(None)
        return len(free) - 1

    def build(tree: tuple, into: int) -> int:
        """First state of an automaton for ``tree`` that leads to ``into``."""
        kind, *rest = tree
        if kind == "set":
            s = state()
            moves[s] = (rest[0], into)
            return s
        if kind == "cat":
            for part in rest[::-1]:
                into = build(part, into)
            return into
        if kind == "alt":
            s = state()
            free[s] += [build(part, into) for part in rest]
            return s
        part, least, most = rest
        if most is None:
            loop = state()
            free[loop] += [build(part, loop), into]
            into = loop
        else:
            for _ in range(most - least):
                s = state()
                free[s] += [build(part, into), into]
                into = s
        for _ in range(least):
            into = build(part, into)
        return into

    ends = {}
    begin = state()
    for k, tree in enumerate(trees):
        end = state()
        ends[end] = k
        free[begin].append(build(tree, end))

    marks = np.zeros(256, np.int64)
    for kinds in {m[0] for m in moves if m}:
        member = np.zeros(256, np.int64)
        member[list(kinds)] = 1
        marks = np.unique(marks * 2 + member, return_inverse=True)[1]
    samples = [int(np.flatnonzero(marks == c)[0]) for c in range(marks.max() + 1)]

    def closure(found: set) -> frozenset:
        todo = list(found)
        while todo:
            for t in free[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(s for s in found if moves[s] or s in ends)

    first = closure({begin})
    known, order, rows = {first: 0}, [first], []
    for here in order:  # grows while it is read
        row = []
        for byte in samples:
            to = closure({moves[s][1] for s in here if moves[s] and byte in moves[s][0]})
            to = to | first if search else to
            if to not in known:
                known[to] = len(order)
                order.append(to)
            row.append(known[to])
        rows.append(row)
    step = np.array(rows)
    accepts = np.array([sum(1 << ends[s] for s in here if s in ends) for here in order], np.uint32)
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    of_block = np.unique(block, return_index=True)[1]
    step, accepts, start = block[step[of_block]], accepts[of_block], int(block[0])
    dead = next((int(s) for s in range(len(step)) if not accepts[s] and (step[s] == s).all()), None)
    classes = step.shape[1] + 1
    step = np.column_stack([step, np.full(len(step), start)])
    return Automaton((step * classes).astype(np.int32).ravel(), marks.astype(np.int32), classes, accepts, start, dead)


@lru_cache(maxsize=4)
def automata(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton]]:
    trees = [parse(r.pattern) for r in rules]
    return compile_rules(trees, True), [compile_rules([reverse(t)], False) for t in trees]


# --- the pass ------------------------------------------------------------


def end_states(automaton: Automaton, kinds: np.ndarray) -> np.ndarray:
    """The state (times ``classes``) after each byte, given the bytes' classes."""
    n = len(kinds)
    lanes = max(1, min(8192, n // 256))
    steps = -(-n // lanes)
    grid = np.full(lanes * steps, automaton.classes - 1, np.int32)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    states = np.empty_like(grid)
    home = automaton.start * automaton.classes
    entered = np.full(lanes, home, np.int32)
    here = entered.copy()
    for k in range(steps):
        here = automaton.table[here + grid[k]]
        states[k] = here
    while True:
        wrong = np.flatnonzero(entered[1:] != states[-1, :-1]) + 1
        if not len(wrong):
            break
        here = entered[wrong] = states[-1, wrong - 1]
        for k in range(steps):
            here = automaton.table[here + grid[k, wrong]]
            if (here == states[k, wrong]).all():
                break
            states[k, wrong] = here
    return states.T.ravel()[:n]


def leftmost_start(automaton: Automaton, kinds: bytes, begin: int, end: int) -> int:
    """Smallest start from ``begin`` of a match that ends at ``end``, or -1."""
    table, classes, here, found = automaton.table, automaton.classes, automaton.start * automaton.classes, -1
    dead = -1 if automaton.dead is None else automaton.dead * classes
    of_byte, accepts = automaton.of_byte, automaton.accepts
    for at in range(end - 1, begin - 1, -1):
        here = table[here + of_byte[kinds[at]]]
        if here == dead:
            break
        if accepts[here // classes]:
            found = at
    return found


def scan_texts(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES, compiled: tuple[Automaton, list[Automaton]] | None = None) -> dict[int, list[tuple[int, int, int]]]:
    """By text, its (start, rule, end) in code points, sorted; texts without a match are left out."""
    search, backward = compiled or automata(rules)
    joined = np.insert(search.of_byte[data], offsets[1:-1], search.classes - 1)
    bases = offsets[:-1] + np.arange(len(offsets) - 1)
    states = end_states(search, joined) // search.classes if len(joined) else joined
    hits = np.flatnonzero(search.accepts[states] != 0)
    bits = search.accepts[states[hits]]
    found: dict[int, list] = {}
    for k, rule in enumerate(rules):
        at = hits[(bits >> np.uint32(k)) & np.uint32(1) == 1]
        last = np.append(at[1:] != at[:-1] + 1, True) if len(at) else np.zeros(0, bool)
        first = at[np.append(True, last[:-1])] if len(at) else at
        at = at[last]
        at = at[at - first + 1 + lead(rule) >= rule.least]  # the others are too short
        value = re.compile(rule.value) if rule.value else None
        doc, free = -1, 0
        for end, d in zip((at + 1).tolist(), (np.searchsorted(bases, at, "right") - 1).tolist(), strict=True):
            if d != doc:
                doc, free, base = d, 0, int(bases[d])
                text = data[offsets[d] : offsets[d + 1]].tobytes()
            end -= base
            start = leftmost_start(backward[k], text, free, end)
            if start < 0:
                continue
            free = end
            if end - start < rule.least or value and len(value.fullmatch(text[start:end].decode("latin-1"))[1]) < rule.value_least:
                continue
            found.setdefault(d, []).append((start, k, end))
    for d, spans in found.items():
        leads = np.concatenate([[0], np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)])
        found[d] = sorted((int(leads[s]), k, int(leads[e])) for s, k, e in spans)
    return found


def secret_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: ``key`` and ``spans``, an array of (kind, start, end) by start, then kind as listed.

    The automata are compiled on the driver and broadcast; their size depends on the rules alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for rows, data, offsets in tb.chunks(batch, "text"):
                found = scan_texts(data, offsets, rules, shared.value)
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in found.get(d, ())] for d in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, kind)], ["key", "spans"])

    source = small_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("key", key)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
