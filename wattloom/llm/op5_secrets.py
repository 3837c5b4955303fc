"""Secret scans by one combined deterministic automaton.

Each rule is a small regular language over bytes. All rules are put in one nondeterministic automaton that may start a
match at any byte; subset construction and minimisation turn it into a transition array, and one pass over the bytes
of a text reports where some rule has just been matched. The ends are few; for each, the rule's reversed automaton
gives the leftmost start and its own forward automaton the longest end. Spans of a rule do not overlap: a span that is
too short to be a secret still uses up its text, as a regular-expression search would. After a span the rule's own
automaton, begun anew at the end of the span, says which further ends count; it and the way back read each byte at most
once, so the time is linear in the text.

Null and empty texts give no spans. Whole texts are scanned, whatever their length, and rows are independent of each
other: repeated rows give repeated results, an empty table an empty one, and further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wattloom.llm.common import read

# --- rules ---------------------------------------------------------------------------------------------------------

ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
UPPER_NUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
HEX = frozenset(b"0123456789abcdef")


def lit(text: str, any_case: bool = False) -> tuple:
    sets = [frozenset({ord(c.lower()), ord(c.upper())} if any_case else {ord(c)}) for c in text]
    return ("seq", *[("set", s) for s in sets])


def one(chars: str | frozenset) -> tuple:
    return ("set", frozenset(chars.encode()) if isinstance(chars, str) else chars)


def seq(*parts: tuple) -> tuple:
    return ("seq", *parts)


def alt(*parts: tuple) -> tuple:
    return ("alt", *parts)


def opt(part: tuple) -> tuple:
    return ("alt", part, ("seq",))


def star(part: tuple) -> tuple:
    return ("star", part)


def plus(part: tuple) -> tuple:
    return ("seq", part, ("star", part))


def at_least(n: int, part: tuple) -> tuple:
    return ("seq", *[part] * n, ("star", part))


@dataclass(frozen=True)
class Rule:
    """A pattern; a span counts if it has ``least`` characters, not counting those that ``head`` matches before them."""

    name: str
    pattern: tuple
    least: int = 1
    head: tuple | None = None


VALUE = ALNUM | frozenset(b"+/_.=-")
URL64 = ALNUM | frozenset(b"_-")
QUOTE = opt(one("\"'"))
NAMED = seq(alt(*[lit(w, True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]), QUOTE, star(one(" ")), one(":="), star(one(" ")), QUOTE)

#: The base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", seq(NAMED, plus(one(VALUE))), 12, NAMED),
    Rule("access", seq(lit("AKIA"), plus(one(UPPER_NUM))), 18),
    Rule("hex", at_least(16, one(HEX)), 16),
)
#: Formats beyond the base kinds.
MORE_RULES = (
    Rule("pem", seq(lit("-----BEGIN "), star(seq(plus(one(UPPER_NUM)), one(" "))), lit("PRIVATE KEY-----"))),
    Rule("jwt", seq(lit("eyJ"), plus(one(URL64)), one("."), plus(one(URL64)), one("."), plus(one(URL64))), 40),
    Rule("forge", seq(lit("gh"), one("pousr"), one("_"), plus(one(ALNUM))), 24),
    Rule("chat", seq(lit("xox"), one("abprs"), one("-"), plus(one(ALNUM | frozenset(b"-")))), 20),
)
RULES = BASE_RULES + MORE_RULES

# --- automata ------------------------------------------------------------------------------------------------------


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node: tuple, start: int, backwards: bool) -> int:
        """Put ``node`` after ``start``; the state in which it has been read."""
        kind, *parts = node
        if kind == "set":
            end = self.state()
            self.moves[start].append((parts[0], end))
            return end
        if kind == "seq":
            for part in reversed(parts) if backwards else parts:
                start = self.add(part, start, backwards)
            return start
        if kind == "alt":
            end = self.state()
            for part in parts:
                self.empty[self.add(part, start_of := self.state(), backwards)].append(end)
                self.empty[start].append(start_of)
            return end
        hub = self.state()
        self.empty[start].append(hub)
        self.empty[self.add(parts[0], hub, backwards)].append(hub)
        return hub

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """next[state][byte]; accepts[state] is a bit mask of rules. State 0 is the start, and the dead one is ``dead``."""

    next: list[tuple[int, ...]]
    accepts: list[int]
    dead: int


def determinise(rules: tuple[Rule, ...], anywhere: bool, backwards: bool = False) -> Automaton:
    """Subset construction over byte classes, then partition refinement to the least automaton."""
    nfa = _Nfa()
    first = nfa.state()
    ends = {}
    for k, rule in enumerate(rules):
        start = nfa.state()
        nfa.empty[first].append(start)
        ends[nfa.add(rule.pattern, start, backwards)] = 1 << k
    # bytes that no set tells apart share a class
    sets = list({s for row in nfa.moves for s, _ in row})
    signature: dict[tuple, int] = {}
    classes = [signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)]
    sample = [classes.index(c) for c in range(len(signature))]
    begin = nfa.closure({first})
    index, todo, table = {begin: 0}, [begin], []
    while todo:
        here, row = todo.pop(0), []
        for byte in sample:
            there = {t for s in here for chars, t in nfa.moves[s] if byte in chars}
            reached = nfa.closure(there | {first} if anywhere else there)
            if reached not in index:
                index[reached] = len(index)
                todo.append(reached)
            row.append(index[reached])
        table.append(row)
    moves = np.array(table)
    accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in index])
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        refined = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)[1].ravel()
        if refined.max() == part.max():
            break
        part = refined
    order: dict[int, int] = {}
    for x in part:  # states in order of first appearance, so that the start is 0
        order.setdefault(int(x), len(order))
    rows: list = [None] * len(order)
    masks = [0] * len(order)
    for s, x in enumerate(part):
        k = order[int(x)]
        if rows[k] is None:
            per_class = [order[int(part[t])] for t in moves[s]]
            rows[k] = tuple(per_class[c] for c in classes)
            masks[k] = int(accepts[s])
    dead = next((k for k, row in enumerate(rows) if not masks[k] and set(row) == {k}), -1)
    return Automaton(rows, masks, dead)


@cache
def combined(rules: tuple[Rule, ...] = RULES) -> tuple[np.ndarray, list[int]]:
    """The combined automaton's transition array (states, 256), and the rules that end in each state as a bit mask."""
    machine = determinise(rules, anywhere=True)
    return np.array(machine.next, np.uint16 if len(machine.next) < 1 << 16 else np.uint32), machine.accepts


class Scanner:
    """The combined automaton of ``rules`` with the two small ones of each rule."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, table: tuple[np.ndarray, list[int]] | None = None) -> None:
        """table: ``combined(rules)``, if it is known already."""
        self.rules = rules
        moves, masks = table or combined(rules)
        self.forward = [determinise((r,), anywhere=False) for r in rules]
        self.head = [r.head and determinise((Rule("", r.head),), anywhere=False) for r in rules]
        self.back = [determinise((r,), anywhere=False, backwards=True) for r in rules]
        self.again = [determinise((r,), anywhere=True) for r in rules]
        # a state is its own row of 256 rows; item 256 holds the mask of rules that end there
        linked: list[list] = [[None] * 257 for _ in masks]
        for row, there, mask in zip(linked, moves, masks, strict=True):
            row[:256] = [linked[t] for t in there.tolist()]
            row[256] = mask
        self.start = linked[0]

    @staticmethod
    def _furthest(machine: Automaton, data: bytes, path: range) -> int | None:
        """How many bytes of ``path`` the longest word of the machine takes."""
        state, best = 0, None
        for n, i in enumerate(path, 1):
            state = machine.next[state][data[i]]
            if state == machine.dead:
                break
            if machine.accepts[state]:
                best = n
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then rule, before lengths are looked at."""
        found, row, done = [], self.start, [0] * len(self.rules)
        state, read = [0] * len(self.rules), [0] * len(self.rules)  # of the rule's own automaton, since its last span
        for at, byte in enumerate(data):
            row = row[byte]
            if row[256]:
                mask, k = row[256], 0
                while mask:
                    if mask & 1 and at >= done[k]:
                        if done[k]:
                            own, s = self.again[k], state[k]
                            for i in range(read[k], at + 1):
                                s = own.next[s][data[i]]
                            state[k], read[k] = s, at + 1
                        if not done[k] or own.accepts[s]:
                            start = at + 1 - self._furthest(self.back[k], data, range(at, done[k] - 1, -1))
                            end = start + self._furthest(self.forward[k], data, range(start, len(data)))
                            done[k] = read[k] = end
                            state[k] = 0
                            found.append((start, k, end))
                    mask >>= 1
                    k += 1
        return sorted(found)

    def secrets(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) of what is long enough, in code points, by start and then kind."""
        out, seen, points = [], 0, 0
        for start, k, end in self.scan(data):
            rule = self.rules[k]
            size = end - start
            if rule.head:
                size -= self._furthest(self.head[k], data, range(start, end))
            if size >= rule.least:
                points += _code_points(data, seen, start)
                seen = start
                out.append((rule.name, points, points + end - start))  # the rules match ASCII only
        return out


def _code_points(data: bytes, start: int, end: int) -> int:
    return len(data[start:end].decode("utf-8", "replace"))


_scanners: list[Scanner] = []


def scanner(table: tuple[np.ndarray, list[int]] | None = None) -> Scanner:
    """This process's scanner, made once; tasks are sent the transition array."""
    if not _scanners:
        _scanners.append(Scanner(table=table))
    return _scanners[0]


# --- Spark ---------------------------------------------------------------------------------------------------------


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of each row and ``secrets``: array<struct<kind,start,stop>> of code-point spans."""
    keep = ["doc_id"] if keep is None else keep
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += (", " if schema else "") + "secrets array<struct<kind:string,start:bigint,stop:bigint>>"
    table = docs.sparkSession.sparkContext.broadcast(combined())
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(table.value).secrets
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = [
                [{"kind": k, "start": s, "stop": e} for k, s, e in find(x.as_buffer().to_pybytes())] if x.is_valid else []
                for x in texts.cast(pa.large_binary())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, spans)], names=[*keep, "secrets"])

    return docs.select(*[f"`{c}`" for c in keep], docs[text].alias("__text")).mapInArrow(scan, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in brackets; clean rows stay as they are."""
    place = docs.columns.index(text)
    table = docs.sparkSession.sparkContext.broadcast(combined())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(table.value).secrets
        for batch in batches:
            values = batch.column(place)
            out = values.to_pylist()
            for i, value in enumerate(out):
                if value and (spans := find(value.encode())):
                    parts, done = [], 0
                    for kind, start, end in spans:
                        if end > done:  # spans of different kinds may overlap
                            if start >= done:
                                parts += [value[done:start], f"[{kind}]"]
                            done = end
                    out[i] = "".join(parts) + value[done:]
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, values.type))

    return docs.mapInArrow(scan, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document, derived from ``find_secrets``."""
    found = find_secrets(read(spark, sf_dir, "documents"))

    return found.selectExpr(
        "doc_id",
        "cast(size(filter(secrets, s -> s.kind = 'assign')) as bigint) as n_assign",
        "cast(size(filter(secrets, s -> s.kind = 'access')) as bigint) as n_access",
        "cast(size(filter(secrets, s -> s.kind = 'hex')) as bigint) as n_hex",
        "sha2(array_join(transform(filter(secrets, s -> s.kind in ('assign', 'access', 'hex')), s -> concat_ws(':', s.kind, s.start, s.stop)), ','), 256) as base_sha256",
        "array_join(transform(secrets, s -> concat_ws(':', s.kind, s.start, s.stop)), ',') as spans",
    )
