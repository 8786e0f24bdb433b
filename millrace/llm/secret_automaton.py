"""Secret scans with one deterministic automaton for all rules.

The rules' regular expressions are compiled by subset construction into one
automaton and minimised into a transition array over byte classes. It reads each
text once, byte by byte from the end, and is in a marked state exactly where some
rule's match starts; the state names the rules. From each such start the rule's
own forward automaton finds the longest end. Per rule, matches are leftmost and
don't overlap; those that are too short are dropped afterwards, as the rules say.

A batch of texts is read in step: it is cut at text ends and at bytes that bring
the automaton to its start state from every state, and all pieces advance
together in numpy. A stretch without such a byte is one piece, however long.

Null texts are empty texts. Offsets are code points, ends exclusive. Repeated
rows are scanned alike; other columns are kept by ``redact`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import share_code


@dataclass(frozen=True)
class Rule:
    """A match is head, then tail; tail or the whole match must have ``least`` characters."""

    kind: str
    head: str
    tail: str
    least: int
    whole: bool
    fold: bool = False  # letters of the head in either case


#: The three base rules, then those that the scan adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, False, True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 18, True),
    Rule("hex", r"", r"[0-9a-f]{16,}", 16, True),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 24, True),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 20, True),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY", r"-----", 5, False),
)
BASE = ("assign", "access", "hex")
_PIECE = 2048
_BYTES_AT_ONCE = 1 << 23
_FEW = 12


# --- regular expressions to automata ----------------------------------------


class _Parser:
    """A byte regex to a tree: ("set", 256-bit mask), ("cat", [..]), ("alt", [..]), ("rep", node, least, most)."""

    def __init__(self, pattern: str, fold: bool) -> None:
        self.s, self.at, self.fold = pattern, 0, fold

    def parse(self):
        node = self.alternatives()
        if self.at != len(self.s):
            raise ValueError(f"unexpected {self.s[self.at]!r} in {self.s!r}")
        return node

    def peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.s[self.at - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated())
        return ("cat", items)

    def repeated(self):
        node = self.single()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                low, _, high = self.s[self.at : self.s.index("}", self.at)].partition(",")
                exact = "," not in self.s[self.at : self.s.index("}", self.at)]
                self.at = self.s.index("}", self.at) + 1
                node = ("rep", node, int(low), int(low) if exact else int(high) if high else None)
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def single(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            return node
        if c == "[":
            return ("set", self.members())
        return ("set", self.mask([self.escaped() if c == "\\" else ord(c)]))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.s[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def members(self) -> int:
        negated = self.peek() == "^"
        self.at += negated
        found: list[int] = []
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.s[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                found.extend(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                found.append(low)
        mask = self.mask(found)
        return ((1 << 256) - 1) ^ mask if negated else mask

    def mask(self, found: list[int]) -> int:
        if self.fold:
            found = [x for b in found for x in ({b, b ^ 32} if chr(b).isascii() and chr(b).isalpha() else {b})]
        return sum(1 << b for b in set(found))


def _reversed(node):
    if node[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    return ("rep", _reversed(node[1]), *node[2:]) if node[0] == "rep" else node


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []  # moves without a byte
        self.on: list[tuple[int, int] | None] = []  # (mask, target)

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.on) - 1

    def add(self, node, start: int) -> int:
        """Build the node from ``start``; its end state."""
        if node[0] == "set":
            end = self.state()
            self.on[start] = (node[1], end)
            return end
        if node[0] == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if node[0] == "alt":
            end = self.state()
            for x in node[1]:
                s = self.state()
                self.free[start].append(s)
                self.free[self.add(x, s)].append(end)
            return end
        _, x, least, most = node
        for _ in range(least):
            start = self._step(x, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            back = self._step(x, loop)
            self.free[back].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self._step(x, start)
            self.free[start].append(end)
        return end

    def _step(self, node, start: int) -> int:
        s = self.state()
        self.free[start].append(s)
        return self.add(node, s)


@dataclass
class Automaton:
    """Transition array over byte classes; ``marks`` has the bit mask of accepted rules by state."""

    classes: np.ndarray  # (256,) byte to class
    moves: np.ndarray  # (states, classes)
    marks: np.ndarray  # (states,)
    start: int


def _close(nfa: _Nfa, states) -> frozenset:
    seen, todo = set(states), list(states)
    while todo:
        for t in nfa.free[todo.pop()]:
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return frozenset(x for x in seen if nfa.on[x] is not None or not nfa.free[x])


def build(nodes: list, searching: bool) -> Automaton:
    """Subset construction over all nodes at once, then minimisation. searching: matches may start anywhere."""
    nfa = _Nfa()
    first, ends = [], {}
    for k, node in enumerate(nodes):
        s = nfa.state()
        first.append(s)
        e = nfa.add(node, s)
        end = nfa.state()
        nfa.free[e].append(end)
        ends[end] = k
    masks = sorted({x[0] for x in nfa.on if x})
    signature = [tuple(m >> b & 1 for m in masks) for b in range(256)]
    kinds = {x: k for k, x in enumerate(dict.fromkeys(signature))}
    classes = np.array([kinds[x] for x in signature])
    example = [signature.index(x) for x in kinds]
    initial = _close(nfa, first)
    number, rows, todo = {initial: 0}, [], [initial]
    while todo:
        now = todo.pop(0)
        row = []
        for b in example:
            to = {nfa.on[x][1] for x in now if nfa.on[x] and nfa.on[x][0] >> b & 1}
            new = _close(nfa, to | set(first) if searching else to)
            if new not in number:
                number[new] = len(number)
                todo.append(new)
            row.append(number[new])
        rows.append(row)
    moves = np.array(rows)
    marks = np.array([sum(1 << ends[x] for x in s if x in ends) for s in number])
    label = np.unique(marks, return_inverse=True)[1]
    while True:  # states stay together while no byte tells them apart
        new = np.unique(np.column_stack([label, label[moves]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == label.max():
            break
        label = new
    one = np.unique(new, return_index=True)[1]
    order = np.argsort(marks[one], kind="stable")  # marked states last
    place = np.empty(len(one), int)
    place[order] = np.arange(len(one))
    return Automaton(classes, place[new[moves[one]]][order], marks[one][order], int(place[new[0]]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        parse = lambda r: _Parser(r.head, r.fold).parse()
        tail = lambda r: _Parser(r.tail, False).parse()
        whole = [("cat", [parse(r), tail(r)]) for r in rules]
        self.search = a = build([_reversed(n) for n in whole], True)
        self.forward = [(build([parse(r)], False), build([tail(r)], False)) for r in rules]
        width = a.moves.shape[1]
        self.table = (a.moves * width).astype(np.int32).ravel()
        self.hit_from = int(np.flatnonzero(a.marks)[0]) * width
        self.mark_of = {k * width: int(m) for k, m in enumerate(a.marks) if m}
        self.first = a.start * width
        self.classes = a.classes.astype(np.uint8)
        resets = (a.moves == a.start).all(axis=0)
        self.reset = resets[a.classes]
        self.slow = self.table.tolist()

    def starts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, rule mask) of every byte of the texts between ``bounds`` at which a match starts."""
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        resets = np.flatnonzero(self.reset[data])
        at = np.searchsorted(resets, np.arange(_PIECE, len(data), _PIECE))
        cuts = np.unique(np.concatenate([bounds, resets[at[at < len(resets)]]]))
        begin, end = cuts[:-1], cuts[1:]
        size = end - begin
        order = np.argsort(-size, kind="stable")
        size, last = size[order], end[order] - 1
        classes = self.classes[data]
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # pieces longer than each step
        state = np.full(len(size), self.first, np.int32)
        where, marks = [], []
        step = 0
        while step < len(active) and active[step] > _FEW:
            n = active[step]
            if n != len(state):
                state, last = state[:n], last[:n]
            state = self.table.take(state + classes.take(last - step))
            hit = state >= self.hit_from
            if hit.any():
                k = np.flatnonzero(hit)
                where.append(last[k] - step)
                marks.append(state[k])
            step += 1
        if step < len(active):
            rest, odd = [], []
            raw = classes.tobytes()
            for piece in range(active[step]):
                s, table, top = int(state[piece]), self.slow, self.hit_from
                begin_at, at = int(last[piece] - size[piece] + 1), int(last[piece] - step)
                for pos in range(at, begin_at - 1, -1):
                    s = table[s + raw[pos]]
                    if s >= top:
                        rest.append(pos)
                        odd.append(s)
            where.append(np.array(rest, np.int64))
            marks.append(np.array(odd, np.int64))
        if not where:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pos, state = np.concatenate(where), np.concatenate(marks)
        order = np.argsort(pos)
        return pos[order], np.array([self.mark_of[int(s)] for s in state[order]], np.int64)

    @staticmethod
    def _longest(a: Automaton, data: bytes, at: int) -> int:
        """End of the longest match at ``at``, or -1."""
        state, end = a.start, at if a.marks[a.start] else -1
        moves, classes = a.moves, a.classes
        for pos in range(at, len(data)):
            state = moves[state, classes[data[pos]]]
            if a.marks[state]:
                end = pos + 1
            elif not (moves[state] != state).any():  # nothing leads on
                break
        return end

    def spans(self, data: bytes, where: list[int], marks: list[int]) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of one text, given its starts."""
        out = []
        for k, rule in enumerate(self.rules):
            head, tail = self.forward[k]
            free = 0
            for s, mark in zip(where, marks):
                if not mark >> k & 1 or s < free:
                    continue
                value = self._longest(head, data, s)
                end = self._longest(tail, data, value)
                free = end
                if end - (s if rule.whole else value) >= rule.least:
                    out.append((s, k, end))
        return sorted(out)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in code points of each text."""
        out: list = [[] for _ in texts]
        raw = [x.encode("utf-8", "surrogatepass") for x in texts]
        at = 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= _BYTES_AT_ONCE):
                size += len(raw[to])
                to += 1
            bounds = np.cumsum([0, *map(len, raw[at:to])])
            pos, marks = self.starts(np.frombuffer(b"".join(raw[at:to]), np.uint8), bounds)
            ends = np.searchsorted(pos, bounds)
            for k in np.flatnonzero(np.diff(ends)):
                a, b, text = ends[k], ends[k + 1], raw[at + k]
                found = self.spans(text, (pos[a:b] - bounds[k]).tolist(), marks[a:b].tolist())
                if found and not texts[at + k].isascii():
                    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    found = [(int(before[s]), r, int(before[e])) for s, r, e in found]
                out[at + k] = found
            at = to
        return out


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def _joined(rules, found) -> str:
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in found)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts by base kind, base_sha256, spans, n_secrets) of every row."""

    def run(batches):
        scan = scanner(rules)
        base = {k for k, r in enumerate(rules) if r.kind in BASE}
        for batch in batches:
            found = scan.scan([x or "" for x in batch.column(1).to_pylist()])
            own = [[x for x in f if x[1] in base] for f in found]
            count = lambda kind: pa.array([sum(rules[x[1]].kind == kind for x in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[count(kind) for kind in BASE],
                    pa.array([hashlib.sha256(_joined(rules, f).encode()).hexdigest() for f in own]),
                    pa.array([_joined(rules, f) for f in found], pa.string()),
                    pa.array([len(f) for f in found], pa.int64()),
                ],
                ["doc_id", *[f"n_{kind}" for kind in BASE], "base_sha256", "spans", "n_secrets"],
            )

    share_code(docs.sparkSession)
    counts = ", ".join(f"n_{kind} long" for kind in BASE)
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {counts}, base_sha256 string, spans string, n_secrets long")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", token: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span, overlapping ones joined, replaced by ``token``; all columns stay, null texts too."""

    def run(batches):
        scan = scanner(rules)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for k, found in enumerate(scan.scan([x or "" for x in texts])):
                if found:
                    out, done = [], 0
                    for s, _, e in found:
                        if s >= done:
                            out += [texts[k][done:s], token]
                        done = max(done, e)
                    texts[k] = "".join([*out, texts[k][done:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    share_code(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def clean_lengths(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """Bring a column of text lengths up to date, where there is one."""
    if length_col not in docs.columns:
        return docs
    return docs.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
