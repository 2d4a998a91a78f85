"""Regular expressions compiled to one deterministic automaton over bytes.

The rules' regexes become one NFA, which subset construction makes
deterministic and partition refinement minimises; the result is a transition
array. ``Automaton.scan`` steps many byte segments at once with numpy: each
byte of the input is read once, for all rules together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ACCEPT = 1


class _Parser:
    """The regex subset the rules use: literals, ``\\xHH``, escapes, classes, groups, ``(?i:``, ``|``, ``? * + {n} {n,m} {n,}``."""

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def parse(self, fold: bool = False):
        parts = [self.branch(fold)]
        while self.peek() == "|":
            self.take()
            parts.append(self.branch(fold))
        return ("or", parts)

    def branch(self, fold: bool):
        items = []
        while self.peek() not in ("", "|", ")"):
            item = self.atom(fold)
            while self.peek() in ("?", "*", "+", "{"):
                item = self.repeat(item)
            items.append(item)
        return ("seq", items)

    def repeat(self, item):
        c = self.take()
        if c != "{":
            return ("rep", item, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        end = self.s.index("}", self.i)
        low, _, high = self.s[self.i : end].partition(",")
        top = int(high) if high else None if "," in self.s[self.i : end] else int(low)
        self.i = end + 1
        return ("rep", item, int(low), top)

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            inner = fold
            if self.peek() == "?":
                flags = self.s[self.i : self.s.index(":", self.i) + 1]
                self.i += len(flags)
                inner = fold or "i" in flags
            node = self.parse(inner)
            self.take()
            return node
        if c == "[":
            return ("set", self.klass(fold))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded({self.escaped() if c == "\\" else ord(c)}, fold))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def klass(self, fold: bool) -> frozenset:
        negated = self.peek() == "^" and bool(self.take())
        out: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            a = b = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                c = self.take()
                b = self.escaped() if c == "\\" else ord(c)
            out |= set(range(a, b + 1))
        self.take()
        got = self.folded(out, fold)
        return frozenset(range(256)) - got if negated else got

    @staticmethod
    def folded(codes: set[int], fold: bool) -> frozenset:
        if fold:
            codes = {x for c in codes for x in (c, ord(chr(c).lower()), ord(chr(c).upper())) if x < 128}
        return frozenset(codes)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.on: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append(None)
        return len(self.on) - 1

    def add(self, node, start: int) -> int:
        """Build ``node`` from ``start``; its end state."""
        kind = node[0]
        if kind == "set":
            end, mid = self.state(), self.state()
            self.empty[start].append(mid)
            self.on[mid] = (node[1], end)
            return end
        if kind == "seq":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(x, first)].append(end)
            return end
        _, item, low, high = node
        for _ in range(low):
            start = self.add(item, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(item, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(item, start)
        self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """``step[state * classes + klass[byte]]`` is the next state; 0 starts and 1 has found a match."""

    step: np.ndarray
    klass: np.ndarray
    classes: int
    #: Bytes that lead back to the start from every state: no match reaches over them.
    resets: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step) // self.classes

    def scan(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the segments of ``data`` hold a match of any rule; reads each byte once."""
        order = np.argsort(start - end, kind="stable")  # longest first
        first, size = start[order], (end - start)[order]
        codes = self.klass[data]
        state = np.zeros(len(order), np.int32)
        live = len(order)
        sizes = np.sort(size)
        for t in range(int(size[0]) if len(size) else 0):
            live = len(sizes) - int(np.searchsorted(sizes, t, "right"))
            s = state[:live]
            state[:live] = self.step[s * self.classes + codes[first[:live] + t]]
        found = np.empty(len(order), bool)
        found[order] = state == ACCEPT
        return found


def compile_rules(regexes: list[str]) -> Automaton:
    """One automaton that finds whether a text holds a match of any of ``regexes``."""
    nfa = _Nfa()
    start = nfa.state()
    ends = []
    for r in regexes:
        first = nfa.state()
        nfa.empty[start].append(first)
        ends.append(nfa.add(_Parser(r).parse(), first))
    accept = frozenset(ends)
    sets = sorted({x[0] for x in nfa.on if x}, key=sorted)
    member = np.array([[b in s for s in sets] for b in range(256)])
    _, sample, klass = np.unique(member, axis=0, return_index=True, return_inverse=True)
    klass = klass.reshape(-1)

    def close(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.on[x] or x in accept)

    closed = [close([s]) for s in range(len(nfa.on))]
    origin = closed[start]
    # Subset construction; every set with an accepting state is the one found state.
    number, todo, rows = {origin: 0}, [origin], {0: None, ACCEPT: [ACCEPT] * len(sample)}
    count = 2
    while todo:
        here = todo.pop()
        moves = [nfa.on[s] for s in here]
        row = []
        for b in sample:
            there = set(origin)  # a match may begin anywhere
            for on in moves:
                if int(b) in on[0]:
                    there |= closed[on[1]]
            if there & accept:
                row.append(ACCEPT)
                continue
            key = frozenset(there)
            if key not in number:
                number[key] = count
                count += 1
                todo.append(key)
            row.append(number[key])
        rows[number[here]] = row
    table = np.array([rows[i] for i in range(count)])
    # Minimisation: refine {found}, {others} until successors agree.
    part = np.zeros(count, np.int64)
    part[ACCEPT] = 1
    while True:
        _, new = np.unique(np.concatenate([part[:, None], part[table]], 1), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == part.max():
            break
        part = new
    name = np.full(part.max() + 1, -1)
    name[part[0]], name[part[ACCEPT]] = 0, ACCEPT
    rest = [p for p in range(len(name)) if name[p] < 0]
    name[rest] = np.arange(2, 2 + len(rest))
    small = np.zeros((len(name), table.shape[1]), np.int32)
    small[name[part]] = name[part[table]]
    back = (np.delete(small, ACCEPT, 0) == 0).all(0)
    return Automaton(small.reshape(-1), klass.astype(np.int32), table.shape[1], back[klass])
