"""Regular expressions over bytes as minimal deterministic automata in transition arrays.

The dialect: literals, escapes (\\d \\w \\s \\xHH and punctuation), classes, groups, alternation, ? * + {m} {m,} {m,n}.
Letters may be folded. Several expressions become one automaton whose states carry the set of those that accept.
"""

from __future__ import annotations

from array import array
from collections import defaultdict

_CLASSES = {
    "d": frozenset(range(48, 58)),
    "s": frozenset(b" \t\n\r\f\v"),
    "w": frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"),
}
_NAMED = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}
ALL = frozenset(range(256))


class _Parser:
    """Recursive descent to trees: ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, least, most or None)."""

    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                part = ("rep", part, int(low), int(high) if high else None if comma else int(low))
            else:
                part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
        return part

    def escape(self) -> frozenset:
        c = self.take()
        if c == "x":
            self.i += 2
            return frozenset([int(self.s[self.i - 2 : self.i], 16)])
        if c in _CLASSES:
            return _CLASSES[c]
        if c.isalpha() and c not in _NAMED:
            raise ValueError(f"unknown escape \\{c}")
        return frozenset([_NAMED.get(c, ord(c))])

    def folded(self, chars: frozenset) -> frozenset:
        if not self.fold:
            return chars
        return chars | {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            part = self.alternatives()
            if not self.peek():
                raise ValueError("missing )")
            self.take()
            return part
        if c == "[":
            return ("set", self.klass())
        if c == "\\":
            return ("set", self.folded(self.escape()))
        if c == ".":
            return ("set", ALL - {10})
        if ord(c) > 127 or c in "^$?*+{)":
            raise ValueError(f"not in this dialect: {c}")
        return ("set", self.folded(frozenset([ord(c)])))

    def klass(self) -> frozenset:
        negated = self.peek() == "^"
        self.i += negated
        chars: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escape() if c == "\\" else frozenset([ord(c)])
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else frozenset([ord(c)])
                chars |= set(range(min(low), max(high) + 1))
            else:
                chars |= low
        out = self.folded(frozenset(chars))
        return ALL - out if negated else out


def parse(pattern: str, fold: bool = False):
    p = _Parser(pattern, fold)
    tree = p.alternatives()
    if p.peek():
        raise ValueError(f"unexpected {p.peek()} in {pattern}")
    return tree


def reverse(tree):
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(rest[0]), *rest[1:])
    return (kind, [reverse(x) for x in (rest[0][::-1] if kind == "cat" else rest[0])])


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """The state in which a match of tree that began in start ends."""
        kind, *rest = tree
        if kind == "set":
            own, end = self.state(), self.state()
            self.empty[start].append(own)
            self.moves[own] = (rest[0], end)
            return end
        if kind == "cat":
            for part in rest[0]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in rest[0]:
                self.empty[self.add(part, start)].append(end)
            return end
        part, least, most = rest
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        if most is None:
            self.empty[start].append(end)
            into = self.state()
            self.empty[end].append(into)
            self.empty[self.add(part, into)].append(end)
            return end
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end


class Dfa:
    """next[256 * state + byte]: 256 * the next state; states from first_accepting * 256 on accept; accepts[state]: which expressions."""

    def __init__(self, trees: list, unanchored: bool = False):
        nfa, root = _Nfa(), None
        root = nfa.state()
        if unanchored:
            nfa.moves[root] = (ALL, root)
        ends = {}
        for k, tree in enumerate(trees):
            own = nfa.state()
            nfa.empty[root].append(own)
            ends[nfa.add(tree, own)] = k
        table, accepts = self._subsets(nfa, root, ends)
        self._arrays(*self._minimal(table, accepts))

    @staticmethod
    def _subsets(nfa: _Nfa, root: int, ends: dict[int, int]):
        def closed(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(x for x in seen if nfa.moves[x] or x in ends)

        # bytes that no set tells apart share a column
        masks = {m[0] for m in nfa.moves if m}
        kinds: dict[tuple, list[int]] = defaultdict(list)
        for b in range(256):
            kinds[tuple(b in m for m in masks)].append(b)
        columns = list(kinds.values())
        first = closed([root])
        index, todo, table, accepts = {first: 0}, [first], [], []
        while todo:
            now = todo.pop(0)
            row = [0] * 256
            for bytes_ in columns:
                then = closed({nfa.moves[x][1] for x in now if nfa.moves[x] and bytes_[0] in nfa.moves[x][0]})
                if then not in index:
                    index[then] = len(index)
                    todo.append(then)
                for b in bytes_:
                    row[b] = index[then]
            table.append(row)
            accepts.append(frozenset(ends[x] for x in now if x in ends))
        return table, accepts

    @staticmethod
    def _minimal(table: list[list[int]], accepts: list[frozenset]):
        """Moore's refinement: states are split by what they accept, then by where they lead, until nothing changes."""
        kinds = {a: k for k, a in enumerate(dict.fromkeys(accepts))}
        block = [kinds[a] for a in accepts]
        while True:
            seen: dict[tuple, int] = {}
            then = [seen.setdefault((block[s], *[block[x] for x in table[s]]), len(seen)) for s in range(len(table))]
            if len(seen) == len(set(block)):
                break
            block = then
        members: dict[int, int] = {}
        for s, b in enumerate(block):
            members.setdefault(b, s)
        order = sorted(members, key=lambda b: (bool(accepts[members[b]]), members[b]))
        place = {b: k for k, b in enumerate(order)}
        return [[place[block[x]] for x in table[members[b]]] for b in order], [accepts[members[b]] for b in order], place[block[0]]

    def _arrays(self, table: list[list[int]], accepts: list[frozenset], start: int) -> None:
        self.start, self.accepts = start * 256, accepts
        self.first_accepting = next((k for k, a in enumerate(accepts) if a), len(accepts)) * 256
        shared = [256 * k for k in range(len(table))]
        self.next = [shared[x] for row in table for x in row]
        self.dead = next((256 * k for k, row in enumerate(table) if not accepts[k] and all(x == k for x in row)), -1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"next": array("l", self.next)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        shared = {x: x for x in range(0, len(self.next), 256)}
        self.next = [shared[x] for x in self.next]

    def found(self, data: bytes) -> set[int]:
        """The expressions that accept somewhere, in one pass over all bytes."""
        table, limit, state, at = self.next, self.first_accepting, self.start, set()
        for b in data:
            state = table[state + b]
            if state >= limit:
                at.add(state)
        return {k for s in at for k in self.accepts[s >> 8]}

    def ends(self, data: bytes) -> list[int]:
        """Positions after which it accepts."""
        table, limit, state, out = self.next, self.first_accepting, self.start, []
        for i, b in enumerate(data, 1):
            state = table[state + b]
            if state >= limit:
                out.append(i)
        return out

    def longest(self, data: bytes, start: int) -> int:
        """Where the longest match from start ends; -1: none."""
        table, limit, state, best = self.next, self.first_accepting, self.start, -1
        if state >= limit:
            best = start
        for i in range(start, len(data)):
            state = table[state + data[i]]
            if state >= limit:
                best = i + 1
            elif state == self.dead:
                break
        return best
