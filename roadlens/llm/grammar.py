"""Re-Pair grammars of symbol sequences, and repair costs by min-plus matrices over their rules."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heappop, heappush

#: Role classes and fault classes; a symbol is 3 * role + fault.
ROLES, FINE, TRUNCATED, GONE = "suax", 0, 1, 2
SYMBOLS = 3 * len(ROLES)
#: What edits cost.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States of what was given so far: nothing, a system turn alone, a user turn last, an assistant turn last.
STATES = range(4)
_USER, _ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}
_NEXT = {"s": {0: 1}, "u": _USER, "a": _ASSISTANT, "x": {}}
_SAID = {**_USER, **_ASSISTANT}
#: Fewest insertions between states.
_FILL = [(p, q, k) for p, row in enumerate([{0: 0, 2: 1, 3: 2}, {1: 0, 2: 1, 3: 2}, {2: 0, 3: 1}, {3: 0, 2: 1}]) for q, k in row.items()]

_PRIME, _BASE = (1 << 61) - 1, 911_382_323
#: A rope is (length, hash, power, left, right), or with text and None in place of its sides.
_EMPTY = (0, 0, 1, "", None)


def leaf(text: str) -> tuple:
    h, p = 0, 1
    for c in text:
        h, p = (h * _BASE + ord(c)) % _PRIME, p * _BASE % _PRIME
    return len(text), h, p, text, None


def joined(a: tuple, b: tuple) -> tuple:
    if not a[0] or not b[0]:
        return a if a[0] else b
    return a[0] + b[0], (a[1] * b[2] + b[1]) % _PRIME, a[2] * b[2] % _PRIME, a, b


def written(rope: tuple) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if x[4] is None:
            out.append(x[3])
        else:
            todo += (x[4], x[3])
    return "".join(out)


def before(a: tuple, b: tuple) -> bool:
    """Whether the text of rope ``a`` is less; equal stretches are passed over by length and hash."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x[0] == y[0] and x[1] == y[1]:
            continue
        if x[4] is not None and (x[0] >= y[0] or y[4] is None):
            left += (x[4], x[3])
            right.append(y)
        elif y[4] is not None:
            right += (y[4], y[3])
            left.append(x)
        else:
            n = min(x[0], y[0])
            if x[3][:n] != y[3][:n]:
                return x[3][:n] < y[3][:n]
            if x[0] > n:
                left.append(leaf(x[3][n:]))
            if y[0] > n:
                right.append(leaf(y[3][n:]))
    return bool(right)


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """Of two (cost, rope), the cheaper, or of equal cost the one whose text is less."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def step(vector: Sequence, matrix: Sequence) -> list:
    """A row of (cost, rope) by state times a matrix of them."""
    out: list = [None] * len(STATES)
    for v, row in zip(vector, matrix, strict=True):
        if v is not None:
            for q, m in enumerate(row):
                if m is not None:
                    out[q] = better(out[q], (v[0] + m[0], joined(v[1], m[1])))
    return out


def terminal(symbol: int) -> list[list]:
    """Insertions, if any, and then one edit of a row of this symbol: (cost, rope) from state to state.

    Strings of one state pair and one cost never are another's beginning, since they have
    the same number of letters other than I, and further I cost more. So the least
    string of a whole is made of least strings of its parts.
    """
    role, fault = ROLES[symbol // 3], symbol % 3
    out = [[None] * len(STATES) for _ in STATES]
    for p, q, k in _FILL:
        edits = [("D", DELETE, q)]
        if fault != GONE:
            more = CUT_OFF * (fault == TRUNCATED)
            edits += [("K", KEEP + more, to) for to in [_NEXT[role].get(q)] if to is not None]
            edits += [("R", REROLE + more, to) for to in [_SAID.get(q)] if to is not None]
        for letter, cost, to in edits:
            out[p][to] = better(out[p][to], (INSERT * k + cost, leaf("I" * k + letter)))
    return out


def re_pair(sequences: list[Sequence[int]], rule) -> list[list[int]]:
    """The sequences with their most frequent pair replaced by ``rule(left, right)``, until no pair occurs twice.

    Positions of each pair are indexed; a heap gives the most frequent one, of
    equal ones the smallest. Each replacement updates its neighbours' pairs only.
    """
    sym: list[int] = [-1]
    starts = []
    for s in sequences:
        starts.append(len(sym))
        sym += [*s, -1]
    nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    where: dict[tuple[int, int], set[int]] = {}
    for i in range(len(sym) - 1):
        if sym[i] >= 0 <= sym[i + 1]:
            where.setdefault((sym[i], sym[i + 1]), set()).add(i)
    heap = [(-len(at), pair) for pair, at in where.items() if len(at) > 1]
    heapify(heap)
    while heap:
        n, pair = heappop(heap)
        now = len(where.get(pair, ()))
        if now != -n:
            if now > 1:
                heappush(heap, (-now, pair))
            continue
        a, b = pair
        made, grown = rule(a, b), set()
        for i in sorted(where.pop(pair)):
            j = nxt[i]
            if sym[i] != a or sym[j] != b:
                continue  # a run's pairs overlap: the earlier one has taken it
            l, r = prv[i], nxt[j]  # noqa: E741
            for at, old in ((l, (sym[l], a)), (j, (b, sym[r]))):
                if old in where:
                    where[old].discard(at)
            sym[i], sym[j] = made, -2
            nxt[i], prv[r] = r, i
            for at, new in ((l, (sym[l], made)), (i, (made, sym[r]))):
                if new[0] >= 0 <= new[1]:
                    where.setdefault(new, set()).add(at)
                    grown.add(new)
        for new in sorted(grown):
            if len(where.get(new, ())) > 1:
                heappush(heap, (-len(where[new]), new))
    out = []
    for i in starts:
        s = []
        while sym[i] >= 0:
            s.append(sym[i])
            i = nxt[i]
        out.append(s)
    return out


class Repairs:
    """Costs and edits of symbol sequences; rules and their matrices are kept for the sequences to come."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.matrix = [terminal(s) for s in range(SYMBOLS)]
        self.rules: dict[tuple[int, int], int] = {}

    def rule(self, a: int, b: int) -> int:
        """The symbol of a pair; its matrix is the product of its two sides' matrices."""
        made = self.rules.get((a, b))
        if made is None:
            made = self.rules[a, b] = len(self.matrix)
            right = self.matrix[b]
            self.matrix.append([step(row, right) for row in self.matrix[a]])
        return made

    def of(self, sequences: list[bytes]) -> list[tuple[int, str]]:
        """(cost, audit) of each sequence of symbols: the cheapest edits, of those the ASCII-least."""
        if len(self.rules) > self.most:
            self.clear()
        distinct = list(dict.fromkeys(sequences))
        found = {}
        for s, short in zip(distinct, re_pair(distinct, self.rule), strict=True):
            vector = [(0, _EMPTY), None, None, None]
            for x in short:
                vector = step(vector, self.matrix[x])
            best = vector[0]
            for p, q, k in _FILL:
                if q == 3 and vector[p] is not None:
                    best = better(best, (vector[p][0] + INSERT * k, joined(vector[p][1], leaf("I" * k))))
            found[s] = best[0], written(best[1])
        return [found[s] for s in sequences]
