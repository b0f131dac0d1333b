"""Cheapest edits of a conversation's roles: an auction for shortest paths on a small lattice.

A node is a place between rows and what the repaired roles have come to: nothing yet, a system
row, a user row, a closed pair. Arcs are edits with integer costs. Every node has a price; prices
are such that no arc costs less than the difference of the prices at its ends. A path grows from
the origin: at its last node, either some arc costs just that difference and the path is extended
along it, or the node's price is raised to the least that its arcs allow and the path is
contracted by one node. When it reaches the destination, it is a shortest path, and every arc
of every shortest path is tight (costs just the difference). The first of equally cheap edit
strings is found by following tight arcs in the order of their letters.

Long conversations are cut into pieces. A piece is known by the costs between the states at its
two ends and by the order of its edit strings; pieces are joined by the same auction. No edit
string that ends with a piece's last row is the beginning of another such string, so the first
piece in which two strings differ decides their order.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

NOTHING, SYSTEM, USER, PAIR = range(4)
STATES = 4
#: Costs of the edits, and what a kept truncated row adds.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a piece, and pieces joined at once.
PIECE, FAN = 48, 64
FAR = 1 << 50
#: What an insertion or a relabelled row becomes in each state, and the state after it.
WANTED = ("user", "user", "assistant", "user")
AFTER = (USER, USER, PAIR, USER)
#: The state after a kept row of an initial, by state; absent: it can't be kept.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": PAIR}, {"u": USER})
#: Insertions that close what is open at the end of all rows.
CLOSING = ("", "II", "I", "")

Arcs = list[list[tuple[int, int, object]]]  # by node: cost, head, label; labels of a node's arcs order them


def sign(initial: str, forced: bool, truncated: bool) -> str:
    """A row in one character: ``d`` must go; else its initial (``x``: none of s, u, a), upper case if truncated."""
    if forced:
        return "d"
    c = initial if initial in ("s", "u", "a") else "x"
    return c.upper() if truncated else c


def settle(arcs: Arcs, origin: int, destination: int, price: list[int]) -> None:
    """Raise prices until the path from the origin reaches the destination (or can't: ``FAR``)."""
    path = [origin]
    while (at := path[-1]) != destination:
        least, to = FAR, -1
        for cost, head, _ in arcs[at]:
            if cost + price[head] < least:
                least, to = cost + price[head], head
        if least < FAR and least == price[at]:
            path.append(to)
            continue
        price[at] = least
        if at != origin:
            path.pop()
        elif least >= FAR:
            return


def first_tight(arcs: Arcs, origin: int, destination: int, price: list[int]) -> tuple[list[int], list]:
    """Nodes and labels of the path of tight arcs whose labels come first."""
    nodes, labels, dead = [origin], [], set()
    while nodes[-1] != destination:
        at = nodes[-1]
        for cost, head, label in arcs[at]:
            if head not in dead and price[head] < FAR and price[at] == cost + price[head]:
                nodes.append(head)
                labels.append(label)
                break
        else:
            dead.add(at)
            nodes.pop()
            labels.pop()
    return nodes, labels


def _lattice(signs: str, upto: int, open_end: bool) -> tuple[Arcs, list[int]]:
    """Arcs (in the order D, I, K, R) between states 0 to ``upto``, and prices to start from.

    What a row costs at least, whatever the roles, sums to prices that no arc undercuts.
    """
    arcs: Arcs = []
    floor = [0]
    for c in reversed(signs):
        floor.append(floor[-1] + (DELETE if c == "d" else TRUNCATED if c.isupper() else 0))
    for i, c in enumerate(signs):
        here, there, extra = i * STATES, (i + 1) * STATES, TRUNCATED if c.isupper() else 0
        for q in range(STATES):
            own: list[tuple[int, int, object]] = []
            if q <= upto:
                own.append((DELETE, there + q, "D"))
                if upto >= USER:
                    own.append((INSERT, here + AFTER[q], "I"))
                if c != "d":
                    kept = KEPT[q].get(c.lower())
                    if kept is not None and kept <= upto:
                        own.append((extra, there + kept, "K"))
                    if upto >= USER:
                        own.append((RELABEL + extra, there + AFTER[q], "R"))
            arcs.append(own)
    n = len(signs)
    arcs += [[] for _ in range(STATES)]
    price = [floor[n - i] for i in range(n + 1) for _ in range(STATES)]
    if open_end:  # all rows are done: close what is open, then the last node
        sink = (n + 1) * STATES
        for q in range(STATES):
            arcs[n * STATES + q] = [(INSERT, n * STATES + AFTER[q], "I"), *([(0, sink, "")] if q in (NOTHING, PAIR) else [])]
        for q in (NOTHING, PAIR):
            arcs[n * STATES + q].reverse()
        arcs.append([])
        price.append(0)
    return arcs, price


@lru_cache(maxsize=1 << 15)
def solve_short(signs: str) -> tuple[int, str]:
    """Cost and edits of a conversation of few rows."""
    arcs, price = _lattice(signs, PAIR, True)
    settle(arcs, NOTHING, len(arcs) - 1, price)
    return price[NOTHING], "".join(first_tight(arcs, NOTHING, len(arcs) - 1, price)[1])


class Part:
    """A run of rows: costs by state before and after (flat, ``FAR``: impossible), and the strings' order.

    ``order[a * 4 + b]`` tells, for one state ``a`` before, which string comes first.
    """

    __slots__ = ("cost", "order")

    def __init__(self, cost: list[int], order: list[int]):
        self.cost, self.order = cost, order


@lru_cache(maxsize=1 << 12)
def piece(signs: str) -> tuple[Part, list[str | None]]:
    """The part of a few rows, and its edit strings."""
    cost, text = [FAR] * 16, [None] * 16
    end = len(signs) * STATES
    for b in range(STATES):
        upto = PAIR if b >= USER else b
        arcs, price = _lattice(signs, upto, False)
        for q in range(STATES):
            if q != b:
                price[end + q] = FAR
        for a in range(upto + 1):
            settle(arcs, a, end + b, price)
            if price[a] < FAR:
                cost[a * 4 + b] = price[a]
                text[a * 4 + b] = "".join(first_tight(arcs, a, end + b, price)[1])
    return Part(cost, _places(text)), text


def _places(keys: list) -> list[int]:
    """Each string's place among those of its state before."""
    out = [0] * 16
    for a in range(STATES):
        own = sorted((keys[a * 4 + b], b) for b in range(STATES) if keys[a * 4 + b] is not None)
        for place, (_, b) in enumerate(own):
            out[a * 4 + b] = place
    return out


def join(parts: list[Part]) -> tuple[Part, list[list[int] | None]]:
    """One part of consecutive parts, and the states at all their ends for each pair of outer states."""
    arcs: Arcs = []
    floor = [0]
    for p in reversed(parts):
        floor.append(floor[-1] + min(p.cost))
    for k, p in enumerate(parts):
        for a in range(STATES):
            own = sorted((p.order[a * 4 + b], p.cost[a * 4 + b], b) for b in range(STATES) if p.cost[a * 4 + b] < FAR)
            arcs.append([(c, (k + 1) * STATES + b, o) for o, c, b in own])
    n = len(parts)
    arcs += [[] for _ in range(STATES)]
    cost, states, keys = [FAR] * 16, [None] * 16, [None] * 16
    for b in range(STATES):
        price = [floor[n - k] for k in range(n + 1) for _ in range(STATES)]
        for q in range(STATES):
            if q != b:
                price[n * STATES + q] = FAR
        for a in range(STATES):
            settle(arcs, a, n * STATES + b, price)
            if price[a] < FAR:
                nodes, places = first_tight(arcs, a, n * STATES + b, price)
                cost[a * 4 + b], states[a * 4 + b], keys[a * 4 + b] = price[a], [x % STATES for x in nodes], places
    return Part(cost, _places(keys)), states


class Tree:
    """Parts joined in groups, level by level, so that no auction runs over many of them."""

    def __init__(self, parts: list[Part]):
        self.levels: list[list[list[list[int] | None]]] = []
        while len(parts) > 1:
            joined = [join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
            self.levels.append([states for _, states in joined])
            parts = [p for p, _ in joined]
        self.top = parts[0]

    def ends(self, a: int, b: int) -> list[tuple[int, int]]:
        """States before and after each of the first level's parts on the way from ``a`` to ``b``."""
        spans = [(a, b)]
        for level in reversed(self.levels):
            spans = [s for (x, y), states in zip(spans, level) for s in pairwise(states[x * 4 + y])]
        return spans


def pieces(signs: str) -> list[str]:
    return [signs[i : i + PIECE] for i in range(0, len(signs), PIECE)]


def close(part: Part) -> tuple[int, int]:
    """Total cost and last state of all rows together: the cheapest way to end, the first string of equals."""
    total, _, b = min((part.cost[b] + INSERT * len(CLOSING[b]), part.order[b], b) for b in range(STATES) if part.cost[b] < FAR)
    return total, b


def trace(signs: str, a: int, b: int) -> str:
    """Edits of rows between two known states."""
    own = pieces(signs)
    spans = Tree([piece(s)[0] for s in own]).ends(a, b)
    return "".join(piece(s)[1][x * 4 + y] for s, (x, y) in zip(own, spans))


def part_of(signs: str) -> Part:
    return Tree([piece(s)[0] for s in pieces(signs)]).top


def solve(signs: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    if len(signs) <= PIECE:
        return solve_short(signs)
    cost, b = close(part_of(signs))
    return cost, trace(signs, NOTHING, b) + CLOSING[b]
