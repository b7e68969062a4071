"""Exact search for the cheapest decisions about the pairs of one component.

Pairs are numbered. A pair that becomes
present takes all above it along, one that goes takes all below it, so a state is two
sets, what is decided to be present and to be absent, and all else stays as it is. What is
above or below a pair lies on one protein, so all sets are listed by their members, and
nothing is as long as the component for each pair or state.
Violated then are pairs without something above them, and groups with exactly one
present member, which must go or be joined by another member.

Every violation must pay for one of its options. The cost of a pair that
several violations' options hold is shared out between these: in sweeps, each
takes what the others leave, and gives back what its cheapest option does not
need. What the cheapest options cost in shares, added up over all violations,
is a lower bound, and states are looked at in order of it. A state branches on the
dearest pair that cheapest options of several violations share; where none is left, these
don't depend on each other. The best complete assignment so far is kept, so that the
search may be ended at any time with a value and a bound.

Before any search, ``settle`` finds in whole arrays what is absent anyway (``absent``); what is left
falls into small parts, of which only those with a violation are searched.
"""

from __future__ import annotations

import heapq
import math
import time
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Sweeps before the first state, and before each later one.
FIRST_SWEEPS, SWEEPS = 30, 4
#: Every so many states, a whole assignment is tried from the state.
DIVES = 16
#: Shares that states may keep for their children; beyond, children begin with the shares of the state looked at before.
KEPT = 1_000_000
#: Levels above a pair that are added up for it; with more, less is found absent beforehand.
PASSES = 64

NONE: frozenset[int] = frozenset()


def closures(n: int, rules: list[tuple[int, int]]) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """(above, below): for each pair itself and what rules reach from it, or that reach it, in order."""
    up: dict[int, list[int]] = {}
    for a, b in rules:
        up.setdefault(a, []).append(b)
    above: list[tuple[int, ...]] = []
    under: dict[int, list[int]] = {}
    for x in range(n):
        todo, seen = [x], {x}
        while todo:
            for y in up.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        above.append(tuple(sorted(seen)))
        if len(seen) > 1:
            for y in seen:
                if y != x:
                    under.setdefault(y, []).append(x)
    return above, [tuple(sorted([x, *under.pop(x)])) if x in under else (x,) for x in range(n)]


@dataclass
class Found:
    present: list[bool]
    value: int
    bound: int
    status: str


class Component:
    """``has`` and ``cost`` of each pair, ``rules`` (a, b): a needs b, and ``groups`` that may not have one member."""

    def __init__(self, has: list[bool], cost: list[int], rules: list[tuple[int, int]], groups: list[list[int]]):
        self.n, self.cost = len(has), cost
        self.has = frozenset(i for i, h in enumerate(has) if h)
        self.above, self.below = closures(self.n, rules)
        self.groups = [sorted(g) for g in groups]
        self.on = [frozenset(x for x in g if x in self.has) for g in self.groups]
        self.inside: dict[int, list[int]] = {}
        for g, members in enumerate(self.groups):
            for x in members:
                self.inside.setdefault(x, []).append(g)
        # only pairs that lack something from the start can lack it when nothing about them is decided
        self.torn = [x for x in sorted(self.has) if not self.has.issuperset(self.above[x])]

    def price(self, pairs: Iterable[int]) -> int:
        return sum(self.cost[x] for x in pairs)

    def lacks(self, pairs: Iterable[int], yes: frozenset[int]) -> tuple[int, ...]:
        """Those of these pairs that are not there and not decided to be, in order."""
        return tuple(sorted(x for x in pairs if x not in self.has and x not in yes))

    def loses(self, on: int, no: frozenset[int]) -> tuple[int, ...]:
        """What goes with a pair and is not decided to, in order."""
        return tuple(x for x in self.below[on] if x in self.has and x not in no)

    def options(self, g: int, on: int, yes: frozenset[int], no: frozenset[int]) -> list[tuple[int, tuple[int, ...]]]:
        """(first member to join or -1, pairs that change): how a group with ``on`` alone can be mended."""
        out = []
        if yes.isdisjoint(self.below[on]):
            out.append((-1, self.loses(on, no)))
        if no.isdisjoint(self.above[on]):
            own = self.lacks(self.above[on], yes)
            out += [(x, self.lacks({*self.above[x], *own} if own else self.above[x], yes)) for x in self.groups[g] if x != on and no.isdisjoint(self.above[x])]
        return out

    def alone(self, yes: frozenset[int], no: frozenset[int]) -> dict[int, int]:
        """Groups with exactly one present member, in order, and that member."""
        now = {}
        for x in yes | no:
            for g in self.inside.get(x, ()):
                now.setdefault(g, set(self.on[g]))
        for g, members in now.items():
            members.update(x for x in self.groups[g] if x in yes)
            members.difference_update([x for x in members if x in no])
        ones = ((g, now.get(g, on)) for g, on in enumerate(self.on))
        return {g: next(iter(on)) for g, on in ones if len(on) == 1}

    def share_out(self, open_: dict[int, list[tuple[int, tuple[int, ...]]]], before: dict[int, dict[int, float]], sweeps: int) -> tuple[dict[int, dict[int, float]], dict[int, int]]:
        """Shares of the pairs' costs for groups with these options, from those ``before``; and how many groups use each pair."""
        lists = {g: [m for _, m in o] for g, o in open_.items()}
        users: dict[int, int] = {}
        inside = {g: {x for m in o for x in m} for g, o in lists.items()}
        for xs in inside.values():
            for x in xs:
                users[x] = users.get(x, 0) + 1
        left = {x: float(self.cost[x]) for x in users}
        shares = {}
        for g, xs in inside.items():
            old = before.get(g)
            shares[g] = {x: min(left[x], self.cost[x] if users[x] == 1 else old.get(x, 0.0) if old else self.cost[x] / users[x]) for x in xs}
            for x in xs:
                left[x] = max(0.0, left[x] - shares[g][x])
        for _ in range(sweeps if len(lists) > 1 else 0):
            for g, o in lists.items():
                mine = shares[g]
                common = [x for x in mine if users[x] > 1]
                for x in common:
                    mine[x] += left[x]
                    left[x] = 0.0
                worth = [sum(mine[x] for x in m) for m in o]
                least = min(worth)
                held: dict[int, list[int]] = {x: [] for x in common}
                for i, m in enumerate(o):
                    for x in m:
                        if x in held:
                            held[x].append(i)
                for x, where in held.items():
                    give = min(mine[x], min(worth[i] for i in where) - least)
                    if give > 0:
                        mine[x] -= give
                        left[x] += give
                        for i in where:
                            worth[i] -= give
        return shares, users

    def violated(self, yes: frozenset[int], no: frozenset[int]) -> tuple[dict[int, list[tuple[int, tuple[int, ...]]]], dict[int, int]] | None:
        """(options, member) of each group on one member and (below zero) of each pair that lacks something above it; None if one can't be mended."""
        there = lambda x: (x in self.has or x in yes) and x not in no
        open_, member = {}, {}
        for x in self.torn:
            if there(x) and not all(map(there, self.above[x])):
                out = [(-1, self.loses(x, no))] if yes.isdisjoint(self.below[x]) else []
                if no.isdisjoint(self.above[x]):
                    out.append((x, self.lacks(self.above[x], yes)))
                open_[-1 - x], member[-1 - x] = out, x
        for g, on in self.alone(yes, no).items():
            open_[g], member[g] = self.options(g, on, yes, no), on
        return (open_, member) if all(open_.values()) else None

    def dive(self, yes: frozenset[int], no: frozenset[int], spent: int) -> tuple[int, frozenset[int], frozenset[int]] | None:
        """(cost, yes, no) of an assignment: the group that loses most by waiting takes its cheapest option, again and again."""
        while True:
            seen = self.violated(yes, no)
            if seen is None:
                return None
            open_, member = seen
            if open_:
                priced = {g: sorted((self.price(m), x) for x, m in o) for g, o in open_.items()}
                g = max(priced, key=lambda g: (priced[g][1][0] - priced[g][0][0] if len(priced[g]) > 1 else math.inf, -g))
                x, on = priced[g][0][1], member[g]
                yes, no, add = self.step(yes, no, NONE, self.below[on]) if x < 0 else self.step(yes, no, {*self.above[on], *self.above[x]}, NONE)
            else:
                return spent, yes, no
            spent += add

    def step(self, yes: frozenset[int], no: frozenset[int], more: Iterable[int], less: Iterable[int]) -> tuple[frozenset[int], frozenset[int], int]:
        add = self.price(x for x in more if x not in yes and x not in self.has) + self.price(x for x in less if x not in no and x in self.has)
        return yes.union(more), no.union(less), add

    def solve(self, seconds: float | None = None, states: int | None = None) -> Found:
        """The cheapest assignment; the best so far, where a limit of time or of states (none by default) ends the search."""
        end = None if seconds is None else time.monotonic() + seconds
        order = lambda found: (found[0], *(sorted(x, reverse=True) for x in found[1:]))
        best = (self.price(self.has), NONE, frozenset(range(self.n)))  # without any pair nothing is violated
        # a state is what its parent decided and what it adds; sets and shares of a parent are there once
        heap: list[tuple] = [(0, 0, 0, NONE, NONE, NONE, NONE, {})]
        count, looked, bound, kept, latest = 0, -1, 0, 0, {}
        while heap:
            low, _, spent, yes, no, more, less, shares = heapq.heappop(heap)
            bound = min(low, best[0])
            if low >= best[0]:
                break
            if (end is not None and time.monotonic() > end) or (states is not None and looked >= states):
                break
            yes, no = yes.union(more), no.union(less)
            seen = self.violated(yes, no)
            if seen is None:
                continue
            open_, member = seen
            looked += 1
            latest, users = self.share_out(open_, latest if shares is None else shares, FIRST_SWEEPS if not count else SWEEPS)
            kept += sum(map(len, latest.values()))
            worth = {g: min(sum(latest[g].get(x, 0.0) for x in m) for _, m in o) for g, o in open_.items()}
            shares = latest if kept <= KEPT else None
            low = max(low, spent + math.ceil(sum(worth.values()) - 1e-6))
            if low >= best[0]:
                continue
            if looked % DIVES == 0 and (found := self.dive(yes, no, spent)) is not None:
                best = min(best, found, key=order)
            if heap and low > heap[0][0]:  # others may be better now
                count += 1
                heapq.heappush(heap, (low, -count, spent, yes, no, NONE, NONE, shares))
                continue
            if not open_:
                best = min(best, (spent, yes, no), key=order)
                continue
            for more, less in self.branch(open_, member, users, latest):
                if no.isdisjoint(more) and yes.isdisjoint(less) and not set(more).intersection(less):
                    _, _, add = self.step(yes, no, more, less)
                    if max(low, spent + add) < best[0]:
                        count += 1
                        heapq.heappush(heap, (max(low, spent + add), -count, spent + add, yes, no, more, less, shares))
        else:
            bound = best[0]
        present = (self.has | best[1]) - best[2]
        return Found([i in present for i in range(self.n)], best[0], bound, "OPTIMAL" if bound >= best[0] else "FEASIBLE")

    def branch(self, open_: dict, member: dict[int, int], users: dict[int, int], shares: dict) -> list[tuple[Iterable[int], Iterable[int]]]:
        """What tells the children apart: does the dearest pair that several groups' options share change; without one, how is a group mended."""
        wanted: dict[int, int] = {}
        for g, o in open_.items():
            for x in min((sum(shares[g].get(x, 0.0) for x in m), j, m) for j, m in o)[2]:
                if users[x] > 1:
                    wanted[x] = wanted.get(x, 0) + 1
        if wanted:
            x = max(wanted, key=lambda x: (wanted[x] * self.cost[x] / users[x], self.cost[x], -x))
            return [(NONE, self.below[x]), (self.above[x], NONE)] if x in self.has else [(self.above[x], NONE), (NONE, self.below[x])]
        g = min(open_)
        on, before, children = member[g], NONE, []
        for x, m in sorted(open_[g], key=lambda c: (self.price(c[1]), c[0])):
            if x < 0:
                children.append((NONE, self.below[on]))
            else:
                children.append(({*self.above[on], *self.above[x]}, before))
                before = before.union(self.below[x])
        return children


@dataclass
class Settled:
    """Decisions about pairs; ``gap`` is, at one pair of a part whose search was ended, its value less its bound."""

    present: np.ndarray
    gap: np.ndarray


def _upward(term: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): each of the terms ``start`` with itself and all terms that rules lead to from it, pair by pair."""
    edges = np.unique(term[a] * n + term[b])
    child, parent = np.divmod(edges, n)
    first = np.searchsorted(child, np.arange(n + 1))
    front = seen = np.unique(start) * (n + 1)
    while len(front):
        low, at = np.divmod(front, n)
        many = first[at + 1] - first[at]
        onward = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        front = np.setdiff1d(np.repeat(low, many) * n + parent[onward], seen)
        seen = np.union1d(seen, front)
    return np.divmod(seen, n)


def absent(term: np.ndarray, has: np.ndarray, cost: np.ndarray, member: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that are absent in a cheapest assignment, found without a search: in the one with the fewest present pairs.

    With all pairs of a term and of what is below it gone, nothing else is violated. So what keeps one of
    these pairs costs less than the annotated ones among them, ``worth``: a member that would be promoted,
    and whatever stands above a pair and is there for its sake alone. A group's only possible member is
    absent, and so is what is below an absent pair. What is absent is worth nothing, so this is repeated.
    """
    n, kinds = len(term), int(term.max()) + 1 if len(term) else 0
    low, high = _upward(term, a, b, term[has], kinds)
    alive = np.ones(n, bool)
    while True:
        worth = np.bincount(high, np.bincount(term, np.where(has & alive, cost, 0), kinds)[low], kinds)[term]
        inside = alive[a] & alive[b]
        down, up = a[inside], b[inside]
        only = alive & ~has & ~member & (np.bincount(up, minlength=n) == 1)
        down, up = down[only[up]], up[only[up]]
        total = own = np.where(has, 0, cost).astype(float)
        for _ in range(PASSES):
            more = own + np.bincount(down, total[up], n)
            if np.array_equal(more, total):
                break
            total = more
        gone = (member & ~has & (cost >= worth)) | ((member | has) & (total >= worth) & (~has | (total > 0)))
        gone |= member & (np.bincount(term[member & alive], minlength=kinds)[term] == 1)
        gone = ~alive | gone
        while (wider := gone[b] & ~gone[a]).any():
            gone[a[wider]] = True
        if np.array_equal(gone, ~alive):
            return gone
        alive = ~gone


def parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that links (a, b) join each number to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        now = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(now, x, least)
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, label):
            return label
        label = now


def settle(term: np.ndarray, has: np.ndarray, cost: np.ndarray, member: np.ndarray, a: np.ndarray, b: np.ndarray, seconds: float | None = None) -> Settled:
    """The cheapest decisions about many pairs at once, those of independent components included.

    ``term`` numbers the terms of each component by itself, from 0 on without gaps; ``member`` marks the
    pairs of a term that form its group; ``a`` needs ``b``. What ``absent`` finds goes first, and
    what is left is torn into parts; those in which something is violated are searched.
    """
    gone = absent(term, has, cost, member, a, b)
    present, gap = has & ~gone, np.zeros(len(term), np.int64)
    kinds = int(term.max()) + 1 if len(term) else 0
    free = member & ~gone
    lone = free & has & (np.bincount(term[free & has], minlength=kinds)[term] == 1)
    inside = ~gone[a] & ~gone[b]
    a, b = a[inside], b[inside]
    wrong = lone.copy()
    wrong[a[present[a] & ~present[b]]] = True
    if not wrong.any():
        return Settled(present, gap)
    where = np.flatnonzero(free)
    where = where[np.argsort(term[where], kind="stable")]
    same = term[where[1:]] == term[where[:-1]]
    label = parts(len(term), np.concatenate([a, where[1:][same]]), np.concatenate([b, where[:-1][same]]))
    chosen = np.isin(label, label[wrong]) & ~gone
    order = np.flatnonzero(chosen)
    order = order[np.argsort(label[order], kind="stable")]
    place = np.empty(len(term), np.int64)
    of = np.flatnonzero(chosen[a])
    of = of[np.argsort(label[a[of]], kind="stable")]
    starts = np.flatnonzero(np.r_[True, label[order[1:]] != label[order[:-1]]])
    ends = np.r_[starts[1:], len(order)]
    place[order] = np.arange(len(order)) - np.repeat(starts, ends - starts)
    rule_starts = np.searchsorted(label[a[of]], label[order[starts]])
    rule_ends = np.searchsorted(label[a[of]], label[order[starts]], "right")
    end = None if seconds is None else time.monotonic() + seconds
    for s, e, rs, re in zip(starts, ends, rule_starts, rule_ends, strict=True):
        mine, links = order[s:e], of[rs:re]
        groups: dict[int, list[int]] = {}
        for x in mine[member[mine]]:
            groups.setdefault(int(term[x]), []).append(int(place[x]))
        rules = list(zip(place[a[links]].tolist(), place[b[links]].tolist(), strict=True))
        found = Component(has[mine].tolist(), cost[mine].tolist(), rules, list(groups.values())).solve(None if end is None else max(0.0, end - time.monotonic()))
        present[mine] = found.present
        gap[mine[0]] = found.value - found.bound
    return Settled(present, gap)
