"""Grammar inference: probabilistic automata learned by state merging.

A prefix tree of the labelled strings is folded by the red-blue order; two
states merge when Hoeffding's bound cannot tell their ending and branching
frequencies apart, here and in all that follows.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np

#: Characters stand for their class, which keeps the alphabet small.
CLASSES = (("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("U", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("d", "0123456789"))
CLASS_OF = {c: name for name, chars in CLASSES for c in chars}
CLASS_SIZE = {name: len(chars) for name, chars in CLASSES}
#: The characters of tokens as numbers from 1; 0 is what stands before them, or any other.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
ALPHABET = len(LETTERS) + 1
CODES = np.zeros(256, np.int64)
CODES[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(1, ALPHABET)
#: Probability of a step or an ending that was never seen.
FLOOR = 1e-3


class Node:
    """count strings pass, ends of them end here, left[c] go on by c to to[c]."""

    __slots__ = ("count", "ends", "left", "to")

    def __init__(self) -> None:
        self.count, self.ends, self.left, self.to = 0, 0, {}, {}


def prefix_tree(strings: list[str]) -> Node:
    root = Node()
    for s in strings:
        node = root
        node.count += 1
        for c in s:
            name = CLASS_OF.get(c, c)
            node.left[name] = node.left.get(name, 0) + 1
            node = node.to.setdefault(name, Node())
            node.count += 1
        node.ends += 1
    return root


def _apart(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    if not n1 or not n2:
        return False
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (n1**-0.5 + n2**-0.5)


def compatible(a: Node, b: Node, alpha: float) -> bool:
    """Whether no statistic from a and b on is significantly different."""
    queue, seen = deque([(a, b)]), set()
    while queue:
        a, b = queue.popleft()
        if (id(a), id(b)) in seen:
            continue
        seen.add((id(a), id(b)))
        if _apart(a.ends, a.count, b.ends, b.count, alpha):
            return False
        for c in a.to.keys() | b.to.keys():
            if _apart(a.left.get(c, 0), a.count, b.left.get(c, 0), b.count, alpha):
                return False
            if c in a.to and c in b.to:
                queue.append((a.to[c], b.to[c]))
    return True


def fold(a: Node, b: Node) -> None:
    """Adds the tree at b into a; b is a tree that nothing else reaches."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        a.count += b.count
        a.ends += b.ends
        for c, y in b.to.items():
            a.left[c] = a.left.get(c, 0) + b.left[c]
            if c in a.to:
                todo.append((a.to[c], y))
            else:
                a.to[c] = y


def codes_of(text: str) -> np.ndarray:
    return CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


@dataclass
class Automaton:
    """States by number: ending and symbol probabilities, and the next state."""

    end: list[float]
    step: list[dict[str, tuple[float, int]]]
    floor: float

    def log_likelihood(self, s: str) -> float:
        """Natural logarithm of the string's probability; what the automaton has
        not seen costs the floor, and it goes on from the start state."""
        total, state = 0.0, 0
        for c in s:
            name = CLASS_OF.get(c, c)
            p, nxt = self.step[state].get(name, (self.floor, 0))
            total += math.log(p / CLASS_SIZE.get(name, 1))
            state = nxt
        return total + math.log(max(self.end[state], self.floor))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probability and next state by state and character, and of endings."""
        cost, to = np.zeros((len(self.step), ALPHABET)), np.zeros((len(self.step), ALPHABET), np.int64)
        for state, steps in enumerate(self.step):
            for code in range(ALPHABET):
                c = LETTERS[code - 1] if code else "?"
                name = CLASS_OF.get(c, c)
                p, to[state, code] = steps.get(name, (self.floor, 0))
                cost[state, code] = math.log(p / CLASS_SIZE.get(name, 1))
        return cost.ravel(), to.ravel(), np.log(np.maximum(self.end, self.floor))

    def log_likelihoods(self, codes: np.ndarray, sizes: np.ndarray, together: int) -> np.ndarray:
        """log_likelihood of many strings, whose characters stand one after the
        other: those of `together` characters or fewer a character at a time."""
        cost, to, end = self.tables()
        starts, out = np.cumsum(sizes) - sizes, np.zeros(len(sizes))
        order = np.argsort(-sizes, kind="stable")
        long = order[sizes[order] > together]
        order = order[len(long) :]
        state, n = np.zeros(len(order), np.int64), len(order)
        ascending = -sizes[order]
        total = np.zeros(len(order))
        for i in range(int(sizes[order[0]]) if n else 0):
            n = int(np.searchsorted(ascending, -i, "left"))  # longer than i
            at = state[:n] * ALPHABET + codes[starts[order[:n]] + i]
            total[:n] += cost[at]
            state[:n] = to[at]
        out[order] = total + end[state]
        costs, nexts = (cost.tolist(), to.tolist()) if len(long) else ([], [])
        for k in long.tolist():
            own, s = 0.0, 0
            for code in codes[starts[k] : starts[k] + sizes[k]].tolist():
                at = s * ALPHABET + code
                own += costs[at]
                s = nexts[at]
            out[k] = own + end[s]
        return out


def infer(strings: list[str], alpha: float = 0.05) -> Automaton:
    """The automaton learned from the strings; with none, one state without steps."""
    root = prefix_tree(sorted(strings))
    red = [root]
    while True:
        known = {id(r) for r in red}
        blue = [(r, c, t) for r in red for c, t in sorted(r.to.items()) if id(t) not in known]
        if not blue:
            break
        r, c, b = max(blue, key=lambda x: x[2].count)
        for q in red:
            if compatible(q, b, alpha):
                r.to[c] = q
                fold(q, b)
                break
        else:
            red.append(b)
    number = {id(r): i for i, r in enumerate(red)}
    end = [r.ends / max(1, r.count) for r in red]
    step = [{c: (r.left[c] / r.count, number[id(t)]) for c, t in r.to.items()} for r in red]
    return Automaton(end, step, FLOOR)
