"""Several regular expressions as one deterministic automaton over bytes.

Rules become one non-deterministic automaton (Thompson), that one a
deterministic automaton by subset construction over classes of bytes, and that
one the smallest by partition refinement.  ``scan`` runs it over a whole slice
of texts: every byte is looked at once, for all rules together, in many lanes.
A lane begins where a row begins or behind a byte that leads every state back
to the start, so lanes do not depend on each other.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parser

import numpy as np

#: Bytes between the places where a lane may begin; lanes that go on alone are walked one by one.
LANE, FEW = 512, 8


class _Nfa:
    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes_of(op, arg, fold: bool) -> frozenset[int]:
    if op is sre.LITERAL:
        found = {arg}
    elif op is sre.NOT_LITERAL:
        return frozenset(range(256)) - _bytes_of(sre.LITERAL, arg, fold)
    elif op is sre.RANGE:
        found = set(range(arg[0], arg[1] + 1))
    elif op is sre.IN:
        rest = [x for x in arg if x[0] is not sre.NEGATE]
        found = set().union(*(_bytes_of(o, a, fold) for o, a in rest))
        if len(rest) < len(arg):
            return frozenset(range(256)) - found
    else:
        raise ValueError(f"not supported in a rule: {op}")
    if fold:
        found |= {ord(c) for b in found if b < 128 for c in (chr(b).lower(), chr(b).upper())}
    return frozenset(found)


def _build(nfa: _Nfa, tree, at: int, fold: bool, back: bool) -> int:
    """Adds a parsed pattern behind state ``at``; its last state."""
    for op, arg in reversed(tree) if back else tree:
        if op is sre.SUBPATTERN:
            at = _build(nfa, arg[3], at, (fold or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE, back)
        elif op is sre.BRANCH:
            ends = [_build(nfa, branch, at, fold, back) for branch in arg[1]]
            at = nfa.state()
            for e in ends:
                nfa.free[e].append(at)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            for _ in range(low):
                at = _build(nfa, inner, at, fold, back)
            if high is sre.MAXREPEAT:
                loop = nfa.state()
                nfa.free[at].append(loop)
                nfa.free[_build(nfa, inner, loop, fold, back)].append(loop)
                at = loop
            else:
                skips = [at]
                for _ in range(high - low):
                    at = _build(nfa, inner, at, fold, back)
                    skips.append(at)
                at = nfa.state()
                for s in skips:
                    nfa.free[s].append(at)
        else:
            then = nfa.state()
            nfa.steps[at].append((_bytes_of(op, arg, fold), then))
            at = then
    return at


@dataclass(frozen=True)
class Automaton:
    """``step[state * n_classes + classes[byte]]`` is the next state times
    ``n_classes``; states from ``first_accept`` on end a match of the rules in
    their ``accepts`` mask.  The start state is 0."""
    classes: np.ndarray
    step: np.ndarray
    n_classes: int
    first_accept: int
    accepts: np.ndarray
    start: int
    dead: int
    resets: np.ndarray


def compile_rules(patterns: list[str], anchored: bool = False, back: bool = False) -> Automaton:
    """The smallest automaton that finds every end of a match of any pattern
    (ends of matches that begin at the first byte, if ``anchored``); with
    ``back`` the patterns are read from their end."""
    nfa = _Nfa()
    begin = nfa.state()
    final: dict[int, int] = {}
    for i, p in enumerate(patterns):
        first = nfa.state()
        nfa.free[begin].append(first)
        final[_build(nfa, list(sre_parser.parse(p.encode())), first, False, back)] = 1 << i
    # bytes that no step tells apart are one class
    sets = list({s for steps in nfa.steps for s, _ in steps})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = np.array([kinds[s] for s in signature], np.uint8)
    example = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]

    start = nfa.closure(frozenset([begin]))
    number, todo, rows = {start: 0}, [start], []
    while todo:
        states, row = todo.pop(0), []
        for b in example:
            to = {t for s in states for chars, t in nfa.steps[s] if b in chars}
            found = nfa.closure(frozenset(to)) | (frozenset() if anchored else start)
            if found not in number:
                number[found] = len(number)
                todo.append(found)
            row.append(number[found])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum({final.get(s, 0) for s in states}) for states in number], np.int64)

    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # refine until states of a block step to the same blocks
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, one = np.unique(block, return_index=True)
    table, accepts = block[table[one]], accepts[one]
    order = np.argsort(accepts > 0, kind="stable")  # accepting states last
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table, accepts, first = place[table[order]], accepts[order], int(place[block[0]])
    n = len(kinds)
    lost = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(
        classes, (table * n).ravel(), n, int((accepts == 0).sum()) * n, accepts, first * n,
        int(lost[0]) * n if anchored and len(lost) else -1, (table == first).all(axis=0)[classes],
    )


def scan(a: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the last bytes of matches, masks of their rules), in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = a.classes[data]
    behind = np.flatnonzero(a.resets[data]) + 1
    grid = behind[np.unique(np.searchsorted(behind, np.arange(0, len(data), LANE)).clip(max=max(0, len(behind) - 1)))] if len(behind) else behind
    starts = np.unique(np.concatenate((offsets, grid)))
    starts = starts[starts < len(data)]
    lengths = np.diff(np.append(starts, len(data)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    state = np.full(len(starts), a.start)
    positions, masks = [], []
    t = 0
    while len(state) > FEW:
        at = starts[:len(state)] + t
        state = a.step.take(state + kinds.take(at))
        if state.max() >= a.first_accept:
            hit = np.flatnonzero(state >= a.first_accept)
            positions.append(at[hit])
            masks.append(a.accepts[state[hit] // a.n_classes])
        t += 1
        if t >= lengths[len(state) - 1]:
            state = state[:int(np.searchsorted(-lengths, -t))]
    step, accepts = a.step.tolist(), a.accepts.tolist()
    for s, begin, n in zip(state.tolist(), starts.tolist(), lengths.tolist()):
        for p, c in enumerate(kinds[begin + t:begin + n].tolist(), begin + t):
            s = step[s + c]
            if s >= a.first_accept:
                positions.append([p])
                masks.append([accepts[s // a.n_classes]])
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, mask = np.concatenate(positions).astype(np.int64), np.concatenate(masks).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], mask[order]


def leftmost(a: Automaton, data: bytes, low: int, end: int) -> int:
    """The first start from ``low`` on of a match that ends in front of
    ``end``, by an automaton that reads backwards; -1 if there is none."""
    state, found = a.start, -1
    step, n, first = a.step, a.n_classes, a.first_accept
    for p in range(end - 1, low - 1, -1):
        state = int(step[state + int(a.classes[data[p]])])
        if state >= first:
            found = p
        elif state == a.dead:
            break
    return found
