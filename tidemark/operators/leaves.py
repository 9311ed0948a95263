"""How the score of boosted trees moves when one feature of a row takes another value.

A leaf of a tree is a bit. For a feature, a table over its intervals between cuts holds the leaves that a value there can reach; the
leaf of a row is the one bit that all its features' tables share. Exchanging a feature exchanges one factor of that product, so
a row costs a few look-ups for each tree and feature used in it, not a walk of all trees for each feature of the model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Leaves of a group; bit 0 stands for "no leaf of this group". Larger trees are several groups, whose values add up.
GROUP = 63
#: Multiplied by a power of two, its upper six bits tell which one it is (0 for 0 as for 1).
_DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)
_PLACES = ((1 << np.arange(64, dtype=np.uint64)) * _DE_BRUIJN >> np.uint64(58)).astype(np.int64)
#: Rows that are scored together, so that their numbers stay in the cache.
ROWS = 4096


@dataclass
class Leaves:
    """``cuts`` of each feature that is used, and for each group of leaves the tables by feature and the values by place."""

    cuts: dict[int, np.ndarray] = field(default_factory=dict)
    groups: list[tuple[dict[int, np.ndarray], np.ndarray]] = field(default_factory=list)


def _walk(node, bounds: dict[int, tuple[float, float]], out: list) -> None:
    """Appends the ranges (from, to] of features and the prediction of each leaf, from left to right."""
    if node.getClass().getSimpleName() == "LeafNode":
        out.append((bounds, node.prediction()))
        return
    split = node.split()
    f, cut = split.featureIndex(), split.threshold()
    lo, hi = bounds.get(f, (-np.inf, np.inf))
    _walk(node.leftChild(), bounds | {f: (lo, min(hi, cut))}, out)
    _walk(node.rightChild(), bounds | {f: (max(lo, cut), hi)}, out)


def leaves_of(trees: list[tuple]) -> Leaves:
    """Of pairs of a fitted tree and its weight, or the values of its leaves by number in place of predictions."""
    walked, cuts = [], {}
    for tree, weight in trees:
        leaves: list = []
        _walk(tree._java_obj.rootNode(), {}, leaves)
        by_number = isinstance(weight, dict)
        values = [weight.get(i, 0.0) if by_number else p * weight for i, (_, p) in enumerate(leaves)]
        walked.append(([b for b, _ in leaves], values))
        for bounds, _ in leaves:
            for f, ends in bounds.items():
                cuts.setdefault(f, set()).update(x for x in ends if np.isfinite(x))
    out = Leaves({f: np.array(sorted(c)) for f, c in cuts.items()})
    ends = {f: (np.append(-np.inf, c), np.append(c, np.inf)) for f, c in out.cuts.items()}
    for bounds, values in walked:
        for first in range(0, len(values), GROUP):
            part, at = bounds[first : first + GROUP], np.zeros(64)
            at[_PLACES[1 : len(part) + 1]] = values[first : first + GROUP]
            tables = {}
            for f in sorted({f for b in bounds for f in b}):
                lo, hi = ends[f]
                tables[f] = np.zeros(len(lo), np.uint64)
                for i, b in enumerate(part):
                    from_, to = b.get(f, (-np.inf, np.inf))
                    tables[f][(lo >= from_) & (hi <= to)] |= np.uint64(1 << (i + 1))
            out.groups.append((tables, at))
    return out


def _values(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at[(bits * _DE_BRUIJN) >> np.uint64(58)]


def moves(leaves: Leaves, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The trees' sum for the rows of ``own``, and for each feature in use what is added to it if that feature is the one of ``other``."""
    mine = {f: np.searchsorted(c, own[:, f]) for f, c in leaves.cuts.items()}
    theirs = {f: np.searchsorted(c, other[:, f]) for f, c in leaves.cuts.items()}
    base, moved = np.zeros(len(own)), {f: np.zeros(len(own)) for f in leaves.cuts}
    every = np.full(len(own), ~np.uint64(0))
    for tables, at in leaves.groups:
        if not tables:  # a tree without a split
            base += at[_PLACES[1]]
            continue
        used = list(tables)
        masks = [tables[f][mine[f]] for f in used]
        after = [every]  # what the features behind one allow, from the last to the first
        for m in reversed(masks[1:]):
            after.append(after[-1] & m)
        before = every
        whole = _values(after[-1] & masks[0], at)
        base += whole
        for f, m, rest in zip(used, masks, reversed(after), strict=True):
            moved[f] += _values(before & rest & tables[f][theirs[f]], at) - whole
            before = before & m
    return base, moved
