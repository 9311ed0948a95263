"""External induced sorting: suffixes in order, each with the length of the prefix it shares with its neighbour.

The sort is that of induced sorting with common-prefix values. Leftmost S-type (LMS) suffixes are the seeds: one induction in ascending
order brings the L-type suffixes out of them, a second one in descending order the S-type suffixes out of those. An induction
moves tuples (first symbol, suffix, symbol before it, common prefix) through a monotone priority queue; a suffix that is taken out sends
the one before it back in, with a common prefix one longer than the least value passed since the last tuple for the same symbol.

To get the seeds in order, the same two inductions sort the LMS *substrings*; neighbours whose common prefix is their whole length are
equal and get one name, and the string of names is sorted by recursion. Its common prefixes, counted in names, are turned into
symbols by the places of the seeds and the common prefixes of the names. Values are cut off at ``depth``, so the recursion goes
to half the depth at each level. It ends where one name covers the depth, or where the names fit in the budget: those are put in order
at once.

Every sequence that grows with the text lives on a tape, which is a file beyond its share of the memory budget, and the queue spills by
range of keys. Files lie in the folders that Spark gives its executors for spilling; random reads go through the page cache.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples handled at once, and ranges of keys that a queue is cut into: as few as serve a text of that many symbols, each
#: range being put in order as a whole.
CHUNK, RANGES = 1 << 16, 512
#: The recursion ends at a string of names for which the budget has this many bytes a name.
ROOM = 64
#: Common prefixes are kept in a byte.
MOST = 255


def spill_folder() -> str:
    """Where Spark lets its executors spill; outside of them the folder for temporary files."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()


class Space:
    """The memory budget in bytes, and the folder for what exceeds it."""

    def __init__(self, budget: int, folder: str | None = None):
        self.budget, self.folder, self.spilled = budget, folder or spill_folder(), 0

    def file(self):
        os.makedirs(self.folder, exist_ok=True)
        return tempfile.TemporaryFile(dir=self.folder)


class Tape:
    """An array written from front to back and read afterwards."""

    def __init__(self, space: Space, dtype):
        self.space, self.dtype, self.parts, self.held, self.size, self.out = space, np.dtype(dtype), [], 0, 0, None

    def append(self, x: np.ndarray) -> None:
        self.parts.append(np.ascontiguousarray(x, self.dtype))
        self.held += self.parts[-1].nbytes
        self.size += len(x)
        if self.held > self.space.budget // 16:
            if self.out is None:
                self.out = self.space.file()
            np.concatenate(self.parts).tofile(self.out)
            self.space.spilled += self.held
            self.parts, self.held = [], 0

    def read(self) -> np.ndarray:
        """The whole array: a memory map where it is a file. Ends the writing."""
        if self.out is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        if self.parts:
            np.concatenate(self.parts).tofile(self.out)
            self.space.spilled += self.held
            self.parts, self.held = [], 0
        self.out.flush()
        return np.memmap(self.out, self.dtype, "r", shape=(self.size,))


def scattered(space: Space, size: int, dtype) -> np.ndarray:
    """A zeroed array to write in any order, a file beyond a share of the budget."""
    dtype = np.dtype(dtype)
    if size * dtype.itemsize <= space.budget // 16:
        return np.zeros(size, dtype)
    file = space.file()
    file.truncate(size * dtype.itemsize)
    space.spilled += size * dtype.itemsize
    return np.memmap(file, dtype, "r+", shape=(size,))


class Queue:
    """A monotone priority queue of rows (key << 8 | common prefix, suffix, symbol before), equal keys in order of arrival.

    Keys are cut into ranges; only the lowest range is kept in order. Rows of higher ranges are held as they come and go to a
    file, range by range, beyond the budget. A range that is itself too large becomes a queue of its own.
    """

    def __init__(self, space: Space, keys: int, base: int = 0, rows: int = 1 << 40):
        ranges = RANGES if keys <= RANGES else min(RANGES, max(16, math.isqrt(rows) // 8))
        self.space, self.base, self.end, self.width = space, base, base + keys, max(1, -(-keys // ranges))
        self.ranges = -(-keys // self.width)
        self.at = -1
        self.front, self.inner = np.zeros((0, 3), np.int64), None
        self.pending: list[np.ndarray] = []
        self.parts: dict[int, list[np.ndarray]] = {}
        self.extents: dict[int, list[tuple[int, int]]] = {}
        self.held, self.file = 0, None

    def _range(self, rows: np.ndarray) -> np.ndarray:
        return ((rows[:, 0] >> 8) - self.base) // self.width

    def push(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        where = self._range(rows)
        own = where == self.at
        if own.any():
            if self.inner is not None:
                self.inner.push(rows[own])
            elif self.width == 1:
                self.parts.setdefault(self.at, []).append(rows[own])
                self.held += rows[own].nbytes
            else:
                new = rows[own]
                new = new[np.argsort(new[:, 0] >> 8, kind="stable")]
                place = np.searchsorted(self.front[:, 0] >> 8, new[:, 0] >> 8, side="right")
                self.front = np.insert(self.front, place, new, axis=0)
            rows = rows[~own]
        if len(rows):
            self.pending.append(rows)
            self.held += rows.nbytes
        if self.held > self.space.budget // 4:
            self._deal()
            self._spill()

    def _deal(self) -> None:
        """Pending rows go to their ranges."""
        if not self.pending:
            return
        rows = np.concatenate(self.pending)
        self.pending = []
        where = self._range(rows)
        order = np.argsort(where.astype(np.uint16), kind="stable")
        rows, where = rows[order], where[order]
        cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            self.parts.setdefault(int(where[a]), []).append(rows[a:b].copy())

    def _spill(self) -> None:
        if self.file is None:
            self.file = self.space.file()
        for r, parts in self.parts.items():
            rows = np.concatenate(parts)
            self.extents.setdefault(r, []).append((self.file.seek(0, os.SEEK_END), len(rows)))
            rows.tofile(self.file)
            self.space.spilled += rows.nbytes
        self.parts, self.held = {}, 0

    def _pieces(self, r: int) -> Iterator[np.ndarray]:
        """The rows of a range in order of arrival, some at a time."""
        for place, n in self.extents.pop(r, ()):
            for at in range(0, n, CHUNK):
                self.file.seek(place + 24 * at)
                yield np.fromfile(self.file, np.int64, 3 * min(CHUNK, n - at)).reshape(-1, 3)
        parts = self.parts.pop(r, [])
        self.held -= sum(p.nbytes for p in parts)
        yield from parts

    def _size(self, r: int) -> int:
        return sum(n for _, n in self.extents.get(r, ())) + sum(map(len, self.parts.get(r, ())))

    def _next(self) -> int | None:
        self._deal()
        return min((r for r in (*self.parts, *self.extents) if r > self.at), default=None)

    def _load(self, up_to: int) -> None:
        """Brings the next rows to the front, if their range may hold keys up to ``up_to``."""
        if self.inner is not None:
            if len(self.inner.peek(up_to)) or self.inner.bound() is not None:
                return
            self.inner = None
        if self.width == 1 and self._size(self.at):  # arrived while the key was being served
            self.front = self._some(self.at)
            return
        r = self._next()
        if r is None or self.base + r * self.width > up_to:
            return
        self.at = r
        if self.width == 1:
            self.front = self._some(r)
        elif self._size(r) * 24 > self.space.budget // 4:
            self.inner = Queue(self.space, min(self.width, self.end - self.base - r * self.width), self.base + r * self.width)
            for piece in self._pieces(r):
                self.inner.push(piece)
            self.inner.peek(up_to)
        else:
            rows = np.concatenate(list(self._pieces(r)))
            self.front = rows[np.argsort(rows[:, 0] >> 8, kind="stable")]

    def _some(self, r: int) -> np.ndarray:
        """The first rows of a range of one key; the rest stays where it is."""
        got, size = [], 0
        for place, n in self.extents.pop(r, ()):
            if size < CHUNK:
                take = min(n, CHUNK)
                self.file.seek(place)
                got.append(np.fromfile(self.file, np.int64, 3 * take).reshape(-1, 3))
                size += take
                place, n = place + 24 * take, n - take
            if n:
                self.extents.setdefault(r, []).append((place, n))
        if r not in self.extents:
            parts = self.parts.pop(r, [])
            self.held -= sum(p.nbytes for p in parts)
            got += parts
        return got[0] if len(got) == 1 else np.concatenate(got)

    def peek(self, up_to: int) -> np.ndarray:
        """The first rows in order, or none if the queue has no row in the range of ``up_to`` or below: a row may still come there."""
        if not len(self.front):
            self._load(up_to)
        return self.inner.peek(up_to) if self.inner is not None else self.front

    def bound(self) -> int | None:
        """No row that ``peek`` did not give has a key below this; None if there is no other."""
        if self.inner is not None:
            got = self.inner.bound()
            return min(self.end, self.base + (self.at + 1) * self.width) if got is None else got
        if len(self.front):
            return min(self.end, self.base + (self.at + (0 if self.width == 1 and self._size(self.at) else 1)) * self.width)
        r = self._next()
        return None if r is None else self.base + r * self.width

    def pop(self, n: int) -> None:
        if self.inner is not None:
            self.inner.pop(n)
        else:
            self.front = self.front[n:]


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of ``values[first .. last]``, by a table of minima over powers of two."""
    size = last - first + 1
    if (size == 1).all():
        return values[first]
    level = np.frexp(size.astype(np.float64))[1] - 1
    tables = [values]
    for k in range(int(level.max())):
        h = 1 << k
        nxt = tables[-1].copy()
        nxt[:-h] = np.minimum(tables[-1][:-h], tables[-1][h:])
        tables.append(nxt)
    table = np.stack(tables)
    return np.minimum(table[level, first], table[level, last - (1 << level) + 1])


def _induce(space: Space, text: np.ndarray, symbols: int, depth: int, down: bool, seeds: Callable[[int, int], tuple[np.ndarray, np.ndarray]], count: int, cut: bool) -> Iterator[tuple]:
    """Induces suffixes from seeds, in ascending order or ``down``; yields (suffixes, common prefix with the one before, seed?, LMS?).

    ``seeds(a, b)`` gives a range of the ``count`` seeds in order of induction, with their common prefixes. With ``cut`` a
    seed stands for its first symbol alone. Going down, symbols are counted from the largest, so that both directions are one.
    """

    def at(places: np.ndarray) -> np.ndarray:
        got = text[places].astype(np.int64)
        return symbols - 1 - got if down else got

    def run(place: int) -> int:
        part = np.asarray(text[place : place + depth])
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    n = len(text)
    queue = Queue(space, symbols, 0, n)
    if down:  # nothing follows the sentinel, so nothing induces it
        queue.push(np.array([[(symbols - 1) << 8, n - 1, at(np.array([n - 2]))[0] if n > 1 else -1]]))
    since, touched = np.zeros(symbols, np.uint8), np.zeros(0, np.int64)  # of the symbol being served: least value since a target was last met
    served, last_place, last_seed, before_last = -1, -1, False, None
    done, ahead = 0, None
    while True:
        if ahead is None or len(ahead[0]) < CHUNK // 2 + 1 and done + len(ahead[0]) < count:
            place, common = seeds(done, min(count, done + CHUNK))
            ahead = (place, common, at(place), np.where(place > 0, at(np.maximum(place - 1, 0)), -1))
        place, common, own, before = ahead
        rows = queue.peek(int(own[0]) if len(own) else symbols)
        if not len(rows) and not len(place):
            return
        # What is known to be next: rows of the queue up to its bound, seeds up to the last one at hand.
        limit = queue.bound()
        limit = symbols if limit is None else limit
        if len(rows) > CHUNK:
            rows = rows[:CHUNK]
            limit = min(limit, int(rows[-1, 0] >> 8))
        taken = int(np.searchsorted(own, limit))
        if done + len(place) < count and taken == len(place):
            rows = rows[: int(np.searchsorted(rows[:, 0] >> 8, own[-1], side="right"))]
        keys = np.concatenate([rows[:, 0] >> 8, own[:taken]])
        is_seed = np.concatenate([np.zeros(len(rows), bool), np.ones(taken, bool)])
        order = np.argsort(2 * keys + is_seed, kind="stable")
        keys, is_seed = keys[order], is_seed[order]
        suffix = np.concatenate([rows[:, 1], place[:taken]])[order]
        prior = np.concatenate([rows[:, 2], before[:taken]])[order]
        value = np.concatenate([(rows[:, 0] & 255).astype(np.uint8), common[:taken]])[order]
        # A suffix may be served as long as nothing before it sends a tuple that belongs in front of it.
        sends = np.where(is_seed, prior > keys, prior >= keys)
        targets = np.where(sends, prior, symbols)
        safe = np.minimum.accumulate(2 * targets) >= 2 * keys + is_seed
        k = len(safe) if safe.all() else int(np.argmin(safe))
        keys, is_seed, suffix, prior, value, sends, targets = (x[:k] for x in (keys, is_seed, suffix, prior, value, sends, targets))
        used = int(is_seed.sum())
        queue.pop(k - used)
        done += used
        ahead = tuple(x[used:] for x in ahead)
        # Common prefixes with the suffix served before: none at a new symbol, and where seeds follow others the run of the symbol.
        fresh = np.concatenate([[keys[0] != served], keys[1:] != keys[:-1]])
        value = np.where(fresh, 0, value).astype(np.uint8)
        seam = is_seed & ~fresh & ~np.concatenate([[last_seed], is_seed[:-1]])
        for j in np.flatnonzero(seam).tolist():
            value[j] = 1 if cut else min(depth, run(int(suffix[j - 1] if j else last_place)), run(int(suffix[j])))
        if keys[0] == served:  # the symbol goes on: what the last round left of it
            passed, values, sent, to, on = before_last
            begin = int(np.searchsorted(passed, served))
            if on and not begin:
                since[touched] = np.minimum(since[touched], values.min())
            else:
                since[touched] = 0
                touched = touched[:0]
            late = sent[sent >= begin]
            if len(late):
                tails = np.append(np.minimum.accumulate(values[::-1])[::-1], MOST)  # least value from each place on
                since[to[late]] = tails[late + 1]  # of equal targets the last one counts
                touched = np.union1d(touched, to[late])
        elif len(touched):
            since[touched] = 0
            touched = touched[:0]
        # Each tuple sent: one more than the least value since the last one for the same symbol.
        where = np.flatnonzero(sends)
        if len(where):
            to = targets[where]
            by = np.argsort(to, kind="stable")
            to_by, where_by = to[by], where[by]
            first = np.concatenate([[True], to_by[1:] != to_by[:-1]])
            start = np.where(first, 0, np.concatenate([[0], where_by[:-1] + 1]))
            least = np.empty(len(where), np.int64)
            got = _least(value, start, where_by).astype(np.int64)
            got = np.where(first, np.minimum(got, since[to_by]), got)
            least[by] = got
            new = np.empty((len(where), 3), np.int64)
            new[:, 0] = to << 8 | np.minimum(depth, least + 1)
            new[:, 1] = suffix[where] - 1
            new[:, 2] = np.where(new[:, 1] > 0, at(np.maximum(new[:, 1] - 1, 0)), -1)
            queue.push(new)
        same = bool(keys[0] == served)
        served, last_place, last_seed, before_last = int(keys[-1]), int(suffix[-1]), bool(is_seed[-1]), (keys, value, where, targets, same)
        yield suffix, value, is_seed, ~is_seed & (prior > -1) & (prior < keys)


def _lms(space: Space, text: np.ndarray) -> np.ndarray:
    """Places of the leftmost S-type suffixes, the sentinel included."""
    high, small = len(text) - 1, True  # the type of the suffix at ``high``
    if not high:
        return np.zeros(1, np.int64)
    back = Tape(space, np.int64)
    while high > 0:
        low = max(0, high - CHUNK)
        part = np.asarray(text[low : high + 1]).astype(np.int64)
        step = np.sign(part[1:] - part[:-1])  # 1: smaller than the next, so S; -1: L; 0: as the next one
        known = np.where(step != 0, np.arange(len(step)), len(step))
        nearest = np.minimum.accumulate(known[::-1])[::-1]
        kind = np.where(nearest < len(step), step[np.minimum(nearest, len(step) - 1)] > 0, small)
        kind = np.append(kind, small)
        back.append((low + 1 + np.flatnonzero(kind[1:] & ~kind[:-1]))[::-1])
        small, high = bool(kind[0]), low
    back, out = back.read(), Tape(space, np.int64)
    for b in range(len(back), 0, -CHUNK):
        out.append(back[max(0, b - CHUNK) : b][::-1])
    return out.read()


def _both(space: Space, text: np.ndarray, symbols: int, depth: int, place: np.ndarray, common: np.ndarray, cut: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All suffixes in descending order from seeds in ascending order: (suffixes, common prefix with the one before, LMS?)."""
    large, prefix = Tape(space, np.int64), Tape(space, np.uint8)
    for suffix, value, is_seed, _ in _induce(space, text, symbols, depth, False, lambda a, b: (np.asarray(place[a:b]), np.asarray(common[a:b])), len(place), cut):
        large.append(suffix[~is_seed])
        prefix.append(value[~is_seed])
    large, prefix = large.read(), prefix.read()
    n = len(large)

    def backwards(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """From the end; a suffix shares with the one before it what that one, the next larger, was given."""
        values = np.zeros(b - a, np.uint8)
        lo = max(a, 1)
        if b > lo:
            values[lo - a :] = prefix[n - b + 1 : n - lo + 1][::-1]
        return np.asarray(large[n - b : n - a])[::-1], values

    for suffix, value, _, lms in _induce(space, text, symbols, depth, True, backwards, n, False):
        yield suffix, value, lms


def _directly(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a string that fits in memory several times: ranks of beginnings, doubled in length until they are long enough."""
    rank, span = np.unique(text, return_inverse=True)[1] + 1, 1
    while span < depth and rank.max() < len(rank):
        ahead = np.concatenate([rank[span:], np.zeros(span, np.int64)])[: len(rank)]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1] + 1
        span *= 2
    order = np.argsort(-rank, kind="stable")
    padded = np.concatenate([text, np.full(depth, -1)])
    common, alike = np.zeros(len(order), np.uint8), np.arange(1, len(order))
    for k in range(depth):
        alike = alike[padded[order[alike] + k] == padded[order[alike - 1] + k]]
        if not len(alike):
            break
        common[alike] += 1
    return order, common


def _descending(space: Space, text: np.ndarray, symbols: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a text with a sentinel, in descending order of their first ``depth`` symbols, and common prefixes up to it."""
    if depth <= 1 or text.dtype != np.uint16 and len(text) * ROOM <= space.budget:
        yield _directly(np.asarray(text).astype(np.int64), depth)
        return
    if len(text) < 2:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
        return
    lms = _lms(space, text)
    m = len(lms)
    place, common = lms, np.zeros(m, np.uint8)
    if m > 1:
        place, common = _sorted_seeds(space, text, symbols, depth, lms)
    for suffix, value, _ in _both(space, text, symbols, depth, place, common, False):
        yield suffix, value


def _by_symbol(space: Space, text: np.ndarray, symbols: int, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    queue = Queue(space, symbols)
    for a in range(0, len(lms), CHUNK):
        at = np.asarray(lms[a : a + CHUNK])
        queue.push(np.stack([text[at].astype(np.int64) << 8, at, at], 1))
    tape = Tape(space, np.int64)
    while len(rows := queue.peek(symbols)):
        tape.append(rows[:, 1])
        queue.pop(len(rows))
    return tape.read(), np.ones(len(lms), np.uint8)


def _runs(text: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Lengths, up to ``most``, of the shorter of two runs of one symbol that begin at ``x`` and at ``y``."""
    out, alive, symbol = np.ones(len(x), np.int64), np.arange(len(x)), np.asarray(text[x])
    while len(alive) and out[alive[0]] < most:
        k = out[alive[0]]
        alive = alive[(text[x[alive] + k] == symbol[alive]) & (text[y[alive] + k] == symbol[alive])]
        out[alive] += 1
    return out


def _beyond(text: np.ndarray, lms: np.ndarray, depth: int, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Common prefixes of LMS suffixes (numbers ``x``, the larger, and ``y``) whose substrings differ and share ``shared`` symbols.

    Where that is all of the larger one's substring, its last symbol is S-type and the same symbol of the other is L-type: both
    go on with it, and part where the shorter run ends.
    """
    last = np.asarray(lms[np.minimum(x + 1, len(lms) - 1)])
    at = np.flatnonzero((shared == last - lms[x] + 1) & (shared < depth))
    if len(at):
        shared = shared.copy()
        shared[at] += _runs(text, last[at], lms[y[at]] + shared[at] - 1, depth) - 1
    return np.minimum(depth, shared)


def _sorted_seeds(space: Space, text: np.ndarray, symbols: int, depth: int, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes in ascending order, with common prefixes."""
    m = len(lms)
    # Names of the LMS substrings, counted from the largest, and common prefixes of neighbouring names.
    names, between = scattered(space, m, np.int64), Tape(space, np.uint8)
    count, carried, last = -1, MOST, -1
    for suffix, value, is_lms in _both(space, text, symbols, depth, *_by_symbol(space, text, symbols, lms), True):
        where = np.flatnonzero(is_lms)
        if len(text) - 1 in suffix:  # the sentinel is a substring of its own
            where = np.union1d(where, np.flatnonzero(suffix == len(text) - 1))
        if not len(where):
            carried = min(carried, int(value.min()))
            continue
        least = np.minimum.reduceat(value[: where[-1] + 1], np.concatenate([[0], where[:-1] + 1]))
        least[0] = min(int(least[0]), carried)
        carried = int(value[where[-1] + 1 :].min()) if where[-1] + 1 < len(value) else MOST
        number = np.searchsorted(lms, suffix[where])
        size = np.asarray(lms[np.minimum(number + 1, m - 1)]) - np.asarray(lms[number]) + 1
        new = (least < np.minimum(size, depth)) | (size != np.concatenate([[last], size[:-1]]))
        if count < 0:
            new[0] = True
        names[number] = count + np.cumsum(new)
        count += int(new.sum())
        between.append(least[new])
        last = int(size[-1])
    count += 1
    between = np.asarray(between.read())
    if count == m:
        order, common = scattered(space, m, np.int64), between[::-1]
        for a in range(0, m, CHUNK):
            order[m - 1 - np.asarray(names[a : a + CHUNK])] = np.arange(a, min(m, a + CHUNK))
        place, prefix, prior = Tape(space, np.int64), Tape(space, np.uint8), np.zeros(1, np.int64)
        for a in range(0, m, CHUNK):
            x = np.asarray(order[a : a + CHUNK])
            y, shared = np.concatenate([prior, x[:-1]]), np.concatenate([common[a - 1 : a] if a else [0], common[a : a + len(x) - 1]]).astype(np.int64)
            prefix.append(_beyond(text, lms, depth, x, y, shared))
            place.append(lms[x])
            prior = x[-1:]
        return place.read(), prefix.read()
    string = Tape(space, np.int64)
    for a in range(0, m, CHUNK):
        string.append(count - 1 - np.asarray(names[a : a + CHUNK]))
    string = string.read()
    half = -(-depth // 2)
    place, common, prior = Tape(space, np.int64), Tape(space, np.uint8), None
    for order, value in _descending(space, string, count, half):
        larger = np.concatenate([[prior if prior is not None else 0], order[:-1]])
        # ``value`` equal names, then two different ones: of names a > b the least value from b + 1 to a, counted from the largest.
        x, y = (np.asarray(string[np.minimum(p + value, m - 1)]) for p in (larger, order))
        ends = value >= half
        differ = ~ends & (x > y)
        shared = np.full(len(order), depth, np.int64)
        if differ.any():
            least = _least(between, count - x[differ], count - 1 - y[differ]).astype(np.int64)
            shared[differ] = _beyond(text, lms, depth, (larger + value)[differ], (order + value)[differ], least)
        walked = np.asarray(lms[np.minimum(order + value, m - 1)]) - np.asarray(lms[order])
        both = np.where(ends, depth, np.minimum(depth, walked + shared))
        if prior is None:
            both[0] = 0
        prior = int(order[-1])
        place.append(lms[order])
        common.append(both.astype(np.uint8))
    place, common = place.read()[::-1], common.read()[::-1]
    return place, np.concatenate([[0], common[:-1]]).astype(np.uint8)


def suffixes(symbols: np.ndarray, depth: int, budget: int = 1 << 26, space: Space | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of bytes in descending order of their first ``depth`` bytes, in pieces: (places, common prefix with the one before).

    ``depth`` is below 256; common prefixes are cut off at it. The last suffix given is the end of the text, which stands for no byte.
    """
    if not 0 < depth <= MOST:
        raise ValueError(f"depth is at most {MOST}")
    space = space or Space(budget)
    text = Tape(space, np.uint16)
    for at in range(0, len(symbols), CHUNK):
        text.append(np.asarray(symbols[at : at + CHUNK]).astype(np.uint16) + 1)
    text.append(np.zeros(1, np.uint16))
    yield from _descending(space, text.read(), 257, depth)
