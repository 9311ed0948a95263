"""Best-fit packing of token sequences, after a Martello-Toth dominance reduction.

Texts are encoded whole and cut only where longer than the capacity. What is solved is the histogram of piece
lengths, which has at most ``capacity`` entries whatever the corpus, so the solver runs on the driver on a
table of proven size and its plan is broadcast:

1. *Reduction.* For the longest remaining length ``j`` the sets that contain it and are provably no worse than
   any other are fixed for good: ``{j}`` if nothing fits beside it; ``{j, i}`` with the longest fitting
   ``i`` if that fills the sequence, if no two pieces fit beside ``j``, or if no three do and ``i`` is at
   least as long as every pair that fits. Equal lengths are fixed many at a time. A piece that no rule covers goes to the remainder.
2. *Remainder.* Best-fit decreasing; open sequences are kept as runs of equal free space, so placing a
   length touches runs, not pieces.

The plan maps ranks within a length to sequence numbers and offsets. Ranks come from counts by
(length, bucket of the identifier), so a length that holds a third of all pieces is still spread out.

Nulls: a null text is empty and packs as its separator; null or repeated identifiers and repeated rows
are packed each on their own. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of
from .tokens import encoder

PIECES = "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long"
#: Buckets of identifiers that a length's pieces are ranked in.
RANK_BUCKETS = 256


def pieces(docs: DataFrame, tokenizer: str, separator: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``with_ids`` adds them as ``ids array<int>``."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    kinds = [("doc_id", pa.int64()), ("doc_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    arrow = pa.schema(kinds)
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        tail = np.array([separator], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = enc.encode(text.as_py()) + tail
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row = [doc_id, key, piece, at // 4, len(part) // 4, zlib.crc32(part)]
                    if with_ids:
                        row.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(out, kinds, strict=True)], schema=arrow)

    text = text_of(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("doc_key"), text.alias("text")).mapInArrow(cut, schema)


class _Lengths:
    """Counts by length, with the largest remaining length at or below a bound."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: int(v) for k, v in counts.items() if v > 0}
        self.keys = sorted(self.count)

    def at_most(self, bound: int) -> int | None:
        i = bisect.bisect_right(self.keys, bound)
        return self.keys[i - 1] if i else None

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.keys.pop(bisect.bisect_left(self.keys, length))

    def put(self, length: int, n: int) -> None:
        if length not in self.count:
            bisect.insort(self.keys, length)
        self.count[length] = self.count.get(length, 0) + n

    def smallest(self, k: int) -> int | None:
        """Length of the ``k`` shortest remaining pieces together, None if there are fewer."""
        total = 0
        for key in self.keys:
            n = min(k, self.count[key])
            total, k = total + n * key, k - n
            if not k:
                return total
        return None

    def best_pair(self, room: int) -> int:
        """Length of the longest two pieces that fit in ``room`` together, 0 if none do."""
        best, lo, hi = 0, 0, bisect.bisect_right(self.keys, room) - 1
        while lo <= hi:
            both = self.keys[lo] + self.keys[hi]
            if both <= room:
                if both > best and (lo < hi or self.count[self.keys[lo]] > 1):
                    best = both
                lo += 1
            else:
                hi -= 1
        return best


def solve(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Plan for a histogram of lengths: rows, sequences used, and sequences fixed by the reduction.

    A row (length, first_rank, n_sequences, per_sequence, first_sequence, offset) puts the pieces of that length
    with ranks first_rank .. first_rank + n_sequences * per_sequence - 1, ``per_sequence`` to each of
    ``n_sequences`` consecutive sequences, from ``offset`` on.
    """
    left = _Lengths(counts)
    rank = dict.fromkeys(left.count, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(length: int, n: int, per: int, first: int, offset: int) -> None:
        plan.append((length, rank[length], n, per, first, offset))
        rank[length] += n * per

    # Reduction: lengths in descending order; what no rule covers stays, also as a partner of shorter pieces.
    for j in reversed(left.keys.copy()):
        room = capacity - j
        while n := left.count.get(j, 0):
            left.take(j, 1)  # the rules are about the pieces beside one of length j
            partner, two, three = left.at_most(room), left.smallest(2), left.smallest(3)
            sure = partner is None or partner == room or two is None or two > room or (three is None or three > room) and partner >= left.best_pair(room)
            left.put(j, 1)
            if not sure:
                break
            if partner is None:
                put(j, n, 1, bins, 0)
                left.take(j, n)
                m = n
            elif partner == j:
                m = n // 2
                put(j, m, 2, bins, 0)
                left.take(j, 2 * m)
            else:
                m = min(n, left.count[partner])
                put(j, m, 1, bins, 0)
                put(partner, m, 1, bins, j)
                left.take(j, m)
                left.take(partner, m)
            bins += m
    rest = dict(left.count)
    fixed = bins

    # Best-fit decreasing on runs (first sequence, sequences) by free space.
    runs: dict[int, list[tuple[int, int]]] = {}
    free: list[int] = []  # sorted

    def add(space: int, run: tuple[int, int]) -> None:
        if space not in runs:
            runs[space] = []
            bisect.insort(free, space)
        runs[space].append(run)

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            i = bisect.bisect_left(free, length)
            if i == len(free):
                per = capacity // length
                m, odd = divmod(n, per)
                if m:
                    put(length, m, per, bins, 0)
                    add(capacity - per * length, (bins, m))
                    bins += m
                if odd:
                    put(length, 1, odd, bins, 0)
                    add(capacity - odd * length, (bins, 1))
                    bins += 1
                break
            space = free[i]
            first, size = runs[space].pop()
            if not runs[space]:
                del runs[space]
                free.pop(i)
            per = min(space // length, n)
            m = min(size, n // per)
            put(length, m, per, first, capacity - space)
            n -= m * per
            if space - per * length:
                add(space - per * length, (first, m))
            if m < size:
                add(space, (first + m, size - m))
    return plan, bins, fixed


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello-Toth bound L2: no packing uses fewer sequences."""
    size = np.zeros(capacity + 1, dtype=np.int64)
    for k, v in counts.items():
        size[k] += v
    total = int((np.arange(capacity + 1) * size).sum())
    best = -(-total // capacity)
    weight, number = np.cumsum(np.arange(capacity + 1) * size), np.cumsum(size)
    for k in range(0, capacity // 2 + 1):
        big = int(number[-1] - number[capacity - k])
        mid = int(number[capacity - k] - number[capacity // 2])
        small = int(weight[capacity // 2] - (weight[k - 1] if k else 0))
        spare = mid * capacity - int(weight[capacity - k] - weight[capacity // 2])
        best = max(best, big + mid + max(0, -(-(small - spare) // capacity)))
    return best


def pack(docs: DataFrame, tokenizer: str, separator: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: every sequence holds at most ``capacity`` ids, without gaps from 0."""
    spark = docs.sparkSession
    found = materialize(pieces(docs, tokenizer, separator, capacity, with_ids).withColumn("bucket", F.pmod("doc_key", F.lit(RANK_BUCKETS)).cast("int")), "pieces")
    cells = found.groupBy("length", "bucket").agg(F.count("*").alias("n"))  # at most capacity x RANK_BUCKETS rows
    counts = {int(r["length"]): int(r["n"]) for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _, _ = solve(counts, capacity)
    rows = [(length, first_rank, first_rank + n * per, per, first, offset) for length, first_rank, n, per, first, offset in plan]
    # Each length meets runs of distinct free space, so the plan's size follows from the capacity, not from the input.
    lookup = F.broadcast(spark.createDataFrame(rows, "length long, lo long, hi long, per long, first long, base long"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "doc_key", "piece", "ids_crc32")
    ranked = found.withColumn("r", F.row_number().over(within) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("r") + F.col("ahead"))
    placed = ranked.join(lookup, "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return placed.select(*columns, (F.col("first") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"), (F.col("base") + (step % F.col("per")) * F.col("length")).cast("long").alias("offset"))
