"""Exact removal of repeated byte strings, with external induced sorting of suffixes.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller identifier, or same document and earlier
start) is removed; strings are judged on the input and never cross documents.

A suffix tuple for each byte of the corpus would be an order of magnitude more than the corpus, so suffixes are sorted only
where a repeat can begin. Each window of ``length`` bytes has an anchor: its k-gram with the smallest hash, at a place that the
window's bytes alone decide. Equal windows have equal anchors, so documents are cut into contexts, the runs of windows with
one anchor, and:

1. contexts are sent to shards by the anchor's hash. An anchor seen once has no repeated window. Of equal contexts only
   the earliest can keep a byte; contexts are compared by 128 bits of hash. What is left are different contexts with one anchor;
2. the bytes of those contexts are fetched, once for each distinct context, and every shard sorts their suffixes by external
   induced sorting (:mod:`.induced_sort`), which gives each suffix the length of the prefix that it shares with its neighbour.
   Neighbours that share ``length`` bytes are one group, and of a group all windows but the earliest are repeats. A shard
   that exceeds ``BUDGET`` is sorted in files, so it may be far larger than memory;
3. the covered ranges of each document are merged and cut out.

A context that is frequent within a batch is resolved there, so that a passage in a third of all documents reaches its shard once for
each batch. An anchor with very many contexts is split: its windows are dealt by the anchor's place in them, ``STEP`` places together,
and by the bytes that all windows with such places share, so equal windows still meet and no shard holds them all. Which anchors are split
changes no result, so they are those with ``HOT`` contexts or more in every ``SAMPLE``-th document, ``MOST_HOT`` of them at most.

Nulls: a null text has no bytes; a null identifier ranks first. Documents with the same identifier rank by hash of
text, and rows that repeat both are one document with the same result for each row. Very long texts are read in pieces. Of equal
strings in one document the one that starts first stays. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .hashing import every, mix, prefixes, ranges
from .induced_sort import CHUNK, MOST, Space, Tape, scattered, suffixes

LENGTH, GRAM = 100, 32
#: Bytes of corpus for each shard of contexts, and bytes of contexts for each shard of suffixes.
CONTEXT_SHARD, SUFFIX_SHARD = 8 << 20, 2 << 20
#: Bytes of text whose contexts are resolved together before they are sent.
BATCH = 24 << 20
#: Memory of a shard's sort, beyond which it works in files.
BUDGET = 96 << 20
#: Contexts of an anchor, in every so many documents, from which on it is split, and places of the anchor in a window that go together.
HOT, SAMPLE, STEP = 64, 64, 10
MOST_HOT = 1 << 20
NO_ID = -(1 << 63)
_PLACE = np.uint64((1 << 28) - 1)
_SCAN = 1 << 18  # windows scanned at once
CONTEXT = np.dtype([("gram", "<u8"), ("context", "<u8"), ("other", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("lo", "<u4"), ("n", "u1"), ("off", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<u4"), ("end", "<u4")])


def contexts(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """By pieces of a text: hash of the anchor, two of the context, first window, windows, and offset of the anchor in the first window."""
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, _SCAN):
        part = data[at : at + _SCAN + length - 1]
        prefix = prefixes(part)
        grams = every(prefix, gram)
        # The least hash of each window, the leftmost of equal ones: the place is below the hash's upper bits.
        low, done = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * done <= width:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if done < width:
            low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
        anchor = (low & _PLACE).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        hi = np.append(lo[1:], len(anchor))
        place = anchor[lo]
        whole = ranges(prefix, lo, hi - 1 + length)
        halves = ranges(prefix, lo, place) * np.uint64(0x9FB21C651E98DF25) ^ ranges(prefix, place, hi - 1 + length)
        yield grams[place], mix(whole + (place - lo).astype(np.uint64)), mix(halves), lo + at, hi - lo, place - lo


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by context and rank, and for each the number of its context's first row."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    rows = rows[np.lexsort((rows["lo"], rows["key"], rows["doc"], rows["other"], rows["context"], rows["gram"]))]
    new = np.concatenate([[True], (rows["gram"][1:] != rows["gram"][:-1]) | (rows["context"][1:] != rows["context"][:-1]) | (rows["other"][1:] != rows["other"][:-1])])
    return rows, np.flatnonzero(new)[np.cumsum(new) - 1]


def _later(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows that rank after their context's first: a repeated row ranks equal."""
    lead = rows[first]
    return (rows["doc"] != lead["doc"]) | (rows["key"] != lead["key"]) | (rows["lo"] != lead["lo"])


def _covered(rows: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(rows), RANGE)
    out["doc"], out["key"], out["start"], out["end"] = rows["doc"], rows["key"], rows["lo"], rows["lo"] + rows["n"] + np.uint32(length - 1)
    return out


def _send(rows: np.ndarray, length: int, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(shard, contexts, covered ranges) of a batch; the ranges of known repeats go along."""
    if len(rows):
        order = np.argsort(rows["context"], kind="stable")
        same = rows["context"][order][1:] == rows["context"][order][:-1]
        often = np.zeros(len(rows), bool)
        often[order[1:][same]] = often[order[:-1][same]] = True
        some, first = _firsts(rows[often])
        later = _later(some, first)
        ranges_ = _covered(some[later], length)
        rows = np.concatenate([rows[~often], some[first == np.arange(len(some))]])
    else:
        ranges_ = np.empty(0, RANGE)
    shard = (rows["gram"] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    rows, shard = rows[order], shard[order]
    own = (mix(ranges_["key"].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    for s in np.unique(np.concatenate([shard, own])):
        a, b = np.searchsorted(shard, (s, s + 1))
        yield int(s), rows[a:b].tobytes(), ranges_[own == s].tobytes()


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Blobs of each shard, from batches sorted by shard."""
    now, held = None, []
    for batch in batches:
        for shard, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append(blobs)
    if held:
        yield now, held


def _merge(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FOUND = "doc long, key long, start int, end int, gram long"


def _found(ranges_: np.ndarray, asked: np.ndarray | None = None) -> pa.RecordBatch:
    """Covered ranges (``gram`` null), and contexts whose bytes are needed."""
    n, asked = len(ranges_), asked if asked is not None else np.empty(0, CONTEXT)
    nulls = np.concatenate([np.ones(n, bool), np.zeros(len(asked), bool)])
    columns = [
        pa.array(np.concatenate([ranges_["doc"], asked["doc"]]), pa.int64()),
        pa.array(np.concatenate([ranges_["key"], asked["key"]]), pa.int64()),
        pa.array(np.concatenate([ranges_["start"], asked["lo"]]).astype(np.int32), pa.int32()),
        pa.array(np.concatenate([ranges_["end"], asked["lo"] + asked["n"]]).astype(np.int32), pa.int32()),
        pa.array(np.concatenate([np.zeros(n, np.int64), asked["gram"].astype(np.uint64).view(np.int64)]), pa.int64(), mask=nulls),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "key", "start", "end", "gram"])


def split(data: bytes, rows: np.ndarray, length: int) -> np.ndarray:
    """The contexts of hot anchors in parts: windows with the anchor at places that go together, under a hash of the bytes they share."""
    import xxhash

    out = []
    for doc, key, start, windows, off in zip(*(rows[c].tolist() for c in ("doc", "key", "lo", "n", "off")), strict=True):
        anchor = start + off
        for first in range(0, off + 1, STEP):
            lo, hi = max(start, anchor - first - STEP + 1), min(start + windows - 1, anchor - first)
            if lo <= hi:
                shared, whole = data[anchor - first : anchor - first - STEP + 1 + length], data[lo : hi + length]
                out.append((xxhash.xxh3_64_intdigest(shared, first), xxhash.xxh3_64_intdigest(whole, first), xxhash.xxh3_64_intdigest(whole, first + 1000), doc, key, lo, hi - lo + 1, anchor - lo))
    return np.array(out, CONTEXT)


def _hot(rows: DataFrame, length: int, gram: int) -> np.ndarray:
    """Hashes of the anchors to be split, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = [got[0] for value in batch.column(0) for got in contexts(value.as_py(), length, gram)]
            value, n = np.unique(np.concatenate(anchors), return_counts=True) if anchors else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

    some = rows.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(SAMPLE)) == 0).select("data")
    frequent = some.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    return np.sort(np.array([r["gram"] for r in frequent.orderBy(F.desc("n")).limit(MOST_HOT).collect()], np.int64).view(np.uint64))


class Shard:
    """The contexts of a shard, added in rank order, and the windows among them that repeat an earlier one."""

    def __init__(self, length: int, budget: int):
        self.length, self.space = length, Space(budget)
        self.text, self.last = Tape(self.space, np.uint8), (None, None, None)
        self.columns = {c: Tape(self.space, np.int64) for c in ("doc", "key", "lo", "size")}

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows (doc, key, lo, part); a row repeated counts once."""
        doc, key, lo = (batch.column(i).to_numpy() for i in range(3))
        same = np.concatenate([[(doc[0], key[0], lo[0]) == self.last], (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (lo[1:] == lo[:-1])])
        self.last = (doc[-1], key[-1], lo[-1])
        if same.any():
            batch = batch.filter(pa.array(~same))
            doc, key, lo = doc[~same], key[~same], lo[~same]
        part = batch.column(3)
        ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
        if len(part):
            self.text.append(np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]])
            for c, x in (("doc", doc), ("key", key), ("lo", lo), ("size", np.diff(ends))):
                self.columns[c].append(x)

    def repeats(self) -> Iterator[np.ndarray]:
        """Covered ranges, by the sorted suffixes. The data are in rank order, so the least place of a group is the earliest."""
        text, size = self.text.read(), np.asarray(self.columns["size"].read())
        if not len(text):
            return
        first, windows = np.concatenate([[0], np.cumsum(size)]), size - self.length + 1
        repeat = scattered(self.space, len(text) + 1, np.bool_)
        best, carried = -1, MOST
        for places, common in suffixes(text, self.length, space=self.space):
            entry = np.minimum(np.searchsorted(first, places, side="right") - 1, len(size) - 1)
            at = np.flatnonzero(places - first[entry] < windows[entry])
            if not len(at):
                carried = min(carried, int(common.min()))
                continue
            least = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
            least[0] = min(int(least[0]), carried)
            carried = int(common[at[-1] + 1 :].min()) if at[-1] + 1 < len(common) else MOST
            new = least < self.length
            new[0] |= best < 0
            place, heads = places[at], np.flatnonzero(np.concatenate([[True], new[1:]]))
            low = np.minimum.reduceat(place, heads)
            if not new[0]:  # the last piece's group goes on
                repeat[max(best, low[0])] = True
                low[0] = min(best, low[0])
            group = np.cumsum(new) - new[0]
            repeat[place[place != low[group]]] = True
            best = int(low[-1])
        doc, key, lo = (self.columns[c].read() for c in ("doc", "key", "lo"))
        begun = -1
        for a in range(0, len(repeat), CHUNK):
            # Windows that are invalid lie between entries, so a run never crosses one.
            step = np.diff(np.concatenate([[repeat[a - 1] if a else False], repeat[a : a + CHUNK]]).astype(np.int8))
            starts, ends = a + np.flatnonzero(step == 1), a + np.flatnonzero(step == -1)
            if begun >= 0:
                starts = np.concatenate([[begun], starts])
            begun = int(starts[-1]) if len(starts) > len(ends) else -1
            starts = starts[: len(ends)]
            entry = np.searchsorted(first, starts, side="right") - 1
            out = np.empty(len(starts), RANGE)
            out["doc"], out["key"] = doc[entry], key[entry]
            out["start"], out["end"] = starts - first[entry] + lo[entry], ends - first[entry] + lo[entry] + self.length - 1
            yield out


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept``: each document's bytes without those that repeat."""
    spark = docs.sparkSession
    text = text_of(docs)
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("key"), text.cast("binary").alias("data"))
    total = rows.agg(F.sum(F.length("data"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * least, total // CONTEXT_SHARD + 1)

    hot = spark.sparkContext.broadcast(_hot(rows, length, gram))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            sent = list(_send(np.concatenate(held) if held else np.empty(0, CONTEXT), length, shards))
            columns = list(zip(*sent, strict=True)) if sent else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["shard", "contexts", "ranges"])

        for batch in batches:
            for doc, key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = value.as_py()
                for got in contexts(data, length, gram):
                    new = np.empty(len(got[0]), CONTEXT)
                    new["gram"], new["context"], new["other"], new["lo"], new["n"], new["off"] = got
                    new["doc"], new["key"] = doc, key
                    if len(hot.value) and len(new):
                        often = hot.value[np.minimum(np.searchsorted(hot.value, new["gram"]), len(hot.value) - 1)] == new["gram"]
                        if often.any():
                            new = np.concatenate([new[~often], split(data, new[often], length)])
                    held.append(new)
                size += len(data)
                if size > BATCH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_shard(batches):
            known = np.frombuffer(b"".join(b[1] for b in blobs), RANGE)
            all_ = np.frombuffer(b"".join(b[0] for b in blobs), CONTEXT)
            order = np.argsort(all_["gram"], kind="stable")
            value = all_["gram"][order]
            same = value[1:] == value[:-1]
            often = np.zeros(len(all_), bool)
            if len(all_):
                often[order[1:][same]] = often[order[:-1][same]] = True
            some, first = _firsts(all_[often])
            later = _later(some, first)
            lead = some[first == np.arange(len(some))]
            # Anchors with several contexts: their bytes have to be compared.
            several = np.zeros(len(lead), bool)
            if len(lead):
                twin = lead["gram"][1:] == lead["gram"][:-1]
                several[1:] |= twin
                several[:-1] |= twin
            yield _found(np.concatenate([known, _covered(some[later], length)]), lead[several])

    sent = rows.mapInArrow(cut, "shard long, contexts binary, ranges binary")
    found = materialize(sent.repartition(max(least, shards // 4), "shard").sortWithinPartitions("shard").mapInArrow(match, FOUND), "ranges")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zip_.compress(v.as_py()) for v in batch.column(2)], pa.binary())], names=["doc", "key", "z"])

    # Texts are moved compressed, twice: to cut out contexts, and to cut out ranges.
    packed = rows.mapInArrow(squeeze, "doc long, key long, z binary")
    asked = found.where("gram is not null").groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end", "gram")).alias("asked"))
    need = found.where("gram is not null").agg(F.sum(F.col("end") - F.col("start") + (length - 1))).first()[0] or 0
    suffix_shards = max(least, need // SUFFIX_SHARD + 1)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc, key, z, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unzip.decompress(z)
                for a in asked:
                    for c, v in zip(cols, (a["gram"] % suffix_shards, doc, key, a["start"], data[a["start"] : a["end"] + length - 1]), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "doc", "key", "lo", "part"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if of[a] != number:
                    if shard is not None:
                        yield from map(_found, shard.repeats())
                    number, shard = of[a], Shard(length, BUDGET)
                shard.add(batch.slice(a, b - a).drop_columns(["shard"]))
        if shard is not None:
            yield from map(_found, shard.repeats())

    parts = packed.join(asked, ["doc", "key"]).select("doc", "key", "z", "asked").mapInArrow(fetch, "shard long, doc long, key long, lo int, part binary")
    more = parts.repartition(suffix_shards, "shard").sortWithinPartitions("shard", "doc", "key", "lo").mapInArrow(resolve, FOUND)
    gone = found.where("gram is null").unionByName(more).groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.string()), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            result = []
            for doc, z, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = unzip.decompress(z.as_py())
                at, left, spans = 0, [], []
                if gone.is_valid:
                    flat = gone.values
                    spans = _merge(np.stack([flat.field("start").to_numpy(), flat.field("end").to_numpy()], 1))
                for a, b in spans:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                result.append((None if doc == NO_ID else doc, len(data), sum(b - a for a, b in spans), len(spans), ",".join(f"{a}:{b}" for a, b in spans), b"".join(left)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*result, strict=True) if result else [[]] * 6, out, strict=True)], schema=out)

    return packed.join(gone, ["doc", "key"], "left").select("doc", "z", "gone").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, spans string, kept binary")
