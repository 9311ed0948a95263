"""Repeated passages, by hashing lines, paragraphs, and runs of words across both.

Units are lines, paragraphs (lines in a row without a blank one between, two at least), and every ``passage_words`` words in a row,
wherever these begin; a unit is normalised (lower case, single spaces) and hashed with 128 bits. Of all
units with one digest, over all documents, the earliest ranked (identifier, hash of text, offset) stays and the others go.
Lines and paragraphs count from ``line_words`` words on: shorter ones are phrases that clean documents share. Removed ranges are given
in code points of the original text; a removed line takes its line feed along. What a document repeats of itself goes only beyond
the end of the earliest.

Runs of words are many, so neighbours go as one where they can: the least hash of ``GRAM`` words in a run marks it (winnowing),
equal runs have equal marks, and the runs in a row with one mark make a stretch, which is one unit. Only where one mark
has different stretches, as at the ends of a torn passage, or a stretch overlaps an equal one, as in text that repeats itself without
end, they are hashed run by run as well: the first of each, and those that overlap. What goes is the same as if all runs were.

A digest may belong to any share of all units, so each Arrow batch first resolves its own: of a batch's units with
one digest only the earliest goes on, and the others are known to be repeats. A frequent line thus reaches its group once
for each batch.

Very long texts are hashed whole, some units at a time. Nulls: a null text is empty. Rows with the same identifier and text rank equal and keep or lose the same ranges; rows
with the same identifier and other texts are ranked by hash of text. A null identifier ranks first. Empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

LINE_WORDS = 15
PASSAGE_WORDS = 50
#: Words of a mark, and the runs whose marks are found at once.
GRAM = 8
_PIECE = 1 << 16
#: Units of one Arrow batch that are resolved together.
_UNITS = 100_000
#: By code point, whether it parts words; the last entry stands for all beyond.
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def units(text: str, line_words: int = LINE_WORDS) -> Iterator[tuple[str, int, int]]:
    """(normalised unit with its kind, start, end) of every line and paragraph that counts."""
    at, block = 0, []
    for line in [*text.split("\n"), ""]:
        words, end = line.lower().split(), min(at + len(line) + 1, len(text))
        if words:
            block.append((words, at, end))
            if len(words) >= line_words:
                yield "l" + " ".join(words), at, end
        else:
            if len(block) > 1 and sum(len(w) for w, _, _ in block) >= line_words:
                yield "q" + " ".join(w for ws, _, _ in block for w in ws), block[0][1], block[-1][2]
            block = []
        at += len(line) + 1


def _edges(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    space = _SPACE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), len(_SPACE) - 1)]
    turns = np.flatnonzero(np.diff(space, prepend=True, append=True))
    return turns[::2], turns[1::2]


def _least(words: list[str], passage_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By pieces: the first run's place, each run's place of its least gram, and that gram's hash."""
    import xxhash

    gram = min(GRAM, passage_words)
    for at in range(0, len(words) - passage_words + 1, _PIECE):
        part = words[at : at + _PIECE + passage_words - 1]
        one = np.fromiter(map(xxhash.xxh3_64_intdigest, part), dtype=np.uint64, count=len(part))
        n = len(part) - gram + 1
        h = np.zeros(n, dtype=np.uint64)
        for i in range(gram):
            h = h * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        least = np.lib.stride_tricks.sliding_window_view(h, passage_words - gram + 1).argmin(1)
        least += np.arange(len(least))
        yield at, at + least, h[least].view(np.int64)


def stretches(text: str, passage_words: int = PASSAGE_WORDS) -> Iterator[tuple[str, int, int, int]]:
    """(normalised unit with its kind, start, end, hash of the mark) of the stretches of runs with one mark."""
    words = text.lower().split()
    if len(words) < passage_words:
        return
    starts, ends = _edges(text)
    for at, places, hashes in _least(words, passage_words):
        new = np.flatnonzero(np.diff(places, prepend=-1))
        first, last = at + new, at + np.append(new[1:], len(places)) + passage_words - 1
        for i, j, a, b, h in zip(first.tolist(), last.tolist(), starts[first].tolist(), ends[last - 1].tolist(), hashes[new].tolist(), strict=True):
            yield "r" + " ".join(words[i:j]), a, b, h


def passages(text: str, torn: list, passage_words: int = PASSAGE_WORDS) -> Iterator[tuple[str, int, int]]:
    """(normalised unit with its kind, start, end) of every run of ``passage_words`` words in the ranges ``torn``, each once."""
    last = -1
    for a, b in sorted((t["start"], t["end"]) for t in torn):
        words = text[a:b].lower().split()
        starts, ends = ((a + e).tolist() for e in _edges(text[a:b]))
        for i in range(len(words) - passage_words + 1):
            if starts[i] > last:
                last = starts[i]
                yield "p" + " ".join(words[i : i + passage_words]), last, ends[i + passage_words - 1]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, line_words: int = LINE_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``doc_id, n_chars, n_removed, n_spans, spans, text``: each document without its repeated units."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    out = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("alone", pa.bool_()), ("torn", pa.bool_()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen: dict[bytes, tuple] = {}
            marks: dict[int, int] = {}
            cols: list[list] = [[] for _ in out]
            last = None
            for i in sorted(range(len(ids)), key=lambda j: (ids[j] is not None, ids[j] or 0, keys[j])):
                same = (ids[i], keys[i]) == last  # a repeated row: its units are the row's before it, at equal rank
                last = (ids[i], keys[i])
                if same:
                    continue
                text = batch.column(2)[i].as_py()
                found = passages(text, batch.column(3)[i].as_py(), passage_words) if batch.num_columns > 3 else chain(units(text, line_words), stretches(text, passage_words))
                for unit, start, end, *mark in found:
                    digest = xxhash.xxh3_128_digest(unit)
                    first = seen.setdefault(digest, (i, start, end, len(cols[0])))
                    repeat = first != (i, start, end, len(cols[0]))
                    laps = bool(mark) and repeat and first[0] == i and start < first[2]
                    if laps:  # it and the first are read run by run
                        cols[3][first[3]] = True
                    elif repeat and first[0] == i:  # the document's own: the earliest stays whole
                        start = max(start, first[2])
                    h, g = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    torn = laps
                    if mark:
                        h = mark[0]
                        if not repeat and (torn := (row := marks.setdefault(h, len(cols[0]))) != len(cols[0])):
                            cols[3][row] = True
                    # A known repeat, or a second stretch of a mark, needs no group; it is spread by its place instead.
                    alone = repeat or torn
                    for c, v in zip(cols, (h ^ hash((keys[i], start)) if alone else h, g, alone, torn, ids[i], keys[i], start, end), strict=True):
                        c.append(v)
                    if len(cols[0]) >= _UNITS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)
                        seen, marks, cols = {}, {}, [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    place = [F.col("doc_id").isNotNull().alias("known"), "doc_id", "key", "start"]

    after = F.struct(*place) > F.struct(*[f"first.{c}" for c in ("known", "doc_id", "key", "start")])
    own = ~F.col("alone") & F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key") == F.col("key"))
    laps = own & after & (F.col("start") < F.col("first.end"))

    def grouped(found: DataFrame) -> DataFrame:
        """With the first of each digest. Dealt by mark, which serves digests too, and is their order's beginning."""
        digest = Window.partitionBy("h", "alone", "g")
        return found.repartition("h", "alone").withColumn("first", F.min(F.struct(*place, "end")).over(digest))

    def marked(rows: DataFrame) -> DataFrame:
        """With whether the mark has other stretches or overlapping ones."""
        mark = Window.partitionBy("h", "alone")
        rows = rows.withColumn("laps", laps)
        return rows.withColumn("torn", F.max(F.col("torn") | F.col("laps")).over(mark) | (F.min("g").over(mark) < F.max("g").over(mark)))

    def later(found: DataFrame) -> DataFrame:
        start = F.when(own, F.greatest("start", "first.end")).otherwise(F.col("start"))
        return found.where(F.when(F.col("alone"), ~F.col("torn")).otherwise(after & ~F.col("laps"))).select("doc_id", "key", start.alias("start"), "end").where("start < end")

    def of(other: DataFrame) -> Column:
        return rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["key"] == other["key"])

    ranges = F.collect_list(F.struct("start", "end"))  # a document's own
    schema = "h long, g long, alone boolean, torn boolean, doc_id long, key long, start long, end long"
    whole = marked(grouped(rows.mapInArrow(digests, schema)))
    torn = whole.where(F.when(F.col("alone"), F.col("torn")).otherwise(F.col("torn") & ~after | F.col("laps"))).groupBy("doc_id", "key").agg(ranges.alias("torn"))
    runs = grouped(rows.join(torn, of(torn)).select(rows["doc_id"], rows["key"], "text", torn["torn"]).mapInArrow(digests, schema)).withColumn("laps", F.lit(False))
    gone = later(whole).unionByName(later(runs)).groupBy("doc_id", "key").agg(ranges.alias("gone"))
    joined = rows.join(gone, of(gone), "left").select(rows["doc_id"], "text", F.col("gone.start").alias("starts"), F.col("gone.end").alias("ends"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            result = []
            for doc_id, text, starts, ends in zip(frame["doc_id"].astype("Int64"), frame["text"], frame["starts"], frame["ends"], strict=True):
                spans = merge([(int(a), int(b)) for a, b in zip(starts, ends, strict=True)]) if starts is not None else []
                at, left = 0, []
                for a, b in spans:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                result.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), ",".join(f"{a}:{b}" for a, b in spans), "".join(left)))
            yield pd.DataFrame(result, columns=["doc_id", "n_chars", "n_removed", "n_spans", "spans", "text"]).astype({"doc_id": "Int64"})

    return joined.mapInPandas(cut, "doc_id long, n_chars long, n_removed long, n_spans long, spans string, text string")
