"""Benchmark decontamination by latent semantic retrieval.

Documents are read as sequences of benchmark words (any other word is a gap), in chunks of ``CHUNK`` words. Passages of four
chunks give TF-IDF rows; words in more than ``MAX_DF`` of the passages get no weight. A randomised eigendecomposition of the
passages' Gram matrix, stacked with the benchmark's at equal energy, is computed in one distributed pass (each
partition adds its share of Gram x random matrix; the small factor is solved on the driver by Nystrom's formula), and gives the
latent space. Windows of several lengths, one for each length class of the items, are compared with the items by cosine
and by the share of the item's latent weight that they hold (products are taken by chunk and summed over windows). Candidates are
verified in the words themselves: a window leaks an item if it holds ``LCS`` of its words as a common subsequence, or ``PARAPHRASE`` of
them together with nearly all of the answer (the item's last sentence).

The benchmark is a query set: it is taken in blocks of ``BLOCK_ITEMS`` items, each searched against all documents, so what a task
holds is bounded whatever its size.

Nulls: null and empty texts have no windows; items without a word match nothing. Repeated documents are searched each, repeated items
too. A null identifier is passed through. An empty table on either side gives no rows from ``search``, and
``decontaminate`` returns all documents if there is no benchmark. Extra columns are ignored by ``search`` and kept by
``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of
from .tokens import forget

CHUNK, PASSAGE = 16, 4
MAX_DF = 0.02
RANK, OVERSAMPLE = 192, 32
BLOCK_ITEMS = 4096
#: A candidate has this cosine and this share of the item's latent weight at least.
COSINE, SHARE = 0.3, 0.3
LCS, PARAPHRASE, ANSWER = 0.75, 0.5, 0.9
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKENS = 1 << 16  # words handled at once
_SCORES = 1 << 21  # products of chunks and items held at once
_RUN, _RUNS = 64, 512  # rows of a run that are added one by one, and runs handled at once
_COMMON = 0x20000  # characters of the table


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@cache
def _letters() -> tuple[bytes, np.ndarray]:
    """Each byte of ASCII, and each common character, in lower case; a space for what is of no word, 0 where that takes more than the character."""
    lower = [x if (x := chr(c).lower()).isalnum() or x == "_" else " " if len(x) == 1 else "\0" for c in range(_COMMON)]
    lower[0x3A3] = lower[-1] = "\0"  # a sigma, which has another lower case at the end of a word; what is beyond the table
    return "".join(lower[:128]).encode() + bytes(128), np.array([ord(x) for x in lower], dtype="<u4")


def split_words(text: str) -> list[str]:
    """``words_of`` by a table of characters, which is faster."""
    ascii, common = _letters()
    if text.isascii():
        return text.encode().translate(ascii).decode().split()
    lower = common.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), mode="clip")
    return lower.tobytes().decode("utf-32-le").split() if lower.all() else words_of(text)


def answer_of(text: str) -> list[str]:
    """The last sentence of an item that has at least two words, else all of it."""
    for part in reversed(_SENTENCE.findall(text)):
        if len(words := words_of(part)) > 1:
            return words
    return words_of(text)


def subsequence(pattern: dict[int, int], size: int, codes: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; ``pattern`` has the places of each code as bits."""
    full = (1 << size) - 1
    row = full
    for c in codes:
        if m := pattern.get(c):
            hit = row & m
            row = (row + hit | row - hit) & full
    return size - row.bit_count()


def _pattern(codes: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(codes):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Items:
    """A block of the benchmark: its vocabulary (codes from 1; 0 is a gap) and its items as codes."""

    def __init__(self, rows: list[tuple[int, str]]):
        kept = [(i, words_of(t or ""), answer_of(t or "")) for i, t in rows]
        kept = [x for x in kept if x[1]]
        self.ids = [i for i, _, _ in kept]
        self.vocab = {w: n + 1 for n, w in enumerate(sorted({w for _, ws, _ in kept for w in ws}))}
        self.codes = [[self.vocab[w] for w in ws] for _, ws, _ in kept]
        self.patterns = [_pattern(c) for c in self.codes]
        self.answers = [[self.vocab[w] for w in a] for _, _, a in kept]
        self.answer_patterns = [_pattern(a) for a in self.answers]
        #: Chunks of a window that holds the item, a quarter longer, wherever it begins.
        self.span = [-(-5 * len(c) // (4 * CHUNK)) + 1 for c in self.codes]

    def encode(self, text: str) -> np.ndarray:
        words = split_words(text)
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint32, len(words))


def _codes(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint32)


def _layout(docs: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all documents in a row, the part of ``length`` words that each lies in, and each document's first part (then their number)."""
    sizes = np.array([len(d) for d in docs])
    first = np.concatenate([[0], np.cumsum(-(-sizes // length))])
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(docs), np.repeat(first[:-1], sizes) + place // length, first


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def _sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the ``rows`` of ``table`` in each run, without a copy of them all: the runs' first rows are added, then their second ones, and so on."""
    length = np.diff(np.append(starts, len(rows)))
    if length.max(initial=0) > _RUN:  # long runs are cut
        cuts = np.flatnonzero((np.arange(len(rows)) - np.repeat(starts, length)) % _RUN == 0)
        return np.add.reduceat(_sums(table, rows, cuts), np.searchsorted(cuts, starts), axis=0)
    out = np.empty((len(starts), table.shape[1]), table.dtype)
    total, part = np.empty((2, min(_RUNS, len(starts)), table.shape[1]), table.dtype)
    order = np.argsort(-length)
    for lo in range(0, len(starts), _RUNS):
        runs = order[lo : lo + _RUNS]
        at, sizes = starts[runs], length[runs]
        np.take(table, rows[at], axis=0, out=total[: len(runs)], mode="clip")
        for k in range(1, sizes[0]):
            n = np.searchsorted(-sizes, -k)  # longer than k
            np.take(table, rows[at[:n] + k], axis=0, out=part[:n], mode="clip")
            total[:n] += part[:n]
        out[runs] = total[: len(runs)]
    return out


def _lengths(chunks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lengths of the sums of chunks ``begin`` to ``end``, a bounded number of them at once."""
    out = np.empty(len(begin))
    most = max(1, _TOKENS // max(1, (end - begin).max(initial=1)))
    for lo in range(0, len(begin), most):
        size = (end - begin)[lo : lo + most]
        starts = np.cumsum(size) - size
        rows = np.repeat(begin[lo : lo + most] - starts, size) + np.arange(size.sum())
        out[lo : lo + most] = np.linalg.norm(_sums(chunks, rows, starts), axis=1)
    return out


class Space:
    """The latent space of a block of items: weighted term vectors, and the items in it."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray):
        self.items, self.weighted = items, idf != 0
        self.terms = (idf[:, None] * basis).astype(np.float32)
        vectors = np.stack([self.terms[c].sum(0) for c in items.codes])
        self.norm = np.maximum(1e-6, np.linalg.norm(vectors, axis=1))
        self.unit = (vectors / self.norm[:, None]).astype(np.float32)
        #: An item whose words all lack weight is looked for by its words alone.
        self.plain = [n for n, c in enumerate(items.codes) if not idf[c].any()]

    def search(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(document, item, cosine, share of words, share of answer, first word) of each leak, the best window of each pair."""
        spans = np.array(self.items.span)
        for lo, hi in _pieces([len(d) for d in docs]):
            codes = docs[lo:hi]
            row, part, first = _layout(codes, CHUNK)
            chunks = np.zeros((first[-1], self.terms.shape[1]), np.float32)
            if len(at := np.flatnonzero(self.weighted[row])):
                row, part = row[at], part[at]
                starts = _starts(part)
                chunks[part[starts]] = _sums(self.terms, row, starts)
            best: dict[tuple[int, int], tuple] = {}
            most = max(1, _SCORES // max(1, len(chunks)))
            for span in np.unique(spans):
                which = np.flatnonzero(spans == span)
                for n in range(0, len(which), most):
                    for d, i, a, b, cosine in self._candidates(chunks, first, int(span), which[n : n + most]):
                        self._verify(best, codes, first, d, i, a, b, cosine)
            for n in self.plain:
                for d in range(len(codes)):
                    for a in range(first[d], max(first[d] + 1, first[d + 1] - self.items.span[n] + 1)):
                        self._verify(best, codes, first, d, n, a, min(a + self.items.span[n], first[d + 1]), 0.0)
            for (d, n), (cosine, words, answer, start) in sorted(best.items()):
                yield lo + d, n, cosine, words, answer, int(start)

    def _candidates(self, chunks: np.ndarray, first: np.ndarray, span: int, which: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, item, first chunk, end, cosine) of windows of ``span`` chunks near one of the items ``which``, in order for each item.

        A window's product with an item is the sum of its chunks' products, so its own vector is summed up only where it has the share.
        """
        sums = np.empty((len(which), len(chunks) + 1))
        sums[:, 0] = 0
        np.cumsum(self.unit[which] @ chunks.T, axis=1, dtype=np.float64, out=sums[:, 1:])
        least = (SHARE * self.norm[which])[:, None]
        dots = sums[:, span:] - sums[:, :-span]
        i, begin = np.nonzero(dots >= least)
        dot, doc = dots[i, begin], np.searchsorted(first, begin, side="right") - 1
        inside = begin + span <= first[doc + 1]
        short = np.flatnonzero(np.diff(first) < span)  # documents of one window
        dots = sums[:, first[short + 1]] - sums[:, first[short]]
        j, of = np.nonzero(dots >= least)
        i, dot, doc, begin = (np.concatenate(x) for x in ((i[inside], j), (dot[inside], dots[j, of]), (doc[inside], short[of]), (begin[inside], first[short[of]])))
        windows, at, same = np.unique(begin, return_index=True, return_inverse=True)
        length = _lengths(chunks, windows, np.minimum(windows + span, first[doc[at] + 1]))[same]
        for k in np.flatnonzero((length > 1e-4) & (dot >= COSINE * length)).tolist():
            a, d = int(begin[k]), int(doc[k])
            yield d, int(which[i[k]]), a, min(a + span, int(first[d + 1])), float(dot[k] / length[k])

    def _verify(self, best, codes, first, d, n, a, b, cosine) -> None:
        start = (a - first[d]) * CHUNK
        window = codes[d][start : (b - first[d]) * CHUNK].tolist()
        size, answer = len(self.items.codes[n]), len(self.items.answers[n])
        words = subsequence(self.items.patterns[n], size, window) / size
        if words < PARAPHRASE:
            return
        said = subsequence(self.items.answer_patterns[n], answer, window) / answer
        if (words >= LCS or said >= ANSWER) and ((int(d), n) not in best or words > best[int(d), n][1]):
            best[int(d), n] = (cosine, words, said, start)


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``_TOKENS`` words each."""
    lo = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= _TOKENS:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def fit(encoded: DataFrame, items: Items) -> Space:
    """Document frequencies, then the latent space, from all passages of ``encoded`` (column ``codes``)."""
    size = len(items.vocab) + 1

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            docs = [_codes(v.as_py()) for v in batch.column(0)]
            for lo, hi in _pieces([len(d) for d in docs]):
                codes, row, first = _layout(docs[lo:hi], CHUNK * PASSAGE)
                seen = np.sort((row * size + codes)[codes > 0])
                df += np.bincount(seen[_starts(seen)] % size, minlength=size)
                df[0] += first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(df)], names=["code", "df"])

    got = encoded.mapInArrow(frequencies, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(size)
    for r in got:
        df[r["code"]] = r["df"]
    passages, df[0] = df[0], 0  # code 0 counted every passage
    for c in items.codes:
        df[np.unique(c)] += 1
    passages += len(items.codes)
    idf = np.where(df > max(MAX_DF * passages, len(items.codes) * 0.5), 0, np.log((passages + 1) / (df + 1)))
    idf[0] = 0
    rank = min(RANK, size - 1)
    wide = min(rank + OVERSAMPLE, size)
    random = np.random.default_rng(17).normal(size=(size, wide)).astype(np.float32)
    scaled, square = idf.astype(np.float32)[:, None] * random, (idf**2).astype(np.float32)

    def add(gram: np.ndarray, codes: np.ndarray, row: np.ndarray) -> int:
        """Adds Gram x random of normalised TF-IDF rows, but for a last factor ``idf`` of each code; returns their number."""
        keep = np.flatnonzero(square[codes])
        codes, row = codes[keep], row[keep]
        if not len(codes):
            return 0
        starts = _starts(row)
        projected = _sums(scaled, codes, starts) / np.add.reduceat(square[codes], starts)[:, None]
        order = np.argsort(codes)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))[order]
        cuts = _starts(codes[order])
        gram[codes[order[cuts]]] += _sums(projected, of, cuts)
        return len(starts)

    part = 256  # codes of a block of the Gram product

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, rows = np.zeros((size, wide), np.float32), 0
        for batch in batches:
            docs = [_codes(v.as_py()) for v in batch.column(0)]
            for lo, hi in _pieces([len(d) for d in docs]):
                rows += add(gram, *_layout(docs[lo:hi], CHUNK * PASSAGE)[:2])
        gram *= idf[:, None]
        for n, at in enumerate(range(0, size, part)):
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([gram[at : at + part].tobytes()], pa.binary()), pa.array([rows if n == 0 else 0])], names=["block", "gram", "rows"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            for block, gram, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(gram, np.float32).astype(np.float64)
                rows[block] = rows.get(block, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary()), pa.array(list(rows.values()), pa.int64())], names=["block", "gram", "rows"])

    # Two rounds of sums: tasks of the first meet any number of partitions, those of the second at most eight.
    kinds = "block long, gram binary, rows long"
    parts = encoded.mapInArrow(sketch, kinds).withColumn("salt", F.spark_partition_id() % 8).repartition("block", "salt").drop("salt").mapInArrow(total, kinds)
    gram, rows = np.zeros((size, wide), np.float32), 0
    for r in parts.repartition("block").mapInArrow(total, kinds).collect():
        gram[r["block"] * part : (r["block"] + 1) * part] = np.frombuffer(r["gram"], np.float32).reshape(-1, wide)
        rows += r["rows"]
    own = np.zeros((size, wide), np.float32)
    n = add(own, np.concatenate([np.array(c) for c in items.codes]), np.repeat(np.arange(len(items.codes)), [len(c) for c in items.codes]))
    gram = gram.astype(np.float64) + own * idf[:, None] * max(1.0, rows / max(1, n))
    # Nystrom: M is about G (R'G)^-1 G' for G = M R.
    core = random.T.astype(np.float64) @ gram
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    inverse = np.where(values > values.max() * 1e-7, 1 / np.sqrt(np.maximum(values, 1e-30)), 0)
    u, _, _ = np.linalg.svd(gram @ (vectors * inverse), full_matrices=False)
    return Space(items, idf, u[:, :rank])


def _encode(docs: DataFrame, items: Items) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([items.encode(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["doc_id", "codes"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(read, "doc_id long, codes binary")


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_ITEMS`` items."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    n = -(-rows.count() // BLOCK_ITEMS)
    for b in range(n):
        items = Items([(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()])
        if items.ids:
            yield items


LEAKS = "doc_id long, item_id long, cosine double, lcs double, answer double, start_word long"


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and leaked item: the best window's cosine, shares of words and answer, and its first word."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], LEAKS)
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("start_word", pa.int64())])
    for items in _blocks(benchmark):
        encoded = materialize(_encode(docs, items), "codes")
        space = spark.sparkContext.broadcast(fit(encoded.select("codes"), items))

        def scan(batches: Iterator[pa.RecordBatch], space=space) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], space.value.items.ids[n], *rest) for d, n, *rest in space.value.search([_codes(v.as_py()) for v in batch.column(1)])]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, out, strict=True)], schema=out)

        found = found.unionByName(encoded.mapInArrow(scan, LEAKS))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns kept, that leak no item."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for items in _blocks(benchmark):
        space = spark.sparkContext.broadcast(fit(materialize(_encode(docs, items), "codes").select("codes"), items))

        def clean(batches: Iterator[pa.RecordBatch], space=space) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = [space.value.items.encode(t or "") for t in batch.column(at).to_pylist()]
                leaks = {d for d, *_ in space.value.search(codes)}
                yield batch.filter(pa.array([i not in leaks for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
