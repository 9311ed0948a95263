"""Near-duplicate texts: Jaccard join on word 5-grams with Bayesian candidate pruning (BayesLSH).

1. Each text becomes a set of hashed shingles of five lower-cased words (a shorter text is one shingle) and 100 MinHash
   values. Texts with the same words are one class and go on as one representative; copies are never paired.
2. Representatives that agree on any of 25 bands of four values meet in a bucket. There their values are compared 20 at a
   time; with a flat prior, the posterior probability of similarity >= t after m of n agreements is a binomial
   tail, and a pair goes when it falls below ``tolerance``. What a bucket returns is a spanning forest of the survivors.
3. Connected survivors form clusters; their texts are fetched once and all pairs of a cluster are verified exactly, by counting
   common shingles. Large buckets and clusters are split into blocks, each task compares two blocks, and
   pairs never leave a task: it returns link counts for each text and a spanning forest.
4. Components of the verified links are the classes.

At similarity 0.8 a pair shares no band with probability 2e-6, and is pruned wrongly with one of the order of ``tolerance``.

A band, cluster, class or copied text that a third of all rows have is dealt in parts wherever rows meet it. Texts of clusters are
found by hashes of their rows, through a bit map of bounded size, so other texts are not moved.

Very long texts are hashed whole; a text with more shingles than a block makes a block alone. Of equal classes the smallest identifier names
one, and of rows with equal words any row's text serves. Nulls: null and blank texts have no shingle, so they stand alone. Repeated rows and texts with the same words are copies, linked to
each other. A null identifier takes part; class identifiers are the smallest non-null ones. Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join, text_of
from .components import components
from .hashing import mix, prefixes, ranges
from .tokens import forget

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 4
HASHES = BANDS * ROWS
STEP = 20
#: Members of a bucket compared in one task with as many others, and shingles of a block of a cluster.
BUCKET_BLOCK = 1024
CLUSTER_BLOCK = 250_000
#: Bits of the map of wanted rows: 262,144 words of it are broadcast at most.
BITS = 1 << 24
_A = (np.random.default_rng(9).integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = np.random.default_rng(10).integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()


def shingles(words: list[str]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    data = " ".join(words).encode("utf-8", "replace")
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    k = min(SHINGLE, len(starts))
    return np.unique(ranges(prefixes(data), starts[: len(starts) - k + 1], ends[k - 1 :]))


def minhash(values: np.ndarray) -> np.ndarray:
    low, out = (values >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        out = np.minimum(out, (low[at : at + 4096, None] * _A + _B).min(0))
    return out


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, agreements needed to go on): fewer leave a posterior below the tolerance.

    Values are compared by 8 bits, so unequal ones agree by chance once in 256. With a flat prior the posterior of a rate
    of at least r after m of n is P(Binomial(n + 1, r) <= m).
    """
    rate, out = threshold + (1 - threshold) / 256, []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * rate**m * (1 - rate) ** (n + 1 - m)
        out.append((n, m))
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, root) that join what the pairs (a, b) join."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (deep := new[new]).tolist() != new.tolist():
            new = deep
        new = new[root]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(group)


def _blocked(df: DataFrame, key: str, block, total) -> DataFrame:
    """Each row once for every pair of blocks it belongs to: columns ``i`` <= ``j`` and its own ``block``."""
    others = F.transform(F.sequence(F.lit(0), total - 1), lambda o: F.struct(F.least(o, block).alias("i"), F.greatest(o, block).alias("j")))
    return df.withColumn("block", block).withColumn("pair", F.explode(others)).select(key, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), *[c for c in df.columns if c != key], "block")


def _row_keys(docs: DataFrame) -> list:
    """128 bits, as two hashes, of identifier and text."""
    parts = (docs["doc_id"].cast("long"), text_of(docs))
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2`` (hashes of the row), ``digest, n`` (distinct shingles) and ``sig`` (MinHash values) of every document."""
    out = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("sig", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            cols: list[list] = [[], [], []]
            for text in batch.column(3):
                words = words_of(text.as_py())
                values = shingles(words)
                cols[0].append(digest(words))
                cols[1].append(len(values))
                cols[2].append(minhash(values).tobytes() if len(values) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], schema=out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_row_keys(docs), text_of(docs).alias("text")).mapInArrow(read, "doc_id long, k1 long, k2 long, digest binary, n int, sig binary")


def survivors(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) between digests: in each bucket a spanning forest of the pairs that pruning leaves."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = tag[None, :] + np.zeros((len(sig), 1), np.uint64)
            for r in range(ROWS):
                key = mix(key ^ sig[:, :, r])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))], names=["digest", "bands"])

    banded = reps.select("digest", "sig").mapInArrow(bands, "digest binary, bands array<long>").select("digest", F.explode("bands").alias("band"))
    counts = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = materialize(spread_join(banded, counts, "band", "size", BANDS * reps.count()), "buckets")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], names=["digest", "low"])

    low = reps.select("digest", "sig").mapInArrow(short, "digest binary, low binary")
    rows = met.join(low, "digest").select("band", "digest", "size", "low")
    total = F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")
    blocks = _blocked(rows, "band", F.pmod(F.xxhash64("digest"), total.cast("long")).cast("int"), total).select("band", "i", "j", "block", "digest", "low")
    needed = least_matches(threshold, tolerance)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        cols: list[list] = [[], []]
        for (_, i, j), group in _grouped(batches, 3):
            ids, block = [r[4] for r in group], np.array([r[3] for r in group])
            low = np.frombuffer(b"".join(r[5] for r in group), np.uint8).reshape(len(group), HASHES)
            if i == j:
                a, b = np.triu_indices(len(group), 1)
            else:
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                a, b = np.repeat(left, len(right)), np.tile(right, len(left))
            agree = np.zeros(len(a), np.int32)
            for n, least in needed:
                for h in range(n - STEP, n):
                    agree += low[a, h] == low[b, h]
                go = agree >= least
                a, b, agree = a[go], b[go], agree[go]
            member, root = forest(len(group), a, b)
            cols[0] += [ids[x] for x in member]
            cols[1] += [ids[x] for x in root]
            if len(cols[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["a", "b"])
                cols = [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["a", "b"])

    return blocks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(prune, "a binary, b binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of each left and each right set, by products of incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    lv, rv = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lv, rv)
    lrow, rrow = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    lat, rat = np.searchsorted(shared, lv), np.searchsorted(shared, rv)
    lok, rok = lat < len(shared), rat < len(shared)
    lok[lok] = shared[lat[lok]] == lv[lok]
    rok[rok] = shared[rat[rok]] == rv[rok]
    lrow, lat, rrow, rat = lrow[lok], lat[lok], rrow[rok], rat[rok]
    lo, ro = np.argsort(lat, kind="stable"), np.argsort(rat, kind="stable")
    lrow, lat, rrow, rat = lrow[lo], lat[lo], rrow[ro], rat[ro]
    width = 2048
    for at in range(0, len(shared), width):
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        s, e = np.searchsorted(lat, (at, at + width))
        x[lrow[s:e], lat[s:e] - at] = 1
        s, e = np.searchsorted(rat, (at, at + width))
        y[rrow[s:e], rat[s:e] - at] = 1
        out += x @ y.T
    return out


def _some(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``k1`` may be wanted: a bit map of BITS hashed keys, which is all that is broadcast."""
    place = F.pmod(F.xxhash64("k1"), F.lit(BITS))
    word, bit = F.shiftright(place, 6).alias("_word"), F.pmod(place, F.lit(64)).cast("int")
    bits = wanted.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    kept = rows.withColumns({"_word": F.shiftright(place, 6), "_bit": bit}).join(F.broadcast(bits), "_word")
    return kept.where(F.getbit("_bits", F.col("_bit")) == 1).drop("_word", "_bit", "_bits")


def _joined(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """The columns of ``join``, the hashes of the row, and ``class_key`` (null for texts without words)."""
    table = materialize(sketch(docs), "sketch")
    classes = table.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("copy_id"), F.count("*").alias("members"), F.min(F.struct("k1", "k2")).alias("row"))
    reps = materialize(classes, "classes")
    clusters = components(survivors(reps, threshold, tolerance))

    # Blocks of a cluster hold about CLUSTER_BLOCK shingles each; texts are dealt to them by hash.
    n_reps = reps.count()
    placed = clusters.select(F.col("node").alias("digest"), "root").join(reps.select("digest", "n", "members", "row"), "digest")
    totals = placed.groupBy("root").agg(F.ceil(F.sum(F.col("n").cast("long")) / CLUSTER_BLOCK).cast("int").alias("total"), F.count("*").alias("texts"))
    wanted = spread_join(placed, totals, "root", "texts", n_reps).select("digest", "root", "members", F.pmod(F.xxhash64("digest"), F.col("total").cast("long")).cast("int").alias("own"), "total", "row.k1", "row.k2")
    fetched = _some(docs.select(*_row_keys(docs), text_of(docs).alias("text")), wanted).join(wanted, ["k1", "k2"])
    blocks = _blocked(fetched.select("root", "own", "total", "digest", "members", "text"), "root", F.col("own"), F.col("total"))
    blocks = blocks.select("root", "i", "j", "block", "digest", "members", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in _grouped(batches, 3):
            # The same copy may come from several rows; one of each digest counts.
            rows = list({r[4]: r for r in group}.values())
            sets = [shingles(words_of(r[6])) for r in rows]
            block, size = np.array([r[3] for r in rows]), np.array([len(s) for s in sets])
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            both = common_counts([sets[x] for x in left], [sets[x] for x in right])
            linked = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-6
            if i == j:
                np.fill_diagonal(linked, False)
            weight = np.array([r[5] for r in rows])
            links = np.zeros(len(rows), np.int64)
            links[left] += linked @ weight[right]
            if i != j:
                links[right] += linked.T @ weight[left]
            x, y = np.nonzero(linked)
            member, root = forest(len(rows), left[x], right[y])
            at = dict(zip(member.tolist(), root.tolist(), strict=True))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([rows[k][4] for k in some], pa.binary()), pa.array([rows[at.get(k, k)][4] for k in some], pa.binary()), pa.array(links[some], pa.int64())], names=["a", "b", "links"])

    verified = materialize(blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(verify, "a binary, b binary, links long"), "links")
    links = verified.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    roots = components(verified.select("a", "b")).select(F.col("node").alias("digest"), "root")
    named = reps.select("digest", "copy_id", "members").join(links, "digest", "left").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    first = named.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("texts"))
    info = spread_join(named, first, "root", "texts", n_reps).select("digest", F.col("root").alias("class_key"), "class_id", "copy_id", "members", F.coalesce("links", F.lit(0)).alias("links"))
    own = table.select("doc_id", "k1", "k2", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    alone = F.col("digest").isNull()
    return spread_join(own, info, "digest", "members", table.count(), "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("members", F.lit(1)) - 1).cast("long").alias("n_links"),
        "k1",
        "k2",
        "class_key",
    )


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = 1e-7) -> DataFrame:
    """``doc_id, class_id, copy_id, n_copies, n_links`` of every document.

    ``class_id`` is the smallest identifier of the documents that links connect, ``copy_id`` that of the copies, and
    ``n_links`` the number of other documents at similarity ``threshold`` or more, copies included.
    """
    return _joined(docs, threshold, tolerance).drop("k1", "k2", "class_key")


def unique(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = 1e-7) -> DataFrame:
    """The documents, all columns kept, without near duplicates: of each class the row with the smallest identifier stays.

    Texts without words are no duplicates of each other and stay; of rows that repeat both identifier and text one stays.
    A class without an identifier keeps the row with the smallest hash.
    """
    names = docs.columns
    found = _joined(docs, threshold, tolerance)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("r")
    # Minima are pre-aggregated, so a class of any size is no single group.
    keys = found.where("class_key is not null").groupBy("class_key").agg(first).select("r.k1", "r.k2")
    keys = keys.unionByName(found.where("class_key is null").select("k1", "k2").distinct())
    rows = docs.select(*[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(names)], *_row_keys(docs))
    one = rows.join(keys, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return one.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)])
