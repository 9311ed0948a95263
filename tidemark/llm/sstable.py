"""Token-ID output as sorted-string-table shards.

A shard is one file of documents in key order::

    magic | data block ... | index | Bloom filter | footer (fixed size, at the end)

* key: one null flag byte, the identifier as 8 order-preserving bytes, a 4-byte counter for ties
* data block: entries (shared prefix, rest of key, value) with a restart point every 16 entries, a
  list of restart offsets, then zstd; its CRC-32 is kept in the index
* value: the token ids as 16-bit (vocabularies up to 65536) or 32-bit little-endian integers
* index: last key, offset, length and CRC of each block, for binary search
* Bloom filter over the identifiers, about 1 % false positives

Rows are range-partitioned by identifier (and a hash of the text, so that one repeated identifier
is still spread), sorted, and each partition becomes one shard, written under an attempt-specific name;
only names in the returned manifest count, so retried tasks leave no double output.

Nulls: a null text has no tokens but the end id, a null identifier sorts first. Repeated rows and
repeated identifiers keep one record each. An empty table gives no shard and no row. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, text_of
from .tokens import encoder

MAGIC = b"TMSST01\n"
FOOTER = struct.Struct("<QQQQQQBB")  # index offset, index size, Bloom offset, Bloom size, documents, tokens, bytes per id, Bloom hashes
BLOCK_BYTES = 64 * 1024
RESTART = 16
BLOOM_BITS = 10
BLOOM_HASHES = 7


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def make_key(doc_id: int | None, tie: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", tie)


def key_id(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_probes(ident: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(ident), zlib.crc32(ident, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class SSTableWriter:
    """Writes entries that arrive in key order; ``close`` ends the file and returns (documents, tokens)."""

    def __init__(self, stream, id_bytes: int):
        import zstandard

        self.out, self.id_bytes, self.at = stream, id_bytes, 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.idents: list[bytes] = []
        self.docs = self.tokens = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if self.count % RESTART == 0:
            shared = 0
            self.restarts.append(len(self.block))
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=True)) if x != y), len(key))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1
        if not self.idents or self.idents[-1] != key[:9]:
            self.idents.append(key[:9])
        self.docs += 1
        self.tokens += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.count:
            return
        raw = bytes(self.block) + np.array([*self.restarts, len(self.restarts)], dtype="<u4").tobytes()
        data = self.zip.compress(raw)
        self.index.append((self.last, self.at, len(data), zlib.crc32(data)))
        self._put(data)
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def close(self) -> tuple[int, int]:
        self._flush()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQI", *rest) for k, *rest in self.index)
        bits = max(64, BLOOM_BITS * len(self.idents))
        filled = np.zeros(bits, dtype=bool)
        for ident in self.idents:
            filled[_bloom_probes(ident, bits)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(filled).tobytes()
        at_index, at_bloom = self.at, self.at + len(index)
        self._put(index)
        self._put(bloom)
        self._put(FOOTER.pack(at_index, len(index), at_bloom, len(bloom), self.docs, self.tokens, self.id_bytes, BLOOM_HASHES) + MAGIC)
        return self.docs, self.tokens


class SSTable:
    """Reads one shard: ``get`` looks an identifier up by binary search, ``scan`` gives all entries in order."""

    def __init__(self, uri: str):
        import zstandard

        filesystem, path = _fs(uri)
        self.file = filesystem.open_input_file(path)
        size, tail = self.file.size(), FOOTER.size + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[FOOTER.size :] != MAGIC:
            raise ValueError(f"{uri}: not a complete shard")
        at_index, n_index, at_bloom, n_bloom, self.docs, self.tokens, self.id_bytes, _ = FOOTER.unpack(end[: FOOTER.size])
        raw, at = self.file.read_at(n_index, at_index), 0
        self.last_keys, self.blocks = [], []
        while at < len(raw):
            n = struct.unpack_from("<H", raw, at)[0]
            self.last_keys.append(raw[at + 2 : at + 2 + n])
            self.blocks.append(struct.unpack_from("<QQI", raw, at + 2 + n))
            at += 2 + n + 20
        bloom = self.file.read_at(n_bloom, at_bloom)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.unzip = zstandard.ZstdDecompressor()

    def close(self) -> None:
        self.file.close()

    def _block(self, i: int) -> tuple[bytes, np.ndarray]:
        at, size, crc = self.blocks[i]
        data = self.file.read_at(size, at)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        raw = self.unzip.decompress(data)
        n = int(np.frombuffer(raw[-4:], dtype="<u4")[0])
        return raw[: -4 * (n + 1)], np.frombuffer(raw[-4 * (n + 1) : -4], dtype="<u4")

    @staticmethod
    def _entries(raw: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype="<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            raw, _ = self._block(i)
            for key, value in self._entries(raw, 0):
                yield key_id(key), self._ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """All records of an identifier (several only if it is repeated), or an empty list."""
        first = make_key(doc_id)
        if any(not self.bloom[p >> 3] & (128 >> (p & 7)) for p in _bloom_probes(first[:9], self.bits)):
            return []
        found = []
        for i in range(bisect.bisect_left(self.last_keys, first), len(self.blocks)):
            raw, restarts = self._block(i)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:  # the last restart point at or before the key
                mid = (lo + hi + 1) // 2
                if next(self._entries(raw, int(restarts[mid])))[0] <= first:
                    lo = mid
                else:
                    hi = mid - 1
            for key, value in self._entries(raw, int(restarts[lo])):
                if key[:9] > first[:9]:
                    return found
                if key[:9] == first[:9]:
                    found.append(self._ids(value))
        return found


MANIFEST = "path string, has_null boolean, first_id long, last_id long, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id``, write the shards under ``path``; returns the manifest, one row per shard.

    The manifest has ``first_token``, the number of ids in all shards before it.
    """
    spark = docs.sparkSession
    root = path or scratch_path(spark, "sstable")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        id_bytes = 2 if enc.vocab_size <= 1 << 16 and end_id < 1 << 16 else 4
        tail = np.array([end_id], dtype="<u4").tobytes()
        filesystem, base = _fs(root)
        writer = stream = name = None
        first = last = None
        has_null, tie = False, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    filesystem.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.sst"
                    stream = filesystem.open_output_stream(f"{base}/{name}")
                    writer, first = SSTableWriter(stream, id_bytes), doc_id
                    tie, last = 0, doc_id
                else:
                    tie, last = (tie + 1 if doc_id == last else 0), doc_id
                has_null |= doc_id is None
                ids = enc.encode(text.as_py()) + tail
                writer.add(make_key(doc_id, tie), ids if id_bytes == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes())
        if writer is not None:
            n_docs, n_tokens = writer.close()
            stream.close()
            row = {"path": [f"{root}/{name}"], "has_null": [has_null], "first_id": [first], "last_id": [last], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("path", pa.string()), ("has_null", pa.bool_()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    spread = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("h"))
    manifest = materialize(spread.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("h")).select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")
    # One row per shard: a window over all of it is small. Shards of one repeated identifier are ordered by path.
    before = Window.orderBy(F.desc("has_null"), F.asc_nulls_first("first_id"), F.asc_nulls_first("last_id"), "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read every shard of a manifest back: ``doc_id, start, n_tokens, ids_crc32`` of each document."""
    spark = manifest.sparkSession

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["path"], frame["first_token"], strict=True):
                table, rows, at = SSTable(path), [], int(start)
                for doc_id, ids in table.scan():
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(rows) == 20_000:
                        yield _frame(rows)
                        rows = []
                table.close()
                yield _frame(rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "first_token").repartition(n, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    ids, start, n, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "start": np.array(start, dtype="int64"), "n_tokens": np.array(n, dtype="int64"), "ids_crc32": np.array(crc, dtype="int64")})
