"""Language identification with error-correcting output codes.

Each language has a codeword of ``BITS`` bits, more where there are too many languages for that. A text is a histogram of hashed character 1- to 3-grams over the whole,
lower-cased text, read in pieces however long it is; for every bit a ridge-regularised logistic classifier, trained in numpy, predicts the side its language
lies on. Decoding is loss-weighted: each codeword costs the sum of the logistic losses of its bits against the margins, bits
counting by their training accuracy, and the cheapest wins. The score is the softmax of the negative cost; a text is
``ambiguous`` when the two best scores are close.

The classifier is fitted on about ``per_lang`` training documents of each language (twice that at most), drawn by a hash
of identifier and text; everything else covers all rows. Language, source and identifier are never inputs of a prediction.

Nulls: a null text or one without a letter gets ``und`` and score 0, a document without a language is not trained on, and
with no training rows at all every prediction is ``und``. Of codewords that cost the same the language first by name wins. Empty tables give no rows. Repeated rows are predicted each. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_of

DIM = 4096
BITS = 15
#: Least distance of two codewords.
APART = 3
PER_LANG = 400
#: Two best scores nearer than this are ambiguous.
MARGIN = 0.2
#: Category L alone: numerals and fractions are no letters.
_LETTER = regex.compile(r"\p{L}")
#: Characters hashed at once, so that a very long text needs no more memory than a short one.
_CHUNK = 1 << 18


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams of the whole text."""
    counts = np.zeros(DIM, dtype=np.int64)
    low = " " + text.lower() + " "
    for at in range(0, max(1, len(low) - 2), _CHUNK):
        c = np.frombuffer(low[at : at + _CHUNK + 2].encode("utf-32-le", "replace"), dtype="<u4")
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
        for grams in (c[1:-1], two[:-1], three):
            counts += np.bincount((grams * np.uint32(0xC2B2AE35)) >> np.uint32(20), minlength=DIM)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """``n`` codewords of +1/-1: the best of many random codes by smallest distance, with no constant column.

    There are ``BITS`` bits, or as many more as bring any two codewords ``APART`` bits apart.
    """
    rng, bits, best, far = np.random.default_rng(seed), BITS, None, -1
    while far < min(APART, BITS):
        best, far = None, -1
        for _ in range(300 if n <= 64 else 3):
            code = rng.choice([-1, 1], size=(n, bits))
            if n > 1:
                flat = np.abs(code.sum(0)) == n
                code[0, flat] *= -1
                same = code.astype(np.float32) @ code.T.astype(np.float32)
                np.fill_diagonal(same, -bits)
                apart = int((bits - same.max()) // 2)
            else:
                apart = bits
            if apart > far:
                best, far = code, apart
        bits += 1
    return best.astype(np.float32)


class Codes:
    """The fitted bit classifiers and codewords of a set of languages."""

    def __init__(self, x: np.ndarray, langs: list[str], l2: float = 1e-4, steps: int = 150):
        self.names = sorted(set(langs))
        self.code = codewords(len(self.names))
        y = self.code[[self.names.index(v) for v in langs]]
        share = np.array([langs.count(v) for v in self.names], dtype=np.float32)
        rows = (1 / share)[[self.names.index(v) for v in langs]]
        rows = (rows / rows.sum())[:, None].astype(np.float32)
        self.mean = (x * rows).sum(0)
        z = (x - self.mean) * 20
        bits = self.code.shape[1]
        w, b = np.zeros((DIM, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
        mw = np.zeros_like(w)
        for _ in range(steps):  # full-batch gradient descent with momentum
            g = -y / (1 + np.exp(np.clip(y * (z @ w + b), -30, 30))) * rows
            mw = 0.9 * mw + z.T @ g + l2 * w
            w -= 0.5 * mw
            b -= 0.5 * g.sum(0)
        right = ((y * (z @ w + b) > 0) * rows).sum(0)
        self.weight = np.maximum(0.05, 2 * right - 1).astype(np.float32)  # bits count by how well they can be told
        self.w, self.b = w * 20, b - 20 * (self.mean @ w)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best codeword, its score, and whether the second is near, for rows of features."""
        margin = x @ self.w + self.b
        cost = np.stack([(np.log1p(np.exp(-np.clip(margin * c, -30, 30))) * self.weight).sum(1) for c in self.code], 1)
        p = np.exp(cost.min(1, keepdims=True) - cost)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        near = top[:, -1] - top[:, -2] < MARGIN if p.shape[1] > 1 else np.zeros(len(p), dtype=bool)
        return best, p[np.arange(len(p)), best].astype(float), near


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Codes | None:
    """Fit on about ``per_lang`` documents of each language outside the held-out fold; features are taken on the executors."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["lang", "x"])

    learn = docs["lang"].isNotNull() & (fold(docs["doc_id"]) != 0)
    counts = {r["lang"]: r["n"] for r in docs.where(learn).groupBy(docs["lang"].cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    text, lang = text_of(docs), docs["lang"].cast("string")
    # A hash is uniform, so a cut on it takes about per_lang rows of a language wherever they lie, without sorting.
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_lang / n))])[lang]
    draw = F.pmod(F.xxhash64(docs["doc_id"], text), F.lit(1 << 30)) / float(1 << 30)
    chosen = docs.where(learn & text.rlike("\\p{L}") & (draw < share)).select(lang.alias("lang"), text.alias("text"))
    got = chosen.mapInArrow(extract, "lang string, x binary").limit(2 * per_lang * len(counts)).collect()
    if not got:
        return None
    return Codes(np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got]), [r["lang"] for r in got])


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, per_lang))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes | None = model.value
        for batch in batches:
            lang, score, near = [], [], []
            for at in range(0, batch.num_rows, 256):
                texts = [t.as_py() for t in batch.column(2).slice(at, 256)]
                known = [codes is not None and _LETTER.search(t) is not None for t in texts]
                x = np.stack([features(t) for t, k in zip(texts, known, strict=True) if k]) if any(known) else None
                found = iter(zip(*codes.predict(x), strict=True)) if x is not None else iter(())
                for k in known:
                    i, p, a = next(found) if k else (-1, 0.0, True)
                    lang.append(codes.names[i] if k else "und")
                    score.append(float(p))
                    near.append(bool(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_())], schema=out)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"]) == 0).alias("held_out"), text_of(docs).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
