"""Toxicity by a weighted finite-state pattern grammar.

A cascade of weighted transducers reads a clause, each the marks that the one before writes:

1. the lexicon turns words into classes (insult, threat, target, negation, reported speech, other); the arc of an insult or a
   threat weighs its log odds;
2. negation turns insults and threats within its scope into negated ones;
3. reported speech turns those after it into quoted ones;
4. aim joins insults and threats with targets. A target may come afterwards, so the machine guesses: a path that has promised one
   and does not meet it in time is no path.

The machines are composed into one by matching what one writes with what the next reads, and the heaviest path of a clause counts
(sums along a path, the maximum over paths). A clause's evidence is the lexical weight that its path carries, kept apart by mark. A document's
score is a logistic function of the summed evidence, with weights for each mark learned from labels, so negated or quoted insults count
as the labels say they do, and words outside a matched clause count nothing.

The insult lexicon is learned from labelled rows outside the held-out fold: word beginnings that mark toxic documents with
high precision and beyond chance, each as long as it can be without losing support; the weights are their log odds. One half of
a sample of about ``sample`` toxic rows and ``CLEAN_RATIO`` times as many others (twice that at most) gives the lexicon, the other the
logistic weights; a small sample gives both. Labels, language,
source and identifier are never inputs of a score.

A word that begins with a threat is one, at the weight that the labels give it, if they give it one. Of paths of equal weight the one
that promises nothing counts. Clauses are read as streams, however long.

Nulls: a null text is empty, and an empty text gets the score of no evidence. Rows with a null label are not learned from;
without usable labels nothing is toxic. Repeated rows are scored each; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_of
from .tokens import forget

SAMPLE = 4000
#: Clean documents are drawn this many times as often, and with fewer toxic ones than this both steps learn from all of the sample.
CLEAN_RATIO, FEW = 4, 400
#: A word beginning enters the lexicon with this precision at equal class sizes, if so many of its documents would be toxic by
#: chance, at the sample's share of toxic ones, with a probability below CHANCE. Fewer than SUPPORT documents are not counted.
SUPPORT, PRECISION, CHANCE = 6, 0.9, 1e-7
PREFIX_CHARS = range(4, 17)

# Closed word classes of the grammar, by language.
TARGETS = ["you", "your", "yourself", "he", "she", "they", "them", "him", "her", "people", "tu", "toi", "vous", "ils", "elles", "lui", "du", "dich", "dir", "ihr", "euch", "sie", "ihn", "usted", "ustedes", "ti", "te", "ellos", "ellas"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "don't", "without", "pas", "jamais", "ne", "nicht", "kein", "keine", "nie", "nunca", "ni", "sin"]
REPORTS = ["said", "says", "wrote", "writes", "called", "calls", "claimed", "quote", "quoted", "reported", "dit", "disait", "sagte", "sagt", "schrieb", "dijo", "dice"]
THREATS = ["kill", "hurt", "murder", "destroy", "attack", "stab", "shoot", "strangle", "tuer", "frapper", "töten", "umbringen", "schlagen", "matar", "golpear"]
NEAR = 3  # words between an insult or threat and its target
SCOPE = 3  # words that a negation reaches

# What the lexicon writes, and what the machines after it write besides.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, NEGATED_INSULT, NEGATED_THREAT, QUOTED_INSULT, QUOTED_THREAT = range(10)
CLASSES = 6
MARKS = ("plain", "aimed", "negated", "reported", "threat")
PLAIN, AIMED, NEGATED, REPORTED, THREATENED = range(len(MARKS))
#: What a path gains with a mark, beside the lexical weight.
GAIN = {PLAIN: 0.0, AIMED: 1.0, NEGATED: -1.0, REPORTED: -1.0, THREATENED: 1.0}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:|\n]")
_CLASS = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(THREATS, THREAT)


class Transducer:
    """A weighted transducer with one symbol out for each one in: ``arcs(state, symbol)`` gives (next state, written symbol, weight)."""

    def __init__(self, start, arcs, accepts=lambda state: True):
        self.start, self.arcs, self.accepts = start, arcs, accepts

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes; weights add."""

        def arcs(state, symbol):
            return [((p, q), out, u + v) for p, between, u in self.arcs(state[0], symbol) for q, out, v in other.arcs(state[1], between)]

        return Transducer((self.start, other.start), arcs, lambda s: self.accepts(s[0]) and other.accepts(s[1]))

    def compile(self, symbols: int) -> tuple[list[list[list[tuple]]], list[bool]]:
        """Arcs of the reachable states, by state and symbol, with states as numbers from 0; and which states accept."""
        number, todo, table = {self.start: 0}, [self.start], []
        while len(table) < len(todo):
            row = []
            for symbol in range(symbols):
                found = []
                for state, out, weight in self.arcs(todo[len(table)], symbol):
                    if state not in number:
                        number[state] = len(todo)
                        todo.append(state)
                    found.append((number[state], out, weight))
                row.append(found)
            table.append(row)
        return table, [self.accepts(s) for s in todo]


def negation() -> Transducer:
    """Its state is the number of words that the last negation still reaches."""
    negated = {INSULT: NEGATED_INSULT, THREAT: NEGATED_THREAT}

    def arcs(left, word):
        out = OTHER if word == NEGATION else negated.get(word, word) if left else word
        return [(SCOPE if word == NEGATION else max(0, left - 1), out, 0.0)]

    return Transducer(0, arcs)


def report() -> Transducer:
    """Its state is whether a clause has turned to what somebody said."""
    quoted = {INSULT: QUOTED_INSULT, THREAT: QUOTED_THREAT, NEGATED_INSULT: QUOTED_INSULT, NEGATED_THREAT: QUOTED_THREAT}
    return Transducer(0, lambda said, word: [(int(said or word == REPORT), OTHER if word == REPORT else quoted.get(word, word) if said else word, 0.0)])


def aim() -> Transducer:
    """Its state is (words that the last target still reaches, words within which a promised target must come; 0: none).

    Writes a mark, or None for a word without one.
    """

    def arcs(state, word):
        reach, due = state
        if word == TARGET:
            return [((NEAR, 0), None, 0.0)]
        if due == 1:
            return []  # the promise is broken
        after = (max(0, reach - 1), max(0, due - 1))
        promise = (after[0], min(NEAR, after[1] or NEAR))
        if word in (NEGATED_INSULT, QUOTED_INSULT):
            mark = NEGATED if word == NEGATED_INSULT else REPORTED
            return [(after, mark, GAIN[mark])]
        if word not in (INSULT, THREAT):
            return [(after, None, 0.0)]
        near, far = (AIMED, PLAIN) if word == INSULT else (THREATENED, None)
        if reach:
            return [(after, near, GAIN[near])]
        return [(after, far, GAIN.get(far, 0.0)), (promise, near, GAIN[near])]

    return Transducer((0, 0), arcs, lambda state: not state[1])


def grammar() -> Transducer:
    return negation() @ report() @ aim()


_THREATS = frozenset(THREATS)


class Grammar:
    """The compiled grammar with a lexicon of insult beginnings and their weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.arcs, self.accepts = grammar().compile(CLASSES)
        self.longest = max(map(len, lexicon), default=0)
        self.shortest = min(map(len, lexicon), default=0)
        self.automaton = None

    def _search(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word in (*self.lexicon, *THREATS):
                self.automaton.add_word(word, len(word))
            self.automaton.make_automaton()
        return self.automaton

    def read(self, word: str) -> tuple[int, float]:
        """The lexicon's arc for a word: its class and weight."""
        for n in range(self.shortest, min(self.longest, len(word)) + 1):
            if (w := self.lexicon.get(word[:n])) is not None:
                return THREAT if word in _THREATS else INSULT, w
        kind = _CLASS.get(word, OTHER)
        return kind, 1.0 if kind == THREAT else 0.0

    def clause(self, words: Iterable[str]) -> np.ndarray:
        """The evidence of a clause's heaviest path by mark. Of each state only the heaviest way there goes on."""
        none = (0.0,) * len(MARKS)
        ways = {0: (0.0, none)}
        for word in words:
            kind, lexical = self.read(word)
            new: dict[int, tuple] = {}
            for state, (total, found) in ways.items():
                for to, mark, gain in self.arcs[state][kind]:
                    if mark is None:
                        weight, marked = total + gain, found
                    else:
                        weight = total + gain + lexical
                        marked = (*found[:mark], found[mark] + lexical, *found[mark + 1 :])
                    if to not in new or weight > new[to][0]:
                        new[to] = (weight, marked)
            ways = new
        return np.array(max((way for state, way in ways.items() if self.accepts[state]), key=lambda way: way[0])[1])

    def evidence(self, text: str) -> np.ndarray:
        """Clause weights of the whole text; clauses without an insult or threat weigh nothing and are passed over."""
        low, out, done = text.lower(), np.zeros(len(MARKS)), -1
        for end, size in self._search().iter(low):
            begin = end - size + 1
            if begin < done or (begin and low[begin - 1].isalpha()):
                continue
            lo = max(done, 0)  # the clause of a hit starts after the last one's and is read once, as a stream
            for m in _CLAUSE_END.finditer(low, lo, begin):
                lo = m.end()
            after = _CLAUSE_END.search(low, end + 1)
            done = after.start() if after else len(low)
            out += self.clause(m.group() for m in _WORD.finditer(low, lo, done))
        return out


def _spread(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log1p(x), x > 0], axis=-1)


class Model:
    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, bias: float):
        self.grammar, self.weights, self.bias = Grammar(lexicon), weights, bias

    def score(self, text: str) -> float:
        z = float(_spread(self.grammar.evidence(text)) @ self.weights) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _by_chance(one: int, zero: int, share: float) -> float:
    """Probability that at least ``one`` of ``one + zero`` documents are toxic."""
    n = one + zero
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)) for i in range(one, n + 1))


def lexicon_of(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Precise beginnings, of nested ones the longest that keeps nine tenths of the support."""
    odds = {}
    for prefix, (one, zero) in counts.items():
        rate1, rate0 = (one + 0.5) / (n_toxic + 1), (zero + 0.5) / (n_clean + 1)
        if one >= SUPPORT and zero <= 0.1 * one and rate1 / (rate1 + rate0) >= PRECISION and _by_chance(one, zero, n_toxic / (n_toxic + n_clean)) <= CHANCE:
            odds[prefix] = math.log(rate1 / rate0)
    kept: dict[str, float] = {}
    for prefix in sorted(odds, key=len):
        if any(prefix[:n] in kept for n in PREFIX_CHARS if n < len(prefix)):
            continue
        best = prefix
        while longer := [p for p in odds if len(p) == len(best) + 1 and p.startswith(best) and counts[p][0] >= 0.9 * counts[prefix][0]]:
            best = longer[0]
        if not any(best.startswith(k) for k in kept):
            kept[best] = odds[best]
    return kept


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Logistic regression; evidence can only raise a score, so negative weights are held at 0."""
    z = _spread(x)
    w, b = np.zeros(z.shape[1]), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        g = p - y
        w = np.maximum(0, w - 0.5 * (z.T @ g / len(y) + 1e-4 * w))
        b -= 0.5 * g.mean()
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    usable = labels.where(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull() & (fold(labels["doc_id"]) != 0)).select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model({}, np.zeros(2 * len(MARKS)), -5.0)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = {1: min(1.0, sample / n[1]), 0: min(1.0, CLEAN_RATIO * sample / n[0])}
    share = F.when(F.col("toxic") == 1, taken[1]).otherwise(taken[0])
    # A number of rows that does not follow the labels', with a limit at twice that: small enough to broadcast.
    chosen = usable.where(draw < share).withColumn("half", (F.floor(draw * float(1 << 30)) % 2).cast("int")).limit(2 * (1 + CLEAN_RATIO) * sample)
    first, second = ("half = 0", "half = 1") if n[1] * taken[1] >= FEW else ("true", "true")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "half", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        size = [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = set(_WORD.findall(text.as_py().lower()))
                seen[toxic].update({w[:k] for w in words for k in PREFIX_CHARS if k <= len(w)} | {w for w in words if len(w) < PREFIX_CHARS.start})
                size[toxic] += 1
        # A beginning of no toxic document cannot enter the lexicon; the empty one counts the documents.
        keys = [k for k, v in seen[1].items()] + [k for k, v in seen[0].items() if k not in seen[1]]
        one, zero = [seen[1][k] for k in keys] + [size[1]], [seen[0][k] for k in keys] + [size[0]]
        yield pa.RecordBatch.from_arrays([pa.array([*keys, ""], pa.string()), pa.array(one, pa.int64()), pa.array(zero, pa.int64())], names=["prefix", "one", "zero"])

    counted = rows.where(first).select("toxic", "text").mapInArrow(count, "prefix string, one long, zero long")
    found = counted.groupBy("prefix").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).where((F.col("prefix") == "") | (F.col("one") >= SUPPORT) & (F.col("zero") <= 0.1 * F.col("one"))).collect()
    counts = {r["prefix"]: (r["one"], r["zero"]) for r in found}
    size = counts.pop("", (0, 0))
    lexicon = spark.sparkContext.broadcast(lexicon_of(counts, *size))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon.value)
        for batch in batches:
            x = [g.evidence(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = rows.where(second).select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").collect()
    if len({r["toxic"] for r in got}) < 2:
        return Model(lexicon.value, np.zeros(2 * len(MARKS)), -5.0)
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], dtype=float)
    # The sample draws the labels at different rates; the bias is put back to their own proportions.
    w, b = fit_weights(x, y)
    return Model(lexicon.value, w, b + math.log(taken[0] / taken[1]))


def _scored(docs: DataFrame, labels: DataFrame, sample: int, model: Model | None, fields: list) -> DataFrame:
    """Scores, and the given fields of ``docs`` as ``kept_0`` ...: their names may be those of the scores."""
    fitted = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels, sample))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"]) == 0).alias("held_out"), text_of(docs).alias("text"), *[docs[f.name].alias(f"kept_{i}") for i, f in enumerate(fields)])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m: Model = fitted.value
        zero = m.score("")
        for batch in batches:
            score, marks = [], []
            for text in batch.column(2):
                x = m.grammar.evidence(text.as_py())
                if x.any():
                    z = float(_spread(x) @ m.weights) + m.bias
                    score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                else:
                    score.append(zero)
                marks.append(",".join(f"{k}:{v:.2f}" for k, v in zip(MARKS, x, strict=True) if v))
            predicted = [int(s >= 0.5) for s in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(predicted, pa.int32()), pa.array(marks, pa.string()), *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", "marks", *[f"kept_{i}" for i in range(len(fields))]])

    schema = "doc_id long, held_out boolean, score double, predicted int, marks string" + "".join(f", kept_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    return rows.mapInArrow(predict, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted, marks`` of every document."""
    return _scored(docs, labels, sample, model, [])


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, model: Model | None = None) -> DataFrame:
    """The documents, all columns kept, that are not predicted to be toxic."""
    fields = docs.schema.fields
    return _scored(docs, labels, sample, model, fields).where("predicted = 0").select(*[F.col(f"kept_{i}").alias(f.name) for i, f in enumerate(fields)])
