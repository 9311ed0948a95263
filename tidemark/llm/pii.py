"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained here, in numpy, from labelled spans: windows of the corpus around base matches and plain ones, into which
generated addresses and numbers in many written forms are put. It labels each character (begin and inside of each kind, or
outside); a Viterbi path under the CRF's transitions gives the spans of a window. Texts are read in overlapping windows and
reconciled over the whole text: each span is taken from the window that sees it with the widest margin, overlaps go to the
wider-margined, longer span, and base spans override all. A span is ``LONGEST`` characters at most, so one of the windows holds it whole
with characters on either side. What no tagger can learn is checked afterwards: the digits of an added card pass Luhn, the parts of
an added address are at most 255.

A span must hold a trigger (a digit, ``@``, or a bracketed "at" or "dot"), so windows without one cannot add anything; leaving
them out changes no result and makes the cost follow the amount of candidate text.

Nulls: a null text is empty and has no spans. Rows are independent, so repeated rows get the same spans and a null
identifier is passed through. Very long texts are read window by window, whole. Of two spans that tie in margin, length and start, the kind
listed first stays. Empty tables give no rows; with an empty corpus the network learns from generated contexts only.
Extra columns are ignored by ``find`` and passed through by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import forget

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and from one to the next, of a training window, and of the longest span that is added.
WINDOW, STRIDE, TRAINED = 256, 128, 128
LONGEST = 100
#: Windows decoded at once; a window takes about 100 kB while it is.
DECODED = 384
#: Documents that lend contexts to the training, and windows taken from each at most.
SAMPLE_DOCS, SAMPLE_WINDOWS = 500, 6

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match cannot begin inside a run of digits whose beginning fails, so only beginnings are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?(?:at|dot) ?[)\]}]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octet(part: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    low = part.lstrip("0")
    return len(low) < 4 and int(low or "0") <= 255


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by start and then kind as listed."""
    if not _ANY.search(text):
        return []
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


_OWN = " \n@.-_+()[]{}%=:;,/\"'#"
#: Digits fall in three classes: what begins no number, what begins a part of an address, and the rest.
VOCAB = 5 + 26 + len(_OWN)


def char_ids(text: str) -> np.ndarray:
    """Digits are three classes, ASCII letters one each without case, some marks their own, and two classes for the rest."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    ids = np.where(c > 127, 1, 2).astype(np.int64)
    table = np.full(128, 2)
    for ch in range(128):
        s = chr(ch)
        table[ch] = (0 if s == "0" else 3 if s in "12" else 4) if s.isdigit() else 5 + ord(s.lower()) - 97 if s.isalpha() else 31 + _OWN.index(s) if s in _OWN else 2
    low = c < 128
    ids[low] = table[c[low]]
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Embedding, two LSTMs, emissions and CRF transitions. Tags: 0 outside, 1 + 2k begin and 2 + 2k inside of kind k."""

    TAGS = 1 + 2 * len(KINDS)

    def __init__(self, hidden: int = 16, embed: int = 10, seed: int = 5):
        rng, n = np.random.default_rng(seed), np.float32
        self.hidden = hidden
        self.p = {"e": rng.normal(0, 0.3, (VOCAB, embed)).astype(n), "o": rng.normal(0, 0.2, (2 * hidden, self.TAGS)).astype(n), "ob": np.zeros(self.TAGS, n), "t": rng.normal(0, 0.1, (self.TAGS, self.TAGS)).astype(n)}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.3, (embed, 4 * hidden)).astype(n), f"h{d}": rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(n), f"g{d}": np.zeros(4 * hidden, n)}
            self.p[f"g{d}"][hidden : 2 * hidden] = 1  # forget gates start open
        #: Inside follows begin or inside of its own kind only.
        self.allowed = np.array([[j == 0 or j % 2 == 1 or i in (j, j - 1) for j in range(self.TAGS)] for i in range(self.TAGS)])

    def _lstm(self, ids: np.ndarray, d: str, keep: bool):
        batch, steps = ids.shape
        size = self.hidden
        table = self.p["e"] @ self.p[f"x{d}"] + self.p[f"g{d}"]
        h, c = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
        out, cache = np.zeros((steps, batch, size), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[ids[:, t]] + h @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            before, c = c, f * c + i * g
            tanh = np.tanh(c)
            if keep:
                cache.append((t, h, before, i, f, o, g, tanh))
            h = o * tanh
            out[t] = h
        return out, cache

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._lstm(ids, "f", False)[0], self._lstm(ids, "b", False)[0]], 2)
        return both @ self.p["o"] + self.p["ob"]

    def _transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.p["t"], np.float32(-1e4))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi paths of a batch of windows; padding (id -1) reads as outside."""
        e = self.emissions(np.maximum(ids, 0))
        steps, batch, _ = e.shape
        t = self._transitions()
        score, back = e[0] + np.where(self.allowed[0], 0, -1e4), []
        for s in range(1, steps):
            all_ = score[:, :, None] + t
            back.append(all_.argmax(1).astype(np.uint8))
            score = all_.max(1) + e[s]
        path = np.zeros((batch, steps), np.int64)
        path[:, -1] = score.argmax(1)
        for s in range(steps - 2, -1, -1):
            path[:, s] = back[s][np.arange(batch), path[:, s + 1]]
        path[ids < 0] = 0
        return path

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags under the CRF, and its gradients."""
        batch, steps = ids.shape
        f, cache_f = self._lstm(ids, "f", True)
        b, cache_b = self._lstm(ids, "b", True)
        both = np.concatenate([f, b], 2)
        e = both @ self.p["o"] + self.p["ob"]
        t = self._transitions()

        def lse(x, axis):
            m = x.max(axis, keepdims=True)
            return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0] + np.where(self.allowed[0], 0, -1e4)
        for s in range(1, steps):
            alpha[s] = lse(alpha[s - 1][:, :, None] + t, 1) + e[s]
        for s in range(steps - 2, -1, -1):
            beta[s] = lse(t + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        dt = np.exp(alpha[:-1, :, :, None] + t + (e + beta)[1:, :, None, :] - z[:, None, None]).sum((0, 1))
        at, rows, gold_tags = np.arange(steps)[:, None], np.arange(batch), tags.T
        gold = e[at, rows, gold_tags].sum() + t[gold_tags[:-1], gold_tags[1:]].sum()
        de[at, rows, gold_tags] -= 1
        np.subtract.at(dt, (gold_tags[:-1], gold_tags[1:]), 1)
        loss = float((z.sum() - gold) / batch)
        de /= batch
        g = {"t": np.where(self.allowed, dt / batch, 0), "o": both.reshape(-1, 2 * self.hidden).T @ de.reshape(-1, self.TAGS), "ob": de.sum((0, 1)), "e": np.zeros_like(self.p["e"])}
        dh_all = de @ self.p["o"].T
        once = np.zeros((steps * batch, VOCAB), np.float32)
        once[np.arange(steps * batch), ids.T.ravel()] = 1
        for d, cache, dh_own in (("f", cache_f, dh_all[:, :, : self.hidden]), ("b", cache_b, dh_all[:, :, self.hidden :])):
            dz_all = np.zeros((steps, batch, 4 * self.hidden), np.float32)
            h_all = np.zeros((steps, batch, self.hidden), np.float32)
            dh, dc = np.zeros((batch, self.hidden), np.float32), np.zeros((batch, self.hidden), np.float32)
            back = np.ascontiguousarray(self.p[f"h{d}"].T)
            for s, h, before, i, fg, o, gg, tanh in reversed(cache):
                dh = dh + dh_own[s]
                dc = dc + dh * o * (1 - tanh**2)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * fg * (1 - fg), dh * tanh * o * (1 - o), dc * i * (1 - gg**2)], 1)
                dz_all[s], h_all[s] = dz, h
                dh, dc = dz @ back, dc * fg
            flat = dz_all.reshape(steps * batch, -1)
            dtable = once.T @ flat
            gh = h_all.reshape(steps * batch, -1).T @ flat
            g[f"h{d}"], g[f"g{d}"], g[f"x{d}"] = gh, dtable.sum(0), self.p["e"].T @ dtable
            g["e"] += dtable @ self.p[f"x{d}"].T
        return loss, g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 400, batch: int = 48, rate: float = 0.02, seed: int = 3) -> float:
        """Adam on random batches; returns the mean loss of the last twenty steps."""
        rng = np.random.default_rng(seed)
        m, v, losses = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            loss, g = self.gradients(ids[pick], tags[pick])
            losses.append(loss)
            norm = max(1.0, float(np.sqrt(sum((x**2).sum() for x in g.values()))) / 5)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.p:
                x = g[k] / norm
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x**2
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses[-20:]))


def _generate(kind: int, rng: np.random.Generator) -> str:
    """A made-up address or number in one of its written forms, of which the base patterns know some."""
    pick = lambda *forms: forms[int(rng.integers(0, len(forms)))]
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10)))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == 0:
        local = word() + pick("", ".", "_", ".") + pick(digits(2), word(), "")
        at, dot = pick(("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" {at} ", " {dot} "), ("(at)", "(dot)"), (" @ ", "."), (" (at) ", "."))
        return local.strip("._") + at + word() + pick("", digits(1)) + dot + pick("example" + dot + "com", "com", "org", "net", "de", "fr", "co" + dot + "uk")
    if kind == 1:
        return pick(".", ".", "[.]", "(.)", " [dot] ", " . ").join(str(rng.integers(0, 256)) for _ in range(4)) + pick("", "", ":" + digits(4))
    if kind == 2:
        n = int(pick(13, 15, 16, 16, 16, 19))
        body = str(rng.integers(3, 10)) + digits(n - 2)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        gap = pick("", " ", "-", ".", ".", "_", "/", " - ")
        return gap.join(body[i : i + 4] for i in range(0, n, 4))
    return pick(lambda: f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{rng.integers(1, 99)} {digits(3)} {digits(7)}", lambda: f"0{digits(3)} {digits(7)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"00{rng.integers(10, 99)} {digits(3)} {digits(3)} {digits(3)}")()


def _other(rng: np.random.Generator) -> str:
    """Things with digits or brackets that are no personal data."""
    pick = lambda *forms: forms[int(rng.integers(0, len(forms)))]()
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    return pick(
        lambda: f'token = "{hexa(40)}"',
        lambda: f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}.",
        lambda: f"v{rng.integers(1, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}",
        lambda: digits(int(rng.integers(1, 9))),
        lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        lambda: f"{rng.integers(1, 29):02d}.{rng.integers(1, 13):02d}.{rng.integers(1900, 2030)}",
        lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"{digits(3)},{digits(3)}.{digits(2)}",
        lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{rng.integers(1, 9)}.{rng.integers(1, 9)}.{rng.integers(1, 9)}.{rng.integers(1, 9)}.{rng.integers(1, 9)}",
        lambda: "@" + "".join(rng.choice(list("abcdefgh"), 6)),
        lambda: f"#{digits(4)}",
        lambda: hexa(12),
        lambda: f"{digits(3)}-{digits(2)}",
        lambda: f"pp. {digits(3)}-{digits(3)}",
        lambda: "(at) " + "".join(rng.choice(list("abcdefgh"), 5)),
        lambda: " | ".join(digits(int(rng.integers(1, 4))) for _ in range(4)),
        lambda: digits(int(rng.integers(20, 40))),
    )


def training_set(contexts: list[tuple[str, list]], n: int = 3000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Windows with tags: contexts with their base spans, and contexts with one or two generated items put in."""
    rng = np.random.default_rng(seed)
    contexts = contexts or [("the of and to in is it for on with as by at from ", [])]
    ids, tags = np.zeros((n, TRAINED), np.int64), np.zeros((n, TRAINED), np.int64)
    for row in range(n):
        text, spans = contexts[int(rng.integers(0, len(contexts)))]
        spans = list(spans)
        if not spans:
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(0, max(1, min(len(text), TRAINED - 40))))
                at = text.find(" ", at) + 1 or at
                if any(a - 1 <= at <= b + 1 for a, _, b in spans):
                    continue
                kind = int(rng.integers(0, 6))
                item = _generate(kind, rng) if kind < 4 else _other(rng)
                before, after = rng.choice([" ", " ", "", "(", ": ", "\n"]), rng.choice([" ", " ", ". ", ", ", ")", "%%% "])
                text = text[:at] + before + item + after + text[at:]
                grown = len(before) + len(item) + len(after)
                spans = [(a, k, b) if b <= at else (a + grown, k, b + grown) for a, k, b in spans]
                if kind < 4:
                    spans.append((at + len(before), KINDS[kind], at + len(before) + len(item)))
        text = text[:TRAINED].ljust(TRAINED)
        ids[row] = char_ids(text)
        for a, kind, b in spans:
            if a < TRAINED:
                k = KINDS.index(kind)
                tags[row, a : min(b, TRAINED)] = 2 + 2 * k
                tags[row, a] = 1 + 2 * k
    return ids, tags


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network:
    """Fit on contexts of about ``sample_docs`` documents, drawn by hash (twice that at most), and generated items."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for value in batch.column(0):
                text = value.as_py()
                base = base_spans(text)
                starts = [max(0, (a + b - TRAINED) // 2) for a, _, b in base[: SAMPLE_WINDOWS // 2]]
                starts += [i * max(1, len(text) - TRAINED) // SAMPLE_WINDOWS for i in range(SAMPLE_WINDOWS - len(starts))]
                for s in starts:
                    part = text[s : s + TRAINED]
                    inside = [(a - s, k, b - s) for a, k, b in base if s <= a and b <= s + TRAINED]
                    if inside or not _TRIGGER.search(part):
                        texts.append(part)
                        spans.append(";".join(f"{a}:{k}:{b}" for a, k, b in inside))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.string())], names=["text", "spans"])

    n = docs.count()
    draw = F.pmod(F.xxhash64(docs["doc_id"].cast("long"), text_of(docs)), F.lit(1 << 30)) / float(1 << 30)
    got = docs.where(draw < min(1.0, sample_docs / max(1, n))).select(text_of(docs).alias("text")).mapInArrow(contexts, "text string, spans string").limit(2 * sample_docs * SAMPLE_WINDOWS).collect()
    items = sorted((r["text"], r["spans"]) for r in got)
    net = Network()
    net.fit(*training_set([(t, [(int(a), k, int(b)) for a, k, b in (x.split(":") for x in s.split(";") if x)]) for t, s in items]))
    return net


_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r"[(\[{] ?at ?[)\]}]", re.IGNORECASE)


def _plausible(kind: str, item: str) -> bool:
    """What any added span of a kind must show."""
    numbers = _DIGITS.findall(item)
    n = sum(map(len, numbers))
    if len(item) > LONGEST:
        return False
    if kind == "email":
        return ("@" in item or _AT.search(item) is not None) and ("." in item or "dot" in item.lower()) and len(item) >= 6
    if kind == "ip":
        return len(numbers) in (4, 5) and all(map(_octet, numbers[:4])) and n >= 4
    if kind == "card":
        return 12 <= n <= 19 and luhn("".join(numbers)) and len(set("".join(numbers))) > 1
    return 7 <= n <= 15 and not re.search(r"[A-Za-z]", item)


class Finder:
    def __init__(self, net: Network):
        self.net = net

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """(base spans, all spans) of each text."""
        windows, where = [], []
        for n, text in enumerate(texts):
            last = -1
            for m in _TRIGGER.finditer(text):  # every window that holds a part of a trigger
                for i in range(max(last + 1, (m.start() - WINDOW) // STRIDE + 1, 0), m.start() // STRIDE + 1):
                    windows.append(char_ids(text[i * STRIDE : i * STRIDE + WINDOW]))
                    where.append((n, i * STRIDE))
                    last = i
        seen: dict[int, list] = {}
        for at in range(0, len(windows), DECODED):
            part = windows[at : at + DECODED]
            ids = np.full((len(part), WINDOW), -1)
            for row, w in zip(ids, part, strict=True):
                row[: len(w)] = w
            paths = self.net.decode(ids)
            for (n, begin), path, w in zip(where[at : at + DECODED], paths, part, strict=True):
                if path.any():
                    for a, k, b in _runs(path[: len(w)]):
                        seen.setdefault(n, []).append((begin, begin + len(w), begin + a, k, begin + b))
        return [(base := base_spans(text), self._reconcile(text, base, seen.get(n, []))) for n, text in enumerate(texts)]

    @staticmethod
    def _reconcile(text: str, base: list, found: list) -> list:
        """One set of spans for the whole text, from those of its windows."""
        ranked = []
        for lo, hi, a, k, b in found:
            left, right = a - lo if lo else WINDOW, hi - b if hi < len(text) else WINDOW
            # What touches an edge is whole in the next window, as no span is longer than LONGEST < STRIDE.
            if min(left, right) > 0 and _plausible(KINDS[k], text[a:b]):
                ranked.append((-min(left, right), a - b, a, k, KINDS[k], b))
        kept = list(base)
        for _, _, a, _, kind, b in sorted(ranked):
            if all(b <= x or a >= y for x, _, y in kept):
                kept.append((a, kind, b))
        return sorted(kept, key=lambda s: (s[0], KINDS.index(s[1])))


def _runs(path: np.ndarray) -> list[tuple[int, int, int]]:
    out, start, kind = [], None, None
    for i, tag in enumerate([*path.tolist(), 0]):
        if start is not None and (tag == 0 or tag % 2 == 1):
            out.append((start, kind, i))
            start = None
        if tag and tag % 2 == 1:
            start, kind = i, (tag - 1) // 2
    return out


def measure(net: Network, contexts: list[str], n: int = 400, seed: int = 99) -> dict[str, tuple[int, int, int]]:
    """By kind: items generated in forms that the base patterns do not know, those found, and spans added elsewhere.

    A found item is covered to nine tenths by a span of its kind; every other text with an item of no kind takes part.
    """
    rng, finder = np.random.default_rng(seed), Finder(net)
    out = {k: [0, 0, 0] for k in KINDS}
    texts, hidden = [], []
    while len(texts) < n:
        text = contexts[int(rng.integers(0, len(contexts)))]
        kind = int(rng.integers(0, 5))
        item = _generate(kind, rng) if kind < 4 else _other(rng)
        if kind < 4 and any(k == KINDS[kind] for _, k, _ in base_spans(item)):
            continue
        at = text.find(" ", int(rng.integers(0, max(1, len(text))))) + 1
        texts.append(f"{text[:at]} {item} {text[at:]}")
        hidden.append((at + 1, KINDS[kind], at + 1 + len(item)) if kind < 4 else None)
    for (base, spans), want in zip(finder.spans(texts), hidden, strict=True):
        added = [s for s in spans if s not in base]
        if want:
            out[want[1]][0] += 1
            hit = [s for s in spans if s[1] == want[1] and min(s[2], want[2]) - max(s[0], want[0]) >= 0.9 * (want[2] - want[0])]
            out[want[1]][1] += bool(hit)
            added = [s for s in added if s not in hit]
        for _, k, _ in added:
            out[k][2] += 1
    return {k: tuple(v) for k, v in out.items()}


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256`` of them, and all ``spans`` of every document, with their number."""
    model = docs.sparkSession.sparkContext.broadcast(net or train(docs))
    out = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), ("n_added", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        finder = Finder(model.value)
        for batch in batches:
            cols: list[list] = [[] for _ in out]
            for at in range(0, batch.num_rows, 512):
                texts = [t.as_py() for t in batch.column(1).slice(at, 512)]
                for doc_id, (base, spans) in zip(batch.column(0).slice(at, 512).to_pylist(), finder.spans(texts), strict=True):
                    row = (doc_id, *[sum(k == kind for _, k, _ in base) for kind in KINDS], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans), len(spans) - len(base))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")


def mask(text: str, spans: list) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    at, out = 0, []
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The documents, all columns kept, with personal data in ``text`` replaced by its kind; null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(net or train(docs))  # which bounds the batches too
    at = docs.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        finder = Finder(model.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = finder.spans([t or "" for t in texts])
            new = [t if t is None else mask(t, s) for t, (_, s) in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)
