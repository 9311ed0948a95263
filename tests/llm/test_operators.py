"""The operators against brute force on small tables, and on tables with nulls, ties, repeats, odd columns and no rows."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import common, decontam, induced_sort, jaccard_join, langid, packing, pii, quality_rules, sstable, substring_dedup, suffix_dedup, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, spans string, digest string, gone string"
LABELS = "doc_id long, quality int, toxic int"


def words(rng, n, vocab=400):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.randrange(vocab) % 23:x}".translate(str.maketrans("0123456789", "qwzxvjhyku")) for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 0.5, 1, "x", "y", "z") for i, t, lang in rows], DOCS)


def odd_rows():
    rng = random.Random(1)
    base = words(rng, 120)
    long = "\n".join(words(rng, 60) + "." for _ in range(200))
    near = base.split()
    near[60] = "changed"
    return [(1, base, "en"), (2, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, None, "en"), (5, "", None), (None, base + " tail", "de"), (None, None, None), (6, " \n\t ", "de"), (7, long, "de"), (7, "other text of the same id", "de"), (8, long[:3000], None), (9, "!!!! ?? 123", "en"), (10, words(rng, 3), "en"), (11, "é" * 300, "fr"), (12, "a" * 500 + " " + "a" * 500, "fr")]


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


# PII


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(out)]


def test_base_patterns_equal_the_plain_expressions():
    rng = random.Random(2)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "+", "-", " ", "x", "é", "9", "00", "1.2.3.4.5.6.7.8", "a@b", "b@c.d.", "()", "5500-0000-0000-0004", "%", "\n"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == brute_base(text), text


def test_pii_gradients_agree_with_differences():
    net = pii.Network(hidden=3, embed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, pii.VOCAB, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 0, 7, 8, 8]])
    _, g = net.gradients(ids, tags)
    for k in ("o", "t", "hf", "xb", "e", "gf"):
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        was, step = net.p[k][i], 1e-3
        net.p[k][i] = was + step
        up = net.gradients(ids, tags)[0]
        net.p[k][i] = was - step
        down = net.gradients(ids, tags)[0]
        net.p[k][i] = was
        assert g[k][i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-3)


@pytest.fixture(scope="module")
def net():
    rng = random.Random(8)
    n = pii.Network()
    n.fit(*pii.training_set([(words(rng, 25)[: pii.TRAINED], []) for _ in range(80)], 3000))
    return n


def test_pii_network_finds_forms_that_the_patterns_do_not_know(net):
    rng = random.Random(77)
    got = pii.measure(net, [words(rng, 60) for _ in range(100)], 500)
    asked, found, wrong = (sum(v[i] for v in got.values()) for i in range(3))
    assert asked > 300 and found / asked >= 0.9 and found / (found + wrong) >= 0.95
    assert all(f / a >= 0.85 for a, f, _ in got.values())


def test_pii_adds_no_card_that_fails_its_check_and_no_impossible_address(net):
    rng = random.Random(78)
    texts = []
    for _ in range(200):
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        texts.append(f"{words(rng, 9)} {'.'.join(digits[i : i + 4] for i in range(0, 16, 4))} {words(rng, 9)} {rng.randrange(256, 999)}[.]1[.]{rng.randrange(300, 999)}[.]7 {words(rng, 5)}")
    for text, (_, spans) in zip(texts, pii.Finder(net).spans(texts), strict=True):
        for a, kind, b in spans:
            assert kind != "card" or pii.luhn(re.sub(r"\D", "", text[a:b]))
            assert kind != "ip" or all(int(x) <= 255 for x in re.findall(r"\d+", text[a:b])[:4])


def test_pii_long_spans_are_found_wherever_they_lie(net):
    item = "first.last (at) department-of-words (dot) example (dot) org"
    assert len(item) < pii.LONGEST < pii.STRIDE
    for at in range(200, 200 + pii.STRIDE, 7):
        text = ("plain words here " * 40)[:at] + " " + item + " " + "more plain words " * 30
        found = pii.Finder(net).spans([text])[0][1]
        assert any(k == "email" and a <= at + 1 + 3 and b >= at + len(item) - 3 for a, k, b in found), at


def test_pii_of_long_runs_and_long_texts(net):
    long = "plain words of no kind " * 40_000
    zeros = "0" * 5000 + "1.1.1.1 and " + "9" * 5000 + ".1.1.1 and " + "1" * 5000 + " +" + "1" * 5000 + " " + "a" * 5000 + "@" * 50
    text = zeros + long + " me@example.com " + long
    base, spans = pii.Finder(net).spans([text])[0]
    assert [k for _, k, _ in base] == ["ip", "email"] and set(base) <= set(spans)
    assert pii.base_spans(zeros) == [(0, "ip", 5007)]


def test_pii_adds_spans_across_windows_and_keeps_base(net):
    rng = random.Random(5)
    text = words(rng, 30) + " mail jo.hn@site.example.com or call +1 (212) 555-0199 " + words(rng, 40) + " from 10.20.30.40 end"
    base, spans = pii.Finder(net).spans([text])[0]
    assert base == brute_base(text) and len(base) == 3 and set(base) <= set(spans)
    assert pii.mask(text, spans).count("[") >= 3
    assert pii.Finder(net).spans(["", "no digits here"]) == [([], []), ([], [])]


def test_pii_on_odd_and_empty_tables(odd, none, net):
    got = pii.find(odd, net).collect()
    assert len(got) == odd.count() and pii.find(none, net).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty for r in got if r["doc_id"] in (4, 5, 6))
    assert pii.redact(odd, net).columns == odd.columns and pii.redact(odd, net).where("text is null").count() == 2


# Decontamination


def bench_rows(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, lang string, score double")


def test_leaks_and_paraphrases_are_found_and_clean_documents_left(spark):
    rng = random.Random(3)
    items = [(i, words(rng, 30, 4000) + ". " + words(rng, 4, 4000) + ".", "x", 0.0) for i in range(12)]
    docs, want = [], set()
    for d in range(120):
        body = [words(rng, 100, 4000), words(rng, 40, 4000)]
        if d % 10 == 0:
            item = items[d // 10][1]
            if d % 20:
                parts = item.split()
                parts[5], parts[11], parts[17] = "swapped", "other", "word"
                item = " ".join(parts)
            body.insert(1, item)
            want.add((d, d // 10))
        docs.append((d, " ".join(body), "en"))
    docs = make(spark, docs)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.search(docs, bench_rows(spark, items)).collect()}
    assert got == want
    assert {r["doc_id"] for r in decontam.decontaminate(docs, bench_rows(spark, items)).collect()} == set(range(120)) - {d for d, _ in want}


def test_subsequence_equals_dynamic_programming():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.subsequence(decontam._pattern(a), len(a), b) == table[-1][-1]


def test_words_by_table_equal_those_of_the_expression():
    marks = ["", "a_b-C3 \x00\x1c_", "ΟΔΟΣ ΣΑΣ.", "İstanbul DİL", "É\u0301cole ÑANDÚ ²½ x\u00a0y\u3000z", "漢字 \U00020000\U0010ffff A", "🙂Ok🙂 𝐀b", "\ud800A é"]
    every = ["".join(f"{chr(c)}x " for c in range(lo, lo + 256)) for lo in range(0, 0x20400, 256)]
    for text in marks + every:
        assert decontam.split_words(text) == decontam.words_of(text)


def test_sums_of_runs_equal_those_of_copied_rows():
    rng = np.random.default_rng(5)
    table = rng.integers(-9, 9, size=(50, 7)).astype(np.float32)
    for sizes in ([1], [3, 1, 700, 2, 64, 65, 129], rng.integers(1, 30, size=2000)):
        starts = np.cumsum(sizes) - sizes
        rows = rng.integers(0, 50, size=sum(sizes))
        assert np.array_equal(decontam._sums(table, rows, starts), np.add.reduceat(table[rows], starts, axis=0))


def space_of(rng, n_items, vocab):
    items = decontam.Items([(i, words(rng, rng.randrange(20, 60), vocab) + ".") for i in range(n_items)])
    idf = np.linspace(1, 8, len(items.vocab) + 1) * (np.arange(len(items.vocab) + 1) % 3 > 0)
    return decontam.Space(items, idf, np.random.default_rng(6).normal(size=(len(idf), 192)))


def test_candidates_equal_those_of_all_windows():
    rng = random.Random(7)
    space = space_of(rng, 30, 4000)
    docs = [np.array(rng.choices(range(len(space.items.vocab) + 1), k=k), np.uint32) for k in (0, 5, 16, 17, 64, 65, 400, 0, 2000, 90, 0)]
    docs[6][100:160] = (space.items.codes[3] * 3)[:60]
    docs[9][:60] = (space.items.codes[4] * 3)[:60]
    want = []
    for d, c in enumerate(docs):
        size = -(-len(c) // decontam.CHUNK)
        for n, span in enumerate(space.items.span):
            for a in range(max(1, size - span + 1) if size else 0):
                x = space.terms[c[a * decontam.CHUNK : (a + span) * decontam.CHUNK]].sum(0, dtype=np.float64)
                length, dot = np.linalg.norm(x), x @ space.unit[n]
                if length > 1e-4 and dot >= decontam.COSINE * length and dot >= decontam.SHARE * space.norm[n]:
                    want.append((d, n, a, min(a + span, size), round(dot / length, 4)))
    got = []
    first = decontam._layout(docs, decontam.CHUNK)[2]
    space._verify = lambda best, codes, first, d, n, a, b, cosine: got.append((d, n, a - first[d], b - first[d], round(cosine, 4)))
    assert not space.plain and list(space.search(docs)) == [] and first[-1] == sum(-(-len(c) // decontam.CHUNK) for c in docs)
    assert len(want) > 10 and sorted(got) == sorted(want)


def test_decontamination_takes_a_few_times_as_long_as_finding_the_words():
    rng = random.Random(8)
    space = space_of(rng, 200, 4000)
    texts = [words(rng, 500, 4000) for _ in range(300)]

    def took(work):
        times = []
        for _ in range(3):
            began = time.process_time()
            work()
            times.append(time.process_time() - began)
        return min(times)

    ratio = took(lambda: list(space.search([space.items.encode(t) for t in texts]))) / took(lambda: [decontam.words_of(t) for t in texts])
    assert ratio < 4, ratio


def test_decontamination_on_odd_and_empty_tables(spark, odd, none):
    items = bench_rows(spark, [(1, "some words of an item. The answer here.", "x", 0.0), (2, None, "x", 0.0), (None, "", "x", 0.0)])
    assert decontam.search(odd, items).count() == 0 and decontam.search(none, items).count() == 0
    assert decontam.decontaminate(odd, items).count() == odd.count()
    assert decontam.search(odd, bench_rows(spark, [])).count() == 0


# Packing


def test_plan_covers_every_piece_without_overlap():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 33, 100])
        counts = collections.Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 400)))
        plan, bins, fixed = packing.solve(counts, capacity)
        held, placed = collections.defaultdict(list), collections.Counter()
        for length, _, n, per, first, offset in plan:
            for b in range(n):
                held[first + b] += [(offset + k * length, length) for k in range(per)]
            placed[length] += n * per
        assert placed == counts and len(held) == bins
        for spans in held.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        assert packing.lower_bound(counts, capacity) <= bins and fixed <= bins


def test_reduction_reaches_the_optimum_of_small_instances():
    def least(items, capacity):
        best = len(items)

        def go(k, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if k == len(items):
                best = len(rooms)
                return
            for i, r in enumerate(rooms):
                if r >= items[k] and r not in rooms[:i]:
                    go(k + 1, [*rooms[:i], r - items[k], *rooms[i + 1 :]])
            go(k + 1, [*rooms, capacity - items[k]])

        go(0, [])
        return best

    rng, over = random.Random(7), 0
    for _ in range(150):
        items = sorted((rng.randrange(2, 12) for _ in range(rng.randrange(1, 11))), reverse=True)
        over += packing.solve(collections.Counter(items), 12)[1] - least(items, 12)
    assert over <= 6


def test_pack_round_trip(spark, odd, none):
    got = packing.pack(odd, tokens.default_tokenizer(), capacity=64, with_ids=True).collect()
    enc = tokens.encoder(tokens.default_tokenizer())
    want = collections.Counter()
    for i, t, _ in odd_rows():
        ids = np.frombuffer(enc.encode(t or ""), "<u4").tolist() + [1]
        for p, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, tokens.default_tokenizer()).count() == 0


# Jaccard join


def brute_links(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return links, [find(x) for x in range(n)]


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 900)
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        base = words(rng, rng.randrange(3, 120)).split()
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = words(rng, 1)
            rows.append((len(rows), " ".join(own), "en"))
    links, classes = brute_links(rows)
    got = {r["doc_id"]: r for r in jaccard_join.join(make(spark, rows)).collect()}
    assert [got[i]["n_links"] for i in range(len(rows))] == links
    assert [got[i]["class_id"] for i in range(len(rows))] == classes
    left = {r["doc_id"] for r in jaccard_join.unique(make(spark, rows)).collect()}
    assert left == set(classes)


def test_join_on_odd_and_empty_tables(odd, none):
    got = jaccard_join.join(odd).collect()
    assert len(got) == odd.count() and jaccard_join.join(none).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (1, 3, 5)}
    assert by[1]["class_id"] == 1 and by[1]["n_copies"] == 3 and by[5]["n_links"] == 0
    left = jaccard_join.unique(odd)
    assert left.columns == odd.columns
    ids = sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect())
    assert len([i for i, _ in ids if i in (1, 2)]) == 1 and len(ids) == len(set(ids))


# Byte strings


def brute_removal(rows, length=100):
    seen, out = set(), {}
    for key in sorted({(i is not None, i or 0, t or "") for i, t, _ in rows}):
        data = key[2].encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - length + 1):
            part = data[a : a + length]
            if part in seen:
                gone[a : a + length] = True
            seen.add(part)
        out[key] = bytes(np.frombuffer(data, np.uint8)[~gone])
    return out


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SUFFIX_SHARD", 3000)
    monkeypatch.setattr(suffix_dedup, "BATCH", 4000)
    rng = random.Random(13)
    passages = [words(rng, rng.randrange(10, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(5, 40)), rng.choice(passages), words(rng, 3), rng.choice(passages)[rng.randrange(40) :], "ab" * rng.randrange(0, 120)]
        rows.append((i, "é ".join(rng.sample(parts, rng.randrange(1, 6))), "en"))
    rows += [(60 + i, rows[i][1], "en") for i in range(0, 40, 7)] + [(None, rows[3][1], "en")]
    want = brute_removal(rows)
    for r in suffix_dedup.dedup(make(spark, rows)).collect():
        texts = [k for k in want if (k[1] if k[0] else None) == r["doc_id"]]
        assert bytes(r["kept"]) in [want[k] for k in texts]
        assert r["n_bytes"] - r["n_removed"] == len(r["kept"]) and r["n_spans"] == len([s for s in r["spans"].split(",") if s])


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "SUFFIX_SHARD", 2000)
    rng = random.Random(14)
    common = words(rng, 9)
    assert suffix_dedup.GRAM < len(common) < suffix_dedup.LENGTH
    rows = [(i, f"{words(rng, 30)} {words(random.Random(i % 7), 8)} {common} {words(random.Random(i % 5), 8)} {words(rng, 30)}", "en") for i in range(80)]
    want = brute_removal(rows)
    got = suffix_dedup.dedup(make(spark, rows)).collect()
    assert all(bytes(r["kept"]) in [want[k] for k in want if k[1] == r["doc_id"]] for r in got) and sum(r["n_removed"] for r in got) > 500


def shared(x, y):
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def assert_sorted(text, depth, budget):
    space = induced_sort.Space(budget)
    got = [(int(a), int(b)) for s, v in induced_sort.suffixes(np.frombuffer(text, np.uint8), depth, space=space) for a, b in zip(s, v, strict=True)]
    assert sorted(a for a, _ in got) == list(range(len(text) + 1))
    for (a, _), (b, common) in zip(got, got[1:], strict=False):
        x, y = text[a : a + depth], text[b : b + depth]
        assert x >= y and shared(x, y) == common
    return space.spilled


@pytest.mark.parametrize("room", [0, 64, 1 << 30])
def test_induced_sort_gives_order_and_common_prefixes(monkeypatch, room):
    rng, spilled = random.Random(1), 0
    monkeypatch.setattr(induced_sort, "ROOM", room)  # the last: recursion until one name covers the depth
    for trial in range(250):
        monkeypatch.setattr(induced_sort, "CHUNK", rng.choice([2, 3, 8, 1 << 16]))
        monkeypatch.setattr(induced_sort, "RANGES", rng.choice([2, 4, 512]))
        n, some = rng.randrange(0, 120), [bytes(rng.randrange(97, 101) for _ in range(rng.randrange(1, 6))) for _ in range(5)]
        text = [bytes(rng.randrange(2) for _ in range(n)), bytes(rng.randrange(256) for _ in range(n)), b"ab" * (n // 2) + b"a" * rng.randrange(20), b" ".join(rng.choice(some) for _ in range(n // 3)), b"a" * n + bytes(rng.randrange(3) for _ in range(5))][trial % 5]
        spilled += assert_sorted(text, rng.choice([1, 2, 3, 5, 10, 100, 200]), rng.choice([64, 1000, 1 << 20]))
    assert spilled


def test_induced_sort_of_a_shard_of_a_hundred_budgets(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(induced_sort, "CHUNK", 1 << 11)
    rng = random.Random(3)
    passages = [words(rng, 40).encode() for _ in range(20)]
    text = b" ".join(words(rng, 5).encode() + b" " + rng.choice(passages) for _ in range(500))
    budget = len(text) // 100
    space = induced_sort.Space(budget)
    tracemalloc.start()
    seen = sum(len(places) for places, _ in induced_sort.suffixes(np.frombuffer(text, np.uint8), 100, space=space))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(text) + 1 and space.spilled > 50 * len(text)
    assert peak < 6 * len(text) + 2_000_000, peak  # a tuple alone has 24 bytes


def test_induced_sort_of_long_runs():
    assert_sorted(b"a" * 3000 + b"b" * 3000 + b"ab" * 500, 100, 1 << 20)


def test_suffix_dedup_on_odd_and_empty_tables(odd, none):
    got = suffix_dedup.dedup(odd).collect()
    assert len(got) == odd.count() and suffix_dedup.dedup(none).count() == 0
    assert {r["n_removed"] for r in got if r["doc_id"] in (4, 5, 6)} == {0}
    assert len({bytes(r["kept"]) for r in got if r["doc_id"] == 2}) == 1


# Lines


def test_line_dedup_keeps_the_earliest(spark, odd, none):
    rng = random.Random(17)
    passage = ". ".join(words(rng, 20) for _ in range(4)) + "."
    rows = [(3, f"{words(rng, 10)}\n{passage}\nend here now", "en"), (1, f"start {words(rng, 12)}.\n{passage}", "en"), (2, f"{words(rng, 9)} then {passage}", "en"), (4, words(rng, 60), "en")]
    got = {r["doc_id"]: r for r in substring_dedup.dedup(make(spark, rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[4]["n_removed"] == 0
    assert passage not in got[3]["text"] and got[3]["text"].endswith("end here now")
    assert got[2]["n_removed"] > 0.7 * len(passage)
    for i, t, _ in rows:
        spans = [tuple(map(int, s.split(":"))) for s in got[i]["spans"].split(",") if s]
        left = t
        for a, b in reversed(spans):
            left = left[:a] + left[b:]
        assert left == got[i]["text"] and len(t) - got[i]["n_removed"] == len(left)
    assert substring_dedup.dedup(odd).count() == odd.count() and substring_dedup.dedup(none).count() == 0


def test_line_dedup_removes_torn_passages_to_the_word(spark):
    rng = random.Random(23)
    w = words(rng, 400, 9000).split()
    short = " ".join(". ".join(" ".join(w[i : i + 4]) for i in range(0, 60, 4)).split())  # no sentence of eight words, inside longer lines
    torn, under, own = " ".join(w[60:130]), " ".join(w[130:179]), " ".join(w[180:240])
    rows = [(i, f"{words(rng, 9)} {short} {words(rng, 9)}. {words(rng, 9)} {torn} {words(rng, 9)}. {words(rng, 9)} {under} {words(rng, 9)}", "en") for i in (1, 2)]
    rows += [(3, f"{words(rng, 9)} {own} {words(rng, 9)} {own.upper()} {words(rng, 9)}", "en"), (4, "same " * 80, "en")]
    got = {r["doc_id"]: r for r in substring_dedup.dedup(make(spark, rows)).collect()}
    assert got[1]["n_removed"] == 0
    at = [rows[1][1].index(p) for p in (short, torn)]
    assert got[2]["spans"] == ",".join(f"{a}:{a + len(p)}" for a, p in zip(at, (short, torn), strict=True))
    a = rows[2][1].index(own.upper())
    assert got[3]["spans"] == f"{a}:{a + len(own)}"
    assert len(got[4]["text"].split()) == 50


def brute_lines(rows, line_words, passage_words):
    """Removed characters by document: every unit against all earlier ones, run by run."""
    first, gone = {}, {}
    for i, text, _ in sorted(rows):
        found, gone[i] = list(substring_dedup.units(text, line_words)), np.zeros(len(text), bool)
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        w = text.lower().split()
        found += [("p" + " ".join(w[k : k + passage_words]), at[k][0], at[k + passage_words - 1][1]) for k in range(len(w) - passage_words + 1)]
        for u, a, b in found:
            j, _, e = first.setdefault(u, (i, a, b))
            if (j, a, b) != (i, *first[u][1:]) or first[u] != (i, a, b):
                gone[i][max(a, e) if j == i else a : b] = True
    return gone


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_UNITS", 40)
    rng = random.Random(31)
    some = [words(rng, rng.randrange(12, 40), 9000) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(2, 30), 9000), rng.choice(some), rng.choice(some), " ".join([words(rng, 11, 9000)] * rng.randrange(1, 12)), rng.choice(some)[rng.randrange(30) :]]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\n\n", " ", " "]) for x in rng.sample(parts, rng.randrange(1, 6))), "en"))
    rows += [(60 + k, rows[7 * k][1] + " " + rows[k][1], "en") for k in range(8)]
    want = brute_lines(rows, 15, 20)
    for r in substring_dedup.dedup(make(spark, rows), passage_words=20).collect():
        assert r["n_removed"] == want[r["doc_id"]].sum(), r["doc_id"]
        assert r["text"] == "".join(c for c, g in zip(rows[r["doc_id"]][1], want[r["doc_id"]], strict=True) if not g)


def test_line_dedup_paragraphs_and_short_lines(spark):
    rng = random.Random(37)
    block = "\n".join(words(rng, 6, 9000) for _ in range(4))
    rows = [(i, f"{words(rng, 20)}\n\n{block}\n\nRead more here today.\n{words(rng, 20)}", "en") for i in (1, 2)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(make(spark, rows)).collect()}
    assert got[1] == rows[0][1] and block not in got[2] and "Read more here" in got[2]


def test_line_dedup_stretches_cover_every_run():
    text = words(random.Random(3), 4000, 9000)
    w, whole = text.split(), list(substring_dedup.stretches(text))
    assert sum(len(u[1:].split()) - 49 for u, *_ in whole) == len(w) - 49
    assert all(u[1:] == text[a:b] for u, a, b, _ in whole)
    part = {h for *_, h in substring_dedup.stretches(" ".join(w[700:750]))}
    assert len(part) == 1 and part <= {h for *_, h in whole}


# Language


def test_language_held_out_accuracy(spark, odd, none):
    rng = random.Random(19)
    marks = {"aa": "xyz", "bb": "üöä", "cc": "kqv"}
    rows = [(i, " ".join(words(rng, 1) + rng.choice(marks[lang]) for _ in range(30)), lang) for i, lang in enumerate(rng.choice(list(marks)) for _ in range(300))]
    got = langid.identify(make(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in held) / len(held) > 0.95
    by = langid.identify(odd).collect()
    assert len(by) == odd.count() and {r["lang_pred"] for r in by if r["doc_id"] in (4, 5, 6, 9)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in by) and langid.identify(none).count() == 0


def test_language_codewords_are_apart():
    for n in (2, 4, 65, 200):
        code = langid.codewords(n)
        assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= 3 and code.shape[1] >= langid.BITS


# Quality


def brute_signals(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(rep)


def test_quality_signals_and_controlled_cutoffs(spark, odd, none, no_labels):
    got = quality_rules.quality(odd, no_labels).collect()
    sig = collections.Counter(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got)
    assert sig == collections.Counter(brute_signals(t) for _, t, _ in odd_rows())
    assert all(r["kept"] == (not r["base_failed"]) for r in got) and quality_rules.quality(none, no_labels).count() == 0
    rng = random.Random(23)
    rows = [(i, words(rng, 100) if i % 4 else " ".join(w + "%#" for w in words(rng, 100).split()), "en") for i in range(1600)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(1600)], LABELS)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality(make(spark, rows), labels).collect()}
    assert not any(kept[i] for i in range(0, 1600, 4)) and all(kept[i] for i in range(1600) if i % 4)


def test_binomial_tail_is_exact(spark):
    import math

    cases = [(0, 50), (3, 200), (40, 5000), (200, 9000)]
    df = spark.createDataFrame(cases, "k long, n long")
    from pyspark.sql import functions as F

    got = [r["p"] for r in df.select(quality_rules._binomial_cdf(F.col("k"), F.col("n"), 0.02).alias("p")).collect()]
    for (k, n), p in zip(cases, got, strict=True):
        assert p == pytest.approx(sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1)), rel=1e-9)


# Token shards


def test_shards_round_trip_and_lookup(spark, odd, none):
    manifest = sstable.write_shards(odd, tokens.default_tokenizer(), 2)
    got = sorted(sstable.read_shards(manifest).collect(), key=lambda r: r["start"])
    enc = tokens.encoder(tokens.default_tokenizer())
    want = collections.Counter()
    for i, t, _ in odd_rows():
        ids = np.append(np.frombuffer(enc.encode(t or ""), "<u4"), np.uint32(2)).astype("<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    found = collections.Counter()
    for row in manifest.collect():
        table = sstable.SSTable(row["path"])
        for i in (None, 1, 2, 7, 99):
            found[i] += len(table.get(i))
        table.close()
    assert found == {None: 2, 1: 1, 2: 2, 7: 2, 99: 0}
    assert sstable.read_shards(sstable.write_shards(none, tokens.default_tokenizer(), 2)).count() == 0


def test_blocks_of_a_large_shard(tmp_path):
    path, values = tmp_path / "a.sst", {}
    with open(path, "wb") as f:
        w = sstable.SSTableWriter(f, 2)
        for i in range(0, 9000, 3):
            values[i] = np.arange(i % 50, dtype="<u2")
            w.add(sstable.make_key(i - 4000), values[i].tobytes())
        w.close()
    table = sstable.SSTable(str(path))
    assert len(table.blocks) > 2
    for i in range(9000):
        got = table.get(i - 4000)
        assert [g.tolist() for g in got] == ([values[i].tolist()] if i in values else [])
    assert sum(1 for _ in table.scan()) == 3000


# Toxicity


def test_grammar_marks():
    g = toxicity.Grammar({"idiot": 3.0})
    plain, aimed, negated, reported, threat = (g.evidence(t).tolist() for t in ("the idiot ran", "you are an idiot", "never an idiot", "she once said so of that other long gone idiot", "i will kill you"))
    assert plain == [3, 0, 0, 0, 0] and aimed == [0, 3, 0, 0, 0] and negated == [0, 0, 3, 0, 0]
    assert reported[3] == 3 and threat == [0, 0, 0, 0, 1]
    assert not g.evidence("videotic. nothing").any() and not g.evidence("").any()
    assert g.evidence("idiot! you all").tolist() == [3, 0, 0, 0, 0]


def test_grammar_takes_the_heaviest_of_all_paths():
    """Every path through the machines one after the other, against the composed machine."""
    rng = random.Random(41)
    g = toxicity.Grammar({"zonk": 2.0, "blork": 0.5})
    vocab = ["zonk", "blorky", "kill", "you", "never", "said", "word", "tree"]

    def paths(machine, symbols):
        found = [(machine.start, [], 0.0)]
        for x in symbols:
            found = [(q, [*out, y], w + u) for s, out, w in found for q, y, u in machine.arcs(s, x)]
        return [(out, w) for s, out, w in found if machine.accepts(s)]

    for _ in range(400):
        text = [rng.choice(vocab) for _ in range(rng.randrange(0, 9))]
        read = [g.read(x) for x in text]
        ends = [(marks, u + v + w) for one, u in paths(toxicity.negation(), [k for k, _ in read]) for two, v in paths(toxicity.report(), one) for marks, w in paths(toxicity.aim(), two)]
        weights = [w + sum(x for m, (_, x) in zip(marks, read, strict=True) if m is not None) for marks, w in ends]
        got = g.clause(text)
        best = [np.bincount([m for m in marks if m is not None], [x for m, (_, x) in zip(marks, read, strict=True) if m is not None], len(toxicity.MARKS)).tolist() for (marks, _), w in zip(ends, weights, strict=True) if w >= max(weights) - 1e-9]
        assert any(got == pytest.approx(b) for b in best)


def test_toxicity_held_out_accuracy(spark, odd, none, no_labels):
    rng = random.Random(29)
    rows = [(i, words(rng, 40) + (" you blorkface " if i % 3 == 0 else " ") + words(rng, 30), "en") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)] + [(5, 1, None), (None, 1, 1)], LABELS)
    docs = make(spark, rows)
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) / len(held) > 0.95
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and 250 < left.count() < 280
    by = toxicity.toxicity(odd, no_labels).collect()
    assert len(by) == odd.count() and not any(r["predicted"] for r in by) and toxicity.toxicity(none, no_labels).count() == 0


def test_toxicity_of_long_clauses_counts_each_insult_once():
    g = toxicity.Grammar({"zonk": 1.0})
    far = " and".join([" zonk" + " the plain word" * 100] * 3)
    assert len(far) > 4000 and g.evidence(far).sum() == 3
    fill = " plainword" * 300
    assert (g.evidence(f"he said{fill} zonk") == g.clause(f"he said{fill} zonk".split())).all()
    assert g.evidence((" zonk" + fill) * 40).sum() == 40


@pytest.mark.parametrize("text", ["½", "²", "Ⅷ 12", "", None, "!?"])
def test_a_text_without_a_letter_is_undetermined(spark, text):
    docs = make(spark, [(i, f"wort {i}", "de") for i in range(1, 30)] + [(1000, text, "de")])
    assert {r["lang_pred"] for r in langid.identify(docs).where("doc_id = 1000").collect()} == {"und"}


def test_spread_join_deals_heavy_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 3)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2] * 3 + [3] + [None] * 20 + [9])], "k long, v long")
    right = left.where("k in (1, 2, 3)").groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", F.col("k") * 10)
    for how, rows in (("inner", 44), ("left", 65)):
        got = common.spread_join(left, right, "k", "n", left.count(), how).collect()
        assert len(got) == rows and all(r["x"] == (None if r["k"] in (None, 9) else r["k"] * 10) for r in got) and len({r["v"] for r in got}) == rows
