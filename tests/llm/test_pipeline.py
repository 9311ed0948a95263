"""The pipeline on a small corpus with planted cases, each stage against what brute force expects of its own input."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import jaccard_join
from tidemark.llm.common import materialize

from .test_operators import brute_links, words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    where = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, words(rng, 25, 4000) + ". " + words(rng, 4, 4000) + ".") for i in range(6)]
    rows, labels = [], []
    for i in range(260):
        body = words(rng, rng.randrange(60, 150), 4000)
        if i % 4 == 1:
            body = body[:200] + " you blorkface " + body[200:]
        if i % 13 == 0:
            body += " " + items[i // 13 % 6][1] + " " + words(rng, 10)
        if i % 10 == 2:
            body += f" mail joe{i}@mail.example.com or +1 (555) 010-{1000 + i}"
        rows.append((i, body, "en", f"src{i % 3}", len(body)))
        labels.append((i, 1, int(i % 4 == 1)))
    for k in range(20):
        text = rows[4 * k][1].split()
        text[7] = "edited"
        rows.append((300 + k, " ".join(text), "en", "src0", 1))
    rows += [(400, None, None, None, None), (401, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, items


def test_stages_take_effect(spark, corpus):
    where, rows, items = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, where), name)
        assert docs.columns == names
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = [r for r in rows if "blorkface" not in (r[1] or "")]
    assert set(seen["toxicity"]) == {r[0] for r in clean}
    _, classes = brute_links([r[:3] for r in clean])
    assert set(seen["ngram_jaccard_join"]) == {clean[c][0] for c in classes}
    leaking = {i for i, t in seen["ngram_jaccard_join"].items() if any(x in (t or "") for _, x in items)}
    assert set(seen["ngram_jaccard_join"]) - set(seen["benchmark_decontamination"]) == leaking
    assert set(seen["pii"]) == set(seen["benchmark_decontamination"])
    assert not any("example.com" in (t or "") for t in seen["pii"].values()) and any("[EMAIL]" in (t or "") for t in seen["pii"].values())
    untouched = [i for i, t in seen["pii"].items() if not any(c.isdigit() for c in seen["benchmark_decontamination"][i] or "")]
    assert untouched and all(seen["pii"][i] == seen["benchmark_decontamination"][i] for i in untouched)


def test_run_packs_what_is_left(spark, corpus):
    where, rows, _ = corpus
    got = corpus_pipeline.run(spark, where).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert 100 < len({r["doc_id"] for r in got}) < len(rows) and jaccard_join.THRESHOLD == 0.8
