"""The pipeline's stages, each on what the one before it kept, against brute force."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from driftquarry.llm import ngram_join, packing

from .test_dedup import brute_groups, brute_join, brute_spans
from .test_layout import check_windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(55))
    rows, labels = [], []
    for i in range(160):
        text, bad = " ".join(word() for _ in range(rng.randint(60, 160))), rng.random() < 0.25
        kind = rng.random()
        if bad:
            text = " ".join(w + "***" for w in text.split())
        elif kind < 0.15 and rows:
            text = rng.choice(rows)[1]
            bad = "***" in text
        elif kind < 0.3 and rows:
            text = " ".join(w if rng.random() > 0.03 else word() for w in rng.choice(rows)[1].split())
            bad = "***" in text
        elif kind < 0.5:
            text = f"{text} {passage} {word()}"
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    rows += [(500, None), (501, ""), (502, " ".join(word() for _ in range(9000))), (503, passage), (504, None), (3, rows[3][1])]
    return rows, labels, {i for i, q, _ in labels if q} | {502, 503}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    rows, labels, good = corpus()
    spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], SCHEMA).coalesce(1).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    kept, docs = [], spark.read.parquet(f"{where}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, where)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        kept.append(docs.collect())
    return where, rows, good, kept


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_quality_keeps_good_documents(made):
    _, _, good, kept = made
    ids = {r[0] for r in kept[0]}
    assert len(good - ids) <= 2
    assert len(ids - good) <= 3 and not ids & {500, 501, 504}


def test_exact_stage(made):
    kept = made[3]
    first = {}
    for i, t in sorted(pairs(kept[0])):
        first.setdefault(t, i)
    assert sorted(r[0] for r in kept[1]) == sorted(first.values())


def test_near_stage(made):
    kept = made[3]
    roots = brute_groups(brute_join(pairs(kept[1]), ngram_join.N, ngram_join.THRESHOLD))
    assert sorted(r[0] for r in kept[2]) == sorted(i for i, _ in pairs(kept[1]) if roots.get(i, i) == i)
    assert len(kept[2]) < len(kept[1])


def test_passage_stage(made):
    kept = made[3]
    spans = {}
    for i, b, e, _ in brute_spans(pairs(kept[2]), 50):
        spans.setdefault(i, []).append((b, e))
    assert spans
    want = {}
    for i, t in pairs(kept[2]):
        words = [w for k, w in enumerate(t.split()) if not any(b <= k < e for b, e in spans.get(i, []))]
        if words:
            want[i] = words
    assert {r[0]: r[1].split() for r in kept[3]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3])


def test_packing_stage(made):
    kept = made[3]
    check_windows([tuple(r) for r in kept[4]], {r[0]: len(r[1].split()) for r in kept[3]}, packing.CAPACITY)


def test_run(spark, made):
    where, kept = made[0], made[3]
    assert sorted(map(tuple, entry.queries()["pipeline"](spark, where).collect())) == sorted(map(tuple, kept[4]))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
