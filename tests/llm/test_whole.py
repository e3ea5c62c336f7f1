"""Corpus operators do the whole job: no pair, window or word is left out."""

import collections
import itertools

import numpy as np
import pytest

from driftquarry.llm import ngram_join, queries, suffix_dedup

from .test_dedup import brute_groups, brute_spans, corpus, frame, sets


def brute_pairs(rows, n, threshold):
    grams, out = sets(rows, n), {}
    for a, b in itertools.combinations(sorted(grams), 2):
        j = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
        if j >= threshold:
            out[a, b] = round(j, 6)
    return out


def brute_classes(rows, n, threshold):
    pairs = brute_pairs(rows, n, threshold)
    roots, links = brute_groups(pairs), collections.Counter(x for p in pairs for x in p)
    return {i: (roots.get(i, i), links[i]) for i, _ in rows if i is not None}


@pytest.mark.parametrize("block,hot,meeting", [(100_000, 1000, 2_000_000), (10, 4, 200), (40, 9, 1000)])
def test_op4_loses_no_link(spark, tmp_path, monkeypatch, block, hot, meeting):
    for name, value in (("BLOCK", block), ("HOT", hot), ("MEETING", meeting)):
        monkeypatch.setattr(ngram_join, name, value)
    near = "a b c d e f g h i j k l"
    rows = corpus(1) + [(100 + i, near) for i in range(5)] + [(200 + i, near + " m") for i in range(3)]
    rows += [(300 + i, " ".join(f"x{k}" if k != i else f"y{i}" for k in range(40))) for i in range(30)]  # a class of near copies
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_ngram_join(spark, str(tmp_path)).collect()
    want = brute_classes(rows, 5, 0.45)
    assert {r[0]: (r[1], r[2]) for r in got} == want
    assert len(got) == len(want) and want[104] == (100, 7)


def test_an_id_with_several_texts(spark):
    rows = [(1, "a b c d e"), (1, "v w x y z"), (2, "a b c d e"), (3, "v w x y z"), (4, "v w x y z"), (5, "p q r")]
    df = frame(spark, rows)
    assert sorted(tuple(r) for r in ngram_join.ngram_join(df, 2, 0.5).collect()) == [(1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0)]
    assert sorted(tuple(r) for r in ngram_join.near_classes(df, 2, 0.5).collect()) == [(1, 1, 3), (2, 1, 1), (3, 1, 2), (4, 1, 2), (5, 5, 0)]


def test_local_roots():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.integers(0, 40, (2, rng.integers(0, 40)))
        roots = brute_groups(list(zip(x.tolist(), y.tolist())))
        assert ngram_join.local_roots(x, y, 40).tolist() == [roots.get(i, i) for i in range(40)]


@pytest.mark.parametrize("a,b", [("x3106 x1901", "x3530 x4447"), ("x4465 x4806", "x1219 x3695")])
def test_op2_does_not_take_equal_bits_for_equal_words(spark, a, b):
    head = " ".join(f"w{i}" for i in range(48))  # the windows' fingerprints agree in the last 40 bits and the first 6
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}")]
    assert suffix_dedup.repeated_spans(frame(spark, rows)).collect() == []
    assert sorted(r[1] for r in suffix_dedup.cut_repeats(frame(spark, rows)).collect()) == sorted(t for _, t in rows)


@pytest.mark.parametrize("bits", [8, 13])
def test_op2_compares_words_where_fingerprints_collide(spark, bits):
    rows = corpus(1, 40)
    got = suffix_dedup.repeated_spans(frame(spark, rows), 50, bits).collect()
    assert sorted({tuple(r) for r in got}) == sorted(brute_spans(rows, 50))
    assert len(got) == len({tuple(r) for r in got})
