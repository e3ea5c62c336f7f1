"""Exact deduplication, the n-gram join and passage deduplication against brute force, with awkward inputs."""

import itertools
import random

import numpy as np
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from driftquarry.llm import common, exact_dedup, ngram_join, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content_hash string, spans_ int, row_ int"


def frame(spark, rows):
    """(id, text) rows as documents, with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x", 1, 2) for i, t in rows], SCHEMA)


def corpus(seed, n=60):
    """Random texts with exact copies, near copies, shared passages, null, empty and very long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([0, 1, 3, 30, 120]))]
        kind = rng.random()
        if kind < 0.2 and rows:
            words = (rng.choice(rows)[1] or "").split()
        elif kind < 0.45 and rows:
            words = [w if rng.random() > 0.04 else word() for w in (rng.choice(rows)[1] or "").split()]
        elif kind < 0.65:
            at = rng.randint(0, len(words))
            words = words[:at] + passage + words[at:]
        rows.append((i, " ".join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, None), (n + 3, " \n "), (n + 4, ""), (n + 5, " ".join(word() for _ in range(30_000))), (None, "null id"), (3, rows[3][1])]
    return rows


def brute_exact(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is not None:
            first.setdefault(t, i)
    return sorted(list(first.values()) + [i for i, t in rows if t is None], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, seed):
    rows = corpus(seed)
    df = frame(spark, rows)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted([r[0] for r in kept.collect()], key=str) == brute_exact(rows)
    assert sorted([r[0] for r in exact_dedup.kept_ids(df).collect()], key=str) == brute_exact(rows)


def test_exact_shuffled_join_and_empty(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(exact_dedup, "small_or_shuffled", lambda df: df)
    assert sorted([r[0] for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()], key=str) == brute_exact(rows)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def test_exact_with_dots_in_names(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, None, 4)], "`my.id` long, `the.text` string, `a.b` int")
    kept = exact_dedup.exact_dedup(df, "my.id", "the.text")
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == [1, 3]
    named = frame(spark, [(1, "a"), (2, "a"), (3, "b")]).withColumnRenamed("lang", "lang.code")
    assert sorted(r[0] for r in exact_dedup.exact_dedup(named).collect()) == [1, 3]


def test_packed_arrays_do_not_overflow():
    with pytest.raises(OverflowError):
        common.binaries(np.zeros(1 << 28, np.uint64), [0, 1 << 28])


def sets(rows, n):
    out = {}
    for i, t in rows:
        if i is not None and t is not None:
            w = [y for x in t.split() if (y := regex.sub(r"[^\p{L}\p{N}]+", "", x.lower()))]
            if w:
                out[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))
    return out


def brute_join(rows, n, threshold):
    grams, rep, out = sets(rows, n), {}, {}
    for i in sorted(grams):
        first = rep.setdefault(grams[i], i)
        if first != i:
            out[first, i] = 1.0
    for a, b in itertools.combinations(sorted(rep.values()), 2):
        j = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
        if j >= threshold:
            out[a, b] = round(j, 6)
    return out


@pytest.mark.parametrize("seed,n,threshold", [(1, 5, 0.45), (2, 3, 0.7), (3, 5, 0.3)])
def test_join(spark, monkeypatch, seed, n, threshold):
    monkeypatch.setattr(ngram_join, "MEETING", 300)  # several fragments and blocks
    monkeypatch.setattr(ngram_join, "FRAGMENT", 500)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "HOT", 6)
    monkeypatch.setattr(ngram_join, "MARKED", 6000 if seed == 1 else 3)
    rows = corpus(seed)
    got = ngram_join.ngram_join(frame(spark, rows), n, threshold).collect()
    assert {(r[0], r[1]): r[2] for r in got} == pytest.approx(brute_join(rows, n, threshold), abs=1e-6)
    assert len(got) == len({(r[0], r[1]) for r in got})


def test_join_keeps_ties_at_the_threshold(spark):
    rows = [(1, "a b c d"), (2, "a b c e"), (3, "x y")]  # 2-grams: 2 of 4 in common
    assert [tuple(r) for r in ngram_join.ngram_join(frame(spark, rows), 2, 0.5).collect()] == [(1, 2, 0.5)]
    assert ngram_join.ngram_join(frame(spark, []), 2, 0.5).collect() == []
    assert ngram_join.ngram_join(frame(spark, [(1, None), (2, ""), (None, "a b")]), 2, 0.5).collect() == []


def brute_groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed,hot", [(1, 1000), (4, 1000), (5, 4)])
def test_drop_near(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = corpus(seed)
    # A class of near copies, and a chain in which only neighbours are near.
    rows += [(300 + i, " ".join(f"x{k}" if k != i else f"y{i}" for k in range(40))) for i in range(20)]
    rows += [(400 + i, " ".join(f"z{k}" for k in range(8 * i, 8 * i + 40))) for i in range(8)]
    df = frame(spark, rows)
    roots = brute_groups(brute_join(rows, 5, 0.45))
    kept = ngram_join.drop_near(df)
    assert kept.columns == df.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted((i for i, _ in rows if roots.get(i, i) == i), key=str)


def test_components_of_chains(spark):
    order = list(range(40))
    random.Random(1).shuffle(order)
    pairs = [(min(p), max(p)) for p in itertools.pairwise(order)] + [(100, 101), (101, 102)]
    got = {r[0]: r[1] for r in ngram_join.components(spark.createDataFrame(pairs, "doc_a long, doc_b long")).collect()}
    want = {k: v for k, v in brute_groups(pairs).items() if k != v}
    assert {k: v for k, v in got.items() if k != v} == want


def brute_spans(rows, length):
    first, out = {}, set()
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        w, current = t.split(), None
        for p in range(len(w) - length + 1):
            source = first.setdefault(tuple(w[p : p + length]), (i, p))
            if source != (i, p):
                if current and p <= current[1] + length:
                    current[1] = p
                else:
                    if current:
                        out.add((i, current[0], current[1] + length, current[2]))
                    current = [p, p, source[0]]
        if current:
            out.add((i, current[0], current[1] + length, current[2]))
    return out


def test_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 31), (3, 40)])
def test_spans(spark, seed, length):
    rows = corpus(seed)
    got = suffix_dedup.repeated_spans(frame(spark, rows), length).collect()
    assert {tuple(r) for r in got} == brute_spans(rows, length)


def test_spans_within_a_document_and_empty(spark):
    rows = [(1, "be " * 70), (2, "to " * 49)]
    assert [tuple(r) for r in suffix_dedup.repeated_spans(frame(spark, rows)).collect()] == [(1, 1, 70, 1)]
    assert suffix_dedup.repeated_spans(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(frame(spark, rows), 30)


@pytest.mark.parametrize("seed", [1, 6])
def test_cut(spark, seed):
    rows = corpus(seed)
    df = frame(spark, rows)
    kept = suffix_dedup.cut_repeats(df)
    assert kept.columns == df.columns
    spans = {}
    for i, b, e, _ in brute_spans(rows, 50):
        spans.setdefault(i, []).append((b, e))
    want = []
    for i, t in rows:
        cut = spans.get(i, [])
        words = [w for k, w in enumerate((t or "").split()) if not any(b <= k < e for b, e in cut)]
        if not cut:
            want.append((i, t))
        elif words:
            want.append((i, " ".join(words)))
    got = kept.select("doc_id", "text", "n_chars").collect()
    tidy = lambda t: None if t is None else " ".join(t.split())
    assert sorted(((r[0], tidy(r[1])) for r in got), key=str) == sorted(((i, tidy(t)) for i, t in want), key=str)
    assert all(r[2] == len(r[1]) for r in got if r[1] is not None)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n", max_size=90), min_size=1, max_size=8))
def test_join_property(spark, texts):
    rows = list(enumerate(texts))
    got = {(r[0], r[1]): r[2] for r in ngram_join.ngram_join(frame(spark, rows), 2, 0.5).collect()}
    assert got == pytest.approx(brute_join(rows, 2, 0.5), abs=1e-6)
