"""Packing, sharding and exact search against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftquarry.llm import hilbert, packing, queries, vector_file


def best_fill(counts, space):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    return max(s for s in sums if s <= space)


def test_fill_is_the_closest():
    rng = random.Random(1)
    for _ in range(300):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 4))}
        space = rng.randint(0, 30)
        used = packing.fill(counts, space)
        assert all(0 < n <= counts[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == best_fill(counts, space)


def test_plan_follows_the_heuristic():
    """Each window is opened by the largest length left and has the least slack that the rest allows."""
    rng = random.Random(2)
    histogram = {rng.randint(1, 20): rng.randint(1, 9) for _ in range(8)}
    left, window = dict(histogram), 0
    for first, used, times in packing.plan(histogram, 20):
        assert first == window
        for _ in range(times):
            top = max(k for k, n in left.items() if n)
            rest = {k: n - (k == top) for k, n in left.items() if n - (k == top) > 0}
            assert top in used and sum(k * n for k, n in used.items()) == top + best_fill(rest, 20 - top)
            for k, n in used.items():
                left[k] -= n
        window += times
    assert not any(left.values())


def check_windows(rows, lengths, capacity):
    windows, seen = {}, {}
    for doc, piece, window, offset, length in rows:
        windows.setdefault(window, []).append((offset, length))
        seen.setdefault(doc, []).append((piece, length))
    assert sorted(windows) == list(range(len(windows)))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, parts in seen.items():
        assert sum(n for _, n in parts) == lengths[doc]
        assert all(n == capacity for _, n in sorted(parts)[:-1])
    assert set(seen) == {k for k, n in lengths.items() if n}


def test_pack(spark):
    rng = random.Random(3)
    lengths = {i: rng.choice([0, 1, 3, 7, 8, 9, 31, 32, 33, 100]) for i in range(300)}
    rows = [(i, " ".join("w" * n) if n else rng.choice(["", None, " \n"]), 5) for i, n in lengths.items()] + [(None, "a b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = [tuple(r) for r in packing.pack(df, 32).collect()]
    check_windows(got, lengths, 32)
    least = -(-sum(lengths.values()) // 32)
    assert len({r[2] for r in got}) <= least + 3
    assert packing.pack(df.limit(0), 32).collect() == []
    assert packing.pack(df, 32, "length").count() == 300


def test_pack_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string")
    got = packing.pack(df, 8).collect()
    assert len(got) == 3 and len({(r[2], r[3]) for r in got}) == 3


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def documents(spark, n=2000):
    rng = random.Random(4)
    rows = [(i, rng.choice(["en", "de", None]), f"src{rng.randint(0, 19)}", rng.choice([None, -5, 0, rng.randint(1, 9000)]), "x") for i in range(n)]
    return spark.createDataFrame(rows + rows[:3] + [(None, None, None, None, None)], "doc_id long, lang string, source string, n_chars long, shard string"), rows


def test_shards_are_runs_of_the_curve(spark):
    df, _ = documents(spark)
    got = hilbert.assign(df, target=200_000).collect()
    assert len(got) == df.count()
    by_shard = {}
    for _, h, s in got:
        by_shard.setdefault(s, []).append(h)
    ends = [(min(v), max(v)) for _, v in sorted(by_shard.items())]
    assert len(ends) > 5 and all(a[1] <= b[0] for a, b in itertools.pairwise(ends))
    weight = {r[0]: max(r[3] or 0, 0) for r in documents(spark)[1]}
    total = {s: 0 for s in by_shard}
    for i, _, s in got:
        total[s] += weight.get(i, 0)
    assert max(total.values()) < 200_000 + 9000
    assert hilbert.assign(df.limit(0)).collect() == []


def test_written_shards_prune(spark, tmp_path):
    df, _ = documents(spark)
    hilbert.write_shards(df, str(tmp_path / "s"), target=200_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    files = back.selectExpr("_metadata.file_name AS f", "source", "n_chars")
    per_file = files.where("n_chars > 0").groupBy("f").agg({"source": "min", "n_chars": "max"}).collect()
    assert len(per_file) > 5
    assert files.where("source = 'src7'").select("f").distinct().count() < len(per_file)


def brute_nearest(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = set()
    for n, i in enumerate(ids):
        d = np.sqrt(((x - x[n]) ** 2).sum(1))
        ranked = sorted((d[m], j) for m, j in enumerate(ids) if j != i)[:k]
        out |= {(i, r + 1, j, round(float(dist), 6)) for r, (dist, j) in enumerate(ranked)}
    return out


def test_search(spark, monkeypatch):
    monkeypatch.setattr(vector_file, "BLOCK", 64)
    monkeypatch.setattr(vector_file, "PART", 2)
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(300)}
    vectors[7] = vectors[8] = vectors[9]  # ties
    bad = [(900, None), (901, []), (902, [1.0] * 7 + [None]), (903, [1.0] * 7), (904, [float("nan")] * 8), (None, [0.0] * 8)]
    rows = [(i, v, "x") for i, v in [*vectors.items(), *bad, (3, vectors[3])]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    for k in (1, 5):
        assert {tuple(r) for r in vector_file.top_k(df, k).collect()} == brute_nearest(vectors, k)


@pytest.mark.parametrize("offset,scale", [(1e4, 1), (1e7, 1), (1e8, 1), (-1e8, 1), (0, 1e-6), (0, 1e6), (1e8, 1e6)])
def test_search_at_any_magnitude(spark, monkeypatch, offset, scale):
    monkeypatch.setattr(vector_file, "BLOCK", 100)
    rng = np.random.default_rng(11)
    vectors = {i: (offset + scale * rng.normal(size=16)).tolist() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    assert {tuple(r) for r in vector_file.top_k(df, 5).collect()} == brute_nearest(vectors, 5)


def test_bounds_hold_and_batches_grow(spark, monkeypatch):
    """A far outlier makes cells so wide that bounds tell little: many batches are read, the result is the same."""
    monkeypatch.setattr(vector_file, "BLOCK", 50)
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=4).tolist() for i in range(200)} | {500: [1e5] * 4}
    x = np.array(list(vectors.values()))
    low, step = x.min(0), (x.max(0) - x.min(0)) / vector_file.CELLS
    cells = np.clip(np.floor((x - low) / step), 0, 255).astype(np.uint8)
    radius = np.sqrt(((x - (low + (cells + 0.5) * step)) ** 2).sum(1))
    lower, upper = vector_file.distance_bounds(x, cells, radius, low, step)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert (lower <= d).all() and (d <= upper).all()
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    assert {tuple(r) for r in vector_file.top_k(df, 2).collect()} == brute_nearest(vectors, 2)


def test_search_of_stated_queries(spark, tmp_path):
    rng = np.random.default_rng(8)
    vectors = {i: rng.normal(size=3).astype(np.float32).tolist() for i in range(-40, 90)}
    spark.createDataFrame([(i, v, 1) for i, v in vectors.items()], "vec_id long, embedding array<float>, asked int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in queries.op7_top_k(spark, str(tmp_path)).collect()}
    assert got == {r for r in brute_nearest(vectors, 10) if r[0] % 20 == 0}
    assert vector_file.top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>"), queries=F.col("vec_id") > 5).collect() == []


def test_search_small_tables(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vector_file.top_k(df, 10).collect()) == [(1, 1, 3, 1.0), (1, 2, 2, 5.0), (2, 1, 3, 4.242641), (2, 2, 1, 5.0), (3, 1, 1, 1.0), (3, 2, 2, 4.242641)]
    assert vector_file.top_k(df.limit(0)).collect() == []
    assert vector_file.top_k(df.limit(1)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r[3] for r in vector_file.top_k(same, 2).collect()} == {0.0}


def test_full_cells_and_lengths_are_several_tasks_work(spark, monkeypatch):
    rows = [(i, "en", "web", 10, "a b c") for i in range(500)] + [(None, "en", "web", 10, "d e"), (7, "en", "web", 10, "f")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["shard"]) for r in hilbert.assign(df, target=100).collect())
    assert [s for _, s in got] == sorted(s for _, s in got) and {s for _, s in got} == set(range(51))  # in order of the id, ten rows a shard
    monkeypatch.setattr(packing, "RANKED", 20)
    packed = packing.pack(df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), 7).collect()
    check_windows([tuple(r) for r in packed], dict.fromkeys(range(500), 3) | {7: sum(r["length"] for r in packed if r["doc_id"] == 7)}, 7)


def test_write_shards_of_nothing_and_of_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "en", "web", 3, "a", 1), (2, "de", "news", 4, "b", 2)], "doc_id long, lang string, source string, n_chars long, hilbert_ string, shard_ int")
    hilbert.write_shards(df, f"{tmp_path}/two")
    back = spark.read.parquet(f"{tmp_path}/two")
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    hilbert.write_shards(df.limit(0), f"{tmp_path}/none")
    assert spark.read.schema(df.schema).parquet(f"{tmp_path}/none").collect() == []
