"""Queries over whole columns and tables, by SQL of their own."""

import duckdb
import pytest

from driftquarry.plans import base, registry
from driftquarry.sources import corpus


def whole(sf_dir, sql):
    con = duckdb.connect()
    for t in ("pages", "documents", "lineitem", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchall()


def test_f6_escapes_the_whole_page(spark, sf_dir):
    got = registry.queries()["f6_xml_escape"](spark, sf_dir).select("page_id", "x").collect()
    want = whole(sf_dir, "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') FROM pages")
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(len(x) for _, x in want) > 1300  # more than 200 characters can become


def test_u2_unites_all_batches(spark, sf_dir):
    got = registry.queries()["u2_union_batches"](spark, sf_dir).select("n", "total").collect()
    [(n, total, odd)] = whole(sf_dir, f"WITH {base.FACTS} SELECT count(*), sum(k), count(*) FILTER (WHERE NOT ok) FROM facts")
    assert odd  # non-finite and null divergences are among them
    assert [r[0] for r in got] == [n]
    assert got[0][1] == pytest.approx(total, abs=1e-4)


def test_f11_returns_every_token(spark, sf_dir):
    got = registry.queries()["f11_tokenize"](spark, sf_dir).select("row_idx", "n", "tokens").collect()
    want = whole(sf_dir, "SELECT doc_id, len(t), array_to_string(t, ' ') FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents)")
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(n for _, n, _ in want) > 3


def test_a5_has_every_student(spark, sf_dir):
    got = {r["student"]: (r["se"], r["se_method"]) for r in registry.queries()["a5_iid_se"](spark, sf_dir).collect()}
    clustered = {r[0]: r[1] for r in whole(sf_dir, registry.oracle_sql()["a4_clustered_se"])}
    [(iid, method)] = whole(sf_dir, f"WITH {base.FACTS} SELECT round(stddev_samp(k) / sqrt(count(k)), 8), 'iid' FROM facts WHERE student = 'N'")
    want = {s: (iid, method) if s == "N" else (se, "clustered-by-sequence") for s, se in clustered.items()}
    assert set(got) == set(want) and len(want) > 1
    assert {s: m for s, (_, m) in got.items()} == {s: m for s, (_, m) in want.items()}
    assert {s: e for s, (e, _) in got.items()} == pytest.approx({s: e for s, (e, _) in want.items()}, abs=1e-7)


def test_pf2_has_every_conversation(spark, sf_dir):
    got = registry.queries()["pf2_chat_nonblank"](spark, sf_dir).select("row_idx", "n").collect()
    want = whole(sf_dir, "SELECT conv_id, length(string_agg('<' || role || '>' || text || chr(10), '' ORDER BY turn)) FROM conversations GROUP BY conv_id")
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(i % 7 == 0 for i, _ in want)


def test_chats_without_messages_are_left_out(spark):
    rows = spark.createDataFrame([(1, [("user", "a")]), (2, []), (3, None)], "conv_id long, messages array<struct<role:string,content:string>>")
    texts = corpus.corpus_texts(rows, "conv_id", lambda role, content: content)
    assert [r["row_idx"] for r in texts.collect()] == [1]
