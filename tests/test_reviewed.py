"""What the third review found: a test for each finding that would have failed before."""

from __future__ import annotations

import datetime
import uuid

import duckdb
import numpy as np
import pytest

from eventloom.operators import fits, graph, survive, transmit
from eventloom.plans import analysis, joins, relational
from eventloom.shared import materialize, parts_for
from eventloom.streaming import live


def test_words_end_where_sql_says(spark, tmp_path):
    texts = ["éla fin.", "là.", "la fin.", "öDIE x.", "die\nx.", "_the.", "the9.", "athe the", "ßthe.", "the.", "日la本.", None, ""]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    f, sql = relational.QUERIES["PRJ-05_well_formed"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, f(spark, str(tmp_path)).collect())) == sorted(con.sql(sql).fetchall())


def test_candidates_are_offered_to_two_slots_not_to_each_day(spark):
    rng = np.random.default_rng(2)
    rows = [(int(u), i, int(d), int(a)) for i, (u, d, a) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(-60, 60, 300), rng.integers(0, 3, 300)))] + [(0, 999, None, 1)]
    occ = spark.createDataFrame(rows, "unit long, occ long, day int, actor int")
    for reach in (1, 7, 20):
        df = transmit.candidates(occ, "unit", "occ", "day", "actor", reach)
        want = sorted((a[0], a[1], b[1], a[2] - b[2]) for a in rows[:-1] for b in rows[:-1] if a[0] == b[0] and a[3] != b[3] and 1 <= a[2] - b[2] <= reach)
        assert sorted(map(tuple, df.collect())) == want
    assert "sequence" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_forest_joins_no_finished_rows_and_sends_no_table_to_the_driver(spark, monkeypatch):
    rows = [(i, i - 1) for i in range(1, 20)] + [(0, None), (50, None), (60, 7), (61, 99)]
    sizes = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, tag, by=None: sizes.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, tag))
    got = {r.node: (r.root, r.generation) for r in graph.forest(spark.createDataFrame(rows, "n long, p long"), "n", "p").collect()}
    assert got == {i: (0, i) for i in range(20)} | {50: (50, 0), 60: (0, 8), 61: (99, 1)}
    assert len(sizes) > 2 and not any("Broadcast" in x for x in sizes)


def test_density_of_counts_is_that_of_rows():
    x, n, grid = np.array([0.1, 0.4, 0.9]), np.array([5, 1, 3]), np.linspace(0, 1, 5)
    assert np.allclose(fits.kde(x, grid, n), fits.kde(np.repeat(x, n), grid))


def test_layers_by_blocks_of_time(spark):
    rng = np.random.default_rng(7)
    at = {v: int(rng.integers(-20, 20)) for v in range(120)}
    edges = sorted({(a, b) for a, b in rng.choice(120, (400, 2)).tolist() if at[a] > at[b]})
    df = spark.createDataFrame([(c, p, at[c], at[p]) for c, p in edges], "c long, p long, tc long, tp long")
    want: dict[int, int] = {}
    for v in sorted({x for e in edges for x in e}, key=at.get):
        want[v] = max((want[p] + 1 for c, p in edges if c == v), default=0)
    for small in (20, 100, 1 << 20):
        got = graph.layers(df, "c", "p", small, times=("tc", "tp")).collect()
        assert len(got) == len(want) and {r.node: r.layer for r in got} == want
    with pytest.raises(ValueError, match="not earlier"):
        graph.layers(spark.createDataFrame([(1, 2, 5, 5)], "c long, p long, tc long, tp long"), "c", "p", 0, times=("tc", "tp"))


def test_layers_of_a_long_chain_take_few_blocks(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id + 1 AS c", "id AS p", "id + 1 AS tc", "id AS tp")
    tags = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, tag, by=None: tags.append(tag) or real(df, tag, by))
    assert {r.node: r.layer for r in graph.layers(df, "c", "p", 800, times=("tc", "tp")).collect()} == {k: k for k in range(3001)}
    assert 3 <= tags.count("layers") <= 8


def test_last_writers_of_first_touches_in_parts(spark):
    rows = [(None, 1, 3), (1, 5, 10), (1, 6, 10), (1, 7, 11), (1, 4, 12), (2, 9, 10), (1, 8, 12), (1, 3, None)]
    df = spark.createDataFrame(rows, "key long, who long, t long")
    got = graph.last_writer_edges(df, "key", "who", "t", first=True, parts=3, times=True)
    assert sorted(map(tuple, got.collect())) == [(4, 7, 1, 12, 11), (7, 6, 1, 11, 10), (8, 7, 1, 12, 11)]
    assert sorted(map(tuple, graph.last_writer_edges(df, "key", "who", "t").collect())) == [(4, 7, 1), (7, 6, 1), (8, 7, 1)]


def test_an_order_touches_a_part_once_in_a_task_of_few_rows(spark, tmp_path):
    t = [datetime.datetime(2024, 1, k) for k in range(1, 5)]
    spark.createDataFrame([(1, t[2]), (1, t[0]), (2, t[1]), (3, t[3])], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 7)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df, _ = analysis._touches(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(7, 1, t[0]), (7, 2, t[1]), (7, 3, t[3])]
    assert [parts_for(n) for n in (0, 1, 1 << 18, 36_000_000)] == [1, 1, 1, 138]


def test_streamed_last_writers_hold_groups_of_keys(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = sorted({(int(k), int(w)): (int(k), int(w), int(t)) for k, w, t in zip(rng.integers(0, 30, 400), rng.integers(-9, 99, 400), rng.integers(-5, 12, 400))}.values(), key=lambda r: r[2])
    for part in (rows[:100], rows[100:130], rows[130:]):
        spark.createDataFrame(part, "key long, who long, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, who long, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    df = live.stream_last_writers(stream, "key", "who", "t", groups=3)
    got = live.run_to_files(df, f"writers-{uuid.uuid4().hex}")
    batch = graph.last_writer_edges(spark.createDataFrame(rows, "key long, who long, t long"), "key", "who", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_shared_counts_hold_no_table_of_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(o), int(p)) for o, p in zip(rng.integers(0, 60, 400), rng.integers(0, 12, 400))] + [(o, 99) for o in range(1000, 1300)] + [(None, 1), (1, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(joins, "PAIRED", 7)
    df = joins.jn24(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(joins.JN24_SQL)
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_lineage_sends_no_table_to_the_driver(spark):
    texts = ["a", "a b", "x", "x", "y z", "y", "q", "x"]
    rel = materialize(survive.relations(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string"), "source", "doc_id", "text"), "relations")
    lin = survive.lineage(rel)
    assert "Broadcast" not in lin._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in survive.live_rows(lin)._jdf.queryExecution().executedPlan().toString()
