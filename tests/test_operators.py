"""Operators on small made inputs, against plain Python."""

from __future__ import annotations

import datetime as dt
import gzip
import random
import uuid

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.operators import asof, excite, graph, resample, segment, shift, survive, swarm
from eventloom.sources import jsonl

T0 = dt.datetime(2024, 1, 1, 8)


def at(s: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=s)


def test_gap_at_the_threshold_does_not_split(spark):
    df = spark.createDataFrame([(at(0),), (at(900),), (at(1800.000001),), (None,)], "ts timestamp_ntz")
    got = segment.run_blocks(df, "ts", 900).orderBy("block").collect()
    assert [(r.block, r.n_rows, r.duration_s) for r in got] == [(1, 2, 900.0), (2, 1, 0.0)]
    assert segment.pauses(segment.run_blocks(df, "ts", 900)).count() == 1
    assert segment.run_blocks(df.limit(0), "ts", 900).count() == 0


def test_asof_ties_nulls_and_tolerance(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(5)), (3, "b", at(1)), (4, None, at(9)), (5, "a", None)], "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", at(5), 1), ("a", at(5), 2), ("a", at(9), 3), ("b", None, 4), (None, at(1), 5)], "k string, rt timestamp_ntz, v int")
    run = lambda **kw: {r.id: r.v for r in asof.asof(left, right, ["k"], "ts", "rt", ["v"], tie="v", **kw).collect()}
    assert run() == {1: 3, 2: 2, 3: None, 4: None, 5: None}
    assert run(strict=True) == {1: 3, 2: None, 3: None, 4: None, 5: None}
    assert run(direction="forward") == {1: None, 2: 1, 3: None, 4: None, 5: None}
    assert run(direction="forward", strict=True) == {1: None, 2: 3, 3: None, 4: None, 5: None}
    assert run(tolerance=0.5) == {1: None, 2: 2, 3: None, 4: None, 5: None}


def test_greedy_match_is_the_sequential_pass(spark):
    r = random.Random(1)
    pairs = list({(r.randrange(15), r.randrange(15)): float(r.randrange(6)) for _ in range(70)}.items())
    left, right, want = set(), set(), []
    for (a, b), c in sorted(pairs, key=lambda x: (x[1], x[0])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.append((a, b, c))
    got = asof.greedy_match(spark.createDataFrame([(a, b, c) for (a, b), c in pairs], "lid long, rid long, cost double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_window_candidates_have_closed_ends(spark):
    a = spark.createDataFrame([(1, "u", at(0)), (2, "u", at(100))], "id int, k string, ts timestamp_ntz")
    b = spark.createDataFrame([(7, "u", at(0)), (8, "u", at(60)), (9, "u", at(60.000001)), (10, "v", at(1))], "id int, k string, ts timestamp_ntz")
    got = asof.window_candidates(a, b, ["k"], "id", "ts", "id", "ts", 0, 60, 16).collect()
    assert sorted((r.lid, r.rid) for r in got) == [(1, 7), (1, 8)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5, width=32), min_size=6, max_size=28), st.floats(0.1, 6), st.integers(1, 4))
def test_pelt_is_optimal(x, penalty, least):
    x = np.array(x)

    def cost(cuts):
        e = [0, *cuts, len(x)]
        return sum(float(((x[a:b] - x[a:b].mean()) ** 2).sum()) for a, b in zip(e, e[1:])) + penalty * len(cuts)

    assert abs(cost(shift.pelt(x, penalty, least)) - cost(shift.segment_optimal(x, penalty, least))) < 1e-6


def test_online_run_lengths_fall_at_a_change():
    x = np.concatenate([np.random.default_rng(1).normal(0, 1, 60), np.random.default_rng(2).normal(8, 1, 40)])
    r = shift.bocpd(x, 0.01)
    assert r[58] > 40 and r[70] < 15 and r[99] > 30


def test_stream_state_gives_what_the_batch_gives(spark, tmp_path):
    from eventloom.streaming import live

    x = np.concatenate([np.random.default_rng(7).normal(0, 1, 25), np.random.default_rng(8).normal(5, 1, 15)])
    path = f"{tmp_path}/in"
    for part in (range(0, 18), range(18, 40)):  # two batches
        spark.createDataFrame([("s", int(i), float(x[i])) for i in part], "series string, day int, x double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("series string, day int, x double").option("maxFilesPerTrigger", 1).parquet(path)
    got = live.run_to_files(live.stream_runs(stream, "series", "day", "x", 0.05), f"runs-{uuid.uuid4().hex}", "append").orderBy("o").collect()
    assert [r.run for r in got] == shift.bocpd(x, 0.05).tolist()


def test_excitation_is_recovered():
    rng = np.random.default_rng(4)
    mu, n = np.array([0.4, 0.2]), np.array([[0.5, 0.0], [0.3, 0.2]])
    t, kind, parent = excite.simulate(rng, mu, n, 1.0, 4000.0)
    assert abs((parent >= 0).mean() - 0.5) < 0.12
    m, alpha, ll = excite.fit_em(t, kind, 2, 4000.0, np.array([1.0]), 10.0)
    assert np.abs(alpha[:, :, 0] - n).max() < 0.12 and np.abs(m - mu).max() < 0.1
    assert ll >= excite.fit_em(t, kind, 2, 4000.0, np.array([1.0]), 10.0, most=3)[2]


def test_exponential_gaps_pass_and_others_fail():
    rng = np.random.default_rng(5)
    assert excite.ks_exponential(rng.exponential(1, 2000))[1] > 0.01
    assert excite.ks_exponential(rng.uniform(0, 2, 2000))[1] < 1e-6


def test_layers_and_forest(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (3, 1), (4, 3), (4, 9)], "c long, p long")
    assert {r.node: r.layer for r in graph.layers(e, "c", "p").collect()} == {1: 0, 9: 0, 2: 1, 3: 2, 4: 3}
    f = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)] + [(50, None)], "n long, p long")
    got = {r.node: (r.root, r.generation) for r in graph.forest(f, "n", "p").collect()}
    assert got == {i: (0, i) for i in range(20)} | {50: (50, 0)}


def test_last_writer_needs_an_earlier_one(spark):
    t = spark.createDataFrame([("k", 1, 5), ("k", 2, 5), ("k", 3, 6), ("k", 3, 9), ("j", 3, 1)], "key string, who int, t int")
    assert sorted(map(tuple, graph.last_writer_edges(t, "key", "who", "t").collect())) == [(3, 2, "k")]


def test_risk_sets(spark):
    u = spark.createDataFrame([("a", 1, True), ("a", 3, True), ("a", 3, False), ("a", 2, False)], "g string, last int, lost boolean")
    got = survive.hazards(survive.risk_counts(u.withColumnRenamed("g", "grp"), ["grp"], "last", "lost"), ["grp"]).orderBy("g").collect()
    assert [(r.g, r.at_risk, r.lost) for r in got] == [(1, 4, 1), (2, 3, 0), (3, 2, 1)]
    assert abs(got[-1].survival - 0.75 * 0.5) < 1e-12


def test_bootstrap_covers(spark):
    rows = [("x", i, float(v), 1.0) for i, v in enumerate(np.random.default_rng(3).normal(5, 1, 200))]
    r = resample.bootstrap_ratio(spark.createDataFrame(rows, "g string, c long, a double, b double"), ["g"], "c", "a", "b", 300).first()
    assert r.lo < r.ratio < r.hi and 0.15 < r.hi - r.lo < 0.45


def test_teams_are_faster_but_not_free():
    parents, layer, time = swarm.grow(np.random.default_rng(1), 100, 6, 0.3)
    one, _ = swarm.work(parents, layer, time, 1)
    four, busy = swarm.work(parents, layer, time, 4)
    assert one / 4 < four < one and busy >= time.sum()
    assert all(all(layer[p] == layer[c] - 1 for p in ps) for c, ps in enumerate(parents))


def test_json_lines(spark, tmp_path):
    path = f"{tmp_path}/x.jsonl.gz"
    with gzip.open(path, "wt") as f:
        f.write('{"id": "a", "at": "2024-01-01T00:00:00.5Z", "n": "7", "data": {"k": 1}, "odd": 1}\n{"id": "b", "at": "nope", "n": "x"}\n\nnot json\n[1]\n')
    spec = jsonl.TableSpec("t", {"id": "string", "at": "timestamp", "n": "bigint", "data": "string"}, ("data",))
    lines = jsonl.read_lines(spark, path)
    main, text = jsonl.typed(lines, spec)
    assert [(r.id, r.n) for r in main.orderBy("id").collect()] == [("a", 7), ("b", None)]
    assert main.where("id = 'a'").first()["at"] == dt.datetime(2024, 1, 1, 0, 0, 0, 500000)
    assert text.where("id = 'a'").first()["data"] == '{"k":1}'
    assert tuple(jsonl.counters(lines, spec).first()) == (4, 2, 1, 1)
