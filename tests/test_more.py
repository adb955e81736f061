"""Values of the second-phase operators against brute force and by hand."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import anchors, desk, encode, markdown, refs
from eventloom.operators import excite, fits, graph, pointfit, resample, shift, survive
from eventloom.shared import cached, signature
from eventloom.streaming import live

# ---------------------------------------------------------------- fits of processes


def _pairs_design(t, k, n_kinds, betas, reach):
    e = np.zeros((len(t), n_kinds, len(betas)))
    for c, p in itertools.product(range(len(t)), repeat=2):
        if t[p] < t[c] and t[p] >= t[c] - reach:
            e[c, k[p]] += betas * np.exp(-betas * (t[c] - t[p]))
    return e


@pytest.mark.parametrize("seed", range(8))
def test_design_equals_pairs(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 70))
    t = np.sort(np.round(rng.uniform(0, 50, n), 1))  # with ties, and gaps of exactly the reach
    k = rng.integers(0, 3, n)
    betas = np.array([0.5, 3.0, 400.0])
    d = pointfit.design(t, k, 3, 50.0, betas, 4.0)
    assert np.allclose(d.e, _pairs_design(t, k, 3, betas, 4.0), atol=1e-9)
    assert np.allclose(d.g.sum(axis=0), (1 - np.exp(-np.outer(np.minimum(4.0, 50.0 - t), betas))).sum(axis=0))


@pytest.fixture(scope="module")
def made():
    mu, n = np.array([0.4, 0.2]), np.array([[0.4, 0.1], [0.2, 0.3]])
    t, k, _ = excite.simulate(np.random.default_rng(3), mu, n, 1.0, 2000.0)
    return mu, n, pointfit.design(t, k, 2, 2000.0, np.array([1.0, 0.2]), 8.0)


def test_gradient_and_certificate(made):
    _, _, d = made
    f = pointfit.fit(d, tol=1e-4)
    gm, ga = pointfit.gradient(d, f.mu, f.alpha)
    h = 1e-6
    for i in range(2):
        up, down = f.mu.copy(), f.mu.copy()
        up[i] += h
        down[i] -= h
        assert math.isclose(gm[i], (pointfit.loglik(d, up, f.alpha) - pointfit.loglik(d, down, f.alpha)) / (2 * h), rel_tol=1e-3, abs_tol=1e-2)
    better, gap = pointfit.newton(d, f)
    assert better.loglik >= f.loglik and gap < 1e-3
    # No fit from anywhere is better than the certificate says.
    for f2 in (pointfit.fit(d, tol=1e-12, most=3000), pointfit.multi_start(d, "cell", 4, 7)[0]):
        assert f2.loglik <= better.loglik + gap + 1e-9
        assert pointfit.certificate(d, f2) >= better.loglik - f2.loglik - 1e-9


def test_sharing_of_kernels(made):
    _, n, d = made
    lls = {s: pointfit.fit(d, s, tol=1e-9).loglik for s in ("cell", "class", "global")}
    assert lls["cell"] >= lls["class"] - 1e-3 >= lls["global"] - 2e-3
    f = pointfit.fit(d, "global", tol=1e-9)
    shape = f.alpha / f.alpha.sum(axis=2, keepdims=True)
    assert np.allclose(shape, shape[0, 0])
    assert np.abs(f.branching(np.array([1.0, 0.2]), 8.0) - n).max() < 0.12


def test_penalty_shrinks_and_is_chosen(made):
    _, _, d = made
    masses = [pointfit.fit(d, l1=p).alpha.sum() for p in (0.0, 50.0, 1000.0)]
    assert masses[0] > masses[1] > masses[2]
    rng = np.random.default_rng(0)
    parts = [pointfit.design(np.sort(rng.uniform(0, 100, 40)), rng.integers(0, 2, 40), 2, 100.0, np.array([1.0]), 8.0) for _ in range(8)]
    got = dict(pointfit.held_out(parts, [0.0, 1e4]))
    assert got[1e4] > got[0.0]  # nothing excites anything here


def test_truths_arms_and_blocks():
    mu, n = pointfit.truth(np.random.default_rng(1), 5, 0.7, 0.4)
    assert math.isclose(np.abs(np.linalg.eigvals(n)).max(), 0.7)
    for name in ("fitted", "no_self", "boosted_self"):
        m, b = pointfit.arm(mu, n, name)
        assert np.abs(np.linalg.eigvals(b)).max() <= 0.95 + 1e-9 and (m > 0).all()
        if name == "no_self":
            assert not np.diag(b).any() and np.allclose(pointfit.expected_counts(m, b, 10.0), pointfit.expected_counts(mu, n, 10.0), rtol=0.05)
    w = np.kron(np.eye(3), np.ones((2, 2))) + 0.01
    order = [0, 2, 4, 1, 3, 5]
    assert pointfit.spectral_blocks(w[np.ix_(order, order)], 3).tolist() == [0, 1, 2, 0, 1, 2]
    assert np.allclose(pointfit.block_means(w, np.array([0, 0, 1, 1, 2, 2])), np.eye(3) + 0.01)
    with pytest.raises(ValueError):
        excite.simulate(np.random.default_rng(1), np.ones(1), np.array([[1.0]]), 1.0, 10.0)


def test_windows_are_merged_until_accepted():
    rng = np.random.default_rng(2)
    units = [pointfit.design(np.sort(rng.uniform(0, 50, n)), np.zeros(n, int), 1, 50.0, np.array([1.0]), 5.0) for n in (60, 5, 8, 70, 50)]
    got = pointfit.accept(units, 40, 1.0, np.array([1.0]), 5.0)
    assert [(a, b) for a, b, _ in got] in ([(0, 0), (1, 3), (4, 4)], [(0, 2), (3, 3), (4, 4)])
    assert got[0][0] == 0 and got[-1][1] == 4 and all(b + 1 == c for (_, b, _), (c, _, _) in zip(got, got[1:]))


# ---------------------------------------------------------------- versions, lines, graphs


def test_relations_of_versions(spark):
    base = "facts of a ü thing.\n"
    more = base + "a session"
    texts = [base, more, more + " note", more + " note", more, more[:-3], "rewritten", "rewritten, more", "dead", "rewritten, more and more", "", "x", None, "merged"]
    rows = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)] + [(100, "b", "only"), (200, None, "n"), (201, None, "n")], "id long, who string, text string")
    got = {r.id: (r.rel, r.base, r.base_lag) for r in survive.relations(rows, "who", "id", "text").collect()}
    assert got == {
        0: ("first", None, None), 1: ("append", 0, 1), 2: ("append", 1, 1), 3: ("ident", 2, 1), 4: ("revert", 1, 3), 5: ("trunc", 4, 1), 6: ("rewrite", 5, 1), 7: ("append", 6, 1),
        8: ("rewrite", 7, 1), 9: ("fork", 7, 2), 10: ("trunc", 9, 1), 11: ("append", 10, 1), 12: ("revert", 10, 2), 13: ("append", 12, 1), 100: ("first", None, None), 200: ("first", None, None), 201: ("ident", 200, 1),
    }
    rel = survive.relations(rows.where("who = 'a' AND id < 10"), "who", "id", "text")
    lin = survive.lineage(rel)
    assert {r.id: (r.gen, r.depth, r.parent, r.input) for r in lin.collect()} == {**{i: (0, 0, None, None) for i in range(6)}, 6: (6, 1, 0, 5), 7: (6, 1, None, None), 8: (8, 2, 6, 7), 9: (6, 1, None, None)}
    assert sorted(r.id for r in survive.live_rows(lin).collect()) == [0, 1, 2, 4, 5, 6, 7, 9]


def test_lines_and_what_replaced_them():
    a = ["title", "one two three", "same", "four five", "six", "end"]
    b = ["title", "one two 3 three", "same", "six seven", "new words", "five four", "end"]
    assert fits.line_changes(a, b) == [0, 1, 2, 5, 3, 6]
    assert fits.line_changes(["x", "y"], []) == [None, None] and fits.line_changes([], ["x"]) == []
    assert fits.line_changes(["a", "b", "c"], ["c", "a", "b"]) == [1, 2, None]  # c moved: its place before is gone
    assert fits.align_lines(["x"] * 20000 + ["u"], ["u"] + ["x"] * 20000) == [(20000, 0)]


def test_layers_by_rounds_and_at_once(spark):
    rng = np.random.default_rng(4)
    edges = sorted({tuple(sorted(rng.choice(40, 2, replace=False).tolist(), reverse=True)) for _ in range(70)})
    df = spark.createDataFrame(edges, "c long, p long")
    want: dict[int, int] = {}
    for v in sorted({x for e in edges for x in e}):
        want[v] = max((want[p] + 1 for c, p in edges if c == v), default=0)
    for small in (0, 1 << 20):
        assert {r.node: r.layer for r in graph.layers(df, "c", "p", small).collect()} == want
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (1, 9)], "c long, p long")
    for small in (0, 1 << 20):
        with pytest.raises(Exception, match="cycle"):
            graph.layers(cycle, "c", "p", small).collect()


def test_ancestors(spark):
    up = spark.createDataFrame([(i, i - 1 if i % 10 else None) for i in range(1, 60)], "n long, p long")
    got = graph.ancestors(up, "n", "p", spark.createDataFrame([(27,), (44,), (44,)], "node long"))
    assert sorted(r.node for r in got.collect()) == [*range(20, 28), *range(40, 45)]


def test_last_writers_across_batches(spark, tmp_path):
    rows = [(1, 5, 10), (1, 6, 10), (1, 7, 11), (1, 4, 12), (2, 9, 10), (1, 8, 12)]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "key long, who long, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, who long, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    import uuid

    got = live.run_to_files(live.stream_last_writers(stream, "key", "who", "t"), f"writers-{uuid.uuid4().hex}")
    batch = graph.last_writer_edges(spark.createDataFrame(rows, "key long, who long, t long"), "key", "who", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) == [(4, 7, 1), (7, 6, 1), (8, 7, 1)]


# ---------------------------------------------------------------- change points


def test_kernel_changes_against_all_splits():
    rng = np.random.default_rng(5)
    for _ in range(10):
        x = np.concatenate([rng.normal(m, 1, 8) for m in (0, 4, 4)])
        gamma, penalty, least = shift.bandwidth(x), 1.0, 3
        gram = np.exp(-gamma * np.square(x[:, None] - x[None]))
        cost = lambda a, b: (b - a) - gram[a:b, a:b].sum() / (b - a)
        best = min(((sum(cost(a, b) for a, b in zip([0, *cuts], [*cuts, 24])) + penalty * len(cuts), cuts) for r in range(4) for cuts in itertools.combinations(range(3, 22), r) if all(b - a >= least for a, b in zip([0, *cuts], [*cuts, 24]))), key=lambda z: z[0])
        assert shift.pelt_kernel(x, penalty, least, gamma) == list(best[1])


def test_series_driver(spark):
    rng = np.random.default_rng(6)
    rows = [("step", i, float(v)) for i, v in enumerate(np.concatenate([rng.normal(0, 1, 20), rng.normal(9, 1, 20)]))]
    rows += [("flat", i, 1.0) for i in range(30)] + [("short", i, float(i)) for i in range(5)] + [("holes", i, None if i % 2 else float(rng.normal())) for i in range(40)]
    got = {r.by: r for r in shift.series_summary(spark.createDataFrame(rows, "s string, o long, x double"), "s", "o", "x").collect()}
    assert {k: r.status for k, r in got.items()} == {"step": "ok", "flat": "constant", "short": "short", "holes": "ok"}
    assert got["step"].means == "20" and "20" in got["step"].kernel.split(",") and got["holes"].n == 20


def test_student_t_is_a_density():
    x = np.linspace(-4000, 4000, 2_000_001)
    assert math.isclose(np.exp(shift.student_t_logpdf(x, 3.0, 1.0, 2.0)).sum() * (x[1] - x[0]), 1.0, rel_tol=1e-5)


# ---------------------------------------------------------------- texts


def test_typed_kinds_and_context():
    assert desk.typed_kind("weather in the north", address_bar=True) == "search"
    assert desk.typed_kind("abc", secret_box=True) == "credential"
    assert desk.typed_kind(None) == "other" and desk.typed_kind("echo hi > f && ls") == "shell"
    assert anchors.context_key("no word here: 5", 14, 15) == "here"


def test_sessions_carry_focus_within_the_gap():
    d = desk.Desk(gap_s=100)
    assert d.turn("s1", 0, "type", "https://a.org/x") == [("read", "https://a.org/x", "visit")]
    assert d.turn("s1", 10, "key", "ctrl + s") == [("write", "https://a.org/x", "key")]
    assert d.turn("s2", 50, "click", "Publish") == [("write", "https://a.org/x", "click_carried")]
    assert d.turn("s3", 500, "click", "Publish") == [("write", "", "click_gap")]
    assert d.turn("s3", 501, "key", "ctrl+l") == [] and d.turn("s3", 502, "type", "some words of search") == []
    assert d.turn("s3", 503, "type", "This text is long enough to be one.") == [("write", "", "type_gap")]
    assert d.turn("s3", 504, None, None) == [] and d.turn("s3", 505, "message", "see ~/a/b and https://b.org/y") == [("mention", "~/a/b", "message"), ("mention", "https://b.org/y", "message")]
    assert d.turn("s3", 506, "bash", "cd /tmp/w && git clone https://github.com/o/n.git") == [("read", "/tmp/w", "shell_cd"), ("read", "code:github.com/o/n", "shell_git_clone")]


def test_markdown_errors_and_empty():
    assert markdown.change_log("") == [] and markdown.roster("no table") == [] and markdown.to_html("") == ""
    with pytest.raises(ValueError):
        markdown.change_log("## Changes\n\n## 2024-02-01 to 2024-01-01\n\n- x")
    with pytest.raises(ValueError):
        markdown.roster("## Roster\n| Name | Model | Joined | Left |\n|--|--|--|--|\n| a | m | soon | active |")
    assert markdown.to_html("<script>*x*</script>") == "<p>&lt;script&gt;<em>x</em>&lt;/script&gt;</p>"
    for text in ("- ", "#", "```", "|", "1. ", "**", "a\n- b", "| a |\n|--|"):
        assert "<script" not in markdown.to_html(text)  # marks with nothing after them end


def test_report_columns_round_trip():
    values = ["red", "blue", None, "red", "red", "blue", "red", "red"] * 5
    c = encode.encode_column("x", values)
    assert "codes" in c and encode.decode_column(c) == values
    assert encode.decode_column(encode.encode_column("y", ["a", "b"])) == ["a", "b"]
    assert encode.safe([float("nan"), 1 << 60, {"a": float("inf")}]) == [None, str(1 << 60), {"a": None}]
    assert [encode.column_type(v) for v in ([True, None], [1, 2], [1, 2.5], ["a", 1], [None])] == ["boolean", "integer", "number", "text", "empty"]
    assert "</script" not in encode.dumps("</script>")


def test_cache_by_signature(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x long, y string")
    again = df.orderBy(F.desc("x"))
    assert signature(df) == signature(again) != signature(df.distinct()) and signature(df) != signature(df.selectExpr("x AS z", "y"))
    made = []
    import uuid

    tag = uuid.uuid4().hex
    for version, want in (("1", False), ("1", True), ("2", False)):
        got, there = cached(tag, version, [again], lambda: made.append(1) or df.groupBy("y").count())
        assert there == want and {r.y: r["count"] for r in got.collect()} == {"a": 1, "b": 2}
    assert len(made) == 2


def test_units_are_uniform(spark):
    r = spark.range(20000).select(resample.unit(7, F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u"), F.countDistinct("u")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] < 0.001 and 0.999 < r[2] < 1 and r[3] == 20000


def test_references_do_not_leak_secrets():
    for t in ("https://h.org/?access_token=abcdef&x=1", "https://h.org/p/ghp_abcdefghijklmnop", "https://user:pw@h.org/x", "/home/u/sk-abcdefghijklmnop/f"):
        got = " ".join(refs.extract(t))
        assert got and not any(s in got for s in ("abcdef", "pw@"))


# ---------------------------------------------------------------- the same by other plans


def _times(spark, seed, n):
    import datetime as dt
    import random

    r = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, r.choice("ab"), t0 + dt.timedelta(seconds=r.choice([r.randrange(3 * 86400), 900 * r.randrange(288)]), microseconds=r.choice([0, 1]))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz"), rows


def test_blocks_do_not_depend_on_buckets(spark):
    from eventloom.operators import segment

    df, _ = _times(spark, 1, 300)
    for by in ((), ("k",)):
        want = sorted(map(tuple, segment.run_blocks(df, "ts", 900, by, bucket_s=86400).collect()))
        for bucket in (60, 3600, 5000):
            assert sorted(map(tuple, segment.run_blocks(df, "ts", 900, by, bucket_s=bucket).collect())) == want


def test_run_columns_by_lists_and_by_lookup(spark):
    from eventloom.operators import segment

    df, _ = _times(spark, 2, 120)
    blocks = segment.run_blocks(df.where("k = 'a'"), "ts", 900).where("block <> 2")
    got = [sorted(map(str, segment.run_columns(df, blocks, "ts", few=n).collect())) for n in (0, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == 120
    assert segment.run_columns(df, blocks.limit(0), "ts").where("block IS NULL").count() == 120


def test_recent_counts_against_pairs(spark):
    from eventloom.operators import segment

    df, rows = _times(spark, 3, 250)
    e = df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    span = 7200 * 1_000_000
    us = {i: (k, (t - rows[0][2].replace(month=1, day=1, hour=0, minute=0, second=0, microsecond=0)).total_seconds()) for i, k, t in rows}
    want = {i: sum(k2 == k and 0 < round((x - y) * 1e6) <= span for j, (k2, y) in us.items()) for i, (k, x) in us.items()}
    for width in (600 * 1_000_000, span, 10 * span):
        assert {r.id: r.n for r in segment.recent_counts(e, ["k"], "id", "us", span, width).collect()} == want


def test_logistic_by_sums(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * x[:, 1])))).astype(float)
    g = ["p" if i % 3 else "q" for i in range(400)]
    df = spark.createDataFrame([(g[i], float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(400)], "g string, a double, b double, y double")
    got = fits.logistic_by(df, "g", ["a", "b"], "y")
    for key in "pq":
        at = np.array([v == key for v in g])
        assert np.allclose(got[key], fits.logistic(x[at], y[at]), atol=1e-6)
    assert fits.logistic_by(df.limit(0), "g", ["a", "b"], "y") == {}
