import gzip
import io
import tarfile

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import graph, joins, learning, regimes
from tidegauge.operators import statistics as st
from tidegauge.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"url": "u", "article": {"title": "t"}, "other": 1}')
    (tmp_path / "a" / "seen_urls.json").write_text('{"url": "no"}')
    assert [(r.url, r.article.title) for r in files.read_articles(spark, f"file://{tmp_path}/a").collect()] == [("u", "t")]
    files.append_jsonl(spark.createDataFrame([(1, "x")], "a int, b string"), f"file://{tmp_path}/log")
    assert [tuple(r) for r in files.read_jsonl(spark, f"file://{tmp_path}/log", "a int, c string").collect()] == [(1, None)]
    (tmp_path / "j.jsonl").write_text('{"t": 1}\n{"t": 2}\n{"t": 3}\n{bad\n{"t": 5}\n')
    assert sorted(r.t for r in files.recover_journal(spark, f"file://{tmp_path}/j.jsonl", "t int", 2).collect()) == [2, 3]
    (tmp_path / "cal.json").write_text('{"fomc_meeting_dates": ["2024-01-31"], "nyse_holidays_2024": ["2024-01-01"], "nyse_holidays_2025": ["2025-01-01"]}')
    assert {r.kind for r in files.read_calendar(spark, f"file://{tmp_path}/cal.json").collect()} == {"fed", "holiday"}
    (tmp_path / "p").mkdir()
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        info = tarfile.TarInfo("m.tex")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"tar"))
    (tmp_path / "p" / "1").write_bytes(buf.getvalue())
    (tmp_path / "p" / "2").write_bytes(gzip.compress(b"gz"))
    (tmp_path / "p" / "3").write_bytes(b"raw")
    assert {r.text for r in files.read_paper_sources(spark, f"file://{tmp_path}/p").collect()} == {"tar", "gz", "raw"}


def test_pipeline_document_and_code(spark):
    doc = spark.sql(f"""SELECT from_json('{{"tickers": [{{"symbol": "A"}}], "correlations": [{{"a": "A", "b": "B", "corr": 0.5}}], "sentiments": {{"A": 0.1}}, "articles": []}}', '{files.PIPELINE}') AS d""").select("d.*")
    out = files.explode_pipeline(doc)
    assert tuple(out["tickers"].first())[2:] == (100.0, 0.0, 0.01) and out["correlations"].first().corr == 0.5 and out["sentiments"].first().symbol == "A"
    src = spark.createDataFrame([("/x/base.py", "class Base:\n    def run(self):\n        return 1\n"), ("/x/top.py", "import x.base\nclass Top(Base):\n    pass\nrun()\n"), ("/x/bad.py", "def (")], "path string, value string")
    edges = {(r.src, r.dst, r.etype) for r in joins.code_edges(files.python_modules(src)).collect()}
    assert edges == {("top", "base", "import"), ("top", "base", "inherit"), ("top", "base", "call")}
    assert [r.name for r in files.python_functions(src, 2).collect()] == ["run"]


def test_projections_and_subspaces(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), [float(3 * a if k else 0.1 * b), float(0.1 * b if k else 3 * a), 0.0]) for k, a, b in zip(rng.integers(0, 2, 80), rng.normal(size=80), rng.normal(size=80), strict=True)]
    df = spark.createDataFrame(rows, "y int, v array<double>")
    p = learning.pca_project(df, "v", 2).first()
    assert len(p.projected) == 2
    basis = learning.fit_subspaces(df, "v", "y", 1)
    scored = learning.project_validity(df, "v", basis[1], basis[0]).collect()
    assert np.mean([(r.validity > 0) == (r.y == 1) for r in scored if abs(r.validity) > 0.3]) > 0.95


def test_retrain_and_clusters(spark):
    rows = [(float(i % 7), float(i % 2), int(i % 2)) for i in range(60)]
    model, auc = learning.retrain([spark.createDataFrame(rows, "a double, e double, y int")], ["a"], "e", "y", folds=3)
    assert model is not None and auc > 0.95
    assert learning.retrain([spark.createDataFrame(rows[:4], "a double, e double, y int")], ["a"], "e", "y")[0] is None
    e = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(0, 10, 0.01)]
    c = {r.id: r.cluster for r in learning.cluster_graph(spark.createDataFrame(e, "src long, dst long, weight double"), 2).collect()}
    assert len({c[k] for k in range(5)}) == 1 and len({c[k] for k in range(10, 15)}) == 1 and c[0] != c[10]


def test_regimes(spark):
    spec = lambda re, im: [{"re": re, "im": im}]
    rows = [("s", 0, spec(-0.5, 1.0)), ("s", 1, spec(-0.01, 1.0)), ("s", 2, spec(0.2, 1.0)), ("s", 3, spec(0.3, 0.0))]
    got = regimes.bifurcation_status(spark.createDataFrame(rows, "k string, t int, z array<struct<re:double,im:double>>"), ["k"], "t", "z").orderBy("t").collect()
    assert [(r.status, r.type) for r in got] == [("stable", None), ("critical", "hopf"), ("bifurcation", "hopf"), ("stable", None)]
    df = spark.createDataFrame([([0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 1)], "l array<double>, p array<double>, n int")
    r = regimes.mix_horizons(df, "l", "p", tongues="n").first()
    assert abs(r.blended - 2.0 * 0.85) < 1e-9 and r.dominant == "long"
    sig = regimes.profile_signature(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), 5)
    r = spark.range(1).select(sig.alias("s"), regimes.compare_profiles(sig, sig).alias("c")).first()
    assert len(r.s) == 5 and abs(r.c - 1) < 1e-9
    m = spark.createDataFrame([("a", 0, -0.1, 1.0), ("a", 1, -0.2, 2.0), ("b", 0, 0.1, 1.0), ("b", 1, -0.2, 1.0)], "k string, idx int, alpha double, omega double")
    assert {(r.k, r.inside) for r in regimes.basin_gates(m, "k", 0.05, 0.1).collect()} == {("a", True), ("b", False)}
    assert {r.k: round(r.e_stab, 6) for r in regimes.spectral_energy(m, "k", 1.0).collect()} == {"a": 0.0, "b": 0.01}
    ph = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 1.0]), (2, [0.0, 3.0], [1.0, 0.01])], "d int, theta array<double>, amplitudes array<double>")
    assert {r.d for r in regimes.detect_resonance(ph, "d").collect()} == {1}


def test_observers_and_sections(spark):
    rows = [("e", t, [0.9**t, 0.5**t]) for t in range(20)] + [("short", 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "e string, t int, v array<double>")
    assert [r.e for r in learning.observer_state(df, "e", "t", "v").collect()] == ["e"]
    assert learning.spectral_robustness(df.where("e = 'e'"), "e", "t", "v", 2).first().robustness > 0
    docs = spark.createDataFrame([(1, "The theorem and the proof follow [1]. " * 2 + "\n\n" + "An amazing incredible thing happened here.")], "d int, t string")
    got = learning.section_profile(docs, "d", "t").orderBy("section").collect()
    assert len(got) == 2 and abs(sum(r.weight for r in got) - 1) < 1e-9 and got[0].technical > 0 < got[1].hype
    prof = st.source_profile(spark.createDataFrame([("a", [float(i), float(i * i % 5)]) for i in range(9)] + [("b", [float(i % 3), float(i)]) for i in range(9)], "s string, v array<double>"), "s", "v")
    assert learning.fiber_resonance(st.spectral_summary(prof, "s", 2), "s").count() == 1


def test_shortest_path_goes_on_until_it_is_settled(spark):
    from tidegauge.operators import graph

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(104)], "src long, dst long, cost double").coalesce(1)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {r.node: r.distance for r in graph.shortest_path(edges, 0).collect()} == {i: float(i) for i in range(105)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_spectra_and_transfer_cover_whole_vectors(spark, tmp_path):
    import numpy as np

    from tidegauge.plans import registry

    v = np.random.default_rng(11).normal(size=(60, 16)) * np.arange(1, 17)
    spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = np.linalg.eigvalsh(np.cov(v.T))[::-1]
    got = registry.QUERIES["d05_spectral_summary"](spark, str(tmp_path)).first()
    assert np.allclose(got.eigenvalues, want[:5]) and np.isclose(got.concentration, want[0] / want.sum())
    x = np.c_[np.ones(60), v[:, :8]]
    w = np.linalg.solve(x.T @ x + 1e-3 * np.diag([0, *[1] * 8]), x.T @ v[:, 8:])
    assert np.allclose(registry.QUERIES["d06_fit_transfer"](spark, str(tmp_path)).first().weights, w.T.ravel(), atol=1e-6)


def _strong(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            more = set().union(*(reach[m] for m in reach[n])) - reach[n] if reach[n] else set()
            if more:
                reach[n] |= more
                changed = True
    return {(n, min(m for m in reach[n] if n in reach[m])) for n in nodes if n in reach[n]}


def test_cycles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    for n, m in ((12, 14), (25, 40), (30, 45)):
        edges = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b}
        got = graph.cycles(spark.createDataFrame(sorted(edges) + [(5, 5)], "src long, dst long"))
        assert {tuple(r) for r in got.collect()} == _strong(edges)
    assert graph.cycles(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_lift(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(3, 5))
    x = rng.normal(size=(40, 5))
    rows = [("a", a.tolist(), (w @ a).tolist()) for a in x] + [("few", [1.0] * 5, [1.0] * 3)] * 2
    df = spark.createDataFrame(rows, "k string, x array<double>, y array<double>")
    got = st.fit_lift(df, ["k"], "x", "y", ridge=0.5, most_rank=2, bound=0.9).collect()
    u, size, v = np.linalg.svd(np.linalg.solve(x.T @ x + 0.5 * np.eye(5), x.T @ x @ w.T).T, full_matrices=False)
    want = (u[:, :2] * size[:2] * min(1, 0.9 / size[0])) @ v[:2]
    assert [(r.k, r.n, r["rank"]) for r in got] == [("a", 40, 2)] and np.allclose(np.reshape(got[0].matrix, (3, 5)), want) and got[0].radius <= 0.9 + 1e-9
    lifted = st.apply_lift(df, st.fit_lift(df, ["k"], "x", "y", 0.5, 2, 0.9), ["k"], "x").collect()
    assert all(r.lifted is None if r.k == "few" else np.allclose(r.lifted, want @ r.x) for r in lifted)


def test_blocks_hold_every_row_once(spark):
    from tidegauge.operators.blocks import in_blocks

    rows = spark.range(50).withColumnRenamed("id", "q")
    for most in (3, 50, 1000):
        out = in_blocks(rows, "q", lambda b: b.join(spark.range(2), F.lit(True)), most)
        assert sorted(tuple(r) for r in out.collect()) == [(q, k) for q in range(50) for k in range(2)]
    assert in_blocks(rows.limit(0), "q", lambda b: b).count() == 0


def test_series_in_batches_keep_their_state(spark):
    from tidegauge.streaming import states

    rng = np.random.default_rng(5)
    rows = [(k, i, [float(x) for x in rng.normal(size=2) + (3 if i % 60 < 30 else -3)]) for k in ("a", "b", None) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, i long, v array<double>").withColumn("ts", F.timestamp_seconds("i"))
    whole = states.regime_events(df, "k", "ts", "v").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = states.regime_events(df, "k", "ts", "v").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    named = lambda found: sorted((r.k or "", r.ts, r.regime, r.event) for r in found)
    assert named(parts) == named(whole) and len(whole) == len(rows) and {r.event for r in whole} >= {"enter", "switch"}


def test_redundant_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 5))
    rows = [(i, (base[i % 12] * rng.choice([-2.0, 1.0, 3.0]) + rng.normal(size=5) * rng.choice([0.005, 0.05, 0.3])).tolist()) for i in range(80)] + [(90, [0.0] * 5), (91, [0.0] * 5)]
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if any(x)}
    for eps in (0.02, 0.2):
        name = {i: i for i, _ in rows}
        for _ in rows:
            for i, x in v.items():
                for j, y in v.items():
                    if np.sqrt(max(0.0, 1 - (x @ y) ** 2)) < eps and name[j] < name[i]:
                        name[i] = name[j]
        got = graph.merge_redundant(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", eps).collect()
        sizes = {c: list(name.values()).count(c) for c in set(name.values()) if c < 90}
        assert {r.component: r.members for r in got if r.component < 90} == sizes and len(sizes) < 80
