"""Profiles of sources, transfer fits, summaries of repositories and pairs of spectra against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidegauge.functions import text as tx
from tidegauge.operators import profiles
from tidegauge.operators import windows as win


def test_own_profiles_come_in(spark):
    base = profiles.default_profiles(spark)
    own = spark.createDataFrame([(0, "new.org", "a", 1.0, "one", True, False), (1, "ft.com", "b", 2.0, "two", True, False), (2, "ft.com", "c", 3.0, "three", False, False), (3, "org", "d", 4.0, "four", True, True)], profiles.PROFILE)
    both = profiles.with_profiles(base, own)
    assert [r.domain for r in both.orderBy("ord").collect()] == [r.domain for r in base.orderBy("ord").collect()] + ["new.org", "org"]
    urls = ["https://www.FT.com/x", "http://arxiv.org/abs/1", "https://a.new.org", "http://x.org:80/y", "nothing", None, "http://o/", "http://sec.gov.arxiv.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    got = {r.i: r.profile and r.profile.parser for r in profiles.match_source(pages, both).collect()}
    assert got == {0: "three", 1: "academic", 2: "one", 3: "four", 4: None, 5: None, 6: None, 7: "academic"}
    assert profiles.match_source(pages, base.limit(0)).where("profile is not null").count() == 0


def test_transfer_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for s, n in (("a", 40), ("b", 7), ("c", 3), ("d", 2), (None, 9)):
        x, h = rng.normal(size=(n, 3)), rng.integers(0, 90, n).astype(float)
        y = x @ [1.0, -2.0, 0.5] + rng.normal(size=n) * 0.1 + 4
        rows += [(s, x[i].tolist(), float(y[i]), float(h[i])) for i in range(n)]
        w = np.linalg.solve(x.T @ x + np.eye(3), x.T @ y)
        told = x @ w + y.mean() - w @ x.mean(0)
        want[s] = (w, y.mean() - w @ x.mean(0), 1 - ((y - told) ** 2).sum() / ((y - y.mean()) ** 2).sum(), told.std() / y.std(), max(0.0, told.std() - y.std()), max(float(np.median(h)), 0.1) if n > 3 else None)
    got = {r.s: r for r in profiles.fit_transfer(spark.createDataFrame(rows, "s string, x array<double>, y double, h double"), "s", "x", "y", "h").collect()}
    assert set(got) - {None} == set("abcd") and got["d"].weights is None and got["c"].decay is None
    for s, (w, bias, r2, amp, inflation, decay) in want.items():
        if s in got and s != "d":
            g = got[s]
            assert np.allclose(g.weights, w) and np.allclose([g.bias, g.r2, g.amplification, g.inflation], [bias, r2, amp, inflation], atol=1e-9) and (g.decay == decay)


def test_repo_summary(spark):
    readme = "# Title\n\n![badge](x) and more text than thirty characters\n\nThis project reads tables and writes other tables.\n\n## Usage\n1. Install it first\n2. no\n# run the thing\n```\n## Next\n1. not a step here"
    rows = [(1, None, readme, ["README.md", "a/b/c.py", "a/b/c/d.py", "src/main.py", "go.mod", "x/go.mod"]), (2, "A description of more than twenty", "", ["load_all.py", "train.py"]), (3, "short", "tiny", []), (4, None, None, None)]
    got = {r.id: r for r in profiles.repo_summary(spark.createDataFrame(rows, "id int, d string, r string, f array<string>"), "id", "d", "r", "f").collect()}
    assert got[1].intent == "This project reads tables and writes other tables." and got[1].workflow == ["Install it first", "run the thing"]
    assert got[1].key_files == ["README.md", "src/main.py"] and got[1].file_patterns == ["a/b/c.py", "go.mod", "src/main.py"]
    assert got[2].intent.startswith("A desc") and got[2].workflow == ["load_input", "process"]
    assert got[3].intent == "GitHub repository (short)" and got[4].intent == "GitHub repository (no description)" and got[4].workflow == ["initialize", "execute", "output"]


def test_insights_and_dependencies(spark):
    files = spark.createDataFrame([("r", p) for p in ("a.py", "src/b.py", "src/c.go", "docs/x.md", ".hidden", "d.go", "lib/z")] + [("s", "Makefile")], "repo string, path string")
    got = {r.repo: (r.language, r.n_files, r.directories) for r in profiles.repo_insights(files, "repo", "path").collect()}
    assert got == {"r": ("go", 2, ["docs", "lib", "src"]), "s": ("unknown", 0, [])}
    bodies = spark.createDataFrame([('{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}',), ("# note\n numpy>=1 \n\nscipy[all]; x\n;only",), ("{}",)], "b string")
    assert [r.d for r in bodies.select(tx.dependencies(F.col("b")).alias("d")).collect()] == [["a", "b"], ["numpy", "scipy"], []]


def test_equivalent_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    sets = [[rng.uniform(-1, 1) for _ in range(rng.randrange(1, 6))] for _ in range(120)]
    df = spark.createDataFrame([*enumerate(sets), (500, []), (501, None)], "id int, s array<double>")

    def far(x, y):
        a, b = (sorted(map(abs, v), reverse=True) for v in (x, y))
        n = max(len(a), len(b))
        return sum(abs(p - q) for p, q in zip(a + [0.0] * (n - len(a)), b + [0.0] * (n - len(b)), strict=True)) / n

    want = {(i, j): far(sets[i], sets[j]) for i in range(120) for j in range(i + 1, 120)}
    for limit in (0.05, 0.3):
        got = {(r.a, r.b): r.distance for r in profiles.equivalent_pairs(df, "id", "s", limit).collect()}
        assert set(got) == {p for p, d in want.items() if d < limit} and all(abs(d - want[p]) < 1e-12 for p, d in got.items())


def test_templates_uncovered_and_stagnant(spark):
    new = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, -1.0]), (3, [0.0, 0.0])], "q int, v array<double>")
    stored = spark.createDataFrame([(7, [2.0, 0.1]), (8, [1.0, 1.0])], "id int, v array<double>")
    assert [(r.q, r.template) for r in profiles.match_template(new, stored).collect()] == [(1, 7)]
    counts, first = profiles.uncovered(spark.createDataFrame([("a_1",)], "id string"), spark.createDataFrame([("a_1",), ("a_2",), ("b_1",), ("b_2",)], "id string"), "id", 2)
    assert {(r.prefix, r.uncovered) for r in counts.collect()} == {("a", 1), ("b", 2)} and [r.id for r in first.collect()] == ["a_2", "b_1"]
    x = [("flat", i, 1.0) for i in range(12)] + [("rise", i, float(i)) for i in range(12)] + [("few", i, 1.0) for i in range(9)] + [("back", i, float(min(i, 9 - i))) for i in range(10)]
    got = win.stagnant(spark.createDataFrame(x, "k string, t int, v double"), ["k"], "t", "v")
    assert {r.k for r in got.collect()} == {"flat", "back"}
