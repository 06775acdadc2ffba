"""The Merkle manifest, the source mix and the prefix trie against plain loops, on small odd inputs and with SQL."""

import binascii
import hashlib
import random

import pytest
from conftest import TESTDATA
from oracle import assert_same, connect
from pyspark.sql import functions as F

from tidegauge.llm import merkle, mixing, prefix_trie, queries

SMALL = TESTDATA / "sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def crc(n):
    return binascii.crc32(str(n).encode())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    """Root, and the (left, right) siblings of each leaf from below."""
    paths, members = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, inside = [], []
        for a in range(0, len(hashes), 16):
            run = hashes[a : a + 16]
            for j in range(len(run)):
                for m in members[a + j]:
                    paths[m].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            inside.append([m for x in members[a : a + 16] for m in x])
        hashes, members = up, inside
    return hashes[0], paths


def manifest_of(rows):
    by, out = {}, []
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    for own in by.values():
        own.sort(key=lambda x: x[:3])
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: tree([x[2] for x in by[s]]) for s in by}
    root, above = tree([own[s][0] for s in order])
    for s, upper in zip(order, above, strict=True):
        for (known, i, leaf, r), lower in zip(by[s], own[s][1], strict=True):
            path = lower + upper
            folded = leaf
            if known and crc(i) % 5 == 0 and r[4] is not None:
                folded = leaf_of(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((i if known else None, leaf, own[s][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


ODD_TEXTS = [None, "", "low", "Éa Bc", "日本 😀 X", "line\nB", "same A", "same A"]


@pytest.mark.parametrize("n", [1, 16, 17, 300])
def test_manifest(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["hot", "hot", "b", None, "é", "", f"s{i % 40}"]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice(ODD_TEXTS)) for i in range(n)]
    rows += [(None, "hot", None, None, None), (3, "hot", None, None, "Twice"), (3, "hot", None, None, "Twice"), (3, "b", "x", 1, "Long " * 50_000), (-7, "hot", "en", 2, "Z")]
    rows = rows if n > 1 else rows[:1]
    df = spark.createDataFrame(rows, DOCS).withColumn("number", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("_s0", F.lit(1))
    got = sorted((tuple(r) for r in merkle.documents_manifest(df).collect()), key=str)
    assert got == manifest_of(rows)
    if n > 16:
        assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_manifest_of_nothing_and_of_three_levels(spark):
    assert merkle.documents_manifest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "one", None, None, f"T{i}") for i in range(4200)]
    got = sorted((tuple(r) for r in merkle.documents_manifest(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == manifest_of(rows)


def aims_of(sizes, weights, epochs=3):
    """Sharing again and again until no source is above its limit."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while True:
        share = {s: left * weights[s] / sum(weights[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = epochs * sizes[s]
            left -= out[s]
        open_ -= full


def test_mix(spark):
    rng = random.Random(5)
    shape = {"a": (400, 30), "b": (3, 5), None: (40, 12), "": (200, 9), "é": (60, 20), "zz": (1, 4), "nil": (5, 0)}
    rows = [(len(shape) * k + j, s, None, None, " ".join(["w"] * rng.randint(0 if w == 0 else 1, 2 * w)) + " \t\x0b\n") for j, (s, (n, w)) in enumerate(shape.items()) for k in range(n)]
    rows += [(None, "a", None, None, None), (7, "a", None, None, "two words"), (7, "a", None, None, "two words"), (8, "b", None, None, "w w  x"), (9, "a", None, None, "word " * 3000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("x")).withColumn("u", F.lit(1)).withColumn("target", F.lit(1)).withColumn("through", F.lit(1))
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (14, 1, 0), (21, 0, 1), (None, 1, 1), (28, None, 0)], "doc_id long, quality int, toxic int")
    again = mixing.documents_mix(df.repartition(7), labels, [1, 2, 3]).collect()
    assert sorted(map(str, mixing.documents_mix(df, labels, [1, 2, 3]).collect())) == sorted(map(str, again))
    assert len(again) == len(rows)
    words = lambda t: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w])
    sizes, most = {}, {}
    for _, s, _, _, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
        most[s] = max(most.get(s, 0), words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    aims = aims_of(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    source = {r[0]: r[1] for r in rows if r[0] not in (None, 7, 8, 9)}
    assert abs(sum(aims.values()) - sum(sizes.values())) < 1e-6
    for r in again:
        if r.doc_id not in source:
            continue
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(aims[s], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    whole = spark.createDataFrame([(r.source_size, r.target, r.taken) for r in again], "s long, t double, k long").groupBy("s", "t").agg(F.sum("k").alias("k")).collect()
    for r in whole:
        s = next(x for x in sizes if sizes[x] == r.s and abs(aims[x] - r.t) < 1e-6)
        assert abs(r.k - r.t) <= most[s] / 2 + 1e-9
    assert mixing.documents_mix(df.limit(0), labels, [1]).count() == 0


def test_better_documents_are_drawn_more_often(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("quality"), mixing.draw("id").alias("u"))
    aims = spark.createDataFrame([("a", 200_000, 40_000.0)], "source string, source_size long, target double")
    got = mixing.mix(rows, aims, ["doc_id"]).where("sampled").toPandas()
    assert len(got) == 4000 and set(got.epochs) == {0}
    assert 0.72 < (got.doc_id % 2 == 0).mean() < 0.84  # for a fifth of all: about 0.78


def trie_of(rows):
    own, digest = {}, lambda r, x: sha(f"{len(r)}:{r}{x}")
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, digest(r or "", x or ""), (r or "", x or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    seqs = {c: tuple(turns.get(c - c % 100, [])[: crc(c) % 6] + turns[c][crc(c) % 6 :]) for c in turns}
    members, kids = {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = sum(saved[q] for q in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(ends[p])) for p, m in members.items()), key=str)


@pytest.mark.parametrize("block", [4, 4096])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 30)
    rng = random.Random(block)
    said = ["", None, "a", "bb", "日本😀", "long " * 200]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in [*range(0, 40), *range(100, 130), 205, 310, 399] for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", "copy") for c in range(400, 470) for t in range(3)]
    rows += [(500, t % 90, "user", f"t{t % 40}") for t in range(200)] + [(600, None, "user", "x"), (600, None, "user", "x"), (600, 1, "a", ""), (None, 1, "user", "nobody"), (601, 1, "user", "")]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("n", F.lit(1)).withColumn("block", F.lit(1)).withColumn("chars", F.lit(1))
    got = sorted((tuple(r) for r in prefix_trie.conversations_trie(df).collect()), key=str)
    assert got == trie_of(rows)
    assert prefix_trie.conversations_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_source_mix", "op13_prefix_trie"])
def test_against_sql(spark, name):
    if not SMALL.exists():
        pytest.skip("the driver's tables are not here")
    assert_same(queries.QUERIES[name](spark, str(SMALL)), connect(SMALL), queries.ORACLES[name])


def test_the_mix_needs_no_python(spark):
    df = spark.createDataFrame([(1, "a", "en", 1, "x y")], DOCS)
    plan = mixing.documents_mix(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), [1, 2, 3])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
