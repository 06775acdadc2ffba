"""Encoding, language, toxicity, lines, near copies, repeated strings, leaks and shards on small odd inputs."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import decontamination, language_id, line_dedup, piece_bpe, sharding, simhash, suffix_dedup, toxicity
from tidegauge.llm.common import held_out

DOCS = "doc_id long, text string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    """With further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("key", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("start", F.lit(None).cast("int")).withColumn("lang", F.lit("en")).withColumn("kind", F.lit(0)).withColumn("score", F.lit(2.0)).withColumn("component_id", F.lit(-5))


ODD = [(1, None), (2, ""), (3, "a"), (4, "Long word " + "x" * 20_000), (5, "same text here"), (5, "same text here"), (6, "same text here"), (7, "\n\n \t"), (8, "日本 ßé 😀\x00")]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = frame(spark, ODD)
    got = {r.doc_id: r for r in piece_bpe.round_trip_digests(rows, MODEL).collect()}
    for i, t in ODD:
        ids = lib.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    back = piece_bpe.decode(piece_bpe.encode(rows, MODEL), MODEL)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, lib.decode(lib.encode(t or ""))) for i, t in ODD}
    assert piece_bpe.round_trip_digests(frame(spark, []), MODEL).count() == 0


def test_pieces_of_random_texts_equal_the_library():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_bpe.PieceModel(open(MODEL, "rb").read())
    rng = random.Random(5)
    parts = [" ", "  ", "   ", "\n", "the", "in", "er", "▁", "é", "日本", "😀", "\x00", "1", "00", "ing", "aaaa", "eee"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = own.encode(t)
        assert ids == lib.encode(t) and own.decode_bytes(ids) == lib.decode(ids).encode()


def test_language(spark):
    words = {"aa": "alpha apple anna", "bb": "birne bruder bald"}
    rows = [(i, " ".join(random.Random(i).choices(words["aa" if i % 2 else "bb"].split(), k=12)), "aa" if i % 2 else "bb") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "aa"), (101, "123 !!", "bb"), (102, "ALPHA apple", None), (None, "birne", "bb")], "doc_id long, text string, lang string")
    model = language_id.train(docs, lambda c: ~held_out(c))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert got[100] == ("und", 0.0) and got[101] == ("und", 0.0) and got[102][0] == "aa" and got[None][0] == "bb"
    assert all(got[i][0] == lang and 0 <= got[i][1] <= 1 for i, _, lang in rows)
    none = language_id.train(docs.limit(0), lambda c: ~held_out(c))
    assert none is None and {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_more_languages_than_a_plane_holds(spark):
    rng, letters = random.Random(10), "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rng.choices(letters, k=8)) for _ in range(6)] for k in range(70)}
    rows = [(12 * k + j, " ".join(rng.choices(words[lang], k=12)), lang) for k, lang in enumerate(words) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train(docs, lambda c: ~held_out(c))).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_toxicity(spark):
    rng = random.Random(1)
    bland, bad = [f"word{k}" for k in range(60)], ["vileone", "viletwo", "vilethree", "rotten"]
    rows = [(i, " ".join(rng.choices(bland, k=30) + (rng.choices(bad, k=3) if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.predict(docs, toxicity.train(docs, labels, lambda c: ~held_out(c))).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.5
    assert np.mean([(got[i] >= 0.7) == (y == 1) for i, _, y in rows]) > 0.98
    empty = toxicity.train(docs, labels.limit(0), lambda c: ~held_out(c))
    assert {round(r.score, 6) for r in toxicity.predict(docs, empty).collect()} == {0.0}


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    a = (y & (rng.random(2000) < 0.5)).astype(float)
    b = (y & (rng.random(2000) < 0.5)).astype(float)
    _, _, discount = toxicity.weights_of(np.stack([a, a, b], 1), y.astype(float))
    assert discount[0] < 0.6 < discount[2]


def _lines(docs, least_docs):
    held = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x).decode()) >= 40 and i is not None:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or len(held.get(key(x), ())) < least_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def test_lines_equal_brute_force_and_deletion_undoes_insertion(spark):
    rng = random.Random(2)
    pool = [f"{'Shared line of some length, number ' * 2}{k}" for k in range(6)]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), "  " + rng.choice(pool).upper() + "\t", f"own {i} " + "z" * 40, "short", ""]) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [*ODD[:4], (None, pool[0]), (50, pool[0]), (50, pool[0])]
    docs = frame(spark, rows)
    index = line_dedup.build(docs, 40)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.apply(index, docs, 5).collect()), key=str)
    assert got == _lines(rows, 5)
    first, more = docs.where("doc_id < 20"), docs.where("doc_id >= 20")
    small = line_dedup.build(first, 40)
    grown = line_dedup.insert(small, more)
    same = lambda a, b: {tuple(r) for r in a.counts.collect()} == {tuple(r) for r in b.counts.collect()}
    assert same(grown, index)
    back = line_dedup.delete(grown, more.select("doc_id"))
    assert same(back, small) and {(r.shard, r.n_keys) for r in back.filters.collect()} == {(r.shard, r.n_keys) for r in small.filters.collect()}
    assert line_dedup.apply(line_dedup.build(frame(spark, []), 40), frame(spark, []), 5).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 5000, np.uint64) for _ in range(2))
    f = line_dedup.CuckooFilter.of(a, b)
    assert f.contains(a, b).all()
    g = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    g.delete(a[:2500], b[:2500])
    assert g.contains(a[2500:], b[2500:]).all() and g.contains(a[:2500], b[:2500]).mean() < 0.01


@pytest.mark.parametrize("radius", [2, 7])
def test_near_copies_equal_brute_force(spark, radius):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = list(ODD)
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(120)] = "new"
        rows.append((100 + i, " ".join(words)))
    got = simhash.groups(frame(spark, rows), 3, radius).collect()
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in got}
    assert fp == {i: simhash.fingerprint(t, 3) for i, t in rows} and fp[1] == fp[2] == 0
    name = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= radius and name[j] < name[i]:
                    name[i], changed = name[j], True
    assert {r.doc_id: r.component_id for r in got} == name
    kept = simhash.keep_one(frame(spark, rows), 3, radius)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(name.values()))
    assert simhash.groups(frame(spark, []), 3, radius).count() == 0


@pytest.mark.parametrize("radius", [0, 7])
def test_similar_groups_equal_brute_force(spark, radius):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [*ODD, (None, "same text here"), (9, "w1 w2 w3 w4 W5"), (10, "w1  w2 w3 w4 w5")]
    for f in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((40, 120, 300)))]
        for k in range(8):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                words[rng.randrange(len(base))] = f"new{rng.randrange(99)}"
            rows.append((100 + 10 * f + k, " ".join(words)))
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()) for i, w in ((i, (t or "").lower().split()) for i, t in rows if i is not None)]
    similar = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    name = {i: i for i, _ in sets}
    edges = [(i, j) for i, x in sets for j, y in sets if similar(x, y)]
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            if name[j] < name[i]:
                name[i], changed = name[j], True
    got = simhash.similar_groups(frame(spark, rows), radius=radius).collect()
    assert {r.doc_id: r.component_id for r in got} == name and len(got) == len(sets)
    docs = frame(spark, rows).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(name.values()))
    assert simhash.similar_groups(frame(spark, []), radius=radius).count() == 0


def test_similar_groups_among_texts_of_shared_passages(spark, monkeypatch):
    """Mosaics of a few passages, of which some are near copies; no shingle is looked at first, some, or all."""
    rng = random.Random(12)
    parts = [" ".join(f"p{k}w{rng.randrange(40)}" for _ in range(25)) for k in range(9)]
    rows = []
    for i in range(70):
        own = " ".join(f"own{rng.randrange(9999)}" for _ in range(rng.choice((0, 2, 8, 30))))
        rows.append((i, " ".join([*rng.sample(parts, rng.randint(1, 5)), own])))
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, w in ((i, t.split()) for i, t in rows)]
    name = {i: i for i, _ in sets}
    for _ in range(len(sets)):
        for i, x in sets:
            for j, y in sets:
                if 5 * len(x & y) >= 4 * len(x | y) and name[j] < name[i]:
                    name[i] = name[j]
    assert len(set(name.values())) < len(name)
    for look in (0, 2**64 * 3 // 10, 2**64 - 1):
        monkeypatch.setattr(simhash, "LOOK", np.uint64(look))
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()} == name


@pytest.mark.parametrize("step", [7, 60, 2_000_000])
def test_shingles_equal_brute_force(step, monkeypatch):
    import pyarrow as pa

    from tidegauge.llm import shingles

    monkeypatch.setattr(shingles, "STEP", step)
    rng = random.Random(11)
    texts = [None, "", " \t\n", "He he HE he he he he", "x" * 200, "a b", "\x00 é\u00a0b 日本 c d e"] + ["".join(rng.choice(["a", "B", "b ", " ", "\n", "to ", "To\t", "é"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    array = pa.array(["cut off", *texts], pa.string()).slice(1)
    sets = {}
    for size in (1, 3, 5):
        got = [r for _, h, edges in shingles.words(array) for r in shingles.runs(h, edges, size)]
        named: dict[int, tuple] = {}
        for t, run in zip(texts, got, strict=True):
            words = (t or "").encode().lower().split()
            want = [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
            assert len(run) == len(want)
            for x, w in zip(run.tolist(), want, strict=True):
                assert named.setdefault(x, w) == w
            assert len(shingles.distinct(run)) == len(set(want))
            share = [sum(x >> k & 1 for x in run.tolist()) * 2 > len(run) for k in range(64)]
            assert shingles.majority(run) & (2**64 - 1) == sum(1 << k for k in range(64) if share[k])
        sets[size] = named
    assert not set(sets[3]) & {x for x, w in sets[5].items() if len(w) == 5}


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(4)
    sample = rng.integers(0, 2**64, 300, np.uint64)
    for radius in (0, 1, 2, 5, 7, 8):
        for total in (10, 10**6, 10**9):
            planned = simhash.plan(sample, total, radius)
            for _ in range(40):
                x = rng.integers(0, 2**64, 1, np.uint64)
                y = x ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, radius + 1), replace=False)))
                assert set(simhash.keys_of(x, planned)[0]) & set(simhash.keys_of(y, planned)[0])


def _removed(rows):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeated_strings_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [*ODD, (None, base)]
    for i in range(80):
        x = list(base)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(400)] = "É"
        rows.append((100 + i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) + "".join(x)[rng.randint(0, 150) : rng.randint(150, 400)] + rng.choice(["", "ab" * 150, "a" * 130])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(frame(spark, rows)).collect()}
    want = _removed(rows)
    assert {i: g for i, g in got.items() if i is not None} == want and got[None][1] == 0
    assert suffix_dedup.remove(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
def test_strings_repeated_within_one_text_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    rows = [(1, "a" * 150), (2, "b" * 253), (3, "c" * 101), (4, "d" * 100), (5, word(80) + "=-" * 60 + word(90)), (6, "e" * 150), (7, "e" * 150)]
    for k, p in enumerate((1, 2, 7, 31, 50, 75, 76, 77, 100)):
        line = word(p)
        rows += [(10 + 4 * k + j, (line * 200)[: 100 + p + more]) for j, more in enumerate((-1, 0, 1, 60))] if k % 2 else [(10 + 4 * k, word(30) + (line * 200)[: 100 + p])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(frame(spark, rows)).collect()}
    want = _removed(rows)
    assert got == want and want[1][1] == 149 and want[2][1] == 252 and want[3][1] == 100 and want[4][1] == 0
    for i, t in rows:  # each alone
        if i in (1, 2, 3, 5):
            assert [r.n_removed for r in suffix_dedup.remove(frame(spark, [(i, t)])).collect()] == [_removed([(i, t)])[i][1]]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    item = "".join(rng.choice("abcdefghij klm") for _ in range(120)).strip()
    few = item[:30] + "XY" + item[33:90] + item[92:]
    many = "".join(c if k % 4 else "?" for k, c in enumerate(item))
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    rows = [*ODD, (20, "before " + item.upper() + " after"), (21, "x " + few), (22, many), (23, item.replace(" ", "\n  ")), (24, item[:60])]
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.matches(frame(spark, rows), bench).collect()}
    plain = decontamination.plain(item)

    def least(text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(plain, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    want = {(i, 1): least(decontamination.plain(t)) for i, t in rows if t and len(t) < 1000 and least(decontamination.plain(t)) <= int(0.07 * len(plain))}
    assert got == want and set(i for i, _ in got) == {20, 21, 23}
    assert decontamination.clean(frame(spark, rows), bench).where("doc_id in (20, 21, 23)").count() == 0
    blocks = decontamination.matches(frame(spark, rows), bench, block_chars=50)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(got)
    assert decontamination.matches(frame(spark, []), bench).count() == 0


def test_shards_fit(spark):
    rows = [(i, "x" * random.Random(i).randint(0, 300)) for i in range(300)] + [(7, "y" * 100)] * 90 + [(1000, "z" * 5000), (None, None)]
    got = sharding.shards(frame(spark, rows), 2000).toPandas()
    size = got.groupby("shard").n_bytes.sum()
    assert len(got) == len(rows) and (got.groupby("shard").shard_bytes.first() == size).all() and (got.groupby("shard").shard_docs.first() == got.groupby("shard").size()).all()
    assert set(size[size > 2000].index) == set(got[got.oversize].shard) == set(got[got.n_bytes == 5000].shard)
    assert sharding.shards(frame(spark, []), 2000).count() == 0


def test_written_shards_hold_every_row_in_its_shard(spark, tmp_path):
    rows = [(i, "x" * random.Random(i).randint(0, 300)) for i in range(100)] + [(7, "y" * 100)] * 90 + [(7, "other"), (1000, "z" * 5000), (None, None), (None, "v"), (None, "w" * 150)] + [(None, "u" * 150)] * 40
    docs = frame(spark, rows)
    placed = sharding.shards(docs, 2000, with_hash=True)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.schema("doc_id long, text string, shard string").parquet(str(tmp_path / "out")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(rows, key=str)
    size, want = {}, {r.shard: r.shard_bytes for r in placed.collect()}
    for r in back:
        size[r.shard[1:]] = size.get(r.shard[1:], 0) + len(r.text or "")
    assert size == want and max(b for b in size.values() if b != 5000) <= 2000


def test_texts_of_marks_have_no_language(spark):
    rows = [(i, "the quick brown fox and the lazy dog number " + "abcdef"[i % 6]) for i in range(60)] + [(100, "\u0301\u0301\u0301\u0301"), (101, "12 34 !?"), (102, "a\u0301bc def")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lang", F.lit("en"))
    told = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train(docs, lambda c: c < 100)).collect()}
    assert told[100] == "und" and told[101] == "und" and told[102] == "en" and told[3] == "en"


def test_a_line_index_grows_a_hundredfold_and_back(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 60)
    line = lambda i: f"line number {i} of many, long enough to be counted as one"
    docs = lambda lo, hi: spark.createDataFrame([(d, "\n".join(line(k) for k in (d * 3, d * 3 + 1, d % 7))) for d in range(lo, hi)], DOCS)
    start = line_dedup.build(docs(0, 12), 40)
    steps, index = [12, 30, 60, 120, 200, 300, 450, 600, 800, 1000, 1200], start
    for lo, hi in zip(steps, steps[1:]):
        index = line_dedup.insert(index, docs(lo, hi))
    told = lambda x: (sorted(map(tuple, x.counts.collect())), sorted(map(tuple, x.postings.collect())))
    anew = line_dedup.build(docs(0, 1200), 40)
    assert told(index) == told(anew) and index.shard_bits > start.shard_bits
    assert sum(r.n_keys for r in index.filters.collect()) == anew.counts.count()
    line_dedup.save(index, f"{tmp_path}/index")
    index = line_dedup.load(spark, f"{tmp_path}/index")
    assert sorted(map(tuple, line_dedup.apply(index, docs(0, 1200)).collect())) == sorted(map(tuple, line_dedup.apply(anew, docs(0, 1200)).collect()))
    with pytest.raises(ValueError):
        line_dedup.insert(index, docs(5, 6))
    back = line_dedup.delete(index, docs(12, 1200).select("doc_id"))
    assert told(back) == told(start) and sum(r.n_keys for r in back.filters.collect()) == start.counts.count()
