"""Nearest neighbours and tool-call links on small odd inputs, the pipeline, and the queries with oracles."""

import json

import numpy as np
import pytest
from conftest import TESTDATA
from oracle import assert_same, connect
from pyspark.sql import functions as F

from tidegauge.llm import chat, hnsw, queries

SMALL = TESTDATA / "sf0.001"


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 12))
    rows = [(i, v[i].tolist()) for i in range(600)] + [(1000 + k, v[0].tolist()) for k in range(300)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [float("nan")] * 12), (2004, [None] + [1.0] * 11), (2005, [float("inf")] * 12), (2006, (v[1] * 1e200).tolist()), (None, v[2].tolist()), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")).withColumn("v", F.lit(1))
    got = hnsw.nearest(df, F.col("vec_id") % 50 == 0, 5, shard_points=200).toPandas()
    kept = {i: np.array(x) for i, x in rows if i is not None and not 2000 <= i <= 2005}
    kept[2006] = v[1]
    ids = sorted(kept)
    unit = np.stack([kept[i] / np.linalg.norm(kept[i]) for i in ids])
    hits = 0
    for q, g in got.groupby("query_id"):
        sims = unit @ unit[ids.index(q)]
        want = [ids[k] for k in np.lexsort((ids, -np.round(sims, 12))) if ids[k] != q][:5]
        hits += len(set(want) & set(g.vec_id))
        assert list(g.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5] and q not in set(g.vec_id)
    assert hits / len(got) >= 0.9
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == [1000, 1001, 1002, 1003, 1004]
    assert hnsw.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def _say(calls=None, **more):
    return json.dumps({"tool_calls": calls} if calls else more)


def test_tool_calls(spark):
    call = lambda i, name="add", args=None, after=(): {"id": i, "name": name, "arguments": args if args is not None else {"b": 2, "a": 1.5}, "depends_on": list(after)}
    rows = [
        (1, 0, "user", 'hé "x"\n'), (1, 1, "assistant", _say([call("A"), call("B", after=["A"])])), (1, 5, "tool", _say(tool_call_id="A", content="3")), (1, 2, "tool", _say(tool_call_id="B", content="4")),
        (1, 6, "tool", _say(tool_call_id="Z", content="?")), (2, 0, "assistant", _say([call("A", args={"a": "no", "b": 1}), call("C", args={"a": 1}), call("D", args={"a": 1, "b": 1, "z": 0}), call("E", name="none")])),
        (2, 1, "assistant", _say([call("P", after=["Q"]), call("Q", after=["P"]), call("R", after=["gone"])])), (2, 2, "assistant", _say([call("A", args={"a": 2, "b": 3})])), (3, None, "user", None), (None, 1, "user", ""), (3, 1, "user", "{not json"), (3, 1, "user", "{not json"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("x")).withColumn("status", F.lit(1))
    got = chat.link(*chat.extract(df), {"add": {"a": "number", "b": "integer", "note": "string?"}}).collect()
    status = {(r.conv_id, r.event_id, r.step): r.status for r in got if r.step and not (r.event_id == "A" and r.conv_id == 2)}
    assert status == {
        (1, "A", 1): "ok", (1, "A", 2): "ok", (1, "B", 1): "ok", (1, "B", 2): "ok", (1, "Z", 2): "orphan", (2, "C", 1): "missing_argument", (2, "D", 1): "unexpected_argument", (2, "E", 1): "unknown_tool",
        (2, "P", 1): "bad_dependency", (2, "Q", 1): "bad_dependency", (2, "R", 1): "bad_dependency",
    }
    assert sorted(r.status for r in got if r.event_id == "A" and r.conv_id == 2) == ["duplicate", "wrong_type"]
    place = {(r.event_id, r.step): (r.at, r.step, r.level) for r in got if r.conv_id == 1}
    assert place["A", 2] == (5, 2, 0) and place["B", 1] == (5, 1, 1) and place["B", 2] == (5, 2, 1)
    assert '{"arguments":{"a":1.5,"b":2},"id":"A","kind":"tool_call","name":"add"}' in {r.json for r in got}
    assert {json.loads(r.json).get("content") for r in got if r.step == 0 and r.conv_id == 1} == {'hé "x"\n'}
    assert sum(r.conv_id == 3 for r in got) == 3 and sum(r.conv_id is None for r in got) == 1
    assert chat.link(*chat.extract(df.limit(0)), {}).count() == 0


def test_tool_calls_run_no_python(spark):
    plan = queries.op10_tool_call_links(spark, str(SMALL))._jdf.queryExecution().toString() if SMALL.exists() else ""
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert_same(queries.QUERIES[name](spark, str(SMALL)), connect(SMALL), queries.ORACLES[name])


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "Un texto muy distinto de los demas, con sus propias palabras y nada que repetir en ningun otro lugar. " * 3
    odd = spark.createDataFrame([(9001, None, "es", "s", 0), (9002, "", "es", "s", 0), (9003, "12 34 !!", "es", "s", 8), (9004, text, "es", "s", len(text)), (9005, text, "es", "s", len(text)), (None, text + "x", "es", "s", 1)], schema)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd).withColumn("held", F.lit(1)).withColumn("row", F.lit("z"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(SMALL))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r.doc_id for r in docs.collect()}
    assert not {9001, 9002, 9003} & seen["language_id"] and {9004, 9005, None} <= seen["language_id"]
    assert 9004 in seen["simhash_near_dedup"] and 9005 not in seen["simhash_near_dedup"]
    assert seen["piece_encoding"] == seen["benchmark_decontamination"]


def test_retries_and_rows_without_turn_or_id(spark):
    call = lambda i: {"id": i, "name": "add", "arguments": {"a": 1, "b": 2}, "depends_on": []}
    rows = [
        (1, 0, "assistant", _say([call("A")])), (1, 1, "tool", _say(tool_call_id="A", content="3")), (1, 3, "assistant", _say([call("A")])), (1, 4, "assistant", _say([call("A"), call("A")])),
        (2, None, "assistant", _say([call("B")])), (2, 2, "assistant", _say([call("B")])), (2, 3, "tool", _say(tool_call_id="B", content="x")), (3, None, "assistant", _say([call("C")])), (3, 1, "tool", _say(tool_call_id="C", content="y")),
        (4, 1, "assistant", _say([call(None)])), (4, 2, "assistant", _say([call(None)])), (5, 1, "assistant", _say([call("D")])), (5, None, "tool", _say(tool_call_id="D", content="z")), (None, 1, "assistant", _say([call("E")])), (None, 2, "tool", _say(tool_call_id="E", content="z")),
    ]
    got = chat.link(*chat.extract(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), {"add": {"a": "number", "b": "integer"}}).collect()
    assert sorted((str(r.conv_id), r.step, str(r.at), r.status) for r in got) == sorted([
        ("1", 1, "0", "ok"), ("1", 1, "3", "duplicate"), ("1", 1, "4", "duplicate"), ("1", 1, "4", "duplicate"), ("1", 2, "1", "ok"),
        ("2", 1, "None", "unanswered"), ("2", 1, "2", "ok"), ("2", 2, "3", "ok"), ("3", 1, "None", "unanswered"), ("3", 2, "1", "orphan"),
        ("4", 1, "1", "unanswered"), ("4", 1, "2", "unanswered"), ("5", 1, "1", "unanswered"), ("5", 2, "None", "orphan"), ("None", 1, "1", "unanswered"), ("None", 2, "2", "orphan"),
    ])
