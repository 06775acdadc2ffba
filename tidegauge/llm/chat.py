"""Chat formatting with linked tool calls, in DataFrame functions only.

Calls and results are joined by (conversation, call id) on a hash of both, checked against the tools' schemas, put into
an order in which every result follows its call and every call follows the results it depends on, and written as
canonical JSON: keys in order, no white space, no keys for what is missing.

Events are messages, calls and results. An event's place is (conv_id, at, step, level, event_id): `at` is its turn, or
the later turn of something it has to follow; step is 0 for messages, 1 for calls and 2 for results; level counts how
many calls it depends on in a row. No event needs its whole conversation, so a very long one is many rows, not one task.

Of several calls with one id in a conversation the first by turn counts and the others are `duplicate`, those with the
same arguments too; every result of that id is linked to it; equal rows stay as often as they are there. A result whose
call is missing is `orphan` and stays at its turn; a call without result is `unanswered` unless its arguments are at
fault. Calls that depend on unknown ids or on each other in a circle are `bad_dependency`. Null conv_id, turn or id: the
row is kept, linked to nothing: such a result is `orphan`, such a call `unanswered` unless its arguments are at fault.
Null texts are null contents; empty texts stay empty. Empty tables give no events. Columns beside those named are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import checkpointed

_CALL = "array<struct<id:string,name:string,arguments:variant,depends_on:array<string>>>"
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"


def extract(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results) of turns; a text that is a JSON object with `tool_calls` or `tool_call_id` is a turn's
    calls or a result, anything else a message."""
    seen = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    seen = seen.withColumn("v", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    seen = seen.withColumn("calls", F.try_variant_get("v", "$.tool_calls", _CALL)).withColumn("answers", F.try_variant_get("v", "$.tool_call_id", "string"))
    calls = seen.where("calls is not null").select("conv_id", "turn", F.explode("calls").alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", F.to_json(F.col("c.arguments")).alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = seen.where("calls is null and answers is not null").select("conv_id", "turn", F.col("answers").alias("call_id"), F.try_variant_get("v", "$.content", "string").alias("content"))
    return seen.where("calls is null and answers is null").select("conv_id", "turn", "role", "text"), calls, results


def _kind(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return F.when(t == "BIGINT", "integer").when(t.startswith("DECIMAL") | (t == "DOUBLE"), "number").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("null")


def _checked(calls: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """Adds `parsed` and `fault`. schemas: for each tool its parameters' JSON types; a question mark after a type marks
    what may be missing; an integer is a number too."""
    types, needed = {}, {}
    for tool, params in schemas.items():
        types[tool] = F.create_map(*[F.lit(x) for p, t in params.items() for x in (p, t.rstrip("?"))]).cast("map<string,string>")
        needed[tool] = F.array(*[F.lit(p) for p, t in params.items() if not t.endswith("?")]).cast("array<string>")
    pick = lambda m, kind: F.coalesce(*[F.when(F.col("name") == k, v) for k, v in m.items()], F.lit(None).cast(kind))
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments")).withColumn("args", F.try_variant_get("parsed", "$", "map<string,variant>"))
    parsed = parsed.withColumn("types", pick(types, "map<string,string>")).withColumn("needed", pick(needed, "array<string>"))
    given = F.transform(F.map_entries("args"), lambda e: F.struct(e.key.alias("want"), _kind(e.value).alias("kind")))
    want = lambda e: F.try_element_at("types", e.want)
    wrong = F.exists(given, lambda e: want(e).isNotNull() & (want(e) != e.kind) & ~((want(e) == "number") & (e.kind == "integer")))
    fault = (
        F.when(F.col("types").isNull(), "unknown_tool").when(F.col("args").isNull(), "bad_arguments")
        .when(F.size(F.array_except("needed", F.map_keys("args"))) > 0, "missing_argument")
        .when(F.exists(given, lambda e: want(e).isNull()), "unexpected_argument").when(wrong, "wrong_type")
    )
    return parsed.withColumn("fault", fault).drop("args", "types", "needed")


def _levels(calls: DataFrame, answered: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, after): calls whose dependencies all resolve, a level at a time until no call becomes
    ready; `after` is the latest turn of what they wait for. Calls on a circle never get a level."""
    waits = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("on"))
    free = calls.where(F.size("depends_on") == 0).select("conv_id", "call_id", F.lit(0).alias("level"), F.col("turn").alias("after"))
    if waits.isEmpty():
        return free
    waits, done = checkpointed(waits), checkpointed(free)
    turns = calls.select("conv_id", "call_id", "turn")
    while True:
        met = waits.join(done.select("conv_id", F.col("call_id").alias("on"), "level", "after"), ["conv_id", "on"], "left")
        met = met.join(answered.select("conv_id", F.col("call_id").alias("on"), "answered"), ["conv_id", "on"], "left")
        ready = met.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("level").alias("m"), (F.max("level") + 1).alias("level"), F.max(F.greatest("after", "answered")).alias("after")).where("n = m")
        ready = checkpointed(ready.join(turns, ["conv_id", "call_id"]).select("conv_id", "call_id", "level", F.greatest("after", "turn").alias("after")))
        if ready.isEmpty():
            break
        done = checkpointed(done.unionByName(ready))
        waits = checkpointed(waits.join(ready, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", "on"))
    return done


def link(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """(conv_id, at, step, level, event_id, status, json) of every event."""
    key = ["conv_id", "call_id"]
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("call_id").isNotNull()
    own, linkable = _checked(calls, schemas), results.where(whole)
    first = own.where(whole).groupBy(*key).agg(F.min(F.struct("turn", F.xxhash64("name", "arguments").alias("tie"), "depends_on")).alias("first")).select(*key, "first.*")
    answered = linkable.groupBy(*key).agg(F.max("turn").alias("answered"))
    levels = _levels(first, answered)
    places = first.select(*key, F.col("turn").alias("first_turn"), "tie").join(levels, key, "left").join(answered, key, "left")
    placed = own.withColumn("whole", whole).hint("shuffle_hash").join(places, key, "left")
    mine = (F.col("turn") == F.col("first_turn")) & (F.xxhash64("name", "arguments") == F.col("tie"))
    status = (
        F.when(F.col("whole") & ~mine, "duplicate").when(F.col("whole") & F.col("level").isNull(), "bad_dependency").when(F.col("fault").isNotNull(), F.col("fault"))
        .when(~F.col("whole") | F.col("answered").isNull(), "unanswered").otherwise("ok")
    )
    own_place = F.col("whole") & mine
    body = F.struct(F.col("parsed").alias("arguments"), F.when(F.size("depends_on") > 0, F.sort_array("depends_on")).alias("depends_on"), F.col("call_id").alias("id"), F.lit("tool_call").alias("kind"), "name")
    call_rows = placed.select("conv_id", F.when(own_place, F.greatest("turn", "after")).otherwise(F.col("turn")).alias("at"), F.lit(1).alias("step"), F.when(own_place, F.coalesce("level", F.lit(0))).otherwise(0).alias("level"), F.col("call_id").alias("event_id"), status.alias("status"), F.to_json(body).alias("json"))
    linked = results.withColumn("whole", whole).hint("shuffle_hash").join(places.select(*key, F.col("level").alias("call_level"), F.col("after").alias("call_after"), F.lit(True).alias("known")), key, "left")
    found = F.col("whole") & F.col("known").isNotNull()
    linked = linked.select("conv_id", "turn", "call_id", "content", found.alias("found"), F.when(found, F.col("call_level")).alias("level"), F.when(found, F.col("call_after")).alias("call_at"))
    answer = F.struct("content", F.lit("tool_result").alias("kind"), F.col("call_id").alias("tool_call_id"))
    result_rows = linked.select("conv_id", F.greatest("turn", "call_at").alias("at"), F.lit(2).alias("step"), F.coalesce("level", F.lit(0)).alias("level"), F.col("call_id").alias("event_id"), F.when(F.col("found"), "ok").otherwise("orphan").alias("status"), F.to_json(answer).alias("json"))
    said = F.struct(F.col("text").alias("content"), F.lit("message").alias("kind"), "role")
    message_rows = messages.select("conv_id", F.col("turn").alias("at"), F.lit(0).alias("step"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("event_id"), F.lit("ok").alias("status"), F.to_json(said).alias("json"))
    return message_rows.unionByName(call_rows).unionByName(result_rows)
