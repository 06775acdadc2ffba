"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op2_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidegauge.llm import piece_bpe

    return piece_bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import decontamination

    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Bytes of text in a shard.
SHARD_BYTES, FINE_SHARD_BYTES = 16 << 20, 64 << 10


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import sharding

    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def extendible_shards_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with small shards, so that small tables need a deep directory too."""
    from tidegauge.llm import sharding

    return sharding.shards(table(spark, sf_dir, "documents"), FINE_SHARD_BYTES)


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import simhash

    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import line_dedup

    docs = table(spark, sf_dir, "documents")
    thinned = line_dedup.apply(line_dedup.build(docs, least_chars=40), docs, least_docs=5)
    return thinned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import language_id

    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, lambda c: ~held_out(c))
    return language_id.predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    scored = toxicity.predict(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import hnsw

    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import suffix_dedup

    return suffix_dedup.remove(table(spark, sf_dir, "documents"))


def op10_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns' own calls and results, and beside them each user's turn as a call of an `answer` tool with the
    assistant's turn after it as the result. In every third conversation a call depends on the one two turns before it, up
    to four in a row; in every seventh it is made again a turn later, and in every eleventh it names no known tool."""
    from tidegauge.llm import chat

    turns = table(spark, sf_dir, "conversations")
    messages, calls, results = chat.extract(turns)
    call_id = lambda turn: F.substring(F.md5(F.concat_ws(":", "conv_id", turn).cast("binary")), 1, 12)
    waits = (F.col("conv_id") % 3 == 0) & (F.col("turn") % 8 >= 2)
    asked = turns.where("role = 'user'").select(
        "conv_id", "turn", call_id(F.col("turn")).alias("call_id"), F.when(F.col("conv_id") % 11 == 0, "ask").otherwise("answer").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("question"))).alias("arguments"), F.when(waits, F.array(call_id(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    again = asked.where("conv_id % 7 = 0").withColumn("turn", F.col("turn") + 1)
    given = turns.where("role = 'assistant'").select("conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return chat.link(messages, calls.unionByName(asked).unionByName(again), results.unionByName(given), {"answer": {"question": "string", "turn": "integer"}})


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import merkle

    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import mixing

    mixed = mixing.documents_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), weights=[1, 2, 3])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm import prefix_trie

    return prefix_trie.conversations_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_piece_round_trip, op3_decontamination, op4_extendible_shards, op5_simhash_groups, op6_line_dedup, op7_language_id, op8_nearest_neighbours, op9_suffix_dedup, op10_tool_call_links, op11_merkle_manifest, op12_source_mix, op13_prefix_trie, extendible_shards_fine)}
#: The white space of the contracts, for DuckDB: \\x20 and \\x09 to \\x0D.
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a column's decimal text: a step for each bit, with a byte of the text put in at each eighth.
_CRC = """(xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                   lambda v, b: xor(xor(v, b) >> 1, 3988292384 * (xor(v, b) & 1)))))"""

_SHARDS = """
        WITH r AS (
            SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
                   ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2) << 30)
                   | (('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT >> 2) AS h
            FROM documents
        ), sizes AS (
            SELECT d AS depth, h >> (60 - d) AS bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
            FROM r, range(0, 61) t(d) GROUP BY ALL
        ), leaf AS (
            SELECT r.doc_id, r.n_bytes, r.h, min(s.depth) AS depth
            FROM r JOIN sizes s ON s.bucket = r.h >> (60 - s.depth) AND (s.shard_bytes <= {limit} OR s.depth = 60) GROUP BY ALL
        )
        SELECT l.doc_id, l.n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.h >> (60 - l.depth)), l.depth::INT, '0') END AS shard,
               l.depth::INT AS depth, s.shard_bytes, s.shard_docs, s.shard_bytes > {limit} AS oversize
        FROM leaf l JOIN sizes s ON s.depth = l.depth AND s.bucket = l.h >> (60 - l.depth)
"""

# The same rule for rows with copies: what does not fit together at full depth is cut by counting copies.
_SHARDS_FINE = _SHARDS[: _SHARDS.index("), leaf AS (")] + """), first AS (
            SELECT o.h, min(s.depth) AS depth
            FROM (SELECT DISTINCT h FROM r) o JOIN sizes s ON s.bucket = o.h >> (60 - s.depth) AND (s.shard_bytes <= {limit} OR s.depth = 60) GROUP BY ALL
        ), placed AS (
            SELECT r.*, s.depth, s.shard_bytes, s.shard_docs, s.shard_bytes > {limit} AS apart, greatest(1, {limit} // greatest(r.n_bytes, 1)) AS room,
                   count(*) OVER (PARTITION BY r.h, r.doc_id, r.n_bytes) AS copies, row_number() OVER (PARTITION BY r.h, r.doc_id, r.n_bytes) - 1 AS i
            FROM r JOIN first f ON f.h = r.h JOIN sizes s ON s.depth = f.depth AND s.bucket = r.h >> (60 - s.depth)
        ), cut AS (
            SELECT *, least(room, copies - i // room * room) AS here FROM placed
        )
        SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth::INT, '0') END || CASE WHEN apart AND copies > room THEN '-' || (i // room) ELSE '' END AS shard,
               depth::INT AS depth, CASE WHEN apart THEN here * n_bytes ELSE shard_bytes END AS shard_bytes, CASE WHEN apart THEN here ELSE shard_docs END AS shard_docs,
               CASE WHEN apart THEN here * n_bytes ELSE shard_bytes END > {limit} AS oversize
        FROM cut
"""

ORACLES: dict[str, str] = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE heads AS (
            SELECT doc_id, source AS tree, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents
        ), hashed AS (
            SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN {_CRC.format("doc_id")} % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || {_LOWER.format("text")}, '-')) END AS changed FROM heads
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number, count(*) OVER (PARTITION BY tree) AS n FROM hashed
        ), lower AS (
            SELECT tree, 0 AS level, n, number, leaf AS h FROM leaves
            UNION ALL
            SELECT tree, level + 1, (n + 15) // 16, number // 16, sha256(string_agg(h, '' ORDER BY number)) FROM lower WHERE n > 1 GROUP BY tree, level, n, number // 16
        ), subroots AS (
            SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS number, count(*) OVER () AS n FROM lower WHERE n = 1
        ), upper AS (
            SELECT 0 AS level, n, number, subroot AS h FROM subroots
            UNION ALL
            SELECT level + 1, (n + 15) // 16, number // 16, sha256(string_agg(h, '' ORDER BY number)) FROM upper WHERE n > 1 GROUP BY level, n, number // 16
        ), nodes AS (
            SELECT false AS above, * FROM lower UNION ALL SELECT true, NULL, * FROM upper
        ), sided AS (
            SELECT a.above, a.tree, a.level, a.number, coalesce(string_agg(b.h, '' ORDER BY b.number) FILTER (b.number < a.number), '') AS lhs, coalesce(string_agg(b.h, '' ORDER BY b.number) FILTER (b.number > a.number), '') AS rhs
            FROM nodes a JOIN nodes b ON a.above = b.above AND a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.number // 16 = b.number // 16 GROUP BY ALL
        ), walk AS (
            SELECT doc_id, leaf, tree, false AS above, 0 AS level, number, n, coalesce(changed, leaf) AS folded, '' AS proof FROM leaves
            UNION ALL
            SELECT w.doc_id, w.leaf, w.tree, w.n = 1 OR w.above, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN s.number ELSE w.number // 16 END, CASE WHEN w.n = 1 THEN s.n ELSE (w.n + 15) // 16 END,
                   CASE WHEN w.n = 1 THEN w.folded ELSE sha256(d.lhs || w.folded || d.rhs) END, CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || d.lhs || d.rhs END
            FROM walk w JOIN subroots s ON s.tree IS NOT DISTINCT FROM w.tree
            JOIN sided d ON d.above = w.above AND d.level = w.level AND d.number = w.number AND (w.above OR d.tree IS NOT DISTINCT FROM w.tree)
            WHERE NOT (w.above AND w.n = 1)
        ), top AS (
            SELECT h AS root FROM upper WHERE n = 1
        )
        SELECT w.doc_id, w.leaf, s.subroot, t.root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.root AS verified
        FROM walk w JOIN subroots s ON s.tree IS NOT DISTINCT FROM w.tree, top t WHERE w.above AND w.n = 1
    """,
    "op12_source_mix": f"""
        WITH judged AS (
            SELECT doc_id, avg(quality) AS mean FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), items AS (
            SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, coalesce(0.5 + 1.5 * j.mean, 1.0) AS quality,
                   (('0x' || substr(md5(md5(coalesce(d.doc_id::VARCHAR, '')) || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
            FROM documents d LEFT JOIN judged j USING (doc_id)
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::HUGEINT AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM items GROUP BY source
        ), seen AS (
            SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, coalesce(sum(cap) OVER before, 0) AS caps_before, coalesce(sum(weight) OVER before, 0) AS weights_before FROM sources
            WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), filled AS (
            SELECT *, cap * (weights - weights_before) < weight * (total - caps_before) AS filled FROM seen
        ), rate AS (
            SELECT max(total) - coalesce(sum(cap) FILTER (filled), 0) AS amount, max(weights) - coalesce(sum(weight) FILTER (filled), 0) AS rest FROM filled
        ), aims AS (
            SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE weight::DOUBLE * amount::DOUBLE / rest::DOUBLE END AS target FROM filled, rate
        ), placed AS (
            SELECT i.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size)::BIGINT ELSE 0 END AS epochs,
                   sum(i.size) OVER w AS through, row_number() OVER w AS place
            FROM items i JOIN aims a ON a.source IS NOT DISTINCT FROM i.source WINDOW w AS (PARTITION BY i.source ORDER BY -ln(i.u) / i.quality, i.u ROWS UNBOUNDED PRECEDING)
        ), rests AS (
            SELECT *, target - epochs * source_size AS rest FROM placed
        ), gaps AS (
            SELECT *, rest - coalesce(sum(size) FILTER (through <= rest) OVER (PARTITION BY source), 0) AS gap FROM rests
        ), chosen AS (
            SELECT source, min({{'miss': abs(gap - size), 'place': place}}) AS last FROM gaps WHERE rest > 0 AND through > rest AND abs(gap - size) < gap GROUP BY source
        )
        SELECT g.doc_id, g.size, g.source_size, g.target,
               g.size * (g.epochs + (g.rest > 0 AND (g.through <= g.rest OR coalesce(c.last.place = g.place, false)))::BIGINT) AS taken
        FROM gaps g LEFT JOIN chosen c ON c.source IS NOT DISTINCT FROM g.source
    """,
    "op13_prefix_trie": f"""
        WITH own AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT conv_id, conv_id - conv_id % 100 AS head, {_CRC.format("conv_id")} % 6 AS h FROM own WHERE i = 1
        ), counted AS (
            SELECT c.*, (SELECT count(*) FROM own o WHERE o.conv_id = c.head AND o.i <= c.h) AS k FROM convs c
        ), turns AS (
            SELECT c.conv_id, o.i AS d, o.role, o.text FROM counted c JOIN own o ON o.conv_id = c.head AND o.i <= c.h
            UNION ALL
            SELECT c.conv_id, o.i - c.h + c.k, o.role, o.text FROM counted c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h
        ), pre AS (
            SELECT a.conv_id, a.d, any_value(a.text) AS text, sha256(string_agg(sha256(length(b.role) || ':' || b.role || b.text), ',' ORDER BY b.d)) AS prefix, sha256(coalesce(string_agg(sha256(length(b.role) || ':' || b.role || b.text), ',' ORDER BY b.d) FILTER (b.d < a.d), '')) AS above
            FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.d <= a.d GROUP BY a.conv_id, a.d
            UNION ALL
            SELECT conv_id, 0, '', sha256(''), NULL FROM convs
        ), sized AS (
            SELECT *, max(d) OVER (PARTITION BY conv_id) AS n FROM pre
        ), nodes AS (
            SELECT d, prefix, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, length(any_value(text)) AS chars, max(n) > d AS goes_on,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
            FROM sized GROUP BY d, prefix
        ), under AS (
            SELECT a.d, a.prefix, count(*) FILTER (n.d = a.d + 1) AS n_children, count(*) FILTER (NOT n.goes_on) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
            FROM nodes n JOIN pre a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.prefix
        )
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, u.n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
        FROM nodes n JOIN under u USING (d, prefix) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.above
    """,
    "op4_extendible_shards": _SHARDS.format(limit=SHARD_BYTES),
    "extendible_shards_fine": _SHARDS_FINE.format(limit=FINE_SHARD_BYTES),
    "op10_tool_call_links": """
        WITH RECURSIVE calls AS (
            SELECT conv_id, turn, substr(md5(conv_id || ':' || turn), 1, 12) AS call_id, conv_id % 3 = 0 AND turn % 8 >= 2 AS waits, substr(md5(conv_id || ':' || (turn - 2)), 1, 12) AS dep,
                   CASE WHEN conv_id % 11 = 0 THEN 'ask' ELSE 'answer' END AS name, '{"arguments":{"question":' || to_json(text) || ',"turn":' || turn || '}' AS head FROM conversations WHERE role = 'user'
        ), levels AS (
            SELECT conv_id, call_id, turn, 0 AS level FROM calls WHERE NOT waits
            UNION ALL
            SELECT c.conv_id, c.call_id, c.turn, l.level + 1 FROM calls c JOIN levels l ON c.waits AND l.conv_id = c.conv_id AND l.call_id = c.dep
        ), results AS (
            SELECT conv_id, turn, substr(md5(conv_id || ':' || (turn - 1)), 1, 12) AS call_id, text FROM conversations WHERE role = 'assistant'
        ), written AS (
            SELECT c.conv_id, c.call_id, c.turn, c.name, l.level, head || CASE WHEN waits THEN ',"depends_on":["' || dep || '"]' ELSE '' END || ',"id":"' || c.call_id || '","kind":"tool_call","name":"' || c.name || '"}' AS json,
                   EXISTS (SELECT 1 FROM results r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id) AS answered
            FROM calls c LEFT JOIN levels l USING (conv_id, call_id)
        )
        SELECT conv_id, turn AS at, 0 AS step, 0 AS level, NULL AS event_id, 'ok' AS status,
               '{"content":' || to_json(text) || ',"kind":"message","role":' || to_json(role) || '}' AS json FROM conversations
        UNION ALL
        SELECT conv_id, turn, 1, coalesce(level, 0), call_id, CASE WHEN level IS NULL THEN 'bad_dependency' WHEN name = 'ask' THEN 'unknown_tool' WHEN answered THEN 'ok' ELSE 'unanswered' END, json FROM written
        UNION ALL
        SELECT conv_id, turn + 1, 1, 0, call_id, 'duplicate', json FROM written WHERE conv_id % 7 = 0
        UNION ALL
        SELECT r.conv_id, r.turn, 2, coalesce(w.level, 0), r.call_id, CASE WHEN w.call_id IS NULL THEN 'orphan' ELSE 'ok' END,
               '{"content":' || to_json(r.text) || ',"kind":"tool_result","tool_call_id":"' || r.call_id || '"}'
        FROM results r LEFT JOIN written w ON w.conv_id = r.conv_id AND w.call_id = r.call_id
    """,
    "op6_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
        ), keyed AS (
            SELECT *, {_LOWER.format(f'trim(line, {_WHITE})')} AS key FROM lines
        ), often AS (
            SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.last_doc AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}
