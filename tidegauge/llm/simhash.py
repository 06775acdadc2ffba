"""SimHash near-duplicate groups by a generalised pigeonhole over groups of correlated bits.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. Two fingerprints link if at
most `radius` bits differ. The bits are grouped into parts by their correlation, and each part i gets a threshold
t_i >= -1 with sum(t_i) >= radius - parts + 1: then two linked fingerprints are within t_i of each other in some part.
Dynamic programming picks parts and thresholds with the fewest expected keys and candidates. Both sides list their
part's values up to half a threshold away, so linked fingerprints meet under some key, where they are verified.

Null or empty texts have fingerprint zero and link as others do. Fewer words than a shingle: the whole sequence is
one shingle. Rows repeat and tie freely: a group's id is its smallest id. A null id never names a group that has
others. An empty table has no groups. Columns of the input beside id and text are not read.

`similar_groups` links texts by the Jaccard similarity of their shingle sets instead. Linked fingerprints are its first
candidates. Fingerprints miss some pairs at any radius, so among the sets that are not shown to have no similar one, the
pairs not connected yet come from a prefix filter, which misses none: in any order of all shingles, two similar sets
share one of their first few. Every candidate is verified on the sets, and only verified ones form groups.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import shingles
from tidegauge.llm.common import map_batches, written
from tidegauge.llm.components import components, contracted

BITS = 64
#: Most fingerprints looked at to choose parts and thresholds; links never depend on the choice.
SAMPLE = 4_000
SEED = 42
#: Texts are similar if their sets share at least this part of their union (numerator, denominator).
SIMILAR = (4, 5)
#: Shingles whose hash is below this, three tenths of all, are looked at first, to find the sets most of which is in no
#: other set; groups never depend on it.
LOOK = np.uint64(2**64 * 3 // 10)
SIGN_BITS = 7


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the white space of ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(itertools.islice(words, k, None) for k in range(shingle)), strict=False)
    total, sums = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    while True:
        h = np.fromiter((digest(join(r), SEED) for r in itertools.islice(runs, 65536)), np.uint64)
        if not len(h):
            break
        sums += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


def bit_groups(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size, correlated ones together. bits: a row of 0s and 1s for each fingerprint."""
    with np.errstate(all="ignore"):
        near = np.nan_to_num(np.abs(np.corrcoef(bits.T.astype(float)))) if len(bits) > 1 else np.zeros((BITS, BITS))
    np.fill_diagonal(near, 0)
    free, groups = set(range(BITS)), []
    for p in range(parts):
        size = len(free) // (parts - p)
        group = [max(sorted(free), key=lambda b: near[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: near[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def plan(sample: np.ndarray, total: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part in use, for `total` fingerprints of which `sample` are known."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(sample) else np.zeros((0, BITS), np.uint8)
    a, b = bits[: len(bits) // 2], bits[len(bits) // 2 : len(bits) // 2 * 2]
    best = None
    for parts in range(1, min(radius + 2, 5)):
        groups = bit_groups(bits, parts)
        need, choices = radius - parts + 1, []
        for g in groups:
            apart = np.array([(x[g] ^ b[:, g]).sum(1) for x in a]) if len(a) else np.zeros((0, 0))
            costs = {-1: 0.0}
            for t in range(0, min(radius, 4) + 2, 2):
                ball = lambda r, n=len(g): sum(math.comb(n, k) for k in range(min(r, n) + 1))
                share = max(float((apart <= t).mean()) if apart.size else 0.0, ball(t) / 2.0 ** len(g))
                costs[t] = 25.0 * total * ball(t // 2) + total * total / 2 * share * (1 + t)
            choices.append(costs)
        # dynamic programming over the parts: least cost for each sum of thresholds
        at: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for costs in choices:
            after: dict[int, tuple[float, list[int]]] = {}
            for have, (cost, chosen) in at.items():
                for t, c in costs.items():
                    if have + t not in after or cost + c < after[have + t][0]:
                        after[have + t] = (cost + c, [*chosen, t])
            at = after
        fit = min((x for s, x in at.items() if s >= need), default=None)
        if fit and (best is None or fit[0] < best[0]):
            best = (fit[0], [(g, t) for g, t in zip(groups, fit[1], strict=True) if t >= 0])
    if best is None:
        raise ValueError(f"a radius of {radius} is too large")
    return best[1]


def keys_of(fp: np.ndarray, planned: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fingerprints): every part's values up to half its threshold away, marked with the part's number."""
    keys, owners = [], []
    for p, (group, t) in enumerate(planned):
        mask = np.uint64(sum(1 << b for b in group))
        for r in range(t // 2 + 1):
            for flipped in itertools.combinations(group, r):
                x = (fp ^ np.uint64(sum(1 << b for b in flipped))) & mask
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(p * 0xC2B2AE3D27D4EB4F % 2**64)
                keys.append(x ^ (x >> np.uint64(29)))  # a bijection of the part's value, apart from that of other parts
                owners.append(fp)
    return np.concatenate(keys), np.concatenate(owners)


def _spanning(v: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect whatever is connected within `radius` among the fingerprints of one key."""
    left, front, one, two = np.arange(1, len(v)), [0], [], []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
            continue
        p = front.pop()
        near = np.bitwise_count(v[p] ^ v[left]) <= radius
        hit = left[near]
        if len(hit):
            one.append(np.full(len(hit), v[p]))
            two.append(v[hit])
            front.extend(hit)
            left = left[~near]
    return one, two


def _links(keys: np.ndarray, fp: np.ndarray, radius: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints with equal keys; keys are sorted. Small groups are compared pair by pair at once."""
    one, two = [], []
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[edge, len(keys)])
    for s, n in zip(edge[size > small], size[size > small], strict=True):
        a, b = _spanning(np.unique(fp[s : s + n]), radius)
        one += a
        two += b
    few = np.repeat(size <= small, size)
    keys, fp = keys[few], fp[few]
    for k in range(1, small):
        same = keys[k:] == keys[:-k]
        if not same.any():
            break
        x, y = fp[:-k][same], fp[k:][same]
        near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        one.append(x[near])
        two.append(y[near])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *one]), np.concatenate([none, *two])


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) pairs of distinct fingerprints, enough to connect all that link within `radius`.

    Rows are dealt out by key and sorted; a task holds one key's fingerprints at a time. These are distinct ones, so
    copies of a text weigh nothing, and what a key gives is at most one link for each of its fingerprints beyond
    small groups.
    """
    total = fps.count()
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, total // SAMPLE))) == 0).limit(2 * SAMPLE).collect()
    planned = plan(np.array([r.fp for r in sample], np.int64).view(np.uint64), total, radius)

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(fp), 2048):
                k, o = keys_of(fp[s : s + 2048], planned)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(o.view(np.int64))], ["key", "fp"])

    def met(batches):
        none = np.zeros(0, np.uint64)
        keys, fp = none, none
        seen: set[tuple[int, int]] = set()

        def told(k, f):
            a, b = _links(k, f, radius)
            new = [p for p in {(int(min(x, y)), int(max(x, y))) for x, y in zip(a, b, strict=True)} if p not in seen]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(new)
            both = np.array(new, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]
            fp = np.r_[fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if len(keys) and keys[0] != keys[-1]:
                whole = len(keys) - int(np.argmax(keys[::-1] != keys[-1]))  # the last key may go on in the next batch
                yield told(keys[:whole], fp[:whole])
                keys, fp = keys[whole:], fp[whole:]
        if len(keys):
            yield told(keys, fp)

    dealt = map_batches(fps.select("fp"), spread, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, met, "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    marked = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    found = components(links(distinct.select("fp"), radius))
    known = found.join(distinct, F.col("node") == F.col("fp")).select("fp", "component", "first_doc")
    least = known.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = known.join(least, "component").select("fp", "component_id")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def _nodes(docs: DataFrame, shingle: int, fp_shingle: int) -> DataFrame:
    """(doc_id, fp, node, n, looked): node is a name of the shingle set, n its size, looked how many are below LOOK."""

    def run(batches):
        for b in batches:
            for first, h, edges in shingles.words(b.column(1)):
                fp = [shingles.majority(r) for r in shingles.runs(h, edges, fp_shingle)]
                sets = [shingles.distinct(r) for r in shingles.runs(h, edges, shingle)]
                out = [fp, [shingles.name_of(x) for x in sets], [len(x) for x in sets], [int(np.searchsorted(x, LOOK)) for x in sets]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(fp)), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", "fp", "node", "n", "looked"])

    return map_batches(docs, run, "doc_id long, fp long, node long, n long, looked long")


def _longs(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names)


def _joined(names: list[str], parts: list[tuple]) -> pa.RecordBatch:
    return _longs(*(np.concatenate([np.zeros(0, np.uint64), *c]) for c in zip(*parts, strict=True)), names=names)


def _may_match(docs: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """The sets (node, first_doc, n) that may have a similar one: at most n less SIMILAR's part of n of a set's shingles
    are in no other set. Only shingles below LOOK are looked at, the same for all texts, which proves this for most."""

    def spread(batches):
        told: set[int] = set()  # copies in a task speak once
        for b in batches:
            for _, h, edges in shingles.words(b.column(0)):
                parts = []
                for x in map(shingles.distinct, shingles.runs(h, edges, shingle)):
                    node = shingles.name_of(x) if len(x) else None
                    if node is not None and node not in told:
                        told.add(node)
                        x = x[: np.searchsorted(x, LOOK)]
                        parts.append((x, np.full(len(x), node).view(np.uint64)))
                if parts:
                    yield _joined(["s", "node"], parts)

    def met(batches):
        last, kept = None, False  # the last row so far, and whether it has been told as shared
        for b in batches:
            s, node = (b.column(k).to_numpy() for k in (0, 1))
            if last is not None:
                s, node = np.r_[last[0], s], np.r_[last[1], node]
            fresh = np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])]
            s, node = s[fresh], node[fresh]
            same = s[1:] == s[:-1]
            shared = np.r_[False, same] | np.r_[same, False]
            out = shared.copy()
            out[0] &= last is None or not kept
            kept = bool(shared[-1] or (len(s) == 1 and kept))
            last = (s[-1], node[-1])
            name, k = np.unique(node[out], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(k.astype(np.int64))], ["node", "k"])

    seen = map_batches(docs.select("text"), spread, "s long, node long").repartition("s").sortWithinPartitions("s", "node")
    shared = map_batches(seen, met, "node long, k long").groupBy("node").agg(F.sum("k").alias("shared"))
    p, q = SIMILAR
    own = F.col("looked") - F.coalesce("shared", F.lit(0))
    return sets.where("n > 0").join(shared, "node", "left").where(own <= F.floor((q - p) * F.col("n") / q)).select("node", "first_doc", "n")


def _held(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(node, held, sign): the sets needed, as bytes, and how many of a set are in each of 2**SIGN_BITS parts of all hashes (null
    if too many for a byte), which bounds what two sets have in common. Texts are compressed for the shuffle that brings them to their sets'
    first ids; of repeated ids, each row is told by its own set."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press((t.as_py() or "").encode()) for t in b.column(1)], pa.binary())], ["doc_id", "packed"])

    def unpack(batches):
        press = zstandard.ZstdDecompressor().decompress
        now, told = None, set()
        for b in batches:
            ids, nodes, k = b.column(0).to_pylist(), b.column(2).to_pylist(), 0
            while k < len(ids):
                upto, size = k, 0
                while upto < len(ids) and (upto == k or size < shingles.STEP):
                    size, upto = size + b.column(1)[upto].as_buffer().size * 3, upto + 1
                texts = pa.array([press(x.as_py()).decode() for x in b.column(1).slice(k, upto - k)], pa.large_string())
                name, held, sign = [], [], []
                for _, h, edges in shingles.words(texts):
                    for x in map(shingles.distinct, shingles.runs(h, edges, shingle)):
                        i, node = ids[k], nodes[k]
                        now, told = (now, told) if i == now else (i, set())
                        if node not in told and shingles.name_of(x) == node:
                            told.add(node)
                            name.append(node)
                            held.append(x.tobytes())
                            c = np.bincount((x >> np.uint64(64 - SIGN_BITS)).astype(np.int64), minlength=1 << SIGN_BITS)
                            sign.append(c.tolist() if c.max() < 128 else None)
                        k += 1
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(held, pa.binary()), pa.array(sign, pa.list_(pa.int8()))], ["node", "held", "sign"])

    packed = map_batches(docs, pack, "doc_id long, packed binary")
    found = packed.hint("merge").join(needed.select(F.col("first_doc").alias("doc_id"), "node"), "doc_id")
    return map_batches(found.select("doc_id", "packed", "node"), unpack, "node long, held binary, sign array<tinyint>")


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    p, q = SIMILAR

    def compare(batches):
        last, x = None, None
        for b in batches:
            keep = []
            for k, (one, left, right) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True)):
                if one != last:
                    last, x = one, np.frombuffer(left.as_buffer(), np.uint64)
                y = np.frombuffer(right.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                if np.count_nonzero(both[1:] == both[:-1]) * (p + q) >= len(both) * p:
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    right = pairs.hint("merge").join(held.select(F.col("node").alias("b"), F.col("held").alias("right")), "b")
    both = right.hint("merge").join(held.select(F.col("node").alias("a"), F.col("held").alias("left")), "a")
    return map_batches(both.select("a", "b", "left", "right"), compare, "a long, b long")


def _rest(held: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b) pairs of sets in different components that may be similar. placed: (node, n, component). In the order of
    shingles from rare to frequent, two similar sets have one of their first few in common, and as many after it as
    their similarity takes."""
    p, q = SIMILAR

    def spread(batches):
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.slice(k, 512)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                node = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
                yield _longs(np.concatenate(sets), node, names=["s", "node"])

    tokens = map_batches(held.select("node", "held"), spread, "s long, node long").withColumn("df", F.count("*").over(Window.partitionBy("s"))).where("df > 1")
    by_node = Window.partitionBy("node")
    ranked = tokens.withColumn("at", F.row_number().over(by_node.orderBy("df", "s")) - 1).withColumn("common", F.count("*").over(by_node)).join(placed, "node")
    at = F.col("n") - F.col("common") + F.col("at")  # those in no other set come first
    first = ranked.select("s", "node", "n", "component", at.alias("at")).where(F.col("at") <= F.floor((q - p) * F.col("n") / q))
    first = written(first, "first-shingles")
    mixed = first.groupBy("s").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("s")
    first = first.join(mixed, "s", "left_semi").join(held.select("node", "sign"), "node")
    a, b = first.alias("a"), first.alias("b")
    rest = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    both = F.aggregate(F.zip_with("a.sign", "b.sign", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    enough = lambda common: common * (p + q) >= (F.col("a.n") + F.col("b.n")) * p
    fits = (F.least("a.n", "b.n") * q >= F.greatest("a.n", "b.n") * p) & enough(rest) & F.coalesce(enough(both), F.lit(True))
    pairs = a.hint("merge").join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & fits)
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, fp_shingle: int = 3, radius: int = 7) -> DataFrame:
    """(doc_id, component_id) of every row (doc_id, text) with an id; component_id is the smallest id reachable over
    texts similar by SIMILAR or more. Texts without words are copies of each other."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = written(_nodes(docs, shingle, fp_shingle), "shingle-sets")
    sets = written(rows.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.max("looked").alias("looked")), "distinct-sets")
    by_fp = sets.groupBy("fp").agg(F.min("node").alias("top"))
    near = links(by_fp.select("fp"), radius).join(by_fp.select(F.col("fp").alias("a"), F.col("top").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("top").alias("y")), "b").select("x", "y")
    near = near.union(sets.select("fp", "node").join(by_fp, "fp").where("node != top").select("top", "node"))
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a != b").distinct()
    needed = written(_may_match(docs, sets, shingle), "needed-sets")
    held = written(_held(docs, needed, shingle), "held-sets")
    sure = written(_verified(near, held), "similar")
    # what fingerprints miss: only pairs that are not connected yet
    stars = contracted(sure)
    names = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    placed = needed.join(names, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    found = components(stars.union(_verified(_rest(held, placed), held)))
    ids = sets.select("node", "first_doc").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    return rows.select("doc_id", "node").join(ids.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """The rows of `docs` that each group keeps: the one with its smallest id. Of repeated rows with that id, one
    stays. Rows without an id stay."""
    return _kept(docs, groups(docs, shingle, radius))


def keep_one_similar(docs: DataFrame, shingle: int = 5, fp_shingle: int = 3, radius: int = 7) -> DataFrame:
    """The same for groups of texts that are similar."""
    return _kept(docs, similar_groups(docs, shingle, fp_shingle, radius))


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    kept = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    # a merge join at every size: the ids kept grow with the input, and are not to be broadcast while they happen to be few
    out = docs.join(kept.where("n = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    again = kept.where("n > 1").select("doc_id")
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
