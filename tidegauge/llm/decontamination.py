"""Benchmark decontamination: test items found in documents up to a share of edits.

An item of m characters may be changed by k = floor(`budget` * m) edits. It is split into k + 1 pieces, of which at
least one then stands unchanged in the document (pigeonhole). An Aho-Corasick automaton finds all pieces' exact hits in
a text, the hits of an item give the stretches where it may lie, and Myers' bit-parallel edit distance verifies each:
the least distance of the whole item to any part of the stretch.

Items and texts are compared in lower case, with white space runs as one space. Items that are null, empty, or shorter
than `least_chars` after that have too little text to tell anything and never match. Null or empty documents match
nothing. Repeated rows of a document match alike; repeated item ids match by whichever text is nearest. The items are
worked through in blocks of at most `block_chars` characters, which bounds what tasks get by broadcast; a pass over the
documents serves one block. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_batches

BLOCK_CHARS = 8_000_000

_SPACE = re.compile(r"\s+")


def plain(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").lower()).strip()


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in edits + 1 pieces of nearly equal length."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """(least edit distance of an item to a part of `text`, where that part ends), by Myers' bit vectors; the item is
    given as its characters' masks and length. (most + 1, -1) if it is over `most`."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += 1 if ph & high else -1 if mh & high else 0
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """A block of items, ready to be found in texts."""

    def __init__(self, items: list[tuple[int, str]], budget: float, least_chars: int):
        import ahocorasick

        self.automaton, at = ahocorasick.Automaton(), {}
        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        for item_id, text in items:
            text = plain(text)
            if len(text) >= least_chars:
                edits = int(budget * len(text))
                for offset, piece in pieces(text, edits):
                    at.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, text, edits, masks(text)))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.seen: dict[tuple[int, str], tuple[int, int]] = {}

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, end of the match in the plain text, number of stretches that match) of each item found."""
        if not self.items or not text:
            return
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                starts.setdefault(k, set()).add(end + 1 - length - offset)
        found: dict[int, tuple[int, int, int]] = {}
        for k, begins in starts.items():
            item_id, item, edits, peq = self.items[k]
            best, count, reach = (edits + 1, -1), 0, None
            stretches: list[list[int]] = []
            for s in sorted(begins):
                if stretches and s - reach <= 2 * edits + 1:
                    stretches[-1][1] = s
                else:
                    stretches.append([s, s])
                reach = s
            for first, last in stretches:
                lo = max(0, first - edits)
                part = text[lo : last + len(item) + edits]
                known = self.seen.get((k, part))
                if known is None:
                    if len(self.seen) > 20_000:
                        self.seen.clear()
                    known = self.seen[k, part] = distance(peq, len(item), part, edits)
                if known[0] <= edits:
                    count += 1
                    if known[0] < best[0]:
                        best = (known[0], lo + known[1])
            if count and (item_id not in found or best[0] < found[item_id][0]):
                found[item_id] = (*best, count)
        for item_id, (d, end, count) in found.items():
            yield item_id, d, end, count


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, by a hash of the id; each is fetched when its turn comes."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t")).alias("n")).first().n or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = 0.07, least_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, match_end, n_matches, item_chars) of every pair of a document and an item in it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, item_id_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast((items, budget, least_chars))

        def run(batches, shared=shared):
            m = Matcher(*shared.value)
            chars = {i: len(t) for i, t, _, _ in m.items}
            for b in batches:
                cols: list[list[int]] = [[] for _ in range(6)]
                for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for item_id, d, end, count in m.find(plain(t.as_py())):
                        for c, v in zip(cols, (doc_id, item_id, d, end, count, chars[item_id]), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "match_end", "n_matches", "item_chars"])

        found = map_batches(rows, run, "doc_id long, item_id long, distance long, match_end long, n_matches long, item_chars long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no item is found; rows without an id stay."""
    from tidegauge.llm.common import written

    found = written(matches(docs, benchmark, **options).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
