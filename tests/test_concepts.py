"""The concept graph against plain loops."""

import math
import re

from tidegauge.operators import concepts

TEXTS = [
    "# Alpha\nAlpha Beta is **a bold  term** here.\n\nThe Gamma means `code x`.\nAlpha Beta again, Gammas.\n\n\n## Proof\nDelta denotes Alpha. Tagüber Öde",
    "Gamma\n\n \n\nGamma is Gamma\n\nnothing",
    "", None, "no names at all", "One\n---\nTwo Three\n---\nOne",
]
PATTERNS = [r"\*\*([^*]{3,40})\*\*", r"`([^`]{2,30})`", r"\b([A-Z][a-z]{2,}(?:[ _][A-Z][a-z]+)*)\b", r"\b([\w_]{3,20})(?=\s+(?:is|refers|means|denotes)\b)"]


def names_of(text):
    out = {}
    for s in (p.strip() for p in re.split(concepts.SECTION, text)):
        low = s.lower()
        kind = next((k for k, ws in (("theorem", ("theorem", "lemma", "proof")), ("algorithm", ("algorithm", "procedure", "pseudocode")), ("operation", ("compute", "calculate", "apply", "evaluate"))) if any(w in low for w in ws)), "general")
        for p in PATTERNS:
            for m in re.finditer(p, s):
                name = re.sub(r"\s+", "_", m.group(1).strip().lower())
                if 2 < len(name) < 40:
                    out.setdefault(name, (kind, s[:80]))
    return out


def edges_of(text, least, cut):
    found, names, low = set(), sorted(names_of(text)), text.lower()
    parts, n = [p for p in low.split(cut) if p.strip()], max(len(low.split()), 1)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            s, t = a.replace("_", " "), b.replace("_", " ")
            p, q, j = low.count(s) / n, low.count(t) / n, sum(s in x and t in x for x in parts) / max(len(parts), 1)
            w = j * math.log2(j / (p * q + 1e-12)) if p and q and j else 0.0
            if w > least:
                found |= {(a, b, round(w, 9)), (b, a, round(w, 9))}
    return found


def test_concepts_and_their_graph(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {(r.id, r.name): (r.kind, r.section) for r in concepts.concept_table(docs, "id", "text").collect()}
    assert got == {(i, n): v for i, t in enumerate(TEXTS) if t for n, v in names_of(t).items()}
    assert (0, "tag") not in got and got[0, "delta"][0] == "theorem"
    for cut in ("\n\n", "\n"):
        for least in (0.005, 0.5, 2.0):
            rows = concepts.concept_graph(docs, "id", "text", least, cut).collect()
            assert {(r.id, r.a, r.b, round(r.weight, 9)) for r in rows} == {(i, *e) for i, t in enumerate(TEXTS) if t for e in edges_of(t, least, cut)}
            assert len(rows) == len({(r.id, r.a, r.b) for r in rows})
    assert concepts.concept_graph(docs.limit(0), "id", "text").count() == 0
