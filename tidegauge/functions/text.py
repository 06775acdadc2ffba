"""Text and web expressions: HTML, tickers, sentiment, densities, filings, equations, hashed vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions import lexicons as lex


def literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def html_text(html: Column) -> Column:
    """Text outside tags, scripts, styles and noscripts, with single spaces."""
    bare = html
    for tag in ("script", "style", "noscript"):
        bare = F.regexp_replace(bare, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), r"\s+", " "))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "(?s)<[^>]*>", "")


def tickers(text: Column, cashtags_only: bool = False, stop: list[str] | None = None) -> Column:
    """Capital words of two to five letters (or cashtags), without stop words, in order of first sight."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\w)\$([A-Z]{1,5})(?!\w)" if cashtags_only else r"(?<!\w)\$?([A-Z]{1,5})(?!\w)"), F.lit(1))
    kept = F.filter(F.array_distinct(found), lambda t: F.length(t) >= (1 if cashtags_only else 2))
    return kept if cashtags_only else F.array_except(kept, literals(stop or lex.NO_TICKERS))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def lexicon_sentiment(text: Column) -> Column:
    """Sum of the words' sentiment over the square root of how many have one, within -1 and 1."""
    table = F.create_map(*[F.lit(x) for kv in lex.SENTIMENT.items() for x in kv])
    known = F.filter(F.transform(words(text), lambda w: F.try_element_at(table, w)), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(known) > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), total / F.sqrt(F.size(known))))).otherwise(0.0)


def ticker_context_sentiment(text: Column, ticker: Column, around: int = 50) -> Column:
    """Mean sentiment of the text around each mention of a ticker."""
    parts = F.split(text, F.concat(F.lit(r"\b"), ticker, F.lit(r"\b")))
    near = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p, i: lexicon_sentiment(F.concat(F.right(F.get(parts, i), F.lit(around)), F.lit(" "), F.left(p, F.lit(around)))))
    return F.when(F.size(near) > 0, F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.size(near))


def densities(text: Column) -> dict[str, Column]:
    """Shares of technical, hedging and hype words, and citations a sentence."""
    tokens = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.btrim(F.lower(w), F.lit(".,!?;:\"'()[]")))
    n = F.greatest(F.size(tokens), F.lit(1))
    share = lambda names: F.size(F.filter(tokens, lambda w: w.isin(names))) / n
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]")), F.lit(1))
    cited = F.regexp_count(text, F.lit(r"(?i)\[\d+\]|\([A-Z][a-z]+(?:\s+(?:et\s+al\.?|and|&))?,?\s*\d{4}\)|doi:|arXiv:"))
    return {"technical": share(lex.TECHNICAL), "hedging": share(lex.HEDGING), "hype": share(lex.HYPE), "citation": cited / sentences}


def stance(technical: Column, citation: Column, hype: Column) -> Column:
    return F.when((technical > 0.03) & (citation > 0.1) & (hype < 0.02), "scientific").when((hype > 0.03) & (technical < 0.02), "hype").otherwise("editorial")


def article_features(text: Column) -> dict[str, Column]:
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    sentences, size = F.greatest(F.regexp_count(text, F.lit("[.!?]")), F.lit(1)), F.greatest(F.octet_length(text), F.lit(1))
    return {
        "n_words": n, "n_sentences": sentences, "words_a_sentence": n / sentences, "upper_ratio": F.regexp_count(text, F.lit("[A-Z]")) / size, "digit_ratio": F.regexp_count(text, F.lit("[0-9]")) / size,
        "questions": F.regexp_count(text, F.lit(r"\?")), "exclamations": F.regexp_count(text, F.lit("!")),
    }


def links(html: Column) -> Column:
    """ARRAY<STRUCT<href, text, outbound>> of anchors with a quoted href."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*?href=[\"'][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))

    def one(a: Column) -> Column:
        href = F.regexp_extract(a, r"(?is)href=[\"']([^\"']*)[\"']", 1)
        return F.struct(href.alias("href"), F.trim(strip_tags(a)).alias("text"), (~href.startswith("#")).alias("outbound"))

    return F.transform(tags, one)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"href=\"([^\"]*)\""), F.lit(1))


def headings(html: Column) -> Column:
    """ARRAY<STRUCT<level, text, position>> of h1 to h3."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<h[123][^>]*>.*?</h[123]>)"), F.lit(1))
    return F.transform(tags, lambda h, i: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), F.trim(strip_tags(h)).alias("text"), i.alias("position")))


def title(html: Column) -> Column:
    pick = lambda p: F.nullif(F.trim(strip_tags(F.regexp_extract(html, p, 1))), F.lit(""))
    return F.coalesce(pick(r"(?is)<title[^>]*>(.*?)</title>"), pick(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit("Untitled"))


def article_fields(html: Column, headline: Column | None = None, body: Column | None = None) -> dict[str, Column]:
    """Headline, body and number of words of a page: those found by a source's own elements, else the title (or first h1) and
    the text of the body element, without scripts, styles and comments, with single spaces and the common entities resolved.
    What is not there is empty."""
    filled = lambda c: F.lit(None).cast("string") if c is None else F.nullif(c, F.lit(""))

    def plain(c: Column) -> Column:
        for pattern in (r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
            c = F.regexp_replace(c, pattern, " ")
        for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(mark))
        return F.trim(F.regexp_replace(c, r"\s+", " "))

    inside = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?:</{tag}>|\z)", 1)
    title_ = F.when(html.rlike(r"(?is)<title(?:\s[^>]*)?>"), plain(inside("title"))).otherwise(plain(inside("h1")))
    text = F.coalesce(filled(body), plain(inside("body")), F.lit(""))
    return {"headline": F.coalesce(filled(headline), title_, F.lit("")), "body": text, "n_words": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))}


def code_blocks(html: Column) -> Column:
    pick = lambda tag: F.regexp_extract_all(html, F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(F.concat(pick("pre"), pick("code")), lambda c: F.trim(strip_tags(c)))


def emphasis(html: Column) -> Column:
    n = lambda p: F.regexp_count(html, F.lit(p))
    return F.struct(n("(?i)<(b|strong)(\\s[^>]*)?>").alias("bold_count"), n("(?i)<(i|em)(\\s[^>]*)?>").alias("italic_count"), n("(?i)<blockquote[\\s>]").alias("quote_count"))


VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()


def dom_depth(html: Column) -> Column:
    """Deepest nesting of elements; void elements count as one level where they stand, unclosed ones stay open."""
    tags = F.regexp_extract_all(F.regexp_replace(html, "(?s)<!--.*?-->|<!doctype[^>]*>|<!DOCTYPE[^>]*>", ""), F.lit(r"<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*?>"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("deepest"))

    def step(s: Column, t: Column) -> Column:
        void = F.lower(t).isin(VOID_TAGS)
        at = F.when(t.startswith("/"), F.greatest(s["at"] - 1, F.lit(0))).when(void, s["at"]).otherwise(s["at"] + 1)
        return F.struct(at.alias("at"), F.greatest(s["deepest"], at + F.when(void, 1).otherwise(0)).alias("deepest"))

    return F.aggregate(tags, start, step, lambda s: s["deepest"])


def html_tables(html: Column, header: bool = True, most_rows: int | None = None) -> Column:
    """ARRAY<ARRAY<ARRAY<STRING>>>: tables, rows, cells. header=False leaves the first row out."""
    tables = F.regexp_extract_all(html, F.lit("(?is)<table[^>]*>(.*?)</table>"), F.lit(1))

    def rows(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(strip_tags(c))))
        found = found if header else F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))
        return found if most_rows is None else F.slice(found, 1, most_rows)

    return F.transform(tables, rows)


def canonical_url(url: Column, strip_fragment: bool = False) -> Column:
    """Scheme and host in lower case, without `utm_` parameters and those without a name."""
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    rest = F.regexp_replace(url, "#.*$", "")
    base, query = F.regexp_replace(rest, r"\?.*$", ""), F.regexp_extract(rest, r"\?(.*)$", 1)
    front = F.regexp_extract(base, r"^([^:/]+://[^/]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (F.split(p, "=")[0] != ""))
    out = F.concat(F.lower(front), F.substr(base, F.length(front) + 1), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return out if strip_fragment else F.concat(out, fragment)


def doc_key(url: Column) -> Column:
    return F.substring(F.md5(url.cast("binary")), 1, 12)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[^:/]+://([^/:?#]*)", 1))


def source_parser(url: Column) -> Column:
    """The parser of the first source profile whose host is part of the URL's."""
    out = F.lit(None).cast("string")
    for part, parser in reversed(lex.SOURCES):
        out = F.when(F.contains(host(url), F.lit(part)), parser).otherwise(out)
    return out


def infer_subject(url: Column, title_: Column) -> Column:
    seen = F.lower(F.concat_ws(" ", url, title_))
    out = F.lit("general")
    for subject, names in reversed(lex.SUBJECTS):
        out = F.when(F.exists(literals(names), lambda w: F.contains(seen, w)), subject).otherwise(out)
    return out


def arxiv_id(url: Column) -> Column:
    path = F.regexp_extract(F.trim(url), r"/(?:abs|pdf|e-print)/([^v]*)", 1)
    bare = F.regexp_extract(F.trim(url), r"^(\d{4}\.\d{4,5}|[a-z-]+/\d+)$", 1)
    return F.nullif(F.coalesce(F.nullif(F.btrim(F.replace(path, F.lit(".pdf"), F.lit("")), F.lit("/")), F.lit("")), bare), F.lit(""))


def parse_transcript(body: Column) -> dict[str, Column]:
    """Prepared remarks, questions, guidance sentences, money and earnings-per-share mentions."""
    at = F.regexp_instr(body, F.lit(r"(?i)question[\s\-]*and[\s\-]*answer|q\s*&\s*a\s+session|q\s*&\s*a:"))
    sentences = F.transform(F.split(body, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return {
        "prepared_remarks": F.trim(F.when(at > 0, F.substr(body, F.lit(1), at - 1)).otherwise(body)), "qa_section": F.when(at > 0, F.trim(F.substr(body, at))).otherwise(""),
        "guidance": F.filter(sentences, lambda s: F.exists(literals(lex.GUIDANCE), lambda w: F.contains(F.lower(s), w))),
        "revenue_mentions": F.regexp_extract_all(body, F.lit(r"(?i)\$\s*[\d,]+(?:\.\d+)?\s*(?:m(?:illion)?|b(?:illion)?|k)?"), F.lit(0)),
        "eps_mentions": F.regexp_extract_all(body, F.lit(r"(?i)(?:eps|earnings\s+per\s+share)[^\d$]*\$?\d+(?:\.\d+)?"), F.lit(0)),
    }


def parse_filing(body: Column, url: Column) -> dict[str, Column]:
    """Type by URL, else by the first 200 words; an 8-K's item; money and percentages of the first 500 words."""
    split = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    flat = lambda c: F.replace(F.upper(c), F.lit("-"), F.lit(""))
    first = lambda c: F.coalesce(*[F.when(F.contains(flat(c), F.lit(t.replace("-", ""))), t) for t in lex.FILING_TYPES])
    kind = F.coalesce(first(url), first(F.array_join(F.slice(split, 1, 200), " ")), F.lit("unknown"))
    head = F.array_join(F.slice(split, 1, 500), " ")
    item = F.nullif(F.regexp_extract(body, r"(?i)item\s+(\d+\.\d+)", 1), F.lit(""))
    figures = F.concat(F.regexp_extract_all(head, F.lit(r"(?i)\$\s*[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|thousand))?"), F.lit(0)), F.regexp_extract_all(head, F.lit(r"\d+(?:\.\d+)?\s*%"), F.lit(0)))
    return {"filing_type": kind, "event_type": F.when(kind == "8-K", F.concat(F.lit("Item "), item)), "key_figures": figures}


def equations(latex: Column) -> Column:
    """Bodies of equation environments and display math, longer than three characters."""
    patterns = [rf"(?s)\\begin\{{{e}\*?\}}(.*?)\\end\{{{e}\*?\}}" for e in lex.EQUATION_ENVIRONMENTS] + [r"(?s)\\\[(.*?)\\\]", r"(?s)\$\$(.*?)\$\$"]
    found = F.flatten(F.array(*[F.regexp_extract_all(latex, F.lit(p), F.lit(1)) for p in patterns]))
    return F.filter(F.transform(found, lambda e: F.trim(F.regexp_replace(e, r"\s+", " "))), lambda e: F.length(e) > 3)


NOISE = ["\\label", "\\begin{", "\\end{", "\\hline", "\\includegraphics", "\\caption", "\\centering"]


def is_equation_noise(latex: Column) -> Column:
    return (F.length(F.trim(latex)) < 4) | F.exists(literals(NOISE), lambda n: F.contains(latex, n))


def equation_type(latex: Column) -> Column:
    has = lambda *parts: F.exists(literals(list(parts)), lambda p: F.contains(latex, p))
    return F.when(has("\\exp", "e^"), "exponential").when(has("\\sin", "\\cos", "\\tan"), "trigonometric").when(has("\\log", "\\ln"), "logarithmic").when(F.contains(latex, F.lit("^")), "power").otherwise("algebraic")


def annotate_equation(latex: Column) -> dict[str, Column]:
    """Derivatives, their orders, the kind of equation and whether it is nonlinear, by its text."""
    partial, plain = F.contains(latex, F.lit("\\partial")), latex.rlike(r"\\frac\{d|\\dot|\\ddot|d/dt")
    time = F.when(latex.rlike(r"\\partial\^?\{?2\}?.*\\partial t|\\ddot|d\^2.*dt"), 2).when(latex.rlike(r"\\partial t|\\dot|dt"), 1).otherwise(0)
    space = F.when(latex.rlike(r"\\nabla\^2|\\Delta|\\partial x\^2"), 2).when(latex.rlike(r"\\nabla|\\partial x"), 1).otherwise(0)
    return {
        "has_derivative": partial | plain | latex.rlike(r"\\nabla"), "order_time": time, "order_space": space, "kind": F.when(partial | latex.rlike(r"\\nabla"), "pde").when(plain, "ode").otherwise("algebraic"),
        "nonlinear": latex.rlike(r"\^\{?[2-9]|\\sin|\\cos|\\exp|\\log"), "symbols": F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(latex, r"\\[a-zA-Z]+", " "), F.lit("([a-zA-Z])"), F.lit(1)))),
    }


def concepts(text: Column) -> Column:
    """Distinct names of bold, code, Capitalised and defined terms, in snake case, of 3 to 39 characters."""
    patterns = [r"\*\*([^*]{3,40})\*\*", r"`([^`]{2,30})`", r"(?U)\b([A-Z][a-z]{2,}(?:[ _][A-Z][a-z]+)*)\b", r"(?U)\b([\w_]{3,20})(?=\s+(?:is|refers|means|denotes)\b)"]
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    names = F.transform(found, lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"\s+", "_"))
    return F.array_distinct(F.filter(names, lambda c: (F.length(c) > 2) & (F.length(c) < 40)))


def concept_type(section: Column) -> Column:
    low = F.lower(section)
    has = lambda *parts: F.exists(literals(list(parts)), lambda p: F.contains(low, p))
    return F.when(has("theorem", "lemma", "proof"), "theorem").when(has("algorithm", "procedure", "pseudocode"), "algorithm").when(has("compute", "calculate", "apply", "evaluate"), "operation").otherwise("general")


def research_concepts(html: Column) -> dict[str, Column]:
    text = html_text(html)
    params = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]\w{0,15}\s*=\s*-?\d+(?:\.\d+)?)"), F.lit(1))
    parts = F.transform(params, lambda p: F.struct(F.trim(F.split(p, "=")[0]).alias("symbol"), F.trim(F.split(p, "=")[1]).cast("double").alias("value")))
    return {"parameters": parts, "terms": F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b"), F.lit(1))), "has_experiment": text.rlike("(?i)experiment|measured|we observe|results show")}


def dependencies(body: Column, most: int = 20, package_json: Column | None = None) -> Column:
    """Names in a package.json's dependencies, then those for development, or in a requirements list without its comments;
    the first `most`. `package_json` tells which it is; without it, what begins with a brace is one."""
    listed = lambda path: F.coalesce(F.map_keys(F.from_json(F.get_json_object(body, path), "map<string,string>")), F.array().cast("array<string>"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), strip), lambda x: ~x.startswith("#"))
    names = F.filter(F.transform(lines, lambda x: strip(F.regexp_extract(x, r"^([^>=<!;\[]*)", 1))), lambda x: x != "")
    json = F.ltrim(body).startswith("{") if package_json is None else package_json
    return F.slice(F.when(json, F.concat(listed("$.dependencies"), listed("$.devDependencies"))).otherwise(names), 1, most)


def installs(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?:pip|npm|conda) install\s+([A-Za-z0-9_.\-@/]+)"), F.lit(1)))


def markdown_links(body: Column) -> Column:
    """ARRAY<STRUCT<title, url, format>>; the format is the URL's last extension."""
    found = F.regexp_extract_all(body, F.lit(r"(\[[^\]]+\]\([^)\s]+\))"), F.lit(1))
    url = lambda x: F.regexp_extract(x, r"\]\(([^)]*)\)$", 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]+)\]", 1).alias("title"), url(x).alias("url"), F.lower(F.regexp_extract(url(x), r"\.([A-Za-z0-9]{1,5})$", 1)).alias("format")))


def difficulty(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("basic|beginner|intro"), 0).when(low.rlike("intermediate"), 1).when(low.rlike("advanced"), 2).when(low.rlike("expert"), 3).otherwise(1)


def summary(html: Column, least: int = 50, most: int = 400) -> Column:
    """First paragraph longer than `least` characters, cut; else the first such sentence of the text."""
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit("(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), html_text)
    long_ = lambda a: F.get(F.filter(a, lambda x: F.length(x) > least), F.lit(0))
    return F.left(F.coalesce(long_(paragraphs), long_(F.split(html_text(html), r"(?<=[.!?])\s+"))), F.lit(most))


def digest_mod(digest: Column, hex_digits: int, modulus: int) -> Column:
    """A hex digest as one big number, modulo a number below 2**30, eight digits at a time."""
    chunks = F.array(*[F.conv(F.substring(digest, k * 8 + 1, 8), 16, 10).cast("long") for k in range(hex_digits // 8)])
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda acc, c: (acc * F.lit(2**32) + c) % F.lit(modulus)).cast("int")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: t != "")


def token_dims(token: Column, dim: int) -> Column:
    """A token's three places: by MD5 and SHA-256 anywhere, by SHA-1 within the first third."""
    b = token.cast("binary")
    return F.array(digest_mod(F.md5(b), 32, dim), digest_mod(F.sha2(b, 256), 64, dim), digest_mod(F.sha1(b), 40, max(1, dim // 3)))


def _digests(words: list[bytes], dim: int) -> np.ndarray:
    """`token_dims` of words, a row for each."""
    third = max(1, dim // 3)
    found = [(int.from_bytes(hashlib.md5(w).digest()) % dim, int.from_bytes(hashlib.sha256(w).digest()) % dim, int.from_bytes(hashlib.sha1(w).digest()) % third) for w in words]
    return np.array(found, np.int64).reshape(-1, 3)


def _listed(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lists of tokens: each token's list and its number among the different ones, which come last."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    flat = tokens.flatten().dictionary_encode()
    return np.repeat(np.arange(len(tokens)), sizes), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def token_places(tokens: Column, dim: int) -> Column:
    """The different places of a list's tokens, in order: `token_dims` of all of them, a token of a batch hashed once."""

    def places(lists: pa.Array) -> pa.Array:
        row, token, words = _listed(lists)
        at, held = _digests(words.cast(pa.binary()).to_pylist(), dim), []
        for k in range(0, len(lists), 1024):
            some = slice(*np.searchsorted(row, [k, k + 1024]))
            seen = np.zeros((min(1024, len(lists) - k), dim), bool)
            seen[(row[some] - k)[:, None], at[token[some]]] = True
            held.append(np.argwhere(seen) + [k, 0])
        held = np.concatenate([*held, np.empty((0, 2), np.int64)])
        return _lists(held[:, 0], len(lists), pa.array(held[:, 1], pa.int32()))

    places.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(places, "array<int>")(tokens)


def lone_tokens(tokens: Column, dim: int) -> Column:
    """A list's different tokens, and of each whether it is alone at its place by MD5."""

    def alone(lists: pa.Array) -> pa.Array:
        row, token, words = _listed(lists)
        row, token = np.divmod(np.unique(row * max(len(words), 1) + token), max(len(words), 1))
        at = np.array([int.from_bytes(hashlib.md5(w).digest()) % dim for w in words.cast(pa.binary()).to_pylist()], np.int64)[token]
        _, place, owners = np.unique(row * dim + at, return_inverse=True, return_counts=True)
        told = pa.StructArray.from_arrays([words.take(pa.array(token)), pa.array(owners[place] == 1)], names=["token", "alone"])
        return _lists(row, len(lists), told)

    alone.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(alone, "array<struct<token:string,alone:boolean>>")(tokens)


def hdv_encode(text: Column, dim: int = 10_000) -> Column:
    """Sorted active places of a text's tokens."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(tokens(text)), lambda t: token_dims(t, dim)))))


def expr_features(latex: Column) -> dict[str, Column]:
    """Depth, size and operator share of an expression with braces."""
    marks = F.regexp_extract_all(latex, F.lit(r"([{}()])"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("deepest"))
    depth = F.aggregate(marks, start, lambda s, m: F.struct((s["at"] + F.when(m.isin("{", "("), 1).otherwise(-1)).alias("at"), F.greatest(s["deepest"], s["at"] + F.when(m.isin("{", "("), 1).otherwise(-1)).alias("deepest")), lambda s: s["deepest"])
    size = F.regexp_count(latex, F.lit(r"\\[a-zA-Z]+|[a-zA-Z0-9]"))
    ops = F.regexp_count(latex, F.lit(r"[+\-*/^=]|\\frac|\\cdot"))
    return {"depth": depth, "size": size, "operator_ratio": ops / F.greatest(size, F.lit(1))}
