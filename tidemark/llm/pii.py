"""Personal data: patterns find protected entities; corpus co-occurrence finds the terms that give them away.

Base: emails, IP addresses, payment cards and phone numbers, with their positions in code points. Method: of every term near a
protected entity, the whole corpus is asked how much of the entity's information it discloses,

    disclosure(t, e) = smoothed PMI(t; e) / IC(e) = ln(n_te * N / (n_t * n_e) * c / (c + `doubt`)) / ln(N / n_e)

with N documents, n_e holding e, n_t holding t and n_te holding t within `context` characters of e, in c different contexts (copies
of one passage are one). There is no least number of contexts: few of them discount the disclosure, the less so the more documents
there are to tell e from. A term that more often than not stands away from the entity (2 * n_te <= n_t) discloses nothing.

Protected entities are the base values, each on its own, and the concept of a credential: a name of one (CONCEPTS) that is given
a value. Terms are runs of letters and digits; a long run of both (SHAPE_CHARS) has its shape as a second term (`#x40`: 40
hexadecimal digits), so values that never occur twice are told by what they look like where credentials stand and nowhere else.
A word is generalised to the kind of what it discloses from `generalise` on and removed from `remove` on, a shape is
generalised to [SECRET], wherever it stands.

Edge cases. Null or empty text: no spans. Very long texts are searched whole; prefix sums take two levels, so the work stays
near linear in the matches. Overlapping spans are all reported; the sanitised text has one placeholder for each connected
stretch, that of the first span. Terms that overlap a base span are not spans. Repeated rows have repeated results, and count as
documents; rows are told apart by id and text, so null and repeated ids are fine. Ids must be integers. Empty input: empty output. Added
columns begin with `__`; others pass through, those whose names begin so with `in_` before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, ascii_lower, let, staged, whole

KINDS = ("email", "ip", "card", "phone")
# A start is either where the last match ended or no continuation of a run that has failed already: the same matches, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
TERM = r"[\p{L}\p{N}]+"
# Names of credentials, as patterns.
CONCEPTS = ("token", "secret", "password", "passwd", "pwd", "credentials?", "api[ _-]?key", "access[ _-]?key", "private[ _-]?key")
SHAPE_CHARS = 16
DOUBT = 2.0
CHUNK = 256
BROADCAST_ROWS = 200_000
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def scan(values: Column, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """Exclusive scan of an int array, in two levels: chunks, then their totals."""
    step = lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
    totals = lambda inner: F.aggregate(F.transform(inner, lambda ch: F.element_at(ch, -1)), F.array(F.lit(zero)), step)
    whole_ = lambda inner, outer: F.flatten(F.transform(inner, lambda ch, c: F.transform(F.slice(ch, 1, F.size(ch) - 1), lambda x: op(F.get(outer, c), x))))
    sums = lambda v: let(F.transform(chunks(v), lambda ch: F.aggregate(ch, F.array(F.lit(zero)), step)), lambda inner: let(totals(inner), lambda outer: whole_(inner, outer)))
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(sums(v)))


def _located(text: Column, pattern: str, keep: Callable[[Column], Column], kind: str) -> Column:
    """Spans of the matches that `keep` accepts."""
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)
    span = lambda start, v: F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(v)).alias("end"), F.lit(kind).alias("kind"), v.alias("value"))

    def spans(gaps: Column, hits: Column) -> Column:
        starts = scan(F.transform(hits, lambda v, i: F.char_length(v) + F.get(gaps, i)), lambda a, b: a + b)
        return F.transform(F.arrays_zip(starts.alias("s"), hits.alias("v")), lambda z, i: span(z["s"] + F.get(gaps, i), z["v"]))

    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = let(gaps, lambda g: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: spans(g, h)))
    return F.filter(found, lambda s: keep(s["value"])).cast(SPAN)


def base_spans(text: Column) -> Column:
    """Emails, addresses, cards and phones of a text as (start, rank, end, kind, value), by start and kind."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]+", "")
    n_digits = lambda v: F.char_length(digits(v))
    rules = {
        "email": (F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(OCTETS)),
        "card": (text.rlike(r"(?:[0-9][ -]?){13}[0-9]"), lambda v: F.call_function("luhn_check", digits(v))),
        "phone": (text.rlike(r"\+[0-9]"), lambda v: n_digits(v).between(10, 15)),
    }
    none = F.array().cast(SPAN)
    return F.sort_array(F.concat(*[F.when(may, _located(text, PATTERNS[k], keep, k)).otherwise(none) for k, (may, keep) in rules.items()]))


def shape(word: Column) -> Column:
    """What a long run of letters and digits looks like: #x hexadecimal or #w not, and its length in steps of 8, to 64; else null."""
    long_ = (F.char_length(word) >= SHAPE_CHARS) & word.rlike(r"\p{N}") & word.rlike(r"\p{L}")
    size = F.least(F.lit(64), (F.char_length(word) - F.char_length(word) % 8)).cast("string")
    return F.when(long_, F.concat(F.when(word.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)\z"), "#x").otherwise("#w"), size))


def _terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, A-Z lower-cased, and the shapes of the long ones."""
    runs = lambda t: F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    shapes = F.filter(F.transform(runs(text), shape), lambda x: x.isNotNull())
    return F.array_distinct(F.when(text.rlike(rf"[\p{{L}}\p{{N}}]{{{SHAPE_CHARS}}}"), F.concat(runs(ascii_lower(text)), shapes)).otherwise(runs(ascii_lower(text))))


CUE = r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(CONCEPTS) + r")[\"']?[ \t]{0,2}[:=]"


def cues(text: Column) -> Column:
    """Spans of credential names that are given a value."""
    return F.when(text.rlike(CUE), _located(text, CUE, lambda v: F.lit(True), "secret")).otherwise(F.array().cast(SPAN))


def entity(span: Column) -> Column:
    """What names an entity, however it is written."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "secret", "").when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(F.regexp_replace(span["value"], "[^0-9]+", "")))


def disclosing_terms(docs: DataFrame, context: int = 80, doubt: float = DOUBT, generalise: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits, terms): key, doc, terms (array<struct<term, disclosure, kind>>) of each document that holds disclosing terms, and the terms.

    kind is that of the entity which the term discloses most. Two documents or more are needed to tell anything.
    """
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))
    n_docs = rows.count()
    found = rows.withColumn("spans", F.concat(base_spans(F.col("text")), cues(F.col("text")))).where(F.size("spans") > 0)
    cue = F.col("s.kind") == "secret"
    around = found.select("doc", "key", "text", F.explode("spans").alias("s")).select(
        "doc", "key", F.col("s.kind").alias("kind"), F.xxhash64(entity(F.col("s"))).alias("e"),
        F.when(cue, "").otherwise(F.substring("text", F.greatest(F.col("s.start") - context, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(context)))).alias("before"), F.substring("text", F.col("s.end") + 1, F.lit(context)).alias("after"),
        F.when(F.col("s.start") > context, F.substring("text", F.col("s.start") - context, F.lit(1))).otherwise("").alias("left"), F.substring("text", F.col("s.end") + context + 1, F.lit(1)).alias("right"),
    )
    # A word cut by the edge of the window is not a term: a letter or digit stands just outside as well.
    before = F.when(F.col("left").rlike(r"[\p{L}\p{N}]"), F.regexp_replace("before", r"^[\p{L}\p{N}]+", "")).otherwise(F.col("before"))
    after = F.when(F.col("right").rlike(r"[\p{L}\p{N}]"), F.regexp_replace("after", r"[\p{L}\p{N}]+$", "")).otherwise(F.col("after"))
    near = staged(around.select("doc", "key", "kind", "e", F.xxhash64("before", "after").alias("ctx"), F.explode(_terms(F.concat(before, F.lit(" "), after))).alias("term")).distinct(), "near")
    holding = near.select("doc", "key", "kind", "e").distinct().groupBy("kind", "e").agg(F.count("*").alias("n_e"))
    # Every term near a credential has the same entity: its count is one number, and no join deals by it.
    secrets = holding.where("kind = 'secret'").agg(F.sum("n_e")).first()[0] or 0
    pairs = near.groupBy("term", "kind", "e", "ctx").agg(F.lit(1).alias("one")).groupBy("term", "kind", "e").agg(F.count("*").alias("contexts"))
    n_te = near.select("term", "kind", "e", "doc", "key").distinct().groupBy("term", "kind", "e").agg(F.count("*").alias("n_te"))
    # n_t is at least the number of documents with the term near any entity: pairs that fall short even so need no counting.
    n_near = near.select("term", "doc", "key").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    share = lambda n_t: F.try_divide(F.ln(F.col("n_te") * n_docs / (F.col(n_t) * F.col("n_e")) * F.col("contexts") / (F.col("contexts") + doubt)), F.ln(F.lit(n_docs) / F.col("n_e")))
    pairs = pairs.join(n_te, ["term", "kind", "e"]).join(n_near, "term")
    known = pairs.where("kind <> 'secret'").join(holding.where("kind <> 'secret'"), ["kind", "e"]).select("term", "kind", "contexts", "n_te", "n_near", "n_e")
    pairs = known.unionByName(pairs.where("kind = 'secret'").select("term", "kind", "contexts", "n_te", "n_near", F.lit(max(secrets, 1)).alias("n_e")))
    pairs = staged(pairs.where((F.col("n_e") < n_docs) & (F.col("n_te") * 2 > F.col("n_near")) & (share("n_near") >= generalise)), "pairs")
    asked = pairs.select("term").distinct()
    held = rows.select("doc", "key", F.explode(_terms(F.col("text"))).alias("term"))
    if asked.count() <= BROADCAST_ROWS:  # else all terms are counted by shuffle
        asked = F.broadcast(asked)
    held = staged(held.join(asked, "term", "left_semi"), "held")
    n_t = held.groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(n_t, "term").where("n_te * 2 > n_t").select("term", share("n_t").alias("disclosure"), "kind").groupBy("term").agg(F.max(F.struct("disclosure", "kind")).alias("most"))
    terms = staged(scored.select("term", "most.disclosure", "most.kind").where(F.col("disclosure") >= generalise), "terms")
    known = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms
    hits = held.join(known, "term").groupBy("doc", "key").agg(F.collect_set(F.struct("term", "disclosure", "kind")).alias("terms"))
    return hits, terms


def find(docs: DataFrame, context: int = 80, doubt: float = DOUBT, generalise: float = 0.85, remove: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __base (spans of the patterns), __spans (those and the terms') and __sanitised (text)."""
    hits, _ = disclosing_terms(docs, context, doubt, generalise, id_col, text_col)
    hits = staged(hits, "hits")
    few = hits.count() <= BROADCAST_ROWS
    hits = hits.select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("terms").alias("__terms"))
    text = whole(F.col(text_col))
    rows = apart(docs).withColumns({"__text": text, "__id": F.col(id_col).cast("long"), "__hash": F.xxhash64(text)})
    df = rows.join(F.broadcast(hits) if few else hits, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__key")), "left")
    df = df.withColumn("__base", base_spans(F.col("__text")))
    df = df.withColumn("__names", F.transform("__terms", lambda t: t["term"]))
    named = lambda v: F.array_contains("__names", ascii_lower(v)) | F.coalesce(F.array_contains("__names", shape(v)), F.lit(False))
    words = _located(F.col("__text"), TERM, named, "term")
    apart_ = F.filter(words, lambda w: ~F.exists("__base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    df = df.withColumn("__spans", F.when(F.col("__terms").isNull(), F.col("__base")).otherwise(F.sort_array(F.concat("__base", apart_))))
    own = lambda s: let(F.filter("__terms", lambda t: t["term"] == ascii_lower(s["value"])), lambda t: F.get(t, F.lit(0)))
    tag = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(let(own(s), lambda t: F.when(t.isNull() | (t["kind"] == "secret"), "[SECRET]").when(t["disclosure"] >= remove, "").otherwise(F.concat(F.lit("["), F.upper(t["kind"]), F.lit(" TERM]")))))
    df = df.withColumn("__until", scan(F.transform("__spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b)))
    pieces = F.transform("__spans", lambda s, i: F.when(s["start"] >= F.get("__until", i), F.concat(F.substring("__text", F.get("__until", i) + 1, s["start"] - F.get("__until", i)), tag(s))).otherwise(F.lit("")))
    end = F.array_max(F.transform("__spans", lambda s: s["end"]))
    clean = F.when(F.size("__spans") == 0, F.col("__text")).otherwise(F.concat(F.array_join(pieces, ""), F.substring("__text", end + 1, F.char_length("__text"))))
    return df.withColumn("__sanitised", clean).drop("__text", "__id", "__hash", "__doc", "__key", "__terms", "__names", "__until")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
