"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Entities are the base spans: e-mail addresses, IP addresses, card and phone numbers. The
corpus tells how strongly other terms reveal them: for a term t and an entity e, both
counted in documents, ``PMI(t; e) = log2(n(t, e) N / (n(t) n(e)))`` is compared with the
information of the entity, ``IC(e) = log2(N / n(e))``. A term with ``PMI >= IC`` occurs
with the entity only and is removed; one with ``PMI >= IC / alpha`` is generalised. Both
must occur with the entity in at least ``support`` different texts, so that a single text
or its copies say nothing. Terms are only treated in documents that hold the entity.

Null and empty texts have no spans. Rows that repeat an id are documents of their own;
rows with equal id and text get equal spans. Texts are searched whole, however long. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.names import unused
from docketry.plans.sizing import fits
from docketry.plans.tables import stored

# The base patterns. Possessive repeats and the look-behinds find the same
# leftmost matches without backtracking, also in very long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}
KINDS = list(PATTERNS)
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
# Rows (ids, or terms of a few letters) that may be broadcast.
FEW = 500_000
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class Disclosure:
    alpha: float = 1.25        # generalise terms with PMI >= IC / alpha
    support: int = 3           # different texts with both term and entity
    shortest: int = 1          # code points of the shortest term; support and PMI judge the short ones too


def _none() -> Column:
    return F.array().cast(SPAN)


def _found(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches with their offsets: what lies between them adds up."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(done, x):
        begin = done["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
                        F.lit(kind).alias("kind"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["match"].isNotNull() & _valid(x["match"], kind),
                                                F.concat(done["out"], F.array(span))).otherwise(done["out"]).alias("out"))

    return F.when(text.rlike(NEEDS[kind]), F.aggregate(both, start, step, lambda x: x["out"])).otherwise(_none())


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(match: Column, kind: str) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    digits = F.split(F.reverse(_digits(match)), "")
    luhn = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda total, d: total + d)
    return F.when(F.length(_digits(match)).between(12, 19), luhn % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    whole = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_found(whole, kind) for kind in KINDS]))


def told(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _entity(span: Column) -> Column:
    """The protected value behind a span, however it is written."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"] == "email", F.lower(span["value"])).when(
        span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"])))


def _terms(text: Column, p: Disclosure) -> Column:
    """Distinct lower-case words of a text outside what looks like a base span."""
    bare = text
    for kind in KINDS:
        bare = F.when(text.rlike(NEEDS[kind]), F.regexp_replace(bare, PATTERNS[kind], " ")).otherwise(bare)
    words = F.split(F.lower(bare), r"[^\p{L}\p{N}]+")
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= p.shortest)


def _holders(docs: DataFrame, found: DataFrame, p: Disclosure) -> DataFrame:
    """Documents with an entity that enough different texts have: ``id, mark, text, entities, terms``."""
    held = found.where(F.size("spans") > 0).select(
        "id", "mark", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    known = stored(held.groupBy("entity").agg(F.countDistinct("mark").alias("texts")).where(
        F.col("texts") >= p.support).select("entity"), "pii-entities")
    kept = held.join(known, "entity", "left_semi").groupBy("id", "mark").agg(F.collect_set("entity").alias("entities"))
    texts = docs.select(F.col("id").alias("__id"), "text", F.xxhash64("text").alias("__mark"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))
    kept = stored(kept, "pii-kept")
    if fits(kept, FEW):
        # Few documents hold a shared entity: the texts of the others stay where they are.
        texts = texts.join(F.broadcast(kept.select("id", "mark")), same, "left_semi")
    joined = kept.join(texts, same)
    return stored(joined.select("id", "mark", "text", "entities", _terms(F.col("text"), p).alias("terms")), "pii-holders")


def disclosures(docs: DataFrame, found: DataFrame, holders: DataFrame, p: Disclosure) -> DataFrame:
    """``term, entity, pmi, ic, kind``: the terms to treat, by entity. Counts are over all documents."""
    pair = holders.select("id", "mark", F.explode("entities").alias("entity"), "terms").select(
        "id", "mark", "entity", F.explode("terms").alias("term"))
    # One row per text first: copies add to the counts, not to the support.
    both = pair.groupBy("term", "entity", "mark").agg(F.count("*").alias("n")).groupBy("term", "entity").agg(
        F.sum("n").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= p.support)
    both = stored(both, "pii-pairs")
    total = docs.count()
    n_entity = found.where(F.size("spans") > 0).select(
        F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    # Only the terms of holders are counted. While they are few, the others end in the task that reads them;
    # else they are counted in each task before anything is sent.
    asked = stored(both.select("term").distinct(), "pii-asked")
    words = docs.where("text is not null").select(F.explode(_terms(F.col("text"), p)).alias("term"))
    if fits(asked, FEW):
        words = words.join(F.broadcast(asked), "term", "left_semi")
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term")).join(asked, "term", "left_semi")
    scored = both.join(n_term, "term").join(n_entity, "entity").select(
        "term", "entity",
        F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity"))).alias("pmi"),
        F.log2(F.lit(float(total)) / F.col("n_entity")).alias("ic"))
    close = F.col("pmi") >= F.col("ic") - 1e-9
    return scored.where((F.col("ic") > 0) & (F.col("pmi") >= F.col("ic") / p.alpha - 1e-9)).withColumn(
        "kind", F.when(close, "removed").otherwise("term"))


def _term_spans(holders: DataFrame, told_terms: DataFrame) -> DataFrame:
    """``id, mark, extra``: spans of the terms that disclose an entity of the same document."""
    pair = holders.select("id", "mark", F.explode("entities").alias("entity"), "terms").select(
        "id", "mark", "entity", F.explode("terms").alias("term"))
    mine = pair.join(told_terms.select("term", "entity", "kind"), ["term", "entity"]).groupBy("id", "mark", "term").agg(
        F.min("kind").alias("kind")).groupBy("id", "mark").agg(F.map_from_entries(
            F.collect_list(F.struct("term", "kind"))).alias("treat"))
    texts = holders.select("id", "mark", "text").dropDuplicates(["id", "mark"])
    joined = texts.withColumnsRenamed({"id": "__id", "mark": "__mark"}).join(
        mine, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def step(done, token):
        end = done["at"] + F.length(token)
        kind = F.try_element_at(F.col("treat"), F.lower(token))
        span = F.struct(done["at"].alias("start"), F.lit(len(KINDS)).alias("rank"), end.alias("end"),
                        kind.alias("kind"), token.alias("value"))
        return F.struct(end.alias("at"), F.when(kind.isNotNull(), F.concat(done["out"], F.array(span))).otherwise(
            done["out"]).alias("out"))

    tokens = F.regexp_extract_all("text", F.lit(TOKENS), F.lit(0))
    return joined.select("id", "mark", F.aggregate(tokens, start, step, lambda x: x["out"]).alias("extra"))


def personal_data(docs: DataFrame, p: Disclosure = Disclosure()) -> DataFrame:
    """``id, mark, base, spans`` for every row of ``docs`` (two columns: id, text).

    ``base`` are the base spans, ``spans`` those and the disclosing terms (kinds ``term``:
    generalised, ``removed``), by start; ``mark`` is the text's hash.
    """
    docs = docs.toDF("id", "text").select(F.col("id").cast("bigint").alias("id"), "text")
    found = stored(docs.select("id", F.xxhash64("text").alias("mark"), base_spans(F.col("text")).alias("spans")), "pii-base")
    holders = _holders(docs, found, p)
    terms = stored(disclosures(docs, found, holders, p), "pii-terms")
    extra = _term_spans(holders, terms).withColumnsRenamed({"id": "__id", "mark": "__mark"})
    joined = found.join(extra, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    apart = F.filter(F.coalesce("extra", _none()), lambda t: ~F.exists(
        F.col("spans"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return joined.select("id", "mark", F.col("spans").alias("base"),
                         F.array_sort(F.concat("spans", apart)).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its label; overlapping spans become the label of the first."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done, s):
        put = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), labels[s["kind"]])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= done["at"], put).otherwise(done["out"]).alias("out"))

    end = F.aggregate(spans, start, step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)


def sanitise(docs: DataFrame, p: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced; all rows and columns stay."""
    key, mark, spans = (unused(docs.columns, c) for c in ("__id", "__mark", "__spans"))
    found = personal_data(docs.select(id_col, text_col), p).where(F.size("spans") > 0).select(
        F.col("id").alias(key), F.col("mark").alias(mark), F.col("spans").alias(spans)).dropDuplicates([key, mark])
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(mark))
    changed = F.when(F.col(spans).isNotNull(), replaced(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))
    joined = docs.join(found, same, "left")
    return joined.select(*[changed.alias(c) if c == text_col else F.col(c) for c in docs.columns])
