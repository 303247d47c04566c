"""Feature and score columns of a case. Native expressions, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.plans import prose as P

NUMERIC_YES = rf"^(?:1|1\.0)$|{X.word_re(r'decision\s*:\s*1(?:\.0)?', True)}"
NUMERIC_NO = rf"^(?:0|0\.0)$|{X.word_re(r'decision\s*:\s*0(?:\.0)?', True)}"
JUDGMENT_CHARS = 320


def labelled(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rule bodies to whole-word, case-blind patterns."""
    return [(label, X.word_re(body, True)) for label, body in rules]


def judgment_excerpt(full_text: X.ColumnLike, decision: X.ColumnLike, summary: X.ColumnLike,
                     anchors: Sequence[str] = tuple(L.JUDGMENT_ANCHORS)) -> Column:
    """The decision if there is one, else the text from the first anchor *in list order*."""

    def from_text(source: Column) -> Column:
        found = [
            F.nullif(F.regexp_extract(source, f"(?s){X.word_re(a, True)}.{{0,{JUDGMENT_CHARS}}}", 0), F.lit(""))
            for a in anchors
        ]
        return F.trim(F.substring(F.coalesce(*found, source), 1, JUDGMENT_CHARS))

    if P.plain_words(anchors):
        wanted = tuple(anchors)

        @F.arrow_udf("string")
        def quoted(texts: pa.Array) -> pa.Array:
            return P.by_turns(lambda t: P.quoted(t, wanted, JUDGMENT_CHARS), texts)

        read = F.nullif(quoted(X.blank(full_text)), F.lit(""))
    else:
        read = X.let(X.squash(full_text), lambda s: F.when(s != "", from_text(s)))
    given = X.squash(decision)
    stand_in = F.coalesce(F.nullif(X.squash(summary), F.lit("")), F.lit("Judgment text unavailable."))
    return F.when(F.length(given) > 2, F.substring(given, 1, JUDGMENT_CHARS)).otherwise(
        F.coalesce(read, stand_in)
    )


def verdict(judgment: X.ColumnLike, summary: X.ColumnLike,
            rules: Sequence[tuple[str, str]] = tuple(L.VERDICT_RULES)) -> Column:
    """Outcome class of a judgment; the summary decides only when the judgment is silent."""
    yes, no = rules[0][0], rules[1][0]
    late = [(yes, f"(?i){X.EDGE_L}allowed|granted{X.EDGE_R}"), (no, f"(?i){X.EDGE_L}dismissed|rejected{X.EDGE_R}")]
    by_summary = X.first_rule(X.blank(summary), late, "Judgement reserved / Mixed outcome")

    def classify(value: Column) -> Column:
        chain = [(yes, NUMERIC_YES), (no, NUMERIC_NO), *labelled(rules)]
        return F.when(value == "", F.lit("Judgement unavailable")).otherwise(
            X.first_rule(value, chain, by_summary)
        )

    return X.let(X.squash(judgment), classify)


def verdict_class(judgment: X.ColumnLike, rules: Sequence[tuple[str, str]] = tuple(L.VERDICT_CLASSES)) -> Column:
    """The finer nine-class table. Rule order is data: ``guilty`` precedes ``not guilty``."""

    def classify(value: Column) -> Column:
        chain = [("Allowed", NUMERIC_YES), ("Dismissed", NUMERIC_NO), *labelled(rules)]
        return F.when(value == "", F.lit("Unknown")).otherwise(X.first_rule(value, chain, "Unknown"))

    return X.let(X.squash(judgment), classify)


def final_verdict(outcome: X.ColumnLike, title: X.ColumnLike) -> Column:
    """Outcome worded for the kind of case named in the title."""
    v, t = F.lower(X.blank(outcome)), F.lower(X.blank(title))
    # fixed values: outcomes that keep their own wording, kinds, endings
    own = [
        ("Conviction Recorded", "conviction|convicted"),
        ("Acquittal Recorded", "acquittal|acquitted"),
        ("Bail Granted", "bail granted"),
        ("Bail Rejected", "bail rejected|bail denied|bail dismissed"),
        ("Matter Remanded", "remand"),
        ("Matter Disposed", "disposed"),
    ]
    kinds = [
        ("Appeal", X.word_re("appeal")),
        ("Petition", X.word_re("petition|writ|slp")),
        ("Application", X.word_re("application")),
    ]
    endings = [
        (" Partly Allowed", "partly allowed|partially allowed|allowed in part|partly granted"),
        (" Dismissed", "dismissed|rejected|declined|denied|failed"),
        (" Allowed", "allowed|granted|in favor|successful"),
    ]
    kind = X.first_rule(t, kinds, "Case")
    worded = None
    for ending, pattern in endings:
        hit, label = v.rlike(pattern), F.concat(kind, F.lit(ending))
        worded = F.when(hit, label) if worded is None else worded.when(hit, label)
    rest = worded.otherwise(F.coalesce(F.nullif(X.blank(outcome), F.lit("")), F.lit("Judgement unavailable")))
    return X.first_rule(v, own, rest)


def case_type(c: X.ColumnLike, variant: str = "import", rules: Sequence[tuple[str, str]] | None = None) -> Column:
    """Type by the first matching pattern of a rule list (plain substrings, no word edges)."""
    rules, default = tuple(rules or L.CASE_TYPE_RULES[variant]), L.CASE_TYPE_DEFAULT[variant]
    if not P.portable(rules):
        return X.first_rule(F.lower(X.blank(c)), rules, default)

    @F.arrow_udf("string")
    def typed(texts: pa.Array) -> pa.Array:
        return P.by_turns(lambda t: P.labels(t, rules, default), texts)

    return typed(X.blank(c))


def similarity(title: X.ColumnLike, issues: X.ColumnLike, decision: X.ColumnLike, citation: X.ColumnLike) -> Column:
    """Baseline 45-98 from text lengths and the number of citations."""
    cited = F.size(F.filter(F.split(X.blank(citation), ","), lambda p: p != ""))
    score = (
        F.lit(55)
        + F.least(F.lit(20), X.round_half_up(F.length(X.blank(issues)) / 50))
        + F.least(F.lit(10), X.round_half_up(F.length(X.blank(decision)) / 40))
        + F.least(F.lit(8), cited * 2)
        + F.when(F.length(X.blank(title)) > 30, 4).otherwise(0)
    )
    return X.clamp(score, 45, 98).cast("int")


def keyword_score(c: Column, terms: Sequence[str]) -> Column:
    """Share of listed terms present, 0-100."""
    return F.least(F.lit(100), X.round_half_up(X.count_contains(c, terms) / F.lit(len(terms)) * 100))


def priority(title: X.ColumnLike, issues: X.ColumnLike, decision: X.ColumnLike, citation: X.ColumnLike,
             decided: X.ColumnLike, rules: L.PriorityRules = L.PriorityRules()) -> Column:
    """Priority 20-99 from urgency, impact, deadlines, citations, compliance, recency, severity."""
    text = F.lower(F.concat_ws(" ", X.blank(issues), X.blank(decision), X.blank(title)))
    reported = F.regexp_count(X.blank(citation), F.lit(f"(?i){rules.citation}"))
    year = F.regexp_extract(F.substring(X.blank(decided), 1, 4), r"^\s*(\d+)", 1).try_cast("int")
    recency = F.coalesce(F.greatest(F.lit(0), year - 2000) * F.lit(0.15), F.lit(0.0))

    def total(t: Column) -> Column:
        boost = None
        for points, body in rules.severity:
            hit = t.rlike(X.word_re(body))
            boost = F.when(hit, points) if boost is None else boost.when(hit, points)
        weighted = (
            F.lit(0.3) * keyword_score(t, rules.urgency)
            + F.lit(0.25) * keyword_score(t, rules.impact)
            + F.lit(0.2) * keyword_score(t, rules.deadline)
            + F.lit(0.15) * (F.lit(60) + F.least(F.lit(40), reported * 8))
            + F.lit(0.1) * keyword_score(t, rules.compliance)
        )
        return X.clamp(X.round_half_up(F.round(weighted + recency + boost.otherwise(0), 6)), 20, 99).cast("int")

    return X.let(text, total)


def tags(issues: X.ColumnLike, citation: X.ColumnLike, jurisdiction: X.ColumnLike,
         rules: Sequence[tuple[str, str]] = tuple(L.TAG_RULES)) -> Column:
    """Up to four tags: jurisdiction, citation mark, topics."""
    low = F.lower(X.blank(issues))
    found = F.array_distinct(
        F.array_compact(
            F.array(
                F.coalesce(F.nullif(X.blank(jurisdiction), F.lit("")), F.lit("India")),
                F.when(X.blank(citation) != "", "Cited"),
                *[F.when(low.contains(term), tag) for term, tag in rules],
            )
        )
    )
    return X.let(
        found, lambda t: F.slice(F.when(F.size(t) < 2, F.array_append(t, F.lit("General"))).otherwise(t), 1, 4)
    )


def why_match(issues: X.ColumnLike, decision: X.ColumnLike, citation: X.ColumnLike) -> Column:
    # fixed values: reasons and the sentence around them
    details = F.concat_ws(
        ", ",
        F.when(X.blank(issues) != "", "issue overlap"),
        F.when(X.blank(decision) != "", "similar outcome pattern"),
        F.when(X.blank(citation) != "", "citation support"),
    )
    return F.when(
        details == "", "Matched on legal narrative similarity from title and summary context."
    ).otherwise(F.concat(F.lit("Matched on "), details, F.lit(" in the source judgment metadata.")))


def verdict_signal(c: X.ColumnLike, signals: Sequence[tuple[int, str]] = tuple(L.VERDICT_SIGNALS)) -> Column:
    """0-12 points for outcome words."""
    low = F.lower(X.blank(c))
    parts = [F.when(low.rlike(X.word_re(body)), points).otherwise(0) for points, body in signals]
    return reduce(lambda a, b: a + b, parts)


def summary(c: X.ColumnLike, cues: Sequence[tuple[int, str]] = tuple(L.SUMMARY_CUES)) -> Column:
    """Three best sentences by cue words, at most 420 characters; equal scores keep text order."""
    cues = tuple(cues)

    @F.arrow_udf("string")
    def summed_up(texts: pa.Array) -> pa.Array:
        return P.by_turns(lambda t: P.summaries(t, cues), texts)

    return summed_up(X.blank(c))


def squashed(c: X.ColumnLike) -> Column:
    """``X.squash`` for whole texts."""

    @F.arrow_udf("string")
    def squash(texts: pa.Array) -> pa.Array:
        return P.by_turns(P.squashed, texts)

    return squash(X.blank(c))


def display_text(c: X.ColumnLike) -> Column:
    """Boilerplate removed for display; empty when fewer than 20 characters remain."""
    out = F.trim(F.regexp_replace(X.scrub(c, L.DISPLAY_NOISE), f"{X.SPACE}{{2,}}", " "))
    return X.let(X.trim_wide(out), lambda t: F.when(F.length(t) < 20, F.lit("")).otherwise(t))


def case_title(c: X.ColumnLike) -> Column:
    """Title case with small words kept low and acronyms kept high."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(X.blank(c), f"{X.SPACE}+", " "), r"\.\.\.$", ""))

    def word(w: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(low.isin(L.TITLE_VERSUS + L.TITLE_SMALL_WORDS), low)
            .when(w.rlike("^[A-Z]{2,}$"), w)
            .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
        )

    joined = F.array_join(F.transform(F.split(cleaned, " "), word), " ")
    return X.let(
        joined,
        lambda j: F.when(j == "", F.lit("Untitled Case")).otherwise(
            F.concat(F.upper(F.substring(j, 1, 1)), F.substr(j, F.lit(2)))
        ),
    )


def issue_list(c: X.ColumnLike) -> Column:
    """``Section n in The X Act, yyyy ; ...`` to ``Section n, X Act (yyyy)`` entries."""
    pattern = (
        rf"(?i)^((?:Article|Section|Rule|Order|Schedule)\s+\d+[A-Za-z]?)\s+in\s+(?:The\s+)?(.+?)\s*,?\s*(\d{{4}})?$"
    )

    def entry(s: Column) -> Column:
        act = F.trim(F.regexp_replace(F.regexp_extract(s, pattern, 2), f"{X.SPACE}+", " "))
        provision, year = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 3)
        return (
            F.when(~s.rlike(pattern), F.regexp_replace(s, f"{X.SPACE}+", " "))
            .when(year == "", F.concat_ws(", ", provision, act))
            .otherwise(F.concat(provision, F.lit(", "), act, F.lit(" ("), year, F.lit(")")))
        )

    parts = F.filter(
        F.transform(F.split(X.blank(c), ";"), lambda p: X.trim_wide(p)), lambda p: F.length(p) > 3
    )
    return F.transform(parts, entry)


def _first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def cited_names(c: X.ColumnLike, limit: int | None = None) -> Column:
    """Case names from a quoted ``'name': score`` list."""
    names = F.transform(
        F.regexp_extract_all(X.blank(c), F.lit(r"""['"]([^'"]{4,})['"]\s*:"""), F.lit(1)), lambda n: F.trim(n)
    )
    good = F.filter(names, lambda n: (F.length(n) > 5) & ~n.rlike(r"^[\d.]+$"))
    return F.transform(_first(good, limit), lambda n: case_title(n))


def statutes(c: X.ColumnLike, sections: int | None = None) -> Column:
    """First mention of each known act plus the explicit sections, or the first ``sections`` of them."""
    text = X.blank(c)
    acts = F.array_compact(
        F.array(
            *[
                F.nullif(
                    F.trim(F.regexp_replace(F.regexp_extract(text, f"(?i){p}[^,;.]{{0,30}}", 0), f"{X.SPACE}+", " ")),
                    F.lit(""),
                )
                for p in L.STATUTES
            ]
        )
    )
    explicit = _first(F.regexp_extract_all(text, F.lit(r"(?i)(?:IPC|CrPC|Section)\s+\d+[A-Za-z]?"), F.lit(0)), sections)
    return F.array_distinct(F.concat(acts, explicit))


def explicit_sections(c: X.ColumnLike) -> Column:
    """Distinct section mentions in order, then bare code references."""
    text = X.blank(c)
    # fixed values: mention patterns
    mention = (
        r"(?i)(?:section|sec\.?|s\.)\s*\d{1,4}[A-Z]?\s*(?:of\s+)?(?:ipc|crpc|bnss|it act|ndps|pocso|mvact|[a-z\s]{3,30})?"
    )
    found = F.transform(
        F.regexp_extract_all(text, F.lit(mention), F.lit(0)), lambda m: F.trim(F.regexp_replace(m, f"{X.SPACE}+", " "))
    )
    return F.array_distinct(F.concat(found, F.regexp_extract_all(text, F.lit(r"IPC\s+\d{2,3}[A-Z]?"), F.lit(0))))


def citation_years(c: X.ColumnLike, mentions: int | None = None) -> Column:
    """Distinct years mentioned, or those among the first ``mentions``."""
    years = F.regexp_extract_all(F.upper(X.blank(c)), F.lit(X.word_re(r"(?:19|20)\d{2}")), F.lit(0))
    return F.array_distinct(_first(years, mentions))


def citation_reporters(c: X.ColumnLike, reporters: Sequence[str] = tuple(L.REPORTERS)) -> Column:
    up = F.upper(X.blank(c))
    return F.array_compact(F.array(*[F.when(up.contains(r), F.lit(r)) for r in reporters]))


def whether_issues(c: X.ColumnLike, limit: int | None = None) -> Column:
    """``whether ...`` clauses as sentences."""
    found = _first(F.regexp_extract_all(F.lower(X.blank(c)), F.lit(r"whether\s+[^.;,]{10,120}"), F.lit(0)), limit)
    return F.transform(
        found,
        lambda m: X.let(
            F.trim(F.regexp_replace(m, f"{X.SPACE}+", " ")),
            lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)), F.lit(".")),
        ),
    )


def highlights(c: X.ColumnLike, pool: Sequence[tuple[str, str]], defaults: Sequence[str], limit: int | None = 5) -> Column:
    """Labels whose key occurs in the text, five as a report shows or all with None; the defaults if none does."""
    low = F.lower(X.blank(c))
    found = F.array_compact(F.array(*[F.when(low.contains(key), F.lit(label)) for key, label in pool]))
    return X.let(
        found,
        lambda f: F.when(F.size(f) > 0, _first(f, limit)).otherwise(F.array(*[F.lit(d) for d in defaults])),
    )


def domain_signal(c: X.ColumnLike, signals: Sequence[tuple[int, str]] = tuple(L.DOMAIN_SIGNALS)) -> Column:
    """0-9 points for legal vocabulary; a case-like document has at least two."""
    low = F.lower(X.blank(c))
    parts = [F.when(low.rlike(X.word_re(body)), points).otherwise(0) for points, body in signals]
    return reduce(lambda a, b: a + b, parts)
