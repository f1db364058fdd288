"""Checks of answers against their contexts, and retrieval quality: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text as x
from siltstone.functions.extract import answer_entities, is_noise_answer

ENTITY_STOP = ("This", "That", "These", "Those", "The", "And", "With", "From", "Into", "When", "Where")
NEGATIONS = ("no", "not", "never", "without")


def share(found: Column, of: Column) -> Column:
    """Size of one array by that of another; 1 where the other is empty."""
    return F.when(F.size(of) == 0, F.lit(1.0)).otherwise(F.size(found) / F.size(of).cast("double"))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))


def references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def checked_entities(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z0-9_\-]{3,}\b"), F.lit(0)))
    return F.array_sort(F.filter(found, lambda w: ~w.isin(*ENTITY_STOP)))


def completeness(answer: Column) -> Column:
    clean = x.strip(answer)
    return F.when((F.length(clean) < 24) | (F.size(x.sentences(clean)) == 0), 0.2).when((F.size(x.sentences(clean)) == 1) & (F.length(clean) < 70), 0.55).otherwise(1.0)


def verification(answer: Column, context: Column) -> Column:
    """Struct of supported, confidence, unsupported claims, number of issues and the five stage scores.

    Grounding looks for terms as substrings of the lower-cased context; a claim of fewer than four terms is not judged.
    """
    def supported(s: Column) -> Column:
        """What of each kind the context has; the claims that it does not support. Everything that a fold looks at is a value here."""
        low = s["low"]

        def unsupported(claim: Column) -> Column:
            return x.let(F.array_distinct(x.tokens(claim)), lambda terms: (F.size(terms) >= 4) & (F.size(F.filter(terms, lambda w: low.contains(w))) / F.greatest(F.size(terms), F.lit(1)).cast("double") < 0.42))

        return F.struct(
            s["answer"].alias("answer"), *(s[c].alias(c) for c in ("numbers", "refs", "entities", "claims")), F.filter(s["numbers"], lambda n: low.contains(n)).alias("numbers_in"),
            F.filter(s["refs"], lambda r: (F.trim(r) != "") & low.contains(F.lower(F.trim(r)))).alias("refs_in"), F.filter(s["entities"], lambda w: low.contains(F.lower(w))).alias("entities_in"), F.filter(s["claims"], unsupported).alias("bad"),
        )

    def scored(s: Column) -> Column:
        numeric, cited, entity = (share(s[f"{c}_in"], s[c]) for c in ("numbers", "refs", "entities"))
        missing = [F.size(s[c]) - F.size(s[f"{c}_in"]) for c in ("numbers", "refs", "entities")]
        grounding = F.when(F.size(s["claims"]) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.size(s["bad"]) / F.size(s["claims"]).cast("double")))
        return x.let(completeness(s["answer"]), lambda whole: F.struct(
            s["answer"].alias("answer"), s["bad"].alias("bad"), F.round(grounding, 4).alias("grounding"), F.round(numeric, 4).alias("numeric"), F.round(cited, 4).alias("citation"), F.round(entity, 4).alias("entity"), whole.alias("completeness"),
            (F.size(s["bad"]) + missing[0] + missing[1] + missing[2] + F.when(whole < 1, 1).otherwise(0)).alias("issues"),
        ))

    def judged(s: Column) -> Column:
        weighted = s["grounding"] * 0.38 + s["numeric"] * 0.18 + s["citation"] * 0.15 + s["entity"] * 0.14 + F.round(s["completeness"], 4) * 0.15
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted - F.least(F.lit(0.45), s["issues"] * 0.07)))
        return x.let(F.struct(sure.alias("sure"), (F.trim(s["answer"]) == "").alias("empty"), is_noise_answer(s["answer"]).alias("noise")), lambda c: F.struct(
            (~c["empty"] & ~c["noise"] & (c["sure"] >= 0.62) & (F.size(s["bad"]) == 0)).alias("supported"), F.when(c["empty"], 0.0).when(c["noise"], 0.15).otherwise(F.round(c["sure"], 4)).alias("confidence"), s["bad"].alias("unsupported"),
            F.when(c["empty"] | c["noise"], 1).otherwise(s["issues"]).alias("issues"), *(s[n].alias(n) for n in ("grounding", "numeric", "citation", "entity", "completeness")),
        ))

    found = F.struct(answer.alias("answer"), F.lower(context).alias("low"), numbers(answer).alias("numbers"), references(answer).alias("refs"), checked_entities(answer).alias("entities"), x.claim_parts(answer).alias("claims"))
    return x.let(x.let(x.let(found, supported), scored), judged)


def should_retry(supported: Column, issues: Column, confidence: Column, quality: Column, retries: Column, most: int = 3, model: bool = True) -> Column:
    low = quality < 0.45
    return (retries < most) & (low if not model else (~supported | (issues >= 3) | (confidence < 0.75) | low))


def choose_k(quality: Column, retries: Column, kind: Column, base: int = 12, most: int = 30) -> Column:
    k = F.lit(base) + F.when(kind == "multi_hop", 4).otherwise(0) + F.when(quality < 0.35, 6).otherwise(0) + F.when(retries > 0, retries * 3).otherwise(0)
    return F.least(F.lit(most), F.greatest(F.lit(base), k))


def alignment(question: Column, context: Column) -> Column:
    """Share of the question's terms (longer than two) that the context has."""
    q = F.array_distinct(F.filter(x.tokens(question), lambda w: F.length(w) > 2))
    return F.when(F.size(q) == 0, 0.0).otherwise(x.overlap(q, F.array_distinct(x.tokens(context))) / F.size(q).cast("double"))


def lexical_overlap(terms: Column, text: Column) -> Column:
    return F.least(F.lit(1.0), x.overlap(terms, F.array_distinct(x.tokens(text))) / F.greatest(F.lit(4), F.size(terms)).cast("double"))


def claim_supported(claim: Column, context: Column) -> Column:
    terms = F.filter(F.regexp_extract_all(F.lower(claim), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 3)
    return (F.size(terms) == 0) | (F.size(F.filter(terms, lambda w: F.lower(context).contains(w))) >= F.size(terms) * 0.45)


def unknown_citations(answer: Column, ids: Column) -> Column:
    return F.filter(F.transform(references(answer), lambda r: F.trim(F.split(r, ",")[0])), lambda c: (c != "") & ~F.array_contains(ids, c))


def contradictions(answer: Column) -> Column:
    """Terms of four letters or more that stand in affirmed and in negated sentences."""
    negated = r"\b(no|not|never|cannot|can't|without)\b"

    def terms(keep) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.filter(x.sentences(F.lower(answer)), keep), lambda s: F.regexp_extract_all(s, F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))))

    both = F.array_intersect(terms(lambda s: ~s.rlike(negated)), terms(lambda s: s.rlike(negated)))
    return F.array_sort(F.array_except(both, F.array(*map(F.lit, ("that", "with", "from", "this")))))


def self_verification(question: Column, answer: Column, context: Column, ids: Column) -> Column:
    """Struct of passed, grounding_score, citation_accuracy, action and issue counts of the advanced checks.

    Contexts are lower-cased before entities are looked for, so no context entity ever counts.
    """
    claims = x.sentences(answer)

    def build(s: Column) -> Column:
        n = F.greatest(F.size(claims), F.lit(1)).cast("double")
        grounding = F.size(s["grounded"]) / n
        absolute = F.lower(answer).rlike(r"\balways\b") & F.lower(answer).rlike(r"\bnever\b")
        issues = F.size(claims) - F.size(s["grounded"]) + F.size(s["cited"]) + absolute.cast("int") + (F.size(s["clash"]) > 0).cast("int") + F.least(F.size(s["unknown"]), F.lit(3))
        return F.struct(
            (issues == 0).alias("passed"), grounding.alias("grounding_score"), F.greatest(F.lit(0.0), F.lit(1.0) - F.size(s["cited"]) / n).alias("citation_accuracy"),
            F.when(grounding < 0.5, "re_retrieve").when(issues > 0, "return_with_warning").otherwise("none").alias("action"), issues.alias("issues"),
        )

    parts = F.struct(F.filter(claims, lambda c: claim_supported(c, context)).alias("grounded"), unknown_citations(answer, ids).alias("cited"), contradictions(answer).alias("clash"), F.array_except(answer_entities(answer), answer_entities(question)).alias("unknown"))
    return x.let(parts, build)


def negation(text: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"\s+"), F.array(*map(F.lit, NEGATIONS)))


def corrective_label(question: Column, text: Column) -> Column:
    q = x.judged_tokens(question)
    overlap = x.overlap(q, x.judged_tokens(text)) / F.greatest(F.size(q), F.lit(1)).cast("double")
    return x.let(overlap, lambda o: F.when(o == 0, "IRRELEVANT").when(negation(question) != negation(text), "CONTRADICTORY").when(o >= 0.35, "CORRECT").when(o >= 0.15, "AMBIGUOUS").otherwise("INCORRECT"))


def coverage(question: Column, context: Column) -> Column:
    """0.7 times the share of keywords in the context. Keywords are lower-cased, so none counts as an entity."""
    q = x.keywords(question)
    return F.when(F.size(q) == 0, 0.5).otherwise(F.size(F.filter(q, lambda w: F.lower(context).contains(w))) / F.size(q).cast("double") * 0.7)


def subtopic_completeness(question: Column, context: Column) -> Column:
    topics = F.filter(F.transform(F.split(question, r"(?i)\band\b|,|;|\?|\bvs\b"), x.strip), lambda p: p != "")
    hit = F.filter(topics, lambda p: F.exists(x.keywords(p), lambda w: F.lower(context).contains(w)))
    return F.when(F.size(topics) <= 1, 1.0).otherwise(F.size(hit) / F.size(topics).cast("double"))
