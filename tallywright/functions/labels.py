"""Rules on names of organisations and on pages that claim to be theirs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a body that isn't the statewide one, and a page that isn't a site.
OTHER_BODIES = (
    r"\bcounty\b|\bcity\b|\bborough\b|\bparish\b|\bward\b|\bassembly\b|\byoung\b|\bcollege\b|\bwomen'?s\b|\bclub\b|\bfederation\b|\bcaucus\b|"
    r"\bmoderate\b|\bindependent\b|\bdemocratic-republican\b|\bnational\b|\bliberal\b|\bjefferson"
)
PARKED = (
    "account suspended", "domain for sale", "this domain is parked", "buy this domain", "domain is for sale", "hugedomains", "website coming soon", "under construction",
    "default web page", "index of /",
)
PARTY_TERMS = {"D": r"democratic party|democrats|democratic|democrat", "R": r"republican party|republicans|republican|\bgop\b"}
URLISH = r"(?i)https?://\S+|[\w.+-]+@[\w.-]+|\b[\w-]+\.(?:org|com|net|gov|edu|us|gop|io|co)\b"


def match_unit(label: Column, within: Column, names: dict[str, str]) -> Column:
    """The code of the unit an organisation belongs to: that of the place it lies in, if it is one; else of the
    longest name in its label, unless the label is that of another kind of body."""
    exact = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    low = F.lower(F.coalesce(label, F.lit("")))
    by_label = F.lit(None).cast("string")
    for name in sorted(names, key=len):
        by_label = F.when(low.rlike(rf"\b{re.escape(name.lower())}\b"), names[name]).otherwise(by_label)
    return F.coalesce(F.try_element_at(exact, F.trim(F.coalesce(within, F.lit("")))), F.when(~low.rlike(OTHER_BODIES), by_label))


def term_hits(text: Column, party: str) -> Column:
    """Occurrences of every term, terms within longer ones included."""
    return sum((F.regexp_count(text, F.lit(t)) for t in PARTY_TERMS[party].split("|")), F.lit(0))


def page_confirms(page_text: Column, title: Column, unit_name: Column, party: str) -> Column:
    """Whether a page's text (and title) name the unit and the party: the party more often than the other one, or
    the title names the unit and only this party. Addresses don't count; parked pages never confirm."""
    other = "R" if party == "D" else "D"
    low = F.lower(page_text)
    parked = F.lit(False)
    for m in PARKED:
        parked = parked | F.contains(low, F.lit(m))
    body, head = F.regexp_replace(low, URLISH, " "), F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), URLISH, " ")
    named = F.concat(F.lit(r"\b\Q"), F.lower(unit_name), F.lit(r"\E\b"))
    own = term_hits(body, party)
    by_title = F.regexp_like(head, named) & (term_hits(head, party) > 0) & (term_hits(head, other) == 0)
    return F.coalesce(~parked & F.regexp_like(body, named) & (own > 0) & ((own > term_hits(body, other)) | by_title), F.lit(False))


def numbered_sections(text: Column, anchor: str, most: int) -> Column:
    """struct(number, section) of each numbered section: from its anchor (with the number as group 1) up to the next
    anchor; the first of each number up to ``most``, in order."""
    parts = F.split(text, f"(?i)(?={anchor})")
    each = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, f"(?is)^{anchor}", 1).try_cast("int").alias("number"), p.alias("section")))
    good = F.filter(each, lambda s: s["number"].isNotNull() & (s["number"] <= most))
    first = F.filter(good, lambda s, i: F.array_position(F.transform(good, lambda g: g["number"]), s["number"]) == i + 1)
    return F.array_sort(first)


def between(text: Column, start: str, end: str) -> Column:
    """The squeezed text between two anchors, null without both."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, f"(?is){start}\\s+(.*?)\\s*(?:{end})", 1), r"\s+", " ")), F.lit(""))


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
