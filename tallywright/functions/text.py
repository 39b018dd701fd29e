"""Rules on short texts as Spark expressions: titles, tags, party labels, prose, document classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that decide what a rule accepts.
BILL_NUMBER = r"\b(?:hb|sb|hf|sf|ab|hr|sr|hjr|sjr|lb|ho|so)\s*\.?\s*\d+\b"
YEAR = r"\b(?:19|20)\d{2}\b"
ORDINAL = r"\b\d+(?:st|nd|rd|th)\b"
GENERIC = (
    r"^(?:an act |a bill )?(?:relating to |concerning |regarding )?(?:the )?(?:general |state )?"
    r"(?:appropriations?|budget|supplemental appropriations?|revenue|making appropriations|adjournment|recess|rules)\b"
)
CEREMONIAL = (
    r"\b(?:recogniz|commemorat|designat|honor|congratulat|celebrat|proclaim|condolence|memoriam|mourning|salut|commend)\w*\b"
    r"|\b(?:awareness|appreciation|remembrance)\s+(?:month|week|day)\b|\bmonth of\b|\bweek of\b|\bday as\b"
)
TITLE_STOP_WORDS = (
    "a an the of to in for on and or by with from at as be is are was were relating relate relates act bill resolution concerning regarding "
    "provide providing provisions amend amending amendment establish establishing certain state states general public new law laws section sections"
).split()
ELECTION = (
    r"\b(?:elections?|electoral|voters?|voting|ballots?|polling places?|absentee voting|mail[- ]in voting|campaign finance|campaign contributions?|"
    r"political committees?|redistricting|reapportionment|primary elections?|candidate filing|candidate qualification|write[- ]in candidates?|political parties)\b"
)
ELECTION_SUBJECT = r"\b(?:elections?|voters?|voting|ballots?|polling places?|absentee|campaign finance|redistricting|reapportionment|political parties)\b"
ELECTION_SUBTYPES = (
    ("redistricting", r"\b(?:redistricting|reapportionment|districting plan)\b"),
    ("campaign_finance", r"\b(?:campaign finance|campaign contributions?|campaign expenditures?|political committees?|electioneering communications?)\b"),
    ("election_security", r"\b(?:election fraud|voter fraud|election interference|ballot harvesting|election offenses?|election crimes?|election security)\b"),
    ("candidates_and_parties", r"\b(?:candidate filing|candidate qualification|candidate nomination|write[- ]in candidates?|political parties|party affiliation|primary elections?)\b"),
    ("voting_and_administration", r"\b(?:elections?|electoral|voters?|voting|ballots?|polling places?|absentee voting|mail[- ]in voting)\b"),
)
PARTY_NAMES = {"democratic": "D", "democrat": "D", "democratic-farmer-labor": "D", "democratic-npl": "D", "republican": "R"}
SPACED_CAPITALS = r"(?:\b[A-Z]\s+[A-Z]{2,}\b\s*){2,}"
DOCUMENT_TYPES = (
    ("legislative_priorities", r"legislative[-_ ]?priorit|policy[-_ ]?agenda"), ("platform", r"\bplatform\b|\bplanks?\b"), ("resolutions", r"\bresolution"), ("principles", r"\bprinciples\b|\bcreed\b"),
)
DECLARATIVE = (
    r"\bwe believe\b|\bwe support\b|\bwe oppose\b|\bwe call (?:on|for)\b|\bwe affirm\b|\bwe urge\b|\bbe it resolved\b|\bwhereas\b|"
    r"\bthe \w+ party (?:believes|supports|opposes|affirms)\b|\bplank\b|\bwe demand\b|\bwe recognize\b|\bour party\b|\bwe stand\b"
)
DESPACED = "webelieve|wesupport|weoppose|wecallon|wecallfor|weaffirm|weurge|beitresolved|whereas|plank|wedemand|werecognize|ourparty|westand"
NATIONAL = r"\b(?:democratic|republican)\s+national\s+convention\b|\bnational\s+platform\b|\bdemocratic\s+national\s+committee\b|\brepublican\s+national\s+committee\b"
OTHER_DOCUMENTS = (
    r"non-?profit org|u\.?s\.? postage|postage\s+paid|presorted|inside this issue|in this issue|upcoming events|volume\s+[ivx\d]+,?\s+issue\s+\d+|"
    r"vol\.?\s*[ivx\d]+,?\s*(?:no|issue)\.?\s*\d+|a message from the chair|letter from the chair|quote of the month|minutes of the|call to order|"
    r"the meeting was adjourned|roll call vote|annual report|report to shareholders|the role of the (?:town|county) chair|table of contents\s+welcome"
)
OTHER_NAMES = (
    r"newsletter|bylaws|by-laws|minutes|agenda-?packet|annual[-_ ]?report|shareholders?[-_ ]?report|manual|briefing|brochure|"
    r"call[-_ ]?(?:of|to)[-_ ]?(?:the[-_ ]?)?(?:rscc|convention|meeting)|insider|roster|directory|contribution|invoice|agenda"
)
OTHER_PATHS = r"/(?:news/)?press/|/press-releases?/|/blog/categor|/news/[a-z0-9-]+/?$"
BINARY_TYPES = ("image/", "video/", "audio/", "font/", "application/zip", "application/octet-stream")
BINARY_STARTS = (b"\x89PNG", b"GIF8", b"\xff\xd8\xff", b"RIFF", b"\x00\x00\x01\x00", b"PK\x03\x04", b"\x1f\x8b", b"OggS", b"\x00\x00\x00 ftyp")
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ɵ": "ti", "ƞ": "tf", "Ʃ": "tt", "ƫ": "tti"}


def insensitive(pattern: str) -> str:
    return f"(?i){pattern}"


def found(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(insensitive(pattern)), F.lit(False))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_title(title: Column) -> Column:
    """Lower case without bill numbers, years, ordinals and punctuation; white space squeezed."""
    out = F.lower(F.coalesce(title, F.lit("")))
    for pattern in (BILL_NUMBER, YEAR, ORDINAL, r"[^a-z0-9 ]+"):
        out = F.regexp_replace(out, pattern, " ")
    return squeeze(out)


def significant_tokens(normalized: Column) -> Column:
    words = F.split(normalized, " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOP_WORDS) & ~w.rlike(r"^\d+$")))


def content_tokens(text: Column) -> Column:
    """Distinct words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{4,})"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def first_match(text: Column, rules: tuple[tuple[str, str], ...], default: str | None) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(found(text, pattern), name).otherwise(out)
    return out


def election_subtype(title: Column) -> Column:
    """The first subtype whose rule holds, of titles that the gate lets in; else null."""
    return F.when(found(title, ELECTION), first_match(title, ELECTION_SUBTYPES, "other_election"))


def normalize_tag(tag: Column) -> Column:
    """Without a trailing reference code such as (I0705), squeezed, lower case."""
    return F.lower(squeeze(F.regexp_replace(F.trim(tag), r"\s*\([A-Z]?\d+\)\s*$", "")))


def unanimous(tags: Column, mapping: dict[str, int]) -> Column:
    """What all mappable tags of a |-joined list agree on; null if none is mappable or two differ."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    codes = F.array_distinct(F.array_compact(F.transform(F.split(F.coalesce(tags, F.lit("")), r"\|"), lambda t: F.try_element_at(table, normalize_tag(t)))))
    return F.when(F.size(codes) == 1, codes[0])


def normalize_party(label: Column) -> Column:
    """D, R or other; a ticket of several parties goes to the one major party on it."""
    table = F.create_map(*[F.lit(x) for pair in PARTY_NAMES.items() for x in pair])
    clean = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    majors = F.array_distinct(F.array_compact(F.transform(F.split(clean, "/"), lambda p: F.try_element_at(table, F.trim(p)))))
    return F.when(F.size(majors) == 1, majors[0]).otherwise("other")


def looks_like_prose(text: Column) -> Column:
    """Twelve words or more, few digits, no spaced capitals, two fifths of the words in lower case."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    lower = F.filter(words, lambda w: w.rlike(r"^\p{Ll}"))
    return F.coalesce((F.size(words) >= 12) & (digits / F.nullif(F.length(text), F.lit(0)) <= 0.08) & ~text.rlike(SPACED_CAPITALS) & (F.size(lower) / F.nullif(F.size(words), F.lit(0)) >= 0.4), F.lit(False))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def document_type(url: Column, text: Column) -> Column:
    hay = F.lower(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, 4000)))
    return first_match(hay, DOCUMENT_TYPES, "platform")


def count_matches(text: Column, pattern: str | Column) -> Column:
    return F.regexp_count(text, F.lit(insensitive(pattern)) if isinstance(pattern, str) else pattern)


def confirm_document(text: Column, name: Column | None = None, rivals: list[str] | None = None, least: int = 2500) -> Column:
    """struct(confirmed, reason, hits): whether a text is its own organisation's platform.

    The first rule that fails gives the reason. Names are compared as given: fold accents before (fold_name).
    """
    body = F.coalesce(text, F.lit(""))
    spaces = F.length(F.regexp_replace(body, r"[^ ]", "")) / F.nullif(F.length(body), F.lit(0))
    hits = F.greatest(count_matches(body, DECLARATIVE), F.when(spaces < 0.08, F.regexp_count(F.regexp_replace(F.lower(body), r"[^0-9a-z]+", ""), F.lit(DESPACED))).otherwise(F.lit(0)))
    markers = F.size(F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(f"({OTHER_DOCUMENTS})"), F.lit(1))))
    reason = F.when(body == "", "no text").when(F.length(body) < least, "too short").when(hits < 3, "lacks platform language").when(markers >= 2, "another class of document")
    if name is not None:
        own = F.regexp_count(body, F.concat(F.lit(r"(?i)\b\Q"), name, F.lit(r"\E\b")))
        letters = F.regexp_replace(F.lower(name), r"[^a-z]", "")
        apart = F.regexp_count(F.regexp_replace(F.lower(body), r"[^0-9a-z]+", ""), letters)
        own = F.when((own == 0) & (spaces < 0.08) & (letters != ""), apart).otherwise(own)
        reason = reason.when((own < 2) & (count_matches(body, NATIONAL) >= 2), "national platform").when(own == 0, "never names its state")
        for r in rivals or ():
            apart = ~F.contains(F.lit(r), name) & ~F.contains(name, F.lit(r))
            reason = reason.when(apart & (F.regexp_count(body, F.lit(rf"(?i)\b\Q{r}\E\b")) > own), "names another state more")
    return F.struct(reason.isNull().alias("confirmed"), F.coalesce(reason, F.lit("ok")).alias("reason"), F.when(body == "", 0).otherwise(hits).alias("hits"))


def repair_ligatures(text: Column) -> Column:
    for glyph, letters in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(letters))
    return F.regexp_replace(text, r"[\uF000-\uF8FF]", " ")


def html_text(page: Column) -> Column:
    """Text of a page whose blocks were stripped (strip_blocks): tags out, common references decoded, squeezed."""
    out = F.regexp_replace(page, r"<[^>]+>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"&nbsp;?", " "), r"&amp;", "&")
    return repair_ligatures(F.trim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[ \t]+", " ")))


def other_class(url: Column) -> Column:
    """The class of document that a URL's file name, or else its path, says it is; null for none."""
    path = F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit("+"), F.lit("%2B"))), F.lit(""))
    name = F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)\z", 1), f"(?i)({OTHER_NAMES})", 1))
    return F.when(name != "", name).when(path.rlike(f"(?i)(?:{OTHER_PATHS})"), "press release or index page")


def response_kind(body: Column, content_type: Column, url: Column) -> Column:
    """pdf, binary or text, by the declared type, the address, the first bytes and the share of zeros among 2,048."""
    declared = F.trim(F.split_part(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(";"), F.lit(1)))
    pdf = declared.startswith("application/pdf") | F.split_part(F.lower(url), F.lit("?"), F.lit(1)).endswith(".pdf") | (F.substring(body, 1, 5) == F.lit(b"%PDF-"))
    binary = F.lit(False)
    for start in BINARY_TYPES:
        binary = binary | declared.startswith(start)
    for start in BINARY_STARTS:
        binary = binary | (F.substring(body, 1, len(start)) == F.lit(start))
    head = F.substring(body, 1, 2048)
    zeros = F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\x00]", ""))
    return F.when(pdf, "pdf").when(F.coalesce(binary | (zeros > 0.05 * F.length(head)), F.lit(False)), "binary").otherwise("text")


def response_text(body: Column, content_type: Column, url: Column, decode, strip_blocks) -> Column:
    """Text of an HTML response; empty for binary bodies and for PDF, whose text another reader extracts."""
    return F.when(response_kind(body, content_type, url) == "text", html_text(strip_blocks(decode(body)))).otherwise("")


def visible(text: Column) -> Column:
    return F.lower(text)


def best_copy(text: str, key: str) -> list[Column]:
    """Aggregates: key and length of the longest text, the first key of equal ones; a null text is the shortest."""
    best = F.min(F.struct((-F.coalesce(F.length(text), F.lit(-1))).alias("o"), F.col(key).alias("key")))
    return [best["key"].alias(f"best_{key}"), F.max(F.length(text)).alias("best_chars")]


def clean_text(text: Column) -> Column:
    """Without URLs, squeezed, lower case; 'x-tech' spelled out. Decode references before (unescape_col): left ones go."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\b([a-z]+)-tech\b", "$1 technology")
    return F.lower(squeeze(F.regexp_replace(F.regexp_replace(out, r"https?://\S+|www\.\S+", " "), r"&[a-zA-Z]+;", " ")))


def try_int(text: Column) -> Column:
    return text.try_cast("int")


def leading_year(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}"), F.substring(text, 1, 4).cast("int"))


def state_code(jurisdiction: Column, codes: list[str]) -> Column:
    """The upper-case code of state:xx in an id, null outside the list."""
    code = F.upper(F.regexp_extract(jurisdiction, r"/state:([a-z]{2})/", 1))
    return F.when(code.isin(*codes), code)


def procedural_shell(title: Column, state: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.coalesce(((state == "IL") & F.upper(t).endswith("-TECH")) | ((state == "NM") & t.rlike(r"(?i)^PUBLIC,?\s+PEACE,\s+HEALTH,\s+SAFETY\s+&\s+WELFARE$")), F.lit(False))


def fingerprint(text: Column) -> Column:
    return F.sha2(F.lower(squeeze(F.coalesce(text, F.lit("")))), 256)
