"""Rules on URLs as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms and patterns that the rules score.
TERMS = r"platform|principles|resolutions|priorities|manifesto|creed|planks"
EXCLUDED = (
    r"cdn-cgi|/wp-json/|oembed|/feed/?$|/embed/?$|/amp/?$|/tag/|/category/|/author/|/page/\d+|\?(?:replytocom|share|utm_)|/comment|/trackback"
    r"|\.(?:css|js|jpe?g|png|gif|svg|woff2?|ico|xml)(?:$|\?)|/_api/|wix-laboratory|\.json(?:$|\?)|/[0-9a-f]{6}_[0-9a-f]{12,}|-Icons-|/-Social-|/-Sitemap-"
    r"|/-?[\d.]+(?:em|px|rem|vh|vw|%)(?:$|/)|/\d+K?/(?:month|year)|/robots\.txt|/sitemap|/favicon|(?:/\d+K){2,}"
)
DOCUMENT_WORD = r"(?:platform|platforms|principles|resolutions|planks|creed|manifesto)"
STRONG_SEGMENT = rf"^(?:\d{{4}}[-_]?)?(?:party[-_])?{DOCUMENT_WORD}(?:[-_]?\d{{4}})?$"
NAME_SUFFIX = rf"(?:^|[-_]){DOCUMENT_WORD}$"
YEAR = r"(?:^|[^\d])(19[89]\d|20[0-4]\d)(?:[^\d]|$)"
PRIORITIES = r"legislative[-_ ]?priorities|policy[-_ ]?agenda"


def _rest(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(_rest(url), r"^//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^(?://[^/?#]*)?([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def normalize_url(url: Column) -> Column:
    """host and path in lower case, without www., archive., index.html and trailing slashes."""
    p = F.regexp_replace(F.regexp_replace(path(url), r"(?i)/index\.html?$", "/"), r"/+$", "")
    return F.concat(F.regexp_replace(host(url), r"^(?:www\.|archive\.)", ""), F.lower(p))


def is_excluded(url: Column) -> Column:
    s = segments(url)
    return F.coalesce(url.rlike(f"(?i){EXCLUDED}") | (F.size(s) != F.size(F.array_distinct(s))) | ((F.size(s) > 0) & F.coalesce(F.try_element_at(s, F.lit(-1)).rlike(r"^-?\d+(?:\.\d+)?$"), F.lit(False))), F.lit(False))


def score(url: Column, mime: Column | None = None) -> Column:
    """struct(score, reasons): how likely the URL is the document itself."""
    mime = F.lower(F.coalesce(mime if mime is not None else F.lit(None).cast("string"), F.lit("")))
    s = segments(url)
    last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))
    stem = F.regexp_replace(last, r"(?i)\.(?:pdf|docx?|html?)$", "")
    pdf = mime == "application/pdf"
    document = pdf | (stem != last)
    download = pdf | last.rlike(r"(?i)\.(?:pdf|docx?)$")
    segment = F.exists(s, lambda x: x.rlike(f"(?i){STRONG_SEGMENT}"))
    suffix = ~segment & stem.rlike(f"(?i){NAME_SUFFIX}")
    priorities = url.rlike(f"(?i){PRIORITIES}")
    strong = segment | suffix | priorities
    term = url.rlike(f"(?i){TERMS}")
    hyphens = F.length(F.regexp_replace(stem, r"[^-_]", ""))
    slug = ~strong & ~download
    rules = [
        (segment, 5, "path segment is the document type"), (suffix, 5, "name ends with the document type"), (priorities, 4, "legislative priorities document"),
        (document & stem.rlike(f"(?i){TERMS}"), 3, "document filename matches a term"), (url.rlike(YEAR) & term, 2, "year appears alongside a term"),
        (slug & (hyphens >= 5), -4, "slug reads like a headline"), (slug & (hyphens >= 3) & (hyphens < 5), -2, "long slug"),
        (url.rlike(r"/20\d\d/\d\d/") & ~document, -3, "under a dated archive path"), (~term, -5, "no term in URL"),
    ]
    total = sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n, _ in rules), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, _, t in rules]))
    empty = F.size(s) == 0
    return F.struct(F.when(empty, 0).otherwise(total).alias("score"), F.when(empty, F.array(F.lit("no path"))).otherwise(reasons).alias("reasons"))


def year_hint(url: Column, timestamp: Column) -> Column:
    """The year in the URL, else that of the capture."""
    y = F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), YEAR, 1), F.lit(""))
    return F.coalesce(y, F.when(timestamp.rlike(r"^\d{4}"), F.substring(timestamp, 1, 4))).cast("int")


def registrable_domain(url: Column) -> Column:
    h = F.lower(F.split_part(F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://", ""), F.lit("/"), F.lit(1)))
    h = F.split_part(h, F.lit(":"), F.lit(1))
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(h)


def variants(url: Column) -> Column:
    """The URL, then its host over https with and without www., then over http; equal requests once."""
    h = F.split_part(F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"/+$", ""), F.lit("/"), F.lit(1))
    bare = F.regexp_replace(h, r"^www\.", "")
    all_ = F.array(url, F.concat(F.lit("https://"), h), F.concat(F.lit("https://"), bare), F.concat(F.lit("http://"), bare))
    keys = F.transform(all_, lambda u: F.regexp_replace(u, r"/+$", ""))
    return F.filter(all_, lambda u, i: F.array_position(keys, F.regexp_replace(u, r"/+$", "")) == i + 1)
