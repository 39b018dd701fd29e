"""Statements that a document is made of, as Spark expressions.

Patterns do the packing: a greedy match of bounded length that must end where a sentence does is the longest run of
whole sentences that fits, and a lazy match with a floor is the shortest run of lines that is long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import looks_like_prose, squeeze, word_count

# Characters of the shortest and longest statement, and of lines that are put together; openings that
# are no statement.
LEAST, MOST, WRAPPED = 120, 1500, 400
BOILERPLATE = r"(?i)^\s*(?:table of contents|contents|index|preamble|adopted|approved|page \d+|copyright|all rights reserved|paid for by)\b"

#: The break between lines with a blank one between them, a single character like any other line's end.
GAP = "\u2029"
#: As many whole sentences as fit, or one that is too long by itself.
SENTENCES = rf"(?s)\S(?:.{{0,{MOST - 1}}}(?:(?<=[.!?])(?=\s)|\z)|.*?(?:(?<=[.!?])(?=\s)|\z))"
#: Lines up to a gap, or once they are long enough to a line that ends a sentence, or thrice that to any line.
LINES = (
    rf"(?s)[^\s{GAP}](?:.{{{LEAST - 1},{WRAPPED - 2}}}?(?={GAP})|.{{{WRAPPED - 1},{3 * WRAPPED - 2}}}?(?:(?={GAP})|(?<=[.!?:;])(?=\n))"
    rf"|.{{{3 * WRAPPED - 1},}}?(?=[\n{GAP}])|.*)"
)


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\s*\n")


def joined_lines(text: Column) -> Column:
    """Blocks of hard-wrapped lines."""
    stripped = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""), r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return F.regexp_extract_all(F.regexp_replace(stripped, r"\n(?:\n)+", GAP), F.lit(LINES), F.lit(0))


def statements(blocks: Column) -> Column:
    """Prose of the blocks in order: without opening boilerplate, long blocks cut at ends of sentences."""
    plain = F.transform(blocks, squeeze)
    opened = F.transform(plain, lambda b: F.when(b.rlike(BOILERPLATE), F.regexp_replace(b, BOILERPLATE + r"[ :.\-—]*", "")).otherwise(b))
    cut = F.transform(F.filter(opened, lambda b: F.length(b) >= LEAST), lambda b: F.when(F.length(b) <= MOST, F.array(b)).otherwise(F.regexp_extract_all(b, F.lit(SENTENCES), F.lit(0))))
    return F.filter(F.flatten(cut), lambda s: (F.length(s) >= LEAST) & looks_like_prose(s))


def with_statements(docs: DataFrame, text_col: str, name: str = "statements") -> DataFrame:
    """The rows with an array of their statements: those of the paragraphs, or of joined lines where a text of more than
    500 words has fewer than one paragraph's in 500 and joining finds more. A null or empty text has none."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.withColumn(name, statements(paragraphs(text)))
    few = (word_count(text) > 500) & (F.size(name) * 500 < word_count(text))
    again = out.withColumn(f"{name}_again", F.when(few, statements(joined_lines(text))))
    chosen = F.when(F.size(f"{name}_again") > F.size(name), F.col(f"{name}_again")).otherwise(F.col(name))
    return again.withColumn(name, chosen).drop(f"{name}_again")
