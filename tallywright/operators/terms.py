"""Distinctive terms: TF-IDF within documents and concentration against peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.kernels import unescape_col

TOKEN = r"\b([a-z][a-z'-]{2,})\b"


def ngrams(docs: DataFrame, stop_words: list[str], keep: list[str]) -> DataFrame:
    """keep, term, n: unigrams and bigrams of each document, bigrams bridging stop words. docs: keep, text."""
    stops = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    words = F.filter(F.regexp_extract_all(T.clean_text(unescape_col(F.col("text"))), F.lit(TOKEN), F.lit(1)), lambda w: ~F.array_contains(stops, w))
    d = docs.select(*keep, words.alias("w")).withColumn("b", F.zip_with(F.slice(F.col("w"), 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice(F.col("w"), 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y)))
    return d.select(*keep, F.explode(F.concat("w", "b")).alias("term")).groupBy(*keep, "term").agg(F.count("*").alias("n"))


def distinctive(docs: DataFrame, stop_words: list[str], least: int, top: int = 12, features: int = 30_000, barred: list[str] | None = None) -> DataFrame:
    """The top terms of each document by TF-IDF (sublinear, smoothed, normalised) and by log2 concentration.

    docs: unit, grp, evidence, text; peers share grp and evidence. Terms in one document or in over 95% of them
    are no features, and the ``features`` most frequent of the rest are. A term without a peer's use has no
    concentration (peer_absent). Terms that hold a ``barred`` word aren't reported.
    """
    doc = ["unit", "grp", "evidence"]
    n = ngrams(docs, stop_words, doc)
    docs_n = docs.agg(F.count("*").alias("docs_n"))
    vocab = n.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).crossJoin(F.broadcast(docs_n)).filter("df >= 2 AND df <= 0.95 * docs_n")
    vocab = vocab.orderBy(F.desc("total"), "term").limit(features).select("term", "df", "docs_n")
    w = (1 + F.log("n")) * (F.log((1 + F.col("docs_n")) / (1 + F.col("df"))) + 1)
    t = n.join(vocab, "term").withColumn("w", w)
    by_doc, by_peer = Window.partitionBy(*doc), Window.partitionBy("grp", "evidence")
    t = t.withColumns({"tfidf": F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_doc)), "feature_total": F.sum("n").over(by_doc)})
    t = t.withColumns({"peer_n": F.sum("n").over(Window.partitionBy("grp", "evidence", "term")) - F.col("n"), "peer_feature_total": F.sum("n").over(by_peer) - F.col("feature_total")})
    rates = (F.col("n") / F.col("feature_total")) / (F.col("peer_n") / F.nullif(F.col("peer_feature_total"), F.lit(0)))
    t = t.filter("peer_feature_total > 0").withColumns({"peer_absent": F.col("peer_n") == 0, "log2_concentration": F.when(F.col("peer_n") > 0, F.log2(rates))})
    bad = F.arrays_overlap(F.split("term", " "), F.array(*map(F.lit, barred))) if barred else F.lit(False)
    t = t.filter((F.col("n") >= least) & (F.col("peer_absent") | (F.col("log2_concentration") > 0)) & ~bad)
    t = t.withColumns({
        "tfidf_rank": F.row_number().over(by_doc.orderBy(F.desc(F.round("tfidf", 9)), "term")),
        "concentration_rank": F.when(~F.col("peer_absent"), F.row_number().over(Window.partitionBy(*doc, "peer_absent").orderBy(F.desc(F.round("log2_concentration", 9)), "term"))),
    })
    return t.filter((F.col("tfidf_rank") <= top) | F.coalesce(F.col("concentration_rank") <= top, F.lit(False))).select(
        *doc, "term", "n", "peer_n", "feature_total", "peer_feature_total", "tfidf", "log2_concentration", "peer_absent", "tfidf_rank", "concentration_rank")


def highlights(terms: DataFrame, top: int = 6) -> DataFrame:
    """One line a document: its top TF-IDF terms by score, each with its concentration."""
    t = terms.filter(F.col("tfidf_rank") <= top)
    t = t.withColumn("score", F.col("tfidf") * F.when(F.col("peer_absent"), 1.0).otherwise(F.least(F.greatest(F.coalesce("log2_concentration", F.lit(0.0)), F.lit(0.0)), F.lit(8.0))))
    text = F.when(F.col("peer_absent"), F.concat("term", F.lit(" (absent in peers)"))).otherwise(F.concat("term", F.lit(" ("), F.format_string("%+.1f", "log2_concentration"), F.lit(" log2)")))
    rows = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("o"), "term", text.alias("text"))))
    return t.groupBy("unit", "grp", "evidence").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "; ").alias("distinctive_terms"))
