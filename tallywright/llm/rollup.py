"""Token totals maintained by deltas.

A batch holds signed changes: an insert adds a document's counts, a delete takes them away, and a revision
does both for the old and the new state. Only the batch is read; its deltas, summed by source, language and
tokenizer version, are added to the totals. Batches commit by a rename, which fails if its target exists, of a
complete version that holds the totals and the ids of all batches in them: a batch that is sent again, or whose
writer died, changes nothing, and of writers at once none is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import Scratch

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def word_tokens(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def piece_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other character but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[0-9A-Za-z]+|[^\x20\x09-\x0D0-9A-Za-z]")), F.lit(0)).cast("long")


def byte_tokens(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bpe_tokens(path: str) -> Callable[[Column], Column]:
    """Counts by a public byte-level BPE in the tokenizers library's JSON format, read on each executor."""

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for texts in batches:
            filled = texts.fillna("").tolist()
            n = [len(e.ids) for s in range(0, len(filled), 256) for e in t.encode_batch(filled[s : s + 256], add_special_tokens=False)]
            yield pd.Series(n, dtype="int64")

    return F.pandas_udf(counted, "long", F.PandasUDFType.SCALAR_ITER)


def tally(docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]], *, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and tokenizer version: ``keep`` columns, source, lang, tokenizer, tokens.

    A null or empty text has no tokens.
    """
    text = F.col(f"`{text_col}`")
    wide = docs.select(*[f"`{k}`" for k in keep], F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"), *[f(text).alias(f"n_{i}") for i, f in enumerate(tokenizers.values())])
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"n_{i}").alias("tokens")) for i, name in enumerate(tokenizers)])
    return wide.select(*keep, "source", "lang", F.inline(each))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """The changes of inserting (1) or deleting (-1) counted documents."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col("tokens")).cast("long").alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes of documents whose counts, or whose source or language, go from old to new."""
    return signed(old, -1).unionByName(signed(new, 1))


class TokenLedger:
    """Totals by source, language and tokenizer version in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("."))]
        return max([int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()], default=0)

    def totals(self, v: int | None = None) -> DataFrame:
        v = self.version() if v is None else v
        return self.spark.read.schema(TOTALS).parquet(f"{self.root}/v{v}/totals") if v else self.spark.createDataFrame([], TOTALS)

    def batches(self, v: int | None = None) -> DataFrame:
        v = self.version() if v is None else v
        kind = "batch string, version int"
        return self.spark.read.schema(kind).parquet(f"{self.root}/v{v}/batches") if v else self.spark.createDataFrame([], kind)

    def history(self) -> DataFrame:
        """The totals as each batch left them: version, its batch, and the totals' columns."""
        out = self.spark.createDataFrame([], f"version int, batch string, {TOTALS}")
        for v in range(1, self.version() + 1):
            totals = self.spark.read.schema(TOTALS).parquet(f"{self.root}/v{v}/totals")
            last = self.spark.read.schema("batch string, version int").parquet(f"{self.root}/v{v}/batches").filter(F.col("version") == v)
            out = out.unionByName(totals.crossJoin(F.broadcast(last)))  # one row
        return out

    def commit(self, batch: str, changes: DataFrame, tries: int = 5) -> bool:
        """Add a batch of signed changes; False, and no change, if the batch is in the totals already.

        Groups whose documents are all gone leave the totals. A null source or language is a group of its own. Of
        writers that commit at once one wins; the others start again from what it left.
        """
        deltas = changes.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        deltas = Scratch(self.spark, "deltas").write(deltas, batch)
        for _ in range(tries):
            v = self.version()
            before = self.totals(v)
            known = self.batches(v)
            if known.filter(F.col("batch") == batch).limit(1).count():
                return False
            held = f"_pending-{uuid.uuid4().hex}"
            totals = before.unionByName(deltas).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            totals.filter("n_docs <> 0 OR n_tokens <> 0").coalesce(1).write.parquet(f"{self.root}/{held}/totals")
            known.unionByName(self.spark.createDataFrame([(batch, v + 1)], "batch string, version int")).coalesce(1).write.parquet(f"{self.root}/{held}/batches")
            if self._publish(held, f"v{v + 1}"):
                return True
        raise RuntimeError(f"batch {batch}: {tries} times another writer was first")

    def _publish(self, held: str, name: str) -> bool:
        """Rename a complete version; False, and the folder gone, where that version exists."""
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        refuse = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self.fs.makeQualified(self._path(held)), self.fs.makeQualified(self._path(name)), refuse)
        except Exception:
            if not self.fs.exists(self._path(name)):
                raise
            self.fs.delete(self._path(held), True)
            return False
        return True


def maintain(docs: DataFrame, ledger: TokenLedger) -> DataFrame:
    """The corpus' life in three batches: load, retire repeated texts, move to the next tokenizer version; the totals
    that each of them left, as ``TokenLedger.history`` gives them.

    Repeated texts (all but the row of the smallest id for each text; null texts count as repeats of each other, and
    of rows with the same id any one stays) are deleted; what stays is revised from tokenizer words-1 to words-2. The
    second batch is sent twice. A null or empty text has no tokens, a very long one counts whole. An empty table
    leaves empty totals. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "rollup")
    kinds = {"words-1": word_tokens, "words-2": piece_tokens, "bytes-1": byte_tokens}
    text = F.col("text")
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("digest"), *[f(text).alias(k) for k, f in kinds.items()])
    rows = scratch.write(slim.withColumn("row", F.monotonically_increasing_id()), "rows")
    first = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
    rows = scratch.write(rows.join(first, "row", "left").withColumn("stays", F.coalesce("stays", F.lit(False))), "marked")

    def of(part: DataFrame, *versions: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"`{v}`").alias("tokens")) for v in versions])
        return part.select("source", "lang", F.inline(each))

    gone = signed(of(rows.filter("NOT stays"), "words-1", "bytes-1"), -1)
    ledger.commit("load", signed(of(rows, "words-1", "bytes-1"), 1))
    ledger.commit("retire-copies", gone)
    ledger.commit("retire-copies", gone)
    kept = rows.filter("stays")
    old, new = of(kept, "words-1"), of(kept, "words-2")
    ledger.commit("words-2", revised(old, new))
    return ledger.history()


def op9_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Token totals of all documents after load, after retirement of copies and after a tokenizer change."""
    ledger = TokenLedger(spark, Scratch(spark, "ledger").root)
    return maintain(spark.read.parquet(f"{sf_dir}/documents.parquet"), ledger)


SQL = r"""
WITH ranked AS (SELECT source, lang, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS w1,
  CAST(coalesce(len(regexp_extract_all(text, '[0-9A-Za-z]+|[^\x20\x09-\x0D0-9A-Za-z]')), 0) AS BIGINT) AS w2, CAST(coalesce(strlen(text), 0) AS BIGINT) AS b FROM documents),
kinds AS (
  SELECT 1 AS version, 'load' AS batch, source, lang, 'words-1' AS tokenizer, w1 AS n FROM ranked UNION ALL SELECT 1, 'load', source, lang, 'bytes-1', b FROM ranked
  UNION ALL SELECT 2, 'retire-copies', source, lang, 'words-1', w1 FROM ranked WHERE r = 1 UNION ALL SELECT 2, 'retire-copies', source, lang, 'bytes-1', b FROM ranked WHERE r = 1
  UNION ALL SELECT 3, 'words-2', source, lang, 'words-2', w2 FROM ranked WHERE r = 1 UNION ALL SELECT 3, 'words-2', source, lang, 'bytes-1', b FROM ranked WHERE r = 1)
SELECT CAST(version AS INT) AS version, batch, source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM kinds GROUP BY ALL
"""
