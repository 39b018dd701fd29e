"""Sources and sinks on the driver's tables: what is written is read back and compared with the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..operators.scratch import Scratch
from ..sources import readers, writers
from .common import query, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def place(spark: SparkSession, name: str) -> str:
    return Scratch(spark, "files").path(name)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem WHERE l_quantity >= 40 GROUP BY ALL")
def pruned_scan(spark, d):
    """SRC1, SRC3: a scan of three columns with the filter at the file."""
    t = readers.parquet(spark, f"{d}/lineitem.parquet", ["l_returnflag", "l_linestatus", "l_quantity"], "l_quantity >= 40")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def one_partition(spark, d):
    """SRC2, SNK2: a table overwritten by partitions, of which one is read."""
    o, path = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), place(spark, "orders")
    writers.partitioned(o, path, "o_orderstatus")
    writers.partitioned(o.filter("o_orderstatus = 'F'"), path, "o_orderstatus")
    return readers.parquet(spark, path, ["o_orderkey", "o_custkey"], "o_orderstatus = 'F'")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns" for t in TABLES))
def table_sizes(spark, d):
    """SRC4: rows and columns of every table, rows from the files' footers."""
    every = [readers.sizes(table(spark, d, t), t) for t in TABLES]
    out = every[0]
    for t in every[1:]:
        out = out.unionByName(t)
    return out


@query("SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def csv_table(spark, d):
    """SRC5, SNK3: a CSV report and its reading."""
    path = place(spark, "customer")
    writers.csv_report(table(spark, d, "customer").withColumn("c_acctbal", F.round("c_acctbal", 2)), path)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_table(spark, d):
    """SRC7, SNK4: a report of JSON lines and its reading."""
    path = place(spark, "conversations")
    writers.json_report(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return readers.jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT 'none' AS what, 0::BIGINT AS n, (SELECT count(*) FROM (DESCRIBE part)) AS n_columns UNION ALL SELECT 'all', count(*), (SELECT count(*) FROM (DESCRIBE part)) FROM part")
def whole_tables(spark, d):
    """SNK1, SNK2: a table without rows keeps its schema, and an overwrite leaves nothing of what was there."""
    p, path, empty = table(spark, d, "part"), place(spark, "part"), place(spark, "empty")
    writers.overwrite(p.filter("p_partkey % 2 = 0"), path)
    writers.overwrite(p, path)
    writers.overwrite(p.limit(0), empty)
    return readers.sizes(spark.read.parquet(path), "all").unionByName(readers.sizes(spark.read.parquet(empty), "none")).select(F.col("name").alias("what"), F.col("n_rows").alias("n"), "n_columns")


@query("SELECT r_regionkey, r_name FROM region")
def yaml_table(spark, d):
    """SRC9: a list of a YAML file as a table."""
    path = place(spark, "yaml")
    lines = table(spark, d, "region").agg(F.concat(F.lit("regions:\n"), F.array_join(F.collect_list(F.format_string("  - {r_regionkey: %d, r_name: '%s'}", "r_regionkey", "r_name")), "\n")).alias("value"))
    lines.coalesce(1).write.text(path)
    return readers.settings(spark, f"{path}/part-*", "regions", "r_regionkey long, r_name string", "r_regionkey")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || chr(9) || 'a\\N' END AS note FROM customer")
def dump_table(spark, d):
    """SRC10, SRC11: one table of a dump in text form, among others; nulls, tabs and backslashes come back."""
    return readers.copy_tables(spark, write_dump(spark, d))["public.customer"].select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "note")


@query("SELECT 'public.customer' AS name, 3 AS n_columns, count(*) AS n_rows FROM customer UNION ALL SELECT 'public.nation', 2, count(*) FROM nation")
def dump_contents(spark, d):
    """SRC12: the tables of a dump."""
    t = readers.copy_tables(spark, write_dump(spark, d))
    out = [readers.sizes(v, k) for k, v in t.items()]
    return out[0].unionByName(out[1]).select("name", F.col("n_columns").cast("int").alias("n_columns"), "n_rows")


def write_dump(spark: SparkSession, d: str) -> str:
    path = place(spark, "dump")
    slash = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t"))
    c = table(spark, d, "customer")
    note = F.when(F.col("c_custkey") % 7 != 0, slash(F.concat("c_mktsegment", F.lit("\ta\\N")))).otherwise(F.lit("\\N"))
    rows = {"public.customer (c_custkey, c_name, note)": c.select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", note).alias("value")),
            "public.nation (n_nationkey, n_name)": table(spark, d, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("value"))}
    parts = []
    for i, (name, body) in enumerate(rows.items()):
        edge = lambda text, k: spark.range(1).select(F.lit(i).alias("section"), F.lit(k).alias("k"), F.lit(text).alias("value"))  # noqa: B023, E731
        parts += [edge(f"COPY {name} FROM stdin;", 0), body.select(F.lit(i).alias("section"), F.lit(1).alias("k"), "value"), edge("\\.", 2), edge("", 3)]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    lines.repartition(1).sortWithinPartitions("section", "k").select("value").write.text(path)
    return path


@query("SELECT n_nationkey, upper(substr(n_name, 1, 2)) AS state, CAST(2000 + n_nationkey AS INT) AS year, 'Democratic' AS party, CASE WHEN n_nationkey % 2 = 0 THEN ['draft', 'v2'] ELSE [] END AS flags FROM nation")
def file_names(spark, d):
    """SRC14: what a file's name says."""
    name = F.concat(F.upper(F.substring("n_name", 1, 2)), F.lit("-"), (F.lit(2000) + F.col("n_nationkey")).cast("string"), F.lit("-Democratic"), F.when(F.col("n_nationkey") % 2 == 0, "-draft- v2").otherwise(""), F.lit(".pdf"))
    return table(spark, d, "nation").select("n_nationkey", readers.parse_filename(name).alias("f")).select("n_nationkey", "f.state", "f.year", "f.party", "f.flags")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IS DISTINCT FROM 'P' AND o_orderkey % 3 <> 0 THEN 'settled' ELSE 'to fetch' END AS state FROM orders")
def resumed(spark, d):
    """SNK8: what of a run is settled, and what is to be fetched again or for the first time."""
    o = table(spark, d, "orders")
    done = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "fetch failed: timeout").otherwise("ok").alias("reason"))
    settled, missing = writers.to_retry(done, o.select("o_orderkey"), "o_orderkey")
    return settled.select("o_orderkey", F.lit("settled").alias("state")).unionByName(missing.select("o_orderkey", F.lit("to fetch").alias("state")))


@query(r"SELECT p_partkey, p_name || chr(10) || p_type || ' ' || p_brand AS text FROM part")
def rtf_text(spark, d):
    """SF31: prose of RTF sources."""
    p = table(spark, d, "part")
    source = F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}{\\*\\generator x}\\f0 "), "p_name", F.lit("\\par "), "p_type", F.lit("   "), "p_brand", F.lit("}"))
    return p.select("p_partkey", K.strip_rtf_col(source).alias("text"))


@query(r"SELECT doc_id, text FROM documents WHERE regexp_full_match(text, '[\x{00}-\x{7E}\x{A0}-\x{FF}]*')")
def decoded(spark, d):
    """SF32: texts from bytes of a single-byte encoding."""
    x = table(spark, d, "documents").filter(F.col("text").rlike(r"^[\x00-\x7E\xA0-\xFF]*\z"))
    return x.select("doc_id", K.decode_col(F.encode("text", "ISO-8859-1")).alias("text"))


@query("SELECT doc_id, strip_accents(translate(text, '‘’ʻʼ`´', '')) AS folded FROM documents")
def folded_names(spark, d):
    """SF19: texts without accents."""
    return table(spark, d, "documents").select("doc_id", K.fold_name_col("text").alias("folded"))


HEAD = "regexp_replace({x}, '(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}[^>]*>" for t in K.BLOCK_TAGS) + "', ' ', 'g')"
SHOWN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;?', ' ', 'g'), '&amp;', '&', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ')"""


@query("WITH t AS (SELECT page_id, CASE WHEN page_id % 10 IN (0, 1, 2) THEN '' ELSE " + SHOWN.replace("{x}", HEAD.format(x="html")) + " END AS text FROM pages WHERE html IS NOT NULL) SELECT page_id, text, lower(text) AS visible FROM t")
def response_text(spark, d):
    """SF16-SF18: text of responses; none of images, of bodies of zero bytes, or of PDF, which is left to its reader."""
    p = table(spark, d, "pages").filter("html IS NOT NULL")
    k = F.col("page_id") % 10
    body = F.when(k == 0, F.concat(F.lit(b"GIF89a"), F.encode("html", "UTF-8"))).when(k == 1, F.concat(F.unhex(F.repeat(F.lit("00"), 500)), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    kind = F.when(k == 2, "Application/PDF; x=1").otherwise("text/html; charset=utf-8")
    text = T.response_text(body, kind, F.lit("https://x.org/page"), K.decode_lenient_col, K.strip_blocks_col)
    return p.select("page_id", text.alias("text")).select("page_id", "text", T.visible(F.col("text")).alias("visible"))


def best(df: DataFrame) -> DataFrame:
    return df.groupBy("unit").agg(F.count("*").alias("n_copies"), *T.best_copy("text", "id"))


@query("""WITH r AS (SELECT source AS unit, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM documents)
SELECT unit, count(*) AS n_copies, max(doc_id) FILTER (k = 1) AS best_id, max(length(text)) AS best_chars FROM r GROUP BY unit""")
def best_copies(spark, d):
    """CL7: of all copies the longest, the first of equal ones."""
    return best(table(spark, d, "documents").select(F.col("source").alias("unit"), F.col("doc_id").alias("id"), "text"))
