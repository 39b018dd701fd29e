"""Sources: database dumps in text form, archives, logs and tables of settings."""

from __future__ import annotations

import io
import re
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Only the columns and rows asked for are read."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def sizes(df: DataFrame, name: str) -> DataFrame:
    """name, n_rows and n_columns; the count reads no column, so Parquet answers it from its footers."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A line that isn't JSON of the schema fails the read."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def json_rows(body: Column, names: list[str]) -> Column:
    """Rows of a JSON array of arrays whose first row is a header, as an array of structs."""
    rows = F.from_json(body, "array<array<string>>")
    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.struct(*[F.try_element_at(r, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]))


def settings(spark: SparkSession, path: str, list_key: str, schema: str, unique: str | None = None) -> DataFrame:
    """A small table out of a YAML file's list; a repeated ``unique`` key is an error."""
    import yaml

    rows = (yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {}).get(list_key) or []
    if unique and len({r[unique] for r in rows}) < len(rows):
        raise ValueError(f"{path}: repeated {unique}")
    names = [f.split()[0] for f in re.split(r",\s*(?![^<]*>)", schema)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def copy_rows(lines: DataFrame, table_columns: list[str]) -> DataFrame:
    """Rows of one table's COPY section: value holds a section's lines. Lines of another width are skipped;
    \\N is null and escapes are decoded, so a literal backslash before an N stays one."""
    parts = F.split("value", "\t", -1)
    slash = "\uE000"
    clean = F.transform(parts, lambda p: F.when(p != r"\N", _unescape(p, slash)))
    rows = lines.filter(F.size(parts) == len(table_columns)).select(clean.alias("v"))
    return rows.select(*[F.col("v")[i].alias(c) for i, c in enumerate(table_columns)])


def _unescape(p: Column, mark: str) -> Column:
    out = F.replace(p, F.lit("\\\\"), F.lit(mark))
    for code, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def copy_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every COPY section of text dumps as a table, by name; sections of one name are one table.

    A dump of any size is read in splits. A line's place is its split's start and its number in the split; only the
    lines that open or end a section come to the driver, a few for each table, and tell which places a section
    spans. What looks like an opening inside a section is one of its rows.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", at.alias("at"))
    head = r"^COPY ([^ (]+)[^(]*\(([^)]*)\) FROM stdin;$"
    sections: dict[tuple, list] = {}
    start = None
    for r in sorted(lines.filter(F.col("value").rlike(head) | (F.col("value") == "\\.")).collect(), key=lambda r: tuple(r["at"])):
        place = tuple(r["at"])
        if start and start[1][0] != place[0]:
            start = None
        if r.value == "\\." and start:
            sections.setdefault(start[0], []).append((start[1], place))
            start = None
        elif r.value != "\\." and start is None:
            m = re.match(head, r.value)
            start = (m[1], tuple(c.strip().strip('"') for c in m[2].split(","))), place
    spot = lambda p: F.struct(F.lit(p[0]).alias("file"), F.lit(p[1]).cast("long").alias("start"), F.lit(p[2]).cast("long").alias("line"))
    out = {}
    for (name, names), spans in sections.items():
        inside = reduce(lambda x, y: x | y, [(F.col("at") > spot(a)) & (F.col("at") < spot(b)) for a, b in spans])
        part = copy_rows(lines.filter(inside), list(names))
        out[name] = out[name].unionByName(part) if name in out else part
    return out


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, sha256 and content of the payload files in archives; sidecars and folders are skipped."""

    def members(batches):
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        name = info.filename.rsplit("/", 1)[-1]
                        if not info.is_dir() and not info.filename.startswith("__MACOSX/") and not name.startswith("._") and name != ".DS_Store":
                            yield pd.DataFrame({"archive": [archive], "member": [info.filename], "content": [z.read(info)]})

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, content binary")
    return out.withColumn("sha256", F.sha2("content", 256))


def parse_filename(name: Column) -> Column:
    """struct(state, year, party, flags) of STATE-YEAR-PARTY[-FLAG]*.ext; a name that doesn't fit is an error."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    pattern = r"^([A-Z]{2})-(\d{4})-(.+)$"
    rest = F.split(F.regexp_extract(stem, pattern, 3), "-")
    ok = stem.rlike(pattern) & (F.trim(rest[0]) != "")
    parsed = F.struct(F.regexp_extract(stem, pattern, 1).alias("state"), F.regexp_extract(stem, pattern, 2).cast("int").alias("year"), F.trim(rest[0]).alias("party"), F.filter(F.transform(F.slice(rest, 2, F.size(rest)), lambda f: F.trim(f)), lambda f: f != "").alias("flags"))
    return F.when(ok, parsed).otherwise(F.raise_error(F.concat(F.lit("unparseable filename: "), name)).cast("struct<state:string,year:int,party:string,flags:array<string>>"))
