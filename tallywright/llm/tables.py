"""Reading the tables and the columns that operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only these columns under these names, whatever else the table holds."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in wanted.items()])


def free(name: str, *tables: DataFrame) -> str:
    """A column name like this one that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(df: DataFrame, column: str, wanted) -> DataFrame:
    """The rows, as they are and with all their columns, that ``wanted`` says True of; it gets lists of ``column``."""
    at = df.columns.index(column)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                yield part.filter(pa.array(wanted(part.column(at).to_pylist()), pa.bool_()))

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def map_rows(df: DataFrame, fn, schema: str, most: int = 1024) -> DataFrame:
    """``fn`` gets at most so many rows of an Arrow batch as a dict of lists and yields dicts of lists for ``schema``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for cols in (c for batch in batches for first in range(0, batch.num_rows, most) for c in fn(batch.slice(first, most).to_pydict())):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
