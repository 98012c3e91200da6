"""Readers and sinks of the layers: tolerant files, report headers, paged services, load semantics."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siembra.functions.text import ACCENTED, PLAIN


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """A delimited file with a given schema; lines that don't fit it are dropped."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, encoding=encoding, mode="DROPMALFORMED")


def read_optional(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A CSV file, or an empty table of that schema if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).csv(path, header=True, **options) if there else spark.createDataFrame([], schema)


def normal_header(name: str) -> str:
    plain = name.translate(str.maketrans(ACCENTED, PLAIN)).lower()
    return "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())


def rename_headers(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Normalised column names through an alias table; of columns with one name the first stays."""
    chosen: dict[str, str] = {}
    for c in df.columns:
        key = normal_header(c)
        chosen.setdefault((aliases or {}).get(key, key), c)
    return df.select(*(F.col(f"`{c}`").alias(name) for name, c in chosen.items()))


def read_report(spark: SparkSession, path: str, marker: str, sep: str = ";", head: int = 50) -> DataFrame:
    """A report with a preamble: the header is the first of ``head`` lines that holds ``marker``.

    Total lines and repeated headers go; all columns are text. Only the first lines come to the driver.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    top = [r["line"] for r in lines.limit(head).collect()]
    at = next((k for k, line in enumerate(top) if marker.lower() in line.lower()), None)
    if at is None:
        raise ValueError(f"{path}: no header with {marker} in the first {head} lines")
    header = top[at]
    names = [n.strip() for n in header.split(sep)]
    parts = F.split("line", sep)
    rows = lines.where((F.size(parts) == len(names)) & ~F.col("line").isin(*top[: at + 1]) & ~F.lower("line").startswith("total"))
    return rows.select(*(F.nullif(F.trim(parts[k]), F.lit("")).alias(n) for k, n in enumerate(names)))


def explode_json(df: DataFrame, column: str, keys: Sequence[str], required: str) -> DataFrame:
    """Keys of a JSON text column (also one that is encoded twice); blank is null, rows without ``required`` go."""
    once = F.when(F.col(column).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), F.col(column), F.lit("}")), "v string")["v"]).otherwise(F.col(column))
    found = F.from_json(once, "map<string,string>")
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *(F.nullif(F.trim(found[k]), F.lit("")).alias(k) for k in keys)).where(F.col(required).isNotNull())


class PagedSource(DataSource):
    """``spark.read.format("paged")``: a JSON service that answers ``url?page=N&page_size=M`` with a list.

    Options: url, page_size (500), partitions (1: pages are dealt round robin). A partition ends
    with its first page that isn't full.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give the schema: spark.read.format('paged').schema(...)")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]) -> None:
        self.names, self.url = schema.names, options["url"]
        self.size, self.parts = int(options.get("page_size", 500)), int(options.get("partitions", 1))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.value + 1
        while True:
            with urlopen(f"{self.url}?{urlencode({'page': page, 'page_size': self.size})}", timeout=60) as answer:
                rows = json.load(answer)
            for row in rows:
                yield tuple(row.get(n) for n in self.names)
            if len(rows) < self.size:
                return
            page += self.parts


def overwrite(df: DataFrame, path: str, keep_if_empty: bool = True) -> bool:
    """Full refresh; an empty batch leaves the table as it is unless told otherwise."""
    if keep_if_empty and df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def replace_pipeline(df: DataFrame, path: str, column: str = "pipeline_id") -> None:
    """Replace the rows of the pipelines in ``df`` and no others (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def insert_absent(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows whose keys the target lacks; null keys are equal to null keys."""
    there = target.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return df.distinct().join(there, condition, "left_anti")


def dual_write(df: DataFrame, path: str) -> None:
    """CSV beside Parquet."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def log_run(spark: SparkSession, path: str, **facts: object) -> None:
    """One JSON line about a run."""
    spark.createDataFrame([(json.dumps(facts, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)
