"""Scans, sinks, registries and manifests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from scoreframe.functions import scalar as S
from scoreframe.operators.rules import rule_columns


def read_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header CSV with every column a string; blanks are "", a missing file is an empty table, lacking columns are ""."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    try:
        raw = spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def check_columns(df: DataFrame, table: str, required: Sequence[str]) -> DataFrame:
    return rule_columns(df, table, required)


def write_table(df: DataFrame, path: str, columns: Sequence[str], order_by: Sequence[str | Column], fmt: str = "csv") -> None:
    """The named columns in order, rows sorted over all files, extra columns dropped."""
    out = df.select(*columns).orderBy(*order_by)
    writer = out.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_bundle(nodes: DataFrame, path: str, node_type: str, mode: str = "public") -> DataFrame:
    """One JSON object per entity under path/nodes, a header with type, mode and record count under path/header; gives the header."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    header = nodes.agg(F.count("*").alias("record_count")).select(F.lit(node_type).alias("node_type"), F.lit(mode).alias("mode"), "record_count")
    header.write.mode("overwrite").json(f"{path}/header")
    return header


def reference_grid(spark: SparkSession, rows: Sequence[tuple] | DataFrame, labels: Sequence[str]) -> DataFrame:
    """rows: (row_band, acceptees[], applicants[], rates[]), one entry per label, as a list or a table; one row per cell."""
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(list(rows), "row_band string, acceptees array<int>, applicants array<int>, rates array<double>")
    cells = F.arrays_zip(F.array(*map(F.lit, labels)).alias("col_band"), "acceptees", "applicants", F.col("rates").alias("rate"))
    return df.select("row_band", F.explode(cells).alias("c")).select("row_band", F.col("c.col_band").alias("col_band"), "c.acceptees", "c.applicants", "c.rate")


def document_manifest(df: DataFrame, name: str, content: str) -> DataFrame:
    """One row per document: sha256, length, kind by its first bytes, and a note if it isn't what its name says."""
    c = F.col(content)
    kind = F.when(F.startswith(c, F.lit(b"%PDF")), "pdf").when(F.startswith(c, F.lit(b"PK")), "zip").when(F.lower(F.make_valid_utf8(F.substring(c, 1, 64).cast("string"))).rlike(r"^\s*<(!doctype|html)"), "html").otherwise("other")
    note = F.when(F.col(name).endswith(".pdf") & (kind != "pdf"), "body is not a PDF").otherwise("")
    return df.select(name, F.sha2(c, 256).alias("sha256"), F.length(c).alias("n_bytes"), kind.alias("kind"), note.alias("note"))


def scan_documents(spark: SparkSession, glob: str) -> DataFrame:
    """The manifest of files."""
    return document_manifest(spark.read.format("binaryFile").load(glob), "path", "content")


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, df in tables.items()])


def merge_registry(base: DataFrame, *additions: DataFrame, name: str = "source_name", url: str = "source_url", pos: str = "pos") -> DataFrame:
    """Base rows, then additions; the first row of a (name, url) wins, blank keys go."""
    tagged = [df.withColumn("_o", F.lit(i)) for i, df in enumerate((base, *additions))]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).filter(S.missing(F.col(name)).isNotNull())
    w = Window.partitionBy(name, url).orderBy("_o", pos)
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_o")


def methodology_table(weights: DataFrame, constants: Sequence[tuple[str, str, str]], bands: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """(area, item, value) rows from constants, bands and the weight table (group, component, weight)."""
    spark = weights.sparkSession
    schema = "area string, item string, value string"
    fixed = spark.createDataFrame(list(constants), schema)
    show = lambda x: "" if x is None else f"{x:g}"
    banded = spark.createDataFrame([("band", label, f"{show(a)}..{show(b)}") for label, a, b in bands], schema)
    rows = weights.select(F.concat(F.lit("weight: "), "group").alias("area"), F.col("component").alias("item"), S.fmt_trimmed(F.col("weight"), 1).alias("value"))
    return fixed.unionByName(banded).unionByName(rows)


def public_view(df: DataFrame, stripped: Sequence[str]) -> DataFrame:
    return df.drop(*stripped)
