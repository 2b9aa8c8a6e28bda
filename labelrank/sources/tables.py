"""CSV and Parquet scans and sinks, report tables, fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from labelrank.functions.columns import NULL_TOKENS, null_tokens


def _same_header(spark: SparkSession, path: str | list[str]) -> list[str | list[str]]:
    """The paths, in groups of files that have one header line.

    Only the distinct headers come to the driver, and the names of the files if there are several headers. A
    single file is a group without being read.
    """
    lines = spark.read.text(path)
    if len(lines.inputFiles()) <= 1:
        return [path]
    starts = lines.where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.monotonically_increasing_id().alias("at"), "value").alias("line"))
    headers = starts.groupBy("file").agg(F.min("line")["value"].alias("header"))
    if headers.select("header").distinct().limit(2).count() <= 1:
        return [path]
    return [sorted(r["files"]) for r in headers.groupBy("header").agg(F.collect_list("file").alias("files")).sort("header").collect()]


def _raw_csv(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    """All columns as text, with quotes handled the usual CSV way; columns of all files matched by name."""
    parts = []
    for group in _same_header(spark, path):
        names = csv_columns(spark, group)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        parts.append(spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line).csv(group))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def csv_columns(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names from the header, without reading the rows."""
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def _typed(col: Column, dtype: T.DataType, strict: bool) -> Column:
    if isinstance(dtype, T.StringType):
        return col
    return col.cast(dtype) if strict else col.try_cast(dtype)


_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"


def infer_types(df: DataFrame) -> T.StructType:
    """Narrowest type that holds every text of each column, in one pass.

    Whole numbers give bigint, or double where some are missing; then double, boolean, text.
    """
    checks = []
    for i, c in enumerate(df.columns):
        col = F.col(c)
        checks += [
            F.count(col).alias(f"n{i}"),
            F.count(col.try_cast("bigint")).alias(f"i{i}"),
            F.count_if(F.lower(col).rlike(_NUMBER)).alias(f"d{i}"),
            F.count_if(F.lower(col).isin("true", "false")).alias(f"b{i}"),
        ]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *checks).first()
    fields = []
    for i, c in enumerate(df.columns):
        n = seen[f"n{i}"]
        if n and seen[f"i{i}"] == n and n == seen["rows"]:
            dtype: T.DataType = T.LongType()
        elif seen[f"d{i}"] == n:
            dtype = T.DoubleType()
        elif seen[f"b{i}"] == n:
            dtype = T.BooleanType()
        else:
            dtype = T.StringType()
        fields.append(T.StructField(c, dtype))
    return T.StructType(fields)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
    tokens: Sequence[str] = NULL_TOKENS, strict: bool = True, multi_line: bool = True,
) -> DataFrame:
    """CSV with a header. Texts that stand for a missing value become null before types are applied.

    With a schema the types are given, and text that does not fit raises (``strict=False``: becomes
    null). Without one they are inferred by an extra pass. Columns are matched by name, also over files that
    order them differently; a column that some file lacks raises. Cells may hold line breaks; a file is then
    read by one task, so ``multi_line=False`` is for large files without any, which Spark may split.
    """
    raw = null_tokens(_raw_csv(spark, path, multi_line), tokens)
    if schema is None:
        schema = infer_types(raw)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return raw.select(*[_typed(F.col(f.name), f.dataType, strict).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; cells keep their line breaks and outer blanks."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").option("header", True).option("escape", '"').options(**keep).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet table. Partition by season to let later season filters skip files."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_reports(reports: DataFrame, path: str, by: Sequence[str] = ("model",), mode: str = "overwrite") -> None:
    """Report rows in one folder per model, or per model and fold. The reports are small: one file each."""
    reports.repartition(*by).write.mode(mode).partitionBy(*by).option("header", True).csv(path)


def write_best_params(params: DataFrame, path: str) -> None:
    """Chosen parameters as JSON lines, one row per model."""
    params.write.mode("overwrite").json(path)


def read_best_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, params map<string,string>, mean_accuracy double").json(path)


# Columns of the ranked-prediction table, in order.
RANKED_COLUMNS = ("season", "mvp", "model", "top_k", "mvp_in_top_k")


def write_ranked(ranked: DataFrame, path: str) -> None:
    """Ranked predictions with their fixed columns."""
    write_table(ranked.select(*RANKED_COLUMNS), path)


def model_path(base: str, name: str) -> str:
    """Where the fitted model of this name lives."""
    return f"{base.rstrip('/')}/models/{name}"


def save_model(model: PipelineModel, base: str, name: str) -> str:
    path = model_path(base, name)
    model.write().overwrite().save(path)
    return path


def load_model(base: str, name: str) -> PipelineModel:
    return PipelineModel.load(model_path(base, name))
