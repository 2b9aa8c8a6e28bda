"""Column groups by type, projections, missing-value rules and 0/1 thresholds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Texts that a CSV reader takes as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order. Booleans are in neither group."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def _require(df: DataFrame, cols: Iterable[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def drop_columns(df: DataFrame, *cols: str, strict: bool = True) -> DataFrame:
    """Drop columns; an unknown name is an error unless ``strict=False``."""
    if strict:
        _require(df, cols)
    return df.drop(*cols)


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exactly these columns, in this order."""
    _require(df, cols)
    return df.select(*cols)


def nan_to_null(col: Column) -> Column:
    """NaN counts as missing. Spark would order it above every number and carry it through max."""
    return F.when(~F.isnan(col), col)


def null_nans(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column."""
    floating = (T.FloatType, T.DoubleType)
    return df.select(
        *[
            nan_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Turn the texts that stand for a missing value into null, in every string column."""
    strings = set(string_columns(df))
    return df.select(
        *[F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if c in strings else F.col(c) for c in df.columns]
    )


def above(col: Column | str, threshold: float = 0.5) -> Column:
    """1 where the value is strictly above the threshold, else 0; missing gives 0."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when((value > threshold) & ~F.isnan(value), 1).otherwise(0)


def integer_label(df: DataFrame, label: str) -> DataFrame:
    """Make the label a 0/1 integer, unless its type is integer already."""
    if isinstance(df.schema[label].dataType, T.IntegralType):
        return df
    return df.withColumn(label, above(label))


def to_float32(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast the feature columns to 32-bit floats; the others pass through."""
    wanted = set(cols)
    return df.select(*[F.col(c).cast("float").alias(c) if c in wanted else F.col(c) for c in df.columns])
