"""Feature preparation: each step is fitted on a table, then applied to rows as a projection.

A step fitted with ``fit_on`` sees only the rows that satisfy that condition (say, the training seasons);
without it all rows are used. Fitted steps are small immutable values; applying one never shuffles, except
for a category dictionary that is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from labelrank.functions.columns import keep_columns, nan_to_null, numeric_columns, string_columns
from labelrank.functions.hashing import hash_uniforms
from labelrank.operators import stats
from labelrank.operators.forest import HistogramForest
from labelrank.operators.ordering import sorted_positions
from labelrank.session import SMALL_ROWS, small_rows, small_side, staged


def _rows(df: DataFrame, fit_on: Column | None) -> DataFrame:
    return df if fit_on is None else df.where(fit_on)


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace columns in place, in one projection."""
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


# --- missing values -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fill:
    """Values that stand in for missing ones: mean of a numeric column, mode of a text column."""

    numbers: dict[str, float]
    texts: dict[str, str]

    def apply(self, df: DataFrame) -> DataFrame:
        new = {c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(v)) for c, v in self.numbers.items()}
        new |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.texts.items()}
        return _replace(df, new)


def fit_fill(
    df: DataFrame, numeric: Sequence[str] | None = None, texts: Sequence[str] | None = None,
    fit_on: Column | None = None,
) -> Fill:
    numeric = numeric_columns(df) if numeric is None else list(numeric)
    texts = string_columns(df) if texts is None else list(texts)
    rows = _rows(df, fit_on)
    return make_fill(stats.column_means(rows, numeric), stats.column_modes(rows, texts))


def make_fill(means: dict[str, float | None], modes: dict[str, str | None]) -> Fill:
    empty = [c for c, v in (means | modes).items() if v is None]
    if empty:
        raise ValueError(f"no value to impute from in: {', '.join(empty)}")
    return Fill(means, modes)


# --- category codes -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Codes:
    """Dictionaries (value, code) of the encoded columns; a missing or unknown text has code -1."""

    tables: dict[str, DataFrame]
    sizes: dict[str, int] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        out, new = df, {}
        for i, (c, table) in enumerate(self.tables.items()):
            side = small_side(table.select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}")))
            out = out.join(side, F.col(c) == F.col(f"_v{i}"), "left")
            new[c] = F.coalesce(F.col(f"_c{i}"), F.lit(-1).cast("bigint"))
        return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def fit_codes(df: DataFrame, cols: Sequence[str] | None = None, fit_on: Column | None = None) -> Codes:
    """Code = position of the text among the sorted distinct texts of its column (byte order)."""
    cols = string_columns(df) if cols is None else list(cols)
    return fit_texts(df, cols, fit_on)[1]


def fit_texts(
    df: DataFrame, cols: Sequence[str], fit_on: Column | None = None
) -> tuple[dict[str, str | None], Codes]:
    """Modes and code dictionaries of text columns from one count of their values.

    Filling in a mode adds no text to a column, so the dictionaries hold before and after it.
    """
    if not cols:
        return {}, Codes({})
    counts = stats.value_counts(_rows(df, fit_on), cols)
    short = small_rows(counts, SMALL_ROWS)
    if short is None:
        counts = staged(counts, "text-counts")
        found = {r["column"]: r for r in stats.modes_of(counts).collect()}
        tables = {c: sorted_positions(counts.where(F.col("column") == c), "value") for c in cols}
        sizes = {c: found[c]["size"] if c in found else 0 for c in cols}
        return {c: found[c]["mode"] if c in found else None for c in cols}, Codes(tables, sizes)
    seen: dict[str, dict[str, int]] = {c: {} for c in cols}
    for r in short:
        seen[r["column"]][r["value"]] = r["n"]
    modes = {c: min(vs, key=lambda v: (-vs[v], v), default=None) for c, vs in seen.items()}
    tables = {
        c: df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(sorted(vs))], "value string, code bigint")
        for c, vs in seen.items()
    }
    return modes, Codes(tables, {c: len(vs) for c, vs in seen.items()})


@dataclass(frozen=True)
class OneHot:
    """0/1 columns, one per category but the first; a missing text has zeros everywhere."""

    levels: dict[str, list[str]]

    def apply(self, df: DataFrame) -> DataFrame:
        flags = [
            F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c, vs in self.levels.items() for v in vs[1:]
        ]
        return df.select(*[F.col(c) for c in df.columns if c not in self.levels], *flags)


def fit_one_hot(
    df: DataFrame, cols: Sequence[str], fit_on: Column | None = None, max_columns: int = 2_000
) -> OneHot:
    """Every category makes a column, so a column with very many categories is refused."""
    seen = small_rows(stats.value_counts(_rows(df, fit_on), cols).select("column", "value"), max_columns)
    if seen is None:
        raise ValueError(f"more than {max_columns} categories; use codes instead")
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for r in seen:
        levels[r["column"]].append(r["value"])
    return OneHot({c: sorted(vs) for c, vs in levels.items()})


# --- outliers and scale ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Scale:
    """Min-max scaling to [0, 1]; a constant column becomes 0."""

    ranges: dict[str, tuple[float, float]]

    def apply(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, (lo, hi) in self.ranges.items():
            x = F.col(c).cast("double")
            flat = F.when(x.isNotNull(), F.lit(0.0))
            new[c] = flat if lo is None or lo == hi else (x - F.lit(lo)) / F.lit(hi - lo)
        return _replace(df, new)


def fit_scale(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None) -> Scale:
    return Scale(stats.column_ranges(_rows(df, fit_on), cols))


@dataclass(frozen=True)
class Cap:
    """Bounds outside of which a value is pulled in to the bound. A missing value stays missing."""

    bounds: dict[str, tuple[float, float]]
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, (lo, hi) in self.bounds.items():
            x = nan_to_null(F.col(c).cast("double"))
            new[c] = F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)
        return _replace(df, new)

    def scale(self) -> Scale:
        """Scaling of the capped columns, without another pass: capping keeps order, so the range of the
        capped column is the capped range."""
        clip = {c: [min(max(x, lo), hi) for x in self.ranges[c]] for c, (lo, hi) in self.bounds.items()}
        return Scale({c: (a, b) for c, (a, b) in clip.items()})


def fit_cap(
    df: DataFrame, cols: Sequence[str] | None = None, label: str | None = None, fit_on: Column | None = None,
    exact: bool = True, spread: float = 1.5, max_values: int = 100_000,
    known: dict[str, stats.Summary] | None = None,
) -> Cap:
    """Quartiles -/+ ``spread`` times their distance, for every numeric column but the label.

    ``known`` are summaries of the same rows that were made already.
    """
    cols = numeric_columns(df, exclude=[label] if label else []) if cols is None else list(cols)
    rows = _rows(df, fit_on)
    if exact:
        quartiles, ranges = stats.quantiles(rows, cols, [0.25, 0.75], max_values, known=known)
    else:
        quartiles, ranges = stats.approx_quantiles(rows, cols, [0.25, 0.75]), stats.column_ranges(rows, cols)
    bounds = {
        c: (q1 - spread * (q3 - q1), q3 + spread * (q3 - q1)) for c, (q1, q3) in quartiles.items() if q1 is not None
    }
    return Cap(bounds, {c: ranges[c] for c in bounds})


# --- rows -----------------------------------------------------------------------------------------


def min_minutes(df: DataFrame, col: str = "mp", least: float = 10) -> DataFrame:
    """Leave out rows known to be below the minimum; a missing value stays in."""
    return df.where((F.col(col) >= least) | F.col(col).isNull() | F.isnan(F.col(col).cast("double")))


def add_noise(df: DataFrame, cols: Sequence[str], key: str, seed: int = 42, width: float = 0.1) -> DataFrame:
    """Add uniform noise from [-width, width) to every listed column, reproducibly by row key."""
    draws = hash_uniforms(seed, key, len(cols))
    return _replace(df, {c: F.col(c) + (u * (2 * width) - width) for c, u in zip(cols, draws)})


def concat_columns(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Put two tables side by side, row by row; rows are matched by their key.

    A row that the other table lacks stays, with nulls on that side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return left.join(right, keys, "full")


# --- feature selection ----------------------------------------------------------------------------


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector of the listed columns; a missing value is an error."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def feature_importances(
    df: DataFrame, cols: Sequence[str], label: str, num_trees: int = 1000, max_depth: int = 0, seed: int = 42,
    max_bins: int = 255,
) -> dict[str, float]:
    """Importance of each column in a random forest that predicts the 0/1 label; they add up to 1.

    The trees grow without a depth limit unless ``max_depth`` sets one. If no tree can split, all are 0.
    """
    forest = HistogramForest(numTrees=num_trees, maxDepth=max_depth, seed=seed, maxBins=max_bins)
    table = assemble(df.select(*cols, F.col(label).cast("double").alias("label")), cols)
    return dict(zip(cols, forest.importances(table.select("features", "label"))))


def select_by_importance(
    df: DataFrame, importances: dict[str, float], keep: Sequence[str] = (), threshold: float = 0.01
) -> DataFrame:
    """Columns whose importance is strictly above the threshold, and the ``keep`` columns."""
    return keep_columns(df, [c for c, v in importances.items() if v > threshold] + list(keep))
