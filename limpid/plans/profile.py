"""A whole profile: one object, one table per question."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from limpid.operators import counts, describe, frequent, missing, outliers
from limpid.operators.duplicates import duplicate_count
from limpid.operators.schema import nan_to_null, numeric_columns, text_columns
from limpid.session import tune


class Profile:
    """Descriptive tables of a DataFrame, each computed when it is asked for.

    Value counts can be kept between uses with `keep_counts()`, and freed with `close()`.
    """

    def __init__(self, df: DataFrame, order_by: str | None = None):
        tune(df.sparkSession)
        self.df = nan_to_null(df)
        self.order_by = order_by

    @cached_property
    def shape(self) -> DataFrame:
        return describe.shape(self.df)

    @cached_property
    def types(self) -> DataFrame:
        return describe.column_types(self.df)

    @cached_property
    def missing_values(self) -> DataFrame:
        return missing.null_profile(self.df)

    @cached_property
    def duplicates(self) -> DataFrame:
        return duplicate_count(self.df)

    @cached_property
    def row_quality(self) -> DataFrame:
        return missing.row_quality(self.df)

    @cached_property
    def row_alerts(self) -> DataFrame:
        return missing.row_alerts(self.df, self.order_by)

    @cached_property
    def numeric(self) -> DataFrame:
        return describe.describe_numeric(self.df)

    @cached_property
    def outliers(self) -> DataFrame:
        return outliers.profile_outliers(self.df)

    @cached_property
    def value_counts(self) -> DataFrame:
        return counts.value_counts(self.df)

    @cached_property
    def categorical(self) -> DataFrame:
        return counts.categorical_profile(counts.key_counts(self.df))

    @cached_property
    def top_categories(self) -> DataFrame:
        return frequent.top_values_of(self.df)

    @cached_property
    def format_anomalies(self) -> DataFrame:
        return counts.format_anomalies(self.df)

    @cached_property
    def case_columns(self) -> list[str]:
        """Columns the case treatment should target; collected, one name per column."""
        return [r["column"] for r in counts.case_targets(self.format_anomalies).collect()]

    def preview(self, n: int = 10) -> DataFrame:
        ordered = self.df if self.order_by is None else self.df.orderBy(self.order_by)
        return ordered.limit(n)

    def keep_counts(self) -> "Profile":
        self.value_counts.persist()
        return self

    def close(self) -> None:
        self.value_counts.unpersist()

    def tables(self) -> dict[str, DataFrame]:
        """Every table that applies to this schema."""
        out = {
            "shape": self.shape,
            "types": self.types,
            "missing_values": self.missing_values,
            "duplicates": self.duplicates,
            "row_quality": self.row_quality,
            "row_alerts": self.row_alerts,
        }
        if numeric_columns(self.df):
            out |= {"numeric": self.numeric, "outliers": self.outliers}
        if text_columns(self.df):
            out |= {
                "categorical": self.categorical,
                "top_categories": self.top_categories,
                "format_anomalies": self.format_anomalies,
            }
        return out


def profile(df: DataFrame, order_by: str | None = None) -> Profile:
    return Profile(df, order_by)
