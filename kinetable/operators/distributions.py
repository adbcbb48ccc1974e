"""Value, grade, tag and date distributions per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.grades import grade_label
from kinetable.functions.serials import collection_date
from kinetable.functions.text import one_decimal, value_label
from kinetable.model import NO_TAGS, NULL_LABEL

BINS = 20
_KEY = "dataset_key"


def _number(value: Column) -> Column:
    """The value as a double; NULL and NaN count as missing."""
    v = value.cast("double")
    return F.when(~F.isnan(v), v)


def with_length_bin(df: DataFrame, field: str, bins: int = BINS) -> DataFrame:
    """Add ``bin``, ``bin_lo`` and ``bin_hi`` of a numeric field, equal widths per dataset.

    Bin i is [lo, next lo); the last one includes the maximum. One value only
    gives a single bin. Rows without a number have no bin.
    """
    v = F.col("_v")
    rows = df.withColumn("_v", _number(F.col(field)))
    bounds = rows.groupBy(_KEY).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    width = (F.col("_max") - F.col("_min")) / bins
    edge = lambda i: F.col("_min") + i * F.col("_w")
    guess = F.least(F.floor((v - F.col("_min")) / F.col("_w")), F.lit(bins - 1))
    settled = (
        F.when(F.col("_w") == 0, F.lit(0))
        .when(v < edge(F.col("_g")), F.col("_g") - 1)
        .when((v >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    ).cast("int")
    top = F.when((F.col("bin") == bins - 1) | (F.col("_w") == 0), F.col("_max"))
    return (
        rows.join(bounds, _KEY, "left")
        .withColumn("_w", width)
        .withColumn("_g", F.when(F.col("_w") > 0, guess).otherwise(F.when(v.isNotNull(), F.lit(0))))
        .withColumn("bin", F.when(v.isNotNull(), settled))
        .withColumns({"bin_lo": edge(F.col("bin")), "bin_hi": F.coalesce(top, edge(F.col("bin") + 1))})
        .drop("_v", "_min", "_max", "_w", "_g")
    )


def _with_total(counted: DataFrame, df: DataFrame) -> DataFrame:
    """Add the number of all rows of the dataset."""
    return counted.join(df.groupBy(_KEY).agg(F.count("*").alias("total")), _KEY)


def dist_histogram(df: DataFrame, field: str, bins: int = BINS) -> DataFrame:
    """Counts per equal-width bin, empty bins left out, with the dataset's row total."""
    counted = (
        with_length_bin(df.select(_KEY, field), field, bins).where(F.col("bin").isNotNull())
        .groupBy(_KEY, "bin")
        .agg(F.first("bin_lo").alias("bin_lo"), F.first("bin_hi").alias("bin_hi"),
             F.count("*").alias("count"))
    )
    label = F.when(F.col("bin_lo") == F.col("bin_hi"), F.col("bin_lo").cast("string")).otherwise(
        F.concat_ws("-", one_decimal(F.col("bin_lo")), one_decimal(F.col("bin_hi"))))
    return _with_total(counted.withColumn("label", label), df)


def dist_categorical(df: DataFrame, field: str) -> DataFrame:
    """Counts per value as text; NULL is its own label. With the dataset's row total."""
    dtype = df.schema[field].dataType
    label = F.coalesce(value_label(F.col(field), dtype), F.lit(NULL_LABEL))
    return _with_total(df.groupBy(_KEY, label.alias("label")).agg(F.count("*").alias("count")), df)


def dist_auto(df: DataFrame, field: str, chart: str = "auto") -> DataFrame:
    """Histogram for integer and floating fields, bars for the rest, or as asked."""
    if field not in df.columns:
        raise ValueError(f"unknown field {field!r}")
    numeric = isinstance(df.schema[field].dataType, (T.IntegralType, T.FractionalType)) and (
        not isinstance(df.schema[field].dataType, T.DecimalType))
    kind = chart if chart != "auto" else ("histogram" if numeric else "bar")
    return dist_histogram(df, field) if kind == "histogram" else dist_categorical(df, field)


def dist_grade(resolved: DataFrame) -> DataFrame:
    """Counts per normalised grade and the total; only NULL and '' are ungraded."""
    return _with_total(resolved.groupBy(_KEY, grade_label(F.col("grade")).alias("label")).agg(
        F.count("*").alias("count")), resolved)


def dist_tags(resolved: DataFrame) -> DataFrame:
    """Counts per tag, repeats inside an episode included, plus the untagged episodes, and the total of episodes.

    When some episode has no tags, that count takes the place of a real tag of
    the same name.
    """
    is_none = F.col("label") == NO_TAGS
    labels = resolved.select(
        _KEY,
        F.explode(F.when(F.size("tags") > 0, F.transform("tags", lambda t: F.struct(
            t.alias("label"), F.lit(False).alias("untagged")))).otherwise(
                F.array(F.struct(F.lit(NO_TAGS).alias("label"), F.lit(True).alias("untagged")))
        )).alias("_t"),
    ).select(_KEY, "_t.label", "_t.untagged")
    counted = labels.groupBy(_KEY, "label").agg(
        F.count_if(F.col("untagged")).alias("_none"), F.count_if(~F.col("untagged")).alias("_real"))
    return _with_total(counted.select(
        _KEY, "label",
        F.when(is_none & (F.col("_none") > 0), F.col("_none")).otherwise(F.col("_real")).alias("count"),
    ), resolved)


def dist_collection_date(df: DataFrame) -> DataFrame:
    """Episodes per collection date and the total of those counted.

    An absent column is not a missing date: rows whose shard has no serials (``shard_columns``) are left out.
    """
    serial = F.col("Serial_number") if "Serial_number" in df.columns else F.lit(None).cast("string")
    if "shard_columns" in df.columns:
        df = df.where(F.array_contains("shard_columns", "Serial_number"))
    elif "Serial_number" not in df.columns:
        df = df.limit(0)
    return _with_total(df.groupBy(_KEY, collection_date(serial).alias("label")).agg(F.count("*").alias("count")), df)


def bin_grade_crosstab(df: DataFrame, field: str = "length") -> DataFrame:
    """Grade counts inside each length bin, every episode in exactly one bin."""
    return _by_grade(with_length_bin(df, field).where(F.col("bin").isNotNull()), "bin")


def tag_grade_crosstab(df: DataFrame) -> DataFrame:
    """Grade counts of the episodes that carry each tag."""
    carried = df.select(_KEY, "grade", F.explode(F.array_distinct("tags")).alias("tag"))
    return _by_grade(carried, "tag")


def _by_grade(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(_KEY, column).agg(*[
        F.count_if(F.coalesce(F.col("grade") == g, F.lit(False))).alias(g)
        for g in ("good", "normal", "bad")
    ])
