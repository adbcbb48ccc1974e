"""Keys, slugs, digests and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dataset_key(path: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a path."""
    return F.substring(F.sha2(path, 256), 1, 16)


def raw_dataset_key(path: Column) -> Column:
    return F.concat(F.lit("raw-"), dataset_key(path))


def slug(text: Column) -> Column:
    """Runs of other characters become one underscore; an empty result is ``unknown``."""
    cleaned = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(cleaned == "", F.lit("unknown")).otherwise(cleaned)


def repo_id(path: Column) -> Column:
    """Local repository name of a dataset path: its last folder, other characters than ``._-`` as a dash each."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.concat(F.lit("local/"), F.regexp_replace(
        F.when(name == "", F.lit("dataset")).otherwise(name), "[^A-Za-z0-9._-]", "-"))


def tags_from_json(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def tags_to_json(tags: Column) -> Column:
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def canonical_digest(contract: Column) -> Column:
    """SHA-256 of compact JSON. Fields must be in name order; NULL fields are kept."""
    return F.sha2(F.to_json(contract, {"ignoreNullFields": "false"}), 256)


def value_label(column: Column, dtype: T.DataType) -> Column:
    """Text of a value as a category label; booleans are spelled True and False, doubles as `double_text` has them."""
    if isinstance(dtype, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return double_text(column.cast("double"))
    return column.cast("string")


def double_text(value: Column) -> Column:
    """Text of a double: plain from 0.0001 to under 1e16, else with a signed exponent of two digits or more."""
    text = value.cast("string")
    shape = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    sign, first, power = part(1), part(2), part(4).try_cast("int")
    rest = F.regexp_replace(part(3), "0+$", "")
    digits, after = F.concat(first, rest), F.length(rest) - power
    whole = F.concat(F.rpad(digits, F.greatest(power + 1, F.length(digits)), F.lit("0")), F.lit(""))
    plain = F.when(after <= 0, F.concat(whole, F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(
        F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    wide = F.concat(first, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), exponent)
    special = F.when(F.isnan(value), "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf")
    return F.coalesce(special, F.when(~text.rlike("E"), text).otherwise(F.concat(sign, F.when(
        power == -4, F.concat(F.lit("0.000"), digits)).when((power >= 0) & (power < 16), plain).otherwise(wide))))


def one_decimal(value: Column) -> Column:
    """One decimal, ties to the even digit; values of twenty digits or more as they are."""
    rounded = F.bround(value.try_cast("decimal(38,18)"), 1).try_cast("decimal(38,1)").cast("string")
    return F.coalesce(rounded, value.cast("string"))
