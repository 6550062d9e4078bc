"""Typed cells back to native text, for snapshots that arrive typed (spreadsheets exported to parquet)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import ContractError


SCIENTIFIC = r"\A(-?)([0-9])\.([0-9]+)E(-?[0-9]+)\z"


def _plain_double(c: Column) -> Column:
    """Shortest decimal form without an exponent: the point moves in the text, so no digit is lost. NaN and infinities fail the job."""
    text = c.cast("string")
    part = lambda i: F.regexp_extract(text, SCIENTIFIC, i)
    digits = F.regexp_replace(F.concat(part(2), part(3)), r"(?<=.)0+\z", "")
    power = F.coalesce(part(4).try_cast("int"), F.lit(0))
    before = power + 1      # digits in front of the point
    whole = F.concat(digits, F.repeat(F.lit("0"), F.greatest(F.lit(0), before - F.length(digits))), F.when(F.abs(c) < 1e16, ".0").otherwise(""))
    broken = F.concat(F.substring(digits, F.lit(1), F.greatest(F.lit(0), before)), F.lit("."), F.substring(digits, F.greatest(F.lit(1), before + 1), F.length(digits)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -before)), digits)
    plain = F.concat(part(1), F.when(before <= 0, small).when(F.length(digits) > before, broken).otherwise(whole))
    return (F.when(c.isNull(), F.lit(None).cast("string")).when(text.rlike(r"\A-?[0-9.]+\z"), text).when(text.rlike(SCIENTIFIC), plain)
            .otherwise(F.raise_error(F.lit("INVALID_NUMBER: only finite numbers have a native form")).cast("string")))


def _moment(c: Column) -> Column:
    """ISO form with no or exactly six fractional digits."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss"
    whole = F.date_trunc("second", c) == c
    return F.when(whole, F.date_format(c, pattern)).otherwise(F.date_format(c, pattern + ".SSSSSS"))


def native_text(df: DataFrame) -> DataFrame:
    """Same columns, all text; NULL stays NULL. Booleans and nested types are refused."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.StringType):
            text = c
        elif isinstance(t, T.DateType):
            text = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            text = _moment(c)
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            text = _plain_double(c)
        elif isinstance(t, (T.IntegralType, T.DecimalType)):
            text = c.cast("string")
        else:
            raise ContractError("UNSUPPORTED_CELL_TYPE", "this type has no native text form", column=f.name,
                                type=t.simpleString())
        out.append(text.alias(f.name))
    return df.select(*out)
