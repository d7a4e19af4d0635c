"""Scalar functions X01–X15 as built-in column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwell.functions.nulls import col

# Accepted boolean spellings.
STRICT_TRUE = ("true", "1")
STRICT_FALSE = ("false", "0")
LENIENT_TRUE = ("true", "1", "yes")
LENIENT_FALSE = ("false", "0", "no")
ISO_DATE_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
MODEL_NAME_PREFIXES = ("category__", "number__")


def _normalised_text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def strict_boolean(c: str | Column, dtype: str | None = None) -> tuple[Column, Column]:
    """X01. Returns (parsed, is_invalid). Booleans pass; integers must be 0/1; text must be
    true/false/1/0 after trim+lower. Null and anything else is invalid."""
    c = col(c)
    if dtype == "boolean":
        return c, c.isNull()
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        parsed = F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
        return parsed, parsed.isNull()
    if dtype in ("float", "double"):
        # a float (1.0) is not an accepted spelling
        return F.lit(None).cast("boolean"), F.lit(True)
    text = _normalised_text(c)
    parsed = F.when(text.isin(*STRICT_TRUE), F.lit(True)).when(text.isin(*STRICT_FALSE), F.lit(False))
    return parsed, parsed.isNull()


def lenient_boolean(c: str | Column, dtype: str | None = None) -> Column:
    """X02. Booleans pass through; text true/1/yes and false/0/no after trim+lower; else null."""
    c = col(c)
    if dtype == "boolean":
        return c
    text = _normalised_text(c)
    return F.when(text.isin(*LENIENT_TRUE), F.lit(True)).when(text.isin(*LENIENT_FALSE), F.lit(False))


def lenient_flag(c: str | Column, dtype: str | None = None) -> Column:
    """X02 as used by callers: unknown -> False."""
    return F.coalesce(lenient_boolean(c, dtype), F.lit(False))


def parse_date(c: str | Column, dtype: str | None = None) -> Column:
    """X03 coerce: ISO date / timestamp text or date-like value -> DATE, unparseable -> null. A column of
    type date passes through, so filters on it reach the scan."""
    c = col(c)
    if dtype == "date":
        return c
    return F.to_date(F.try_to_timestamp(c.cast("string")))


def parse_timestamp(c: str | Column) -> Column:
    return F.try_to_timestamp(col(c).cast("string"))


def parse_number(c: str | Column) -> Column:
    """X04 coerce: text or number -> DOUBLE, unparseable -> null."""
    return F.expr(f"try_cast({_sql(c)} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def _sql(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def is_iso_date_text(c: str | Column) -> Column:
    """Whole-string yyyy-mm-dd pattern; null stays null (neither pass nor fail)."""
    return col(c).cast("string").rlike(ISO_DATE_PATTERN)


def untrimmed(c: str | Column) -> Column:
    """Value differs from its trimmed form (null -> null)."""
    c = col(c)
    return c != F.trim(c)


def not_lowercase(c: str | Column) -> Column:
    c = col(c)
    return c != F.lower(c)


def is_alternative_id(c: str | Column, suffix: str = "-B") -> Column:
    """Id ends with the alternative-advert suffix; null id -> False (primary)."""
    return F.coalesce(col(c).cast("string").endswith(suffix), F.lit(False))


def base_id(c: str | Column, suffix: str = "-B") -> Column:
    """Id with the last len(suffix) characters removed."""
    c = col(c).cast("string")
    return c.substr(F.lit(1), F.length(c) - F.lit(len(suffix)))


def month_start(c: str | Column) -> Column:
    """First day of the calendar month."""
    return F.trunc(F.to_date(col(c)), "month")


def week_to_date(week: str | Column, week_zero: str) -> Column:
    """Start date + 7 days per week."""
    return F.date_add(F.lit(week_zero).cast("date"), col(week).cast("int") * 7)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """X10 production variant: den = 0 -> null (negatives divide)."""
    den = col(den)
    return F.try_divide(col(num).cast("double"), F.nullif(den, F.lit(0)).cast("double"))


def positive_ratio(num: str | Column, den: str | Column) -> Column:
    """X10 exploratory variant: den <= 0 -> null."""
    den = col(den)
    return F.try_divide(col(num).cast("double"), F.when(den > 0, den).cast("double"))


def log1p(c: str | Column) -> Column:
    return F.log1p(col(c))


def clip_zero(c: str | Column) -> Column:
    """max(0, x), null stays null."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(0.0)))


def round_half_even(c: str | Column, scale: int = 0) -> Column:
    """Python's round() is half-to-even."""
    return F.bround(col(c), scale)


def clean_encoded_name(c: str | Column) -> Column:
    """Strip encoder prefixes from an encoded feature name."""
    return F.regexp_replace(col(c), "^(" + "|".join(MODEL_NAME_PREFIXES) + ")", "")


def slug(name: str) -> str:
    """Output column name slug (plan-build time)."""
    return name.lower().replace(" ", "_")


def resolve_alias(df_columns, *names: str, dtype: str = "double") -> Column:
    """First present of ``names`` (coalesced in order), null literal when none exists."""
    present = [n for n in names if n in df_columns]
    if not present:
        return F.lit(None).cast(dtype)
    return F.coalesce(*[F.col(n) for n in present]).cast(dtype)


def require_strict_boolean(df, column: str):
    """X01 error path: parse ``column`` strictly; raise ``ValueError`` listing at most five
    distinct invalid values (found by a distributed distinct + limit, U04). Returns ``df`` with
    the column replaced by its parsed boolean."""
    from dwell.operators.sets import invalid_examples

    dtype = dict(df.dtypes).get(column)
    if dtype is None:
        raise KeyError(f"column not found: {column}")
    parsed, invalid = strict_boolean(column, dtype)
    bad = [r[0] for r in invalid_examples(df, column, invalid, 5).collect()]
    if bad or df.filter(invalid).limit(1).count():
        raise ValueError(f"{column} has values that are not booleans: {bad}")
    return df.withColumn(column, parsed)
