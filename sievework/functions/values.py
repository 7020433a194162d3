"""Cell texts to values: missing, zero, censored, range and observed stay apart. Three vocabularies, never unified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_label_key

_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

# Tokens of the main vocabulary, compared after ascii_label_key().
CENSORED = ("tr", "trace", "lod", "loq", "nd", "not detected", "below detection limit", "below quantification limit", "not quantified")
MISSING = ("", "n", "na", "n a", "missing", "unknown")
# Tokens of the bracketed vocabulary, in lower case.
BRACKET_MISSING = ("na", "n/a", "nan", "n.i.", "-", "--", "…")
BRACKET_CENSORED = ("tr", "trace", "spur", "spuren", "<", "<lod")
# Dashes that mean unmeasured in the dagger vocabulary.
DASHES = ("-", "—", "–", "−")


def parse_number(c: Column) -> Column:
    """A finite number, decimal comma allowed; null for all else (so not 1d, inf or NaN, which a cast would take)."""
    text = F.regexp_replace(F.trim(c.cast("string")), ",", ".")
    value = F.when(text.rlike(f"^{_NUMBER}$"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _state(status: Column | str, value: Column | None = None, low: Column | None = None, high: Column | None = None, limit: Column | None = None) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    number = lambda x: (F.lit(None) if x is None else x).cast("double")
    return F.struct(
        status.alias("value_status"), number(value).alias("numeric_value"), number(low).alias("parsed_min"), number(high).alias("parsed_max"),
        (status == "explicit_zero").alias("is_explicit_zero"), status.isin("trace", "below_limit").alias("is_censored"), (status == "range_only").alias("is_range_only"), number(limit).alias("censor_limit"),
    )


def parse_value(raw: Column, raw_min: Column | None = None, raw_max: Column | None = None) -> Column:
    """A struct: status, number, bounds, flags and limit of detection. Bounds given beside the text stay with it, but for a
    range in the text, whose own they are."""
    low, high = (F.lit(None).cast("double") if x is None else parse_number(x) for x in (raw_min, raw_max))
    text, key = F.trim(raw.cast("string")), ascii_label_key(raw.cast("string"))
    plain = r"([0-9]+(?:[.,][0-9]+)?)"
    part = lambda pattern, i: F.regexp_replace(F.regexp_extract(text, pattern, i), ",", ".").try_cast("double")
    below, between = rf"^\s*<\s*{plain}\s*$", rf"^\s*{plain}\s*[-–]\s*{plain}\s*$"
    number = parse_number(text)
    return (
        F.when(text.isNull() & (low.isNotNull() | high.isNotNull()), _state("range_only", None, low, high))
        .when(text.isNull() | (key.isin(*MISSING) & ~text.rlike(r"[<+]|^\.")), _state("missing", None, low, high))
        .when(text.rlike(below), _state("below_limit", None, low, high, part(below, 1)))
        .when(key.isin(*CENSORED), _state("trace", None, low, high))
        .when(text.rlike(between), _state("range_only", None, part(between, 1), part(between, 2)))
        .when(number == 0, _state("explicit_zero", number, low, high))
        .when(number.isNotNull(), _state("observed", number, low, high))
        .otherwise(_state("invalid", None, low, high))
    )


def parse_bracketed(raw: Column) -> Column:
    """A struct (number, status, usable): brackets and parentheses mark estimates, which keep their number but aren't usable."""
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    low = F.lower(text)
    bracketed = text.rlike(r"^(\[.*\]|\(.*\))$")
    number = parse_number(F.when(bracketed, F.trim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text))
    out = lambda status, value=None: F.struct(
        (F.lit(None) if value is None else value).cast("double").alias("number"), F.lit(status).alias("status"), F.lit(status in ("explicit_zero", "observed")).alias("usable")
    )
    return (
        F.when((text == "") | low.isin(*BRACKET_MISSING), out("missing_or_not_reported"))
        .when(low.isin(*BRACKET_CENSORED) | text.startswith("<"), out("trace_or_censored"))
        .when(number.isNull(), out("unparsed_non_numeric"))
        .when(number < 0, out("invalid_negative", number))
        .when(bracketed, out("bracketed_or_parenthesized_estimate", number))
        .when(number == 0, out("explicit_zero", number))
        .otherwise(out("observed", number))
    )


def parse_dagger(raw: Column, annotated: Column | None = None) -> Column:
    """A struct (number, status, estimated). A dagger at the end counts as a note where `annotated`; a zero isn't an observed one."""
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    noted = (F.lit(False) if annotated is None else annotated) & text.endswith("†")
    text = F.when(noted, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    estimated = text.rlike(r"^\(.*\)$")
    inner = F.when(estimated, F.trim(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    number = F.when(inner.rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"), inner.try_cast("double"))
    either = lambda a, b: F.when(estimated, a).otherwise(b)
    status = (
        F.when(inner == "", "missing_blank")
        .when(inner.isin(*DASHES), "unmeasured_dash")
        .when(F.lower(inner) == "tr", either("estimated_trace", "trace_interval"))
        .when(inner == "*", "footnote_only_value_unresolved")
        .when(number.isNull(), "unparsed_requires_review")
        .when(number < 0, "invalid_negative")
        .when(number == 0, either("estimated_zero", "reported_zero_censored_or_nondetect"))
        .otherwise(either("estimated_positive", "reported_positive_origin_unresolved"))
    )
    return F.struct(number.alias("number"), status.alias("status"), estimated.alias("estimated"))


def parsed(df: DataFrame, column: str, parse: Callable[[Column], Column], name: str = "s") -> DataFrame:
    """df with name, what parse() makes of column: worked out once for each distinct text, of which tables of values hold few, and
    met again by a join that Spark makes a broadcast where these are small. For columns of mostly different texts call parse()."""
    texts = df.select(F.col(column).alias("_x")).distinct()
    known = texts.select("_x", parse(F.col("_x")).alias(name))
    return df.join(known, F.col(column).eqNullSafe(F.col("_x")), "left").drop("_x")


def bounded_mass(value: Column, slack: float = 1e-6) -> Column:
    """A mass in g per 100 g, a rounding error over 100 taken back."""
    return F.when((value > 100) & (value <= 100 + slack), F.lit(100.0)).otherwise(value)


def mass_status(status: Column, value: Column) -> Column:
    """The status of a value after conversion: negative and over 100 g per 100 g are invalid."""
    return F.when(value < 0, "invalid_negative").when(value > 100, "invalid_mass_fraction_above_100").otherwise(status)


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| / the larger magnitude; 0 for two zeros."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 0.0).otherwise(F.abs(a - b) / top)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol |b|: b is the reference, so the two aren't alike."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def truthy(c: Column) -> Column:
    """Booleans, and texts that say true; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))
