"""Text keys, tokens and similarities."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_null(c: Column) -> Column:
    """Blank and missing text are one state."""
    return F.when(F.trim(c) != "", c)


def ascii_label_key(c: Column) -> Column:
    """Lower case, other than a-z and 0-9 to single spaces. Same as label_key() where the text is ASCII, and stays in the JVM."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def _folded(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").casefold()


@F.pandas_udf(T.StringType())
def _unicode_label(texts: pd.Series) -> pd.Series:
    return texts.map(_folded).str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


@F.pandas_udf(T.StringType())
def _unicode_name(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(_folded(t).split()))


def label_key(c: Column) -> Column:
    """NFKC, case folding, then as ascii_label_key(). Spark has neither of the first two; apply it to distinct values."""
    return _unicode_label(c)


def name_key(c: Column) -> Column:
    """NFKC, case folding, white space collapsed; punctuation stays."""
    return _unicode_name(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(ascii_label_key(c), " ", "_")


def food_key(c: Column) -> Column:
    """As ascii_label_key(), & read as `and`."""
    return ascii_label_key(F.regexp_replace(F.coalesce(c, F.lit("")), "&", " and "))


def tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """The distinct words of a label, without those in stop."""
    words = F.array_distinct(F.filter(F.split(ascii_label_key(c), " "), lambda w: w != ""))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, its heuristic for long strings included."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def composite_similarity(a: Column, b: Column) -> Column:
    """0.55 sequence ratio + 0.30 token Jaccard + 0.15 whether one label holds the other."""
    x, y = ascii_label_key(a), ascii_label_key(b)
    return 0.55 * sequence_ratio(x, y) + 0.30 * jaccard(tokens(a), tokens(b)) + 0.15 * (x.contains(y) | y.contains(x)).cast("double")


def labelled(parts: dict[str, Column]) -> Column:
    """`label: value` of each part that isn't blank, joined by a full stop."""
    return F.concat_ws(". ", *(F.when(F.trim(c) != "", F.concat(F.lit(f"{k}: "), F.trim(c))) for k, c in parts.items()))


def distinct_text(c: Column, sep: str = ";") -> Column:
    """Aggregate: the sorted distinct texts that aren't blank, joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.trim(c)))), sep)


def first_seen_text(c: Column, order: Column, limit: int, sep: str = "; ") -> Column:
    """Aggregate: the first `limit` distinct texts by order, and how many more there are."""
    rows = F.array_sort(F.collect_list(F.when(F.trim(c) != "", F.struct(order.alias("o"), F.trim(c).alias("x")))))
    seen = F.array_distinct(F.transform(rows, lambda r: r.x))
    more = F.when(F.size(seen) > limit, F.concat(F.lit(f"{sep}... ("), (F.size(seen) - limit).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.slice(seen, 1, limit), sep), more)
