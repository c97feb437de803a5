"""Number texts: separators, normalising, exact rounding."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LoadConfig
from ..sources.scratch import small_methods
from . import patterns as P


def _grouped(separator: str, point: str) -> str:
    """Digits in Western or Indian groups with an optional fraction; a lone separator counts only beside a point."""
    two = rf"(?:{separator}[0-9]{{2}})"
    three = rf"{separator}[0-9]{{3}}"
    many = rf"(?:[0-9]{{0,3}}(?:{three}){{2,}}|[0-9]{{0,2}}{two}+{three})(?:{point}[0-9]*)?"
    return rf"\A-?(?:{many}|[0-9]{{0,3}}{three}{point}[0-9]*)\z"


US_GROUPS, SWISS_GROUPS, BACKTICK_GROUPS, EU_GROUPS = (_grouped(s, p) for s, p in ((",", r"\."), ("'", r"\."), ("`", r"\."), (r"\.", ",")))
PLAIN = r"\A-?(?=[.]?[0-9])[0-9]*(?:\.[0-9]*)?\z"
LONE = r"\A-?(?=[,'`]?[0-9])[0-9]*[,'`][0-9]*\z"
DIGITS = r"\A-?[0-9]+\z"  # plain in every layout
POINTED = r"\A-?[0-9]+(?:\.[0-9]+)?\z"  # plain where the point is the decimal separator
FIXED = rf"\A-?(?:(?=[.]?[0-9])[0-9]*|[0-9]{{0,3}}(?:,[0-9]{{3}})+|[0-9]{{0,2}}(?:,[0-9]{{2}})*,[0-9]{{3}})(?:\.[0-9]*)?\z"


def normalize_number(text: Column, separators: tuple[str, str] | None = None) -> Column:
    """Plain ``-?digits[.digits]`` of a number text in any supported layout, null if malformed.

    US, EU, space, Swiss (apostrophe or backtick) and Indian grouping are read.
    Without ``separators`` (thousands, decimal), two kinds of separator decide by
    order, a repeated one groups, and a lone one is the decimal point.  The
    layout is found by whole-text patterns, so that the text is named only once
    in each branch and the expression stays small.  Texts that are plain already
    are settled by one pattern.
    """
    ready = text.rlike(POINTED if separators is None or separators[1] == "." else DIGITS)
    body = F.replace(text, F.lit(" "), F.lit(""))
    if separators is not None:
        body = F.translate(body, separators[0] + separators[1], ",.")
        plain = F.when(body.rlike(FIXED), F.replace(body, F.lit(","), F.lit("")))
    else:
        plain = (
            F.when(body.rlike(PLAIN), body)
            .when(body.rlike(LONE), F.translate(body, ",'`", "..."))
            .when(body.rlike(US_GROUPS), F.replace(body, F.lit(","), F.lit("")))
            .when(body.rlike(EU_GROUPS), F.translate(body, ",.", "."))
            .when(body.rlike(SWISS_GROUPS) | body.rlike(BACKTICK_GROUPS), F.translate(body, "'`", ""))
        )
    return F.when(ready, text).otherwise(F.regexp_replace(plain, r"\.\z", ""))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def ambiguous_separator(text: Column) -> Column:
    """Whether a value like ``1,234`` or ``1.234`` could be read either way."""
    return text.rlike(r"\A-?[0-9]{1,3}[.,][0-9]{3}\z")


def separator_vote(text: Column) -> Column:
    """'us', 'eu' or null: what one text says about the layout of numbers.

    What is left of a number without its digits tells the layout; it is bound to
    a variable, so that it is worked out once.  Texts without a separator are
    settled before any pattern.
    """
    s = F.trim(text)
    lone_is_point = ~s.rlike(r"\A-?[0-9]{0,3}[.,][0-9]{3}\z")

    def vote(marks: Column) -> Column:
        return (
            F.when(_count(marks, ",") >= 2, "us")
            .when(_count(marks, ".") >= 2, "eu")
            .when(marks == ",.", "us")
            .when(marks == ".,", "eu")
            .when((marks == ",") & lone_is_point, "eu")
            .when((marks == ".") & lone_is_point, "us")
        )

    separated = F.contains(text, F.lit(",")) | F.contains(text, F.lit("."))
    return F.when(separated & s.rlike(P.NUMERIC), F.element_at(F.transform(F.array(F.translate(s, "-0123456789", "")), vote), 1))


def count_votes(df: DataFrame) -> DataFrame:
    """One row: votes for each layout, pooled over all text columns in one pass."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    # The votes are columns of their own, so that the sums for both sides read each vote and don't repeat it.
    votes = df.select(*[separator_vote(F.col(f"`{name}`")).alias(f"v{i}") for i, name in enumerate(texts)])
    total = {side: reduce(add, [F.count_if(F.col(f"v{i}") == side) for i in range(len(texts))], F.lit(0)) for side in ("us", "eu")}
    return votes.agg(*[n.cast("long").alias(f"{side}_votes") for side, n in total.items()])


def dataset_separators(df: DataFrame, config: LoadConfig) -> tuple[str, str] | None:
    """(thousands, decimal) for a whole dataset: configured, else by consensus; a conflict warns and gives none."""
    if config.separators:
        return config.separators
    if not any(isinstance(f.dataType, T.StringType) for f in df.schema.fields):
        return None
    with small_methods(df.sparkSession):
        us, eu = count_votes(df).first()
    us, eu = us >= config.number_format_min_evidence, eu >= config.number_format_min_evidence
    if us and eu:
        config.log("warn", "numbers in both layouts (1,234.5 and 1.234,5): each value is read by itself; set number_format")
        return None
    return (",", ".") if us else (".", ",") if eu else None


def round_half_up(text: Column, scale: int) -> Column:
    """Plain number text rounded half away from zero to ``scale`` digits, without trailing zeros.

    Exact up to 38 digits; a longer number, and a text that is none, stays as it is.
    """
    scale = min(scale, 38)
    longer = text.rlike(rf"\A-?[0-9]*\.[0-9]{{{scale + 1},}}\z")
    rounded = F.regexp_replace(text.try_cast(f"decimal(38,{scale})").cast("string"), r"\.0+\z|(\.[0-9]*?[1-9])0+\z", "$1")
    return F.when(longer, F.coalesce(rounded, text)).otherwise(text)


def js_number_text(value: Column) -> Column:
    """Text of a double as the source of the data would print it: ``1``, ``0.5``, ``10000000``, ``1e+21``.

    From 1e21 up and below 1e-6 it is in exponent form.  Not a number gives null.
    Whole numbers below 1e15 and what Spark prints without an exponent need no pattern.
    """
    size = F.abs(value)
    exponent = (size >= 1e21) | ((size < 1e-6) & (size > 0))
    shown = value.cast("string")
    plain = F.when(size < 1, shown.cast("decimal(38,24)").cast("string")).otherwise(shown.cast("decimal(38,16)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    plain = F.when(value == 0, "0").otherwise(plain)
    whole = (size < 1e15) & (value.try_cast("bigint").cast("double") == value)
    settled = F.when(F.isnan(value) | (size == float("inf")), None).when(whole, value.try_cast("bigint").cast("string")).when((size >= 1e-3) & (size < 1e7), shown)
    return settled.when(exponent, F.regexp_replace(shown, r"\.0E|E", "e")).otherwise(plain)
