"""Dataset profile and header inference.

One aggregate pass gives every measure but distinct counts.  Those are estimated
in the same pass; only columns whose estimated share is near a threshold are
counted exactly, each by an own two-step aggregation that reads one column, so
no row is multiplied by the number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LoadConfig
from ..functions.numbers import ambiguous_separator, dataset_separators, js_number_text
from ..functions.typesystem import CODE, NOT_CATEGORICAL, NUMBER_CHAIN, collate, from_mask
from ..functions.typing import is_nullish, number_form, text_type, value_type
from ..functions.values import as_text, canonical_text, outside_hint
from ..header import ColumnDef, Header
from ..sources.scratch import small_methods

SAMPLE_SEED = 17  # so that a load can be repeated
RSD = 0.02  # relative standard error of distinct estimates
NEAR = 0.1  # an estimated share this near a threshold, five standard errors, is counted exactly
TEXT = (T.StringType, T.CharType, T.VarcharType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def present(column: Column, kind: T.DataType) -> Column:
    """The value, or null where it counts as absent."""
    return F.when(~is_nullish(column), column) if isinstance(kind, TEXT) else column


def plain_number(column: Column, kind: T.DataType, config: LoadConfig) -> Column:
    """Plain digits of a number-like value, null or empty for others."""
    if isinstance(kind, TEXT):
        return number_form(column, config.separators)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return js_number_text(column.cast("double"))
    return as_text(column, kind)


@dataclass(frozen=True)
class ColumnStats:
    """Measures of one column; ``distinct`` is exact where it decides anything."""

    values: int
    nulls: int
    types: tuple[str, ...]
    length: int
    bytes: int
    int_digits: int
    scale: int
    ambiguous: bool
    distinct: int
    exact: bool


def with_values(df: DataFrame, config: LoadConfig) -> DataFrame:
    """First step of the measures: each column's present value, its text, the plain number in it and its type.

    They are columns of their own, each made from those before it, so that the
    aggregates that name them, and the types that name the number, don't work
    them out again: in the branches of an expression Spark would, at every mention.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    each = list(enumerate(fields.items()))
    out = df.select(*[present(quoted(n), k).alias(f"v{i}") for i, (n, k) in each])
    out = out.withColumns({f"p{i}": plain_number(F.col(f"v{i}"), k, config) for i, (_, k) in each if not isinstance(k, WHOLE)})
    shown = (T.DoubleType, T.FloatType)  # their text is their plain number, where they have one
    out = out.withColumns({
        a: c for i, (n, k) in each if not isinstance(k, WHOLE) for a, c in {
            f"s{i}": F.coalesce(F.col(f"p{i}"), F.col(f"v{i}").cast("string")) if isinstance(k, shown) else F.col(f"v{i}") if isinstance(k, TEXT) else F.col(f"p{i}"),
            f"t{i}": value_form(n, k, config, i),
        }.items()
    })
    return out


def value_form(name: str, kind: T.DataType, config: LoadConfig, at: int) -> Column:
    """Type of each value of a column, from the columns made before."""
    v = F.col(f"v{at}")
    if name in config.force_string_columns:
        return F.when(v.isNotNull(), "varchar")
    if name in config.boolean_columns:
        return F.when(v.isNotNull(), "boolean")
    return text_type(v, config.separators, F.col(f"p{at}")) if isinstance(kind, TEXT) else value_type(v, kind, config.separators)


def measures(kind: T.DataType, config: LoadConfig, at: int, estimate: bool = True) -> dict[str, Column]:
    """Aggregates of a column over the columns that :func:`with_values` made (A1)."""
    v, each, text = F.col(f"v{at}"), F.col(f"t{at}"), F.col(f"s{at}")
    out: dict[str, Column] = {"values": F.count(v)}
    if isinstance(kind, WHOLE):
        low, high = F.min(v.cast("long")), F.max(v.cast("long"))
        none = F.lit(None).cast("int")
        digits = F.greatest(F.length(low.cast("string")), F.length(high.cast("string")))
        out |= {"types": F.lit(None).cast("long"), "low": low, "high": high, "length": none, "bytes": digits, "int_digits": digits, "scale": F.lit(0), "ambiguous": F.lit(False)}
    else:
        code = F.element_at(F.create_map(*[F.lit(x) for t, i in CODE.items() for x in (t, 1 << i)]), each)
        chars = F.length(text)
        if config.utf16_lengths:
            chars = chars + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
        numeric = each.isin(*[t for t in NUMBER_CHAIN if t not in ("exponent", "boolean")])
        number = F.when(numeric, F.col(f"p{at}"))
        out |= {
            "types": F.bit_or(code),
            "length": F.max(F.when(~numeric, chars)),
            "bytes": F.max(F.octet_length(text)),
            "int_digits": F.max(F.length(F.split_part(number, F.lit("."), F.lit(1)))),
            "scale": F.max(F.length(F.split_part(number, F.lit("."), F.lit(2)))),
            "ambiguous": F.bool_or(ambiguous_separator(v)) if isinstance(kind, TEXT) else F.lit(False),
        }
    if estimate:
        out["distinct"] = F.approx_count_distinct(F.to_json(v) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else v, RSD)
    return out


def whole_type(low: int | None, high: int | None) -> tuple[str, ...]:
    """Type of whole numbers from their extremes."""
    if low is None:
        return ()
    for bits, t in ((7, "tinyint"), (15, "smallint"), (31, "int")):
        if -(1 << bits) <= low and high < 1 << bits:
            return (t,)
    return ("bigint",)


def distinct_count(df: DataFrame, name: str, local: str, config: LoadConfig) -> DataFrame:
    """One row: exact number of different values, texts in canonical form (A2)."""
    kind = df.schema[name].dataType
    v = present(quoted(name), kind)
    if isinstance(kind, (*TEXT, T.StructType, T.ArrayType, T.MapType)):
        v = canonical_text(v, kind, "varchar" if name in config.force_string_columns else local, config)
    return df.select(v.alias("v")).filter("v is not null").distinct().agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, config: LoadConfig, exact: bool = False, distinct: bool = True) -> tuple[dict[str, ColumnStats], int]:
    """Statistics of every column, and the row count; without ``distinct``, distinct values are not counted."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if not fields:
        return {}, df.count()
    wanted = {n: measures(k, config, i, distinct) for i, (n, k) in enumerate(fields.items())}
    columns = [c.alias(f"c{i}_{m}") for i, ms in enumerate(wanted.values()) for m, c in ms.items()]
    with small_methods(df.sparkSession):
        row = with_values(df, config).agg(F.count(F.lit(1)).alias("rows"), *columns).first()
    rows = row["rows"]
    found: dict[str, dict] = {n: {m: row[f"c{i}_{m}"] for m in wanted[n]} for i, n in enumerate(fields)}
    near: dict[str, DataFrame] = {}
    for n, s in found.items():
        s["type_set"] = whole_type(s["low"], s["high"]) if "low" in s else tuple(from_mask(s["types"]))
        if not distinct:
            s["distinct"] = 0
            continue
        share = s["distinct"] / s["values"] if s["values"] else 0
        close = any(abs(share - t) <= NEAR * t for t in (config.categorical, config.pseudo_unique, 1.0)) or s["distinct"] <= 2
        if s["values"] and (exact or close or share > 1):
            near[n] = distinct_count(df, n, collate(s["type_set"]), config).select(F.lit(n).alias("name"), "n")
    if near:
        for r in reduce(DataFrame.unionAll, near.values()).collect():  # one row a column
            found[r["name"]]["distinct"] = r["n"]
    stats = {
        n: ColumnStats(
            s["values"], rows - s["values"], s["type_set"], s["length"] or 0, s["bytes"] or 0, s["int_digits"] or 0, s["scale"] or 0,
            bool(s["ambiguous"]), s["distinct"] or 0, n in near,
        )
        for n, s in found.items()
    }
    return stats, rows


def stats_frame(df: DataFrame, config: LoadConfig) -> DataFrame:
    """Counts and exact distinct counts as a frame, one row a column; lazy, and nothing passes through the driver."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(present(quoted(n), k)).alias(f"c{i}") for i, (n, k) in enumerate(fields.items())])
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col("rows"), F.col(f"c{i}").alias("values")) for i, n in enumerate(fields)])
    flat = one.select(F.explode(rows).alias("s")).select("s.*")
    counts = reduce(
        DataFrame.unionAll,
        [distinct_count(df, n, "decimal" if isinstance(k, T.DecimalType) else "varchar", config).select(F.lit(n).alias("column_name"), F.col("n").alias("n_distinct")) for n, k in fields.items()],
    )
    out = flat.join(counts, "column_name")
    share = F.col("n_distinct") / F.col("n_values")
    out = out.select(
        "column_name",
        F.col("values").alias("n_values"),
        (F.col("rows") - F.col("values")).alias("n_nulls"),
        F.col("n_distinct").cast("long"),
    )
    return out.withColumn(
        "cardinality",
        F.when(F.col("n_values") == 0, "empty")
        .when(F.col("n_distinct") == F.col("n_values"), "unique")
        .when(share >= config.pseudo_unique, "pseudounique")
        .when(share <= config.categorical, "low")
        .otherwise("normal"),
    )


def infer_header(df: DataFrame, config: LoadConfig, voted: bool = False) -> tuple[Header, dict[str, ColumnStats], int]:
    """Header of a dataset with flags (I2), its statistics and the number of rows.

    ``voted``: the separators of the configuration, if any, are the dataset's already.
    """
    if config.boolean_columns:
        check_booleans(df, config)
    chosen = config.with_(thousands_separator=None, decimal_separator=None)
    pair = config.separators if voted else dataset_separators(df, config)
    if pair:
        chosen = config.with_(thousands_separator=pair[0], decimal_separator=pair[1])
    sampled: dict[str, ColumnStats] = {}
    rows = df.count() if config.sampling else 0
    if config.sampling and rows > config.sampling_minimum:
        stats, rows, sampled = profile_by_sample(df, rows, chosen)
    else:
        stats, rows = profile(df, chosen)
    header = Header()
    unclear = []
    for name, s in stats.items():
        if not s.values:  # deferred until a load brings a value (I13)
            continue
        header[name] = column_of(name, s, chosen, sampled.get(name))
        if s.ambiguous and header[name].type in NUMBER_CHAIN and not pair:
            unclear.append(name)
    if unclear:
        config.log("warn", f"values like 1,234 could be read either way in {', '.join(unclear)}; the separator was taken as the decimal point")
    return header, stats, rows


def profile_by_sample(df: DataFrame, rows: int, config: LoadConfig) -> tuple[dict[str, ColumnStats], int, dict[str, ColumnStats]]:
    """Statistics with distinct values from a sample (I4-I6); also the sample's own.

    Types and lengths are of all rows.  How often values repeat is learned from
    ``sampling`` of the rows, ``sampling_minimum`` at least; a column whose values
    are all different there is counted in full.
    """
    size = max(round(rows * config.sampling), config.sampling_minimum)
    stats, rows = profile(df, config, distinct=False)
    part, _ = profile(df.sample(min(1.0, size / rows), SAMPLE_SEED), config, exact=True)
    unique = [n for n, s in part.items() if s.values and s.distinct == s.values]
    whole = {}
    if unique:
        counts = [distinct_count(df, n, collate(stats[n].types), config).select(F.lit(n).alias("name"), "n") for n in unique]
        whole = {r["name"]: r["n"] for r in reduce(DataFrame.unionAll, counts).collect()}  # one row a column
    # A sampled count rules no key out: only full ones are exact.
    stats = {n: replace(s, distinct=whole.get(n, s.values), exact=n in whole) for n, s in stats.items()}
    return stats, rows, {n: s for n, s in part.items() if s.values and n not in whole}


def column_of(name: str, s: ColumnStats, config: LoadConfig, sampled: ColumnStats | None = None) -> ColumnDef:
    kind = "varchar" if name in config.force_string_columns else "boolean" if name in config.boolean_columns else collate(s.types)
    cap = config.scale_cap
    scale = min(s.scale, cap)
    length = max(s.length, s.int_digits + scale) if s.int_digits else s.length
    if kind == "decimal":
        if s.scale > cap or s.int_digits + scale > 38:
            if config.decimal_to_varchar or s.int_digits + scale > 38:
                config.log("warn", f"column {name!r}: decimals do not fit and are kept as text")
                kind, length, scale = "varchar", s.int_digits + s.scale + 2, 0
            else:
                config.log("warn", f"column {name!r}: decimals are rounded to {cap} digits after the point")
    elif s.scale and kind not in ("double", "exponent"):
        # Numbers among texts: the point and all digits count.
        length, scale = max(s.length, s.int_digits + 1 + s.scale), 0
    elif kind not in NUMBER_CHAIN:
        scale = 0
    if kind in ("varchar", "text", "mediumtext", "longtext"):
        if kind == "varchar" and length > config.max_varchar_length:
            kind = "text"
        if s.bytes >= 16_777_215:
            kind = "longtext"
        elif s.bytes >= 65_535 and kind in ("varchar", "text"):
            kind = "mediumtext"
    seen = sampled or s
    share = seen.distinct / seen.values
    flags: dict[str, bool] = {}
    if s.distinct == s.values and s.exact:
        flags["unique"] = True
    elif share >= config.pseudo_unique:
        flags["pseudounique"] = True
    elif share <= config.categorical and kind not in NOT_CATEGORICAL:
        flags["categorical"] = True
    elif seen.distinct == 1 and not s.nulls:
        flags["single_value"] = True
    if flags.get("unique") and max(length, s.bytes) > config.max_key_length:
        flags["unique"] = False
    return ColumnDef(kind, length, scale if kind in NUMBER_CHAIN else 0, allow_null=s.nulls > 0, **flags)


def check_booleans(df: DataFrame, config: LoadConfig) -> None:
    """Raise if a column declared boolean holds anything else, with an example."""
    names = [n for n in config.boolean_columns if n in df.columns]
    if not names:
        return
    texts = {n: as_text(present(quoted(n), df.schema[n].dataType), df.schema[n].dataType) for n in names}
    row = df.agg(*[F.max(F.when(outside_hint(t), t)).alias(f"b{i}") for i, t in enumerate(texts.values())]).first()
    for i, n in enumerate(names):
        if row[f"b{i}"] is not None:
            raise ValueError(f"column {n!r} is declared boolean but has {row[f'b{i}']!r}")
