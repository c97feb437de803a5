"""Table-level queries, one for each operator family, with equivalent SQL.

Each query applies an operator of this package to whole tables; the SQL states
the same result for another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import LoadConfig
from .engine import Engine
from .functions import dates, numbers, typing, values
from .functions.typesystem import CODE
from .header import ColumnDef, Header
from .operators import evolve, merge, rejects, reshape
from .plans import diff, keys, profile, shape
from .sources.scratch import new_path, spread

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = LoadConfig()
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Profiles

PROFILED = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "events": "event_id ts user_id event_type value props",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
}


def _profile_sql(name: str) -> str:
    texts = {"l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "event_type", "props", "c_name", "c_mktsegment"}
    parts = []
    for c in PROFILED[name].split():
        v = f"CASE WHEN {c} NOT IN ('', '\\N', 'null') THEN {c} END" if c in texts else c
        parts.append(
            f"SELECT '{c}' AS column_name, count({v}) AS n_values, count(*) - count({v}) AS n_nulls, count(DISTINCT {v}) AS n_distinct FROM {name}"
        )
    return (
        "SELECT column_name, CAST(n_values AS BIGINT) AS n_values, CAST(n_nulls AS BIGINT) AS n_nulls, CAST(n_distinct AS BIGINT) AS n_distinct, "
        "CASE WHEN n_values = 0 THEN 'empty' WHEN n_distinct = n_values THEN 'unique' WHEN n_distinct / n_values >= 0.9 THEN 'pseudounique' "
        f"WHEN n_distinct / n_values <= 0.2 THEN 'low' ELSE 'normal' END AS cardinality FROM ({' UNION ALL '.join(parts)})"
    )


def _profile(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile.stats_frame(table(spark, sf_dir, name).select(*PROFILED[name].split()), CONFIG)

    run.__name__ = f"profile_{name}"
    return query(_profile_sql(name))(run)


for _name in PROFILED:
    _profile(_name)


@query(
    """WITH t AS (SELECT CASE WHEN text NOT IN ('', '\\N', 'null') THEN text END AS text FROM documents)
    SELECT CAST(count(text) AS BIGINT) AS n_values, CAST(max(length(text)) AS BIGINT) AS max_chars, CAST(max(strlen(text)) AS BIGINT) AS max_bytes,
    CAST(count(*) - count(text) AS BIGINT) AS n_nulls, count(DISTINCT text) = count(text) AS all_different FROM t"""
)
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _ = profile.profile(table(spark, sf_dir, "documents").select("text"), CONFIG, exact=True)
    s = stats["text"]
    return spark.createDataFrame([(s.values, s.length, s.bytes, s.nulls, s.distinct == s.values)], "n_values long, max_chars long, max_bytes long, n_nulls long, all_different boolean")


SAMPLED = ("o_orderkey", "o_custkey")
WIDTH_SQL = """CASE WHEN min({0}) >= -128 AND max({0}) <= 127 THEN 'tinyint' WHEN min({0}) >= -32768 AND max({0}) <= 32767 THEN 'smallint'
  WHEN min({0}) >= -2147483648 AND max({0}) <= 2147483647 THEN 'int' ELSE 'bigint' END"""


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {WIDTH_SQL.format(c)} AS type, count(DISTINCT {c}) = count(*) AS is_unique FROM orders" for c in SAMPLED))
def sampled_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    header, _, _ = profile.infer_header(table(spark, sf_dir, "orders").select(*SAMPLED), CONFIG.with_(sampling=0.1, sampling_minimum=100))
    return spark.createDataFrame([(n, c.type, c.unique) for n, c in header.items()], "column_name string, type string, is_unique boolean")


# Typing.  The mixed texts cover every branch; they are made from keys by the same rule in both languages.

MIXED = {
    0: ("cast(k % 300 - 150 as string)", "CAST(k % 300 - 150 AS VARCHAR)"),
    1: ("concat(cast(k % 1000 as string), '.', lpad(cast(k % 100 as string), 2, '0'))", "concat(CAST(k % 1000 AS VARCHAR), '.', lpad(CAST(k % 100 AS VARCHAR), 2, '0'))"),
    2: ("concat('0', cast(k as string))", "concat('0', CAST(k AS VARCHAR))"),
    3: ("case when k % 2 = 0 then 'TRUE' else 'false' end", "CASE WHEN k % 2 = 0 THEN 'TRUE' ELSE 'false' END"),
    4: ("concat('2024-0', cast(k % 9 + 1 as string), '-15')", "concat('2024-0', CAST(k % 9 + 1 AS VARCHAR), '-15')"),
    5: ("concat('2024-01-1', cast(k % 10 as string), 'T10:30:00Z')", "concat('2024-01-1', CAST(k % 10 AS VARCHAR), 'T10:30:00Z')"),
    6: ("concat('{\"k\": ', cast(k as string), '}')", "concat('{\"k\": ', CAST(k AS VARCHAR), '}')"),
    7: ("concat('word ', cast(k as string))", "concat('word ', CAST(k AS VARCHAR))"),
    8: ("concat(cast(k % 9 + 1 as string), 'e', cast(k % 20 as string))", "concat(CAST(k % 9 + 1 AS VARCHAR), 'e', CAST(k % 20 AS VARCHAR))"),
    9: ("concat('1', cast(k % 10 as string), ':45')", "concat('1', CAST(k % 10 AS VARCHAR), ':45')"),
    10: ("cast(k * 1000003 as string)", "CAST(k * 1000003 AS VARCHAR)"),
    11: ("case when k % 3 = 0 then '' when k % 3 = 1 then 'null' end", "CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'null' END"),
    12: ("concat('2024/01/1', cast(k % 10 as string), ' 08:15')", "concat('2024/01/1', CAST(k % 10 AS VARCHAR), ' 08:15')"),
}
MIXED_SQL = "(SELECT k, k % 13 AS m, CASE k % 13 " + " ".join(f"WHEN {m} THEN {sql}" for m, (_, sql) in MIXED.items()) + " END AS v FROM (SELECT event_id AS k FROM events))"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "case k % 13 " + " ".join(f"when {m} then {e}" for m, (e, _) in MIXED.items()) + " end"
    return table(spark, sf_dir, "events").selectExpr("event_id as k").selectExpr("k", "k % 13 as m", f"{text} as v")


TYPE_SQL = r"""
CASE WHEN v IS NULL OR v IN ('', '\N', 'null') THEN NULL
     WHEN regexp_full_match(v, '-?0[0-9]+') THEN 'varchar'
     WHEN regexp_full_match(v, '-?[0-9]{1,3}([.,]?[0-9]{3})*') AND NOT contains(v, '.') AND NOT contains(v, ',') THEN
       CASE WHEN TRY_CAST(v AS HUGEINT) BETWEEN -128 AND 127 THEN 'tinyint' WHEN TRY_CAST(v AS HUGEINT) BETWEEN -32768 AND 32767 THEN 'smallint'
            WHEN TRY_CAST(v AS HUGEINT) BETWEEN -2147483648 AND 2147483647 THEN 'int' ELSE 'bigint' END
     WHEN regexp_full_match(v, '-?[0-9]+[.][0-9]+') THEN 'decimal'
     WHEN regexp_full_match(lower(v), 'true|false') THEN 'boolean'
     WHEN regexp_full_match(v, '-?[0-9]+([.][0-9]+)?[eE][-+]?[0-9]+') THEN 'exponent'
     WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z') THEN 'datetimetz'
     WHEN regexp_full_match(v, '[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9:]{5,8}') THEN 'datetime'
     WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date'
     WHEN regexp_full_match(v, '[0-9]{1,2}:[0-9]{2}') THEN 'time'
     WHEN starts_with(v, '{') THEN 'json' ELSE 'varchar' END
"""


@query(f"SELECT m, coalesce({TYPE_SQL}, 'none') AS type, CAST(count(*) AS BIGINT) AS n FROM {MIXED_SQL} GROUP BY ALL")
def predict_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixed(spark, sf_dir)
    kind = F.coalesce(typing.value_type(F.col("v"), df.schema["v"].dataType), F.lit("none"))
    return df.groupBy("m", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH t AS (SELECT unnest([m, (m + 12) % 13]) AS g, {TYPE_SQL} AS t FROM {MIXED_SQL}),
    s AS (SELECT g, list(DISTINCT t) FILTER (WHERE t IS NOT NULL) AS ts FROM t GROUP BY g),
    n AS (SELECT g, ts, list_has_any(ts, ['varchar', 'text']) AS txt, list_has_any(ts, ['json']) AS js, list_has_any(ts, ['date', 'time', 'datetime', 'datetimetz']) AS dt,
          list_has_any(ts, ['boolean', 'tinyint', 'smallint', 'int', 'bigint', 'decimal', 'exponent']) AS nm FROM s WHERE ts IS NOT NULL)
    SELECT g, CASE WHEN txt OR CAST(js AS INT) + CAST(dt AS INT) + CAST(nm AS INT) > 1 THEN 'varchar' WHEN js THEN 'json'
      WHEN dt THEN CASE WHEN len(ts) = 1 THEN ts[1] WHEN list_contains(ts, 'datetimetz') THEN 'datetimetz' ELSE 'datetime' END
      WHEN list_contains(ts, 'exponent') THEN 'exponent' WHEN list_contains(ts, 'decimal') THEN 'decimal' WHEN list_contains(ts, 'bigint') THEN 'bigint'
      WHEN list_contains(ts, 'int') THEN 'int' WHEN list_contains(ts, 'smallint') THEN 'smallint' WHEN list_contains(ts, 'tinyint') THEN 'tinyint' ELSE 'boolean' END AS type FROM n"""
)
def collate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mixed(spark, sf_dir).withColumn("g", F.explode(F.expr("array(m, (m + 12) % 13)")))  # each group has the values of two kinds
    code = F.create_map(*[F.lit(x) for t, i in CODE.items() for x in (t, 1 << i)])
    mask = F.bit_or(F.element_at(code, typing.value_type(F.col("v"), df.schema["v"].dataType)))
    return df.groupBy("g").agg(mask.alias("mask")).select("g", typing.collate_mask(F.col("mask")).alias("type")).filter("type is not null")


# Numbers


def _formatted(us: bool) -> Column:
    text = F.format_number(F.round(F.col("l_extendedprice") * 100).cast("long") / 100, 2)
    return text if us else F.translate(text, ",.", ".,")


NUMBER_SQL = """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber,
  CAST(CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0 AS DECIMAL(18,2)) AS us, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0 AS DECIMAL(18,2)) AS eu FROM lineitem"""


@query(NUMBER_SQL)
def normalize_number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", _formatted(True).alias("us"), _formatted(False).alias("eu"))
    read = [numbers.normalize_number(F.col(c)).try_cast("decimal(18,2)").alias(c) for c in ("us", "eu")]
    return df.select("l_orderkey", "l_linenumber", *read)


VOTE_SQL = """WITH c AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_linenumber % 2 = 0 AS us FROM lineitem)
SELECT CAST(count(*) FILTER (WHERE us) AS BIGINT) AS us_votes, CAST(count(*) FILTER (WHERE NOT us) AS BIGINT) AS eu_votes FROM c"""


@query(VOTE_SQL)
def separator_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.col("l_linenumber") % 2 == 0
    return numbers.count_votes(spread(table(spark, sf_dir, "lineitem")).select(F.when(us, _formatted(True)).otherwise(_formatted(False)).alias("price")))


@query(
    """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, d AS swiss, d AS backtick, d AS spaced, d AS fixed
    FROM (SELECT *, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0 AS DECIMAL(18,2)) AS d FROM lineitem)"""
)
def number_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    us, eu = _formatted(True), _formatted(False)
    texts = {"swiss": F.translate(us, ",", "'"), "backtick": F.translate(us, ",", "`"), "spaced": F.translate(us, ",", " ")}
    read = [numbers.normalize_number(t).try_cast("decimal(18,2)").alias(n) for n, t in texts.items()]
    read.append(numbers.normalize_number(eu, (".", ",")).try_cast("decimal(18,2)").alias("fixed"))
    return spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", *read)


@query(
    "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,3)), 1) AS DECIMAL(18,1)) AS rounded, "
    "CAST(round(CAST(-l_extendedprice AS DECIMAL(18,3)), 1) AS DECIMAL(18,1)) AS rounded_negative FROM lineitem"
)
def round_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,3)")
    return df.select(
        "l_orderkey", "l_linenumber", numbers.round_half_up(price.cast("string"), 1).cast("decimal(18,1)").alias("rounded"),
        numbers.round_half_up((-price).cast("string"), 1).cast("decimal(18,1)").alias("rounded_negative"),
    )


# Dates, booleans, texts


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS us, CAST(o_orderdate AS DATE) AS wordy,
    CAST(o_orderdate AS TIMESTAMP) - INTERVAL 90 MINUTE AS shifted FROM orders"""
)
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    texts = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "wordy": "MMM dd, yyyy hh:mm a"}
    df = spread(table(spark, sf_dir, "orders")).select(
        "o_orderkey", *[F.date_format(d, f).alias(n) for n, f in texts.items()], F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")).alias("shifted")
    )
    return df.select("o_orderkey", *[dates.to_date(F.col(n)).alias(n) for n in texts], dates.to_datetime(F.col("shifted")).alias("shifted"))


# Wall clocks of New York around both changes of 2024, a minute and a second apart: skipped hours, repeated hours and others.
WALL = "CASE WHEN event_id % 2 = 0 THEN TIMESTAMP{0} '2024-03-09 12:00:00' ELSE TIMESTAMP{0} '2024-11-02 12:00:00' END + {1}"


@query(
    f"""WITH w AS (SELECT event_id, {WALL.format("", "to_seconds(event_id % 2000 * 61)")} AS w FROM events)
    SELECT event_id, w + INTERVAL 1 HOUR * CASE WHEN w >= TIMESTAMP '2024-03-10 02:00:00' AND w < TIMESTAMP '2024-11-03 02:00:00' THEN 4 ELSE 5 END AS utc,
    w - INTERVAL 330 MINUTE AS east, w AS plain, w + INTERVAL 90 MINUTE AS stated FROM w"""
)
def source_timezone(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = F.expr(WALL.format("_NTZ", "make_dt_interval(0, 0, 0, event_id % 2000 * 61)"))
    df = table(spark, sf_dir, "events").select("event_id", F.date_format(wall, "yyyy-MM-dd HH:mm:ss").alias("text"))
    text, zoned = F.col("text"), F.concat("text", F.lit("-01:30"))
    return df.select(
        "event_id", dates.to_datetime(text, "America/New_York").alias("utc"), dates.to_datetime(text, "Asia/Kolkata").alias("east"),
        dates.to_datetime(text).alias("plain"), dates.to_datetime(zoned, "America/New_York").alias("stated"),
    )


@query(
    "SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS word FROM labels"
)
def boolean_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("Yes", " f ", "T", "no", "maybe")]), (F.col("doc_id") % 5 + 1).cast("int"))
    texts = [values.boolean_of(F.col(c).cast("string")).alias(c) for c in ("quality", "toxic")]
    return table(spark, sf_dir, "labels").select("doc_id", *texts, values.boolean_of(word).alias("word"))


@query("SELECT doc_id, text AS clean, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("\u0000"), F.col("text"), F.lit("\u0000"))
    clean = values.sanitize(dirty)
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"), F.octet_length(clean).cast("long").alias("bytes"))


COPY_SQL = r"replace(replace(replace(replace({0}, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r')"


@query(
    f"SELECT concat(CAST(doc_id AS VARCHAR), chr(9), coalesce({COPY_SQL.format('text')}, '\\N'), chr(9), coalesce({COPY_SQL.format('source')}, '\\N'), chr(9), '\\N') AS line FROM documents"
)
def copy_text_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(values.copy_line([F.col("doc_id").cast("string"), F.col("text"), F.col("source"), nothing]).alias("line"))


# Keys and headers

COMBOS = {"conversations": [["conv_id"], ["turn"], ["conv_id", "turn"], ["conv_id", "role"]]}


@query(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS combo, '{','.join(c)}' AS columns, CAST(count(*) AS BIGINT) AS groups, CAST(max(n) AS BIGINT) AS most "
        f"FROM (SELECT count(*) AS n FROM conversations GROUP BY {', '.join(c)})"
        for i, c in enumerate(COMBOS["conversations"])
    )
)
def composite_key_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.combination_counts(table(spark, sf_dir, "conversations"), COMBOS["conversations"])


# Columns of five tables that can be keys (no floats), in order, and whether they are whole numbers.
KEYED = {
    "orders": {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": 0, "o_orderpriority": 0},
    "customer": {"c_custkey": 1, "c_name": 0, "c_nationkey": 1, "c_mktsegment": 0},
    "part": {"p_partkey": 1, "p_name": 0, "p_brand": 0, "p_type": 0, "p_size": 1},
    "supplier": {"s_suppkey": 1, "s_name": 0, "s_nationkey": 1},
    "nation": {"n_nationkey": 1, "n_name": 0, "n_regionkey": 1},
}
_CANDIDATES = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS name, {i} AS place, {whole} AS whole, count(DISTINCT {c}) = count(*) AS fits FROM {t}"
    for t, columns in KEYED.items()
    for i, (c, whole) in enumerate(columns.items())
)


@query(
    f"""SELECT table_name, name AS primary_key FROM ({_CANDIDATES}) WHERE fits
    QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY regexp_matches(name, '(^|_)id$') DESC, whole DESC, CASE WHEN whole = 1 THEN place ELSE length(name) END, place) = 1"""
)
def pk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("orders", "customer", "part", "supplier", "nation"):
        df = table(spark, sf_dir, name)
        header, stats, n = profile.infer_header(df, CONFIG)
        rows.append((name, ",".join(keys.predict_indexes(header, df, stats, n, CONFIG).primary_keys)))
    return spark.createDataFrame(rows, "table_name string, primary_key string")


GROUPED = "SELECT concat('g', event_id // 100) AS a, concat('z', event_id % 7) AS b, concat('p', event_id % 100) AS c FROM events"
_COMBOS = " UNION ALL ".join(
    f"SELECT {i} AS place, '{','.join(k)}' AS key, count(*) AS rows, count(DISTINCT ({', '.join(k)})) AS groups FROM ({GROUPED})"
    for i, k in enumerate(("a", "b", "c", "ab", "ac", "bc", "abc"))
)


@query(f"SELECT key FROM ({_COMBOS}) WHERE rows = groups ORDER BY place LIMIT 1")
def key_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr("concat('g', event_id div 100) AS a", "concat('z', event_id % 7) AS b", "concat('p', event_id % 100) AS c")
    header, stats, n = profile.infer_header(df, CONFIG)
    return spark.createDataFrame([(",".join(keys.predict_indexes(header, df, stats, n, CONFIG).primary_keys),)], "key string")


_SEMANTICS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {whole} AS whole, count(DISTINCT {c}) AS n, count({c}) AS rows, {f'max({c})' if whole else 'NULL'} AS most FROM customer"
    for c, whole in KEYED["customer"].items()
)


@query(
    f"""SELECT column_name, CASE WHEN n = rows THEN 'identifier' WHEN n * 10 >= rows * 9 AND whole = 0 THEN 'text'
    WHEN n * 5 <= rows AND (whole = 0 OR most > 32767) THEN 'dimension' WHEN whole = 1 THEN 'measure' ELSE 'text' END AS hint FROM ({_SEMANTICS})"""
)
def column_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").drop("c_acctbal")
    header, stats, n = profile.infer_header(df, CONFIG)
    header = keys.predict_indexes(header, df, stats, n, CONFIG)
    return spark.createDataFrame([(s["column"], s["hint"]) for s in shape.semantics(header)], "column_name string, hint string")


@query(
    f"""WITH d AS (SELECT {WIDTH_SQL.format("c_nationkey")} AS was, {WIDTH_SQL.format("c_nationkey * 1000")} AS now, length(max(c_nationkey)::VARCHAR) AS digits,
      length((max(c_nationkey) * 1000)::VARCHAR) AS more FROM customer),
    o AS (SELECT column_name, column_name = 'c_mktsegment' AS fresh, column_name = 'c_nationkey' AS number FROM information_schema.columns
      WHERE table_name = 'customer' AND column_name IN ('c_nationkey', 'c_name', 'c_mktsegment'))
    SELECT DISTINCT column_name, CASE WHEN fresh THEN 'added' WHEN number AND (was <> now OR more > digits) THEN 'widened' ELSE 'kept' END AS change FROM o, d"""
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_mktsegment")
    new, _, _ = profile.infer_header(df.withColumn("c_nationkey", F.col("c_nationkey") * 1000), CONFIG)
    old, _, _ = profile.infer_header(df.drop("c_mktsegment"), CONFIG)
    changes, merged = diff.compare(old, new)
    rows = [(n, "added" if n in changes.add else "widened" if n in changes.modify else "kept") for n in merged]
    return spark.createDataFrame(rows, "column_name string, change string")


# Loading

# A batch as large as the table: rows of even keys are changed ones, the others come under new keys.
STAGED_ORDERS = """(SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 1000000000 END AS o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"""
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    target = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    staged = target.withColumn("o_totalprice", F.when(key % 4 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1))
    return target, staged.withColumn("o_orderkey", F.when(key % 2 == 0, key).otherwise(key + 1_000_000_000))


@query(f"SELECT {ORDER_COLUMNS} FROM {STAGED_ORDERS} UNION ALL SELECT {ORDER_COLUMNS} FROM orders o WHERE NOT EXISTS (SELECT 1 FROM {STAGED_ORDERS} s WHERE s.o_orderkey = o.o_orderkey)")
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, staged = _orders(spark, sf_dir)
    return merge.upsert(target, staged, ["o_orderkey"])


@query(
    f"""SELECT coalesce(o.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, o.o_custkey) AS o_custkey, coalesce(s.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
    coalesce(o.o_totalprice, s.o_totalprice) AS o_totalprice, coalesce(s.o_orderdate, o.o_orderdate) AS o_orderdate, coalesce(s.o_orderpriority, o.o_orderpriority) AS o_orderpriority
    FROM orders o FULL JOIN {STAGED_ORDERS} s ON o.o_orderkey = s.o_orderkey"""
)
def upsert_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, staged = _orders(spark, sf_dir)
    return merge.upsert(target, staged, ["o_orderkey"], keep=["o_totalprice"])


@query(f"SELECT {ORDER_COLUMNS} FROM orders UNION ALL SELECT {ORDER_COLUMNS} FROM {STAGED_ORDERS} s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE s.o_orderkey = o.o_orderkey)")
def insert_only_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, staged = _orders(spark, sf_dir)
    return merge.upsert(target, staged, ["o_orderkey"], insert_only=True)


@query(f"SELECT o.* FROM orders o JOIN {STAGED_ORDERS} s ON o.o_orderkey = s.o_orderkey WHERE o.o_totalprice IS DISTINCT FROM s.o_totalprice OR o.o_orderstatus IS DISTINCT FROM s.o_orderstatus")
def before_image_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, staged = _orders(spark, sf_dir)
    return merge.before_image(target, staged, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query(
    """WITH s AS (SELECT s_suppkey + 3 AS s_suppkey, s_name, s_nationkey FROM supplier)
    SELECT 's_name' AS unique_index, CAST(sum(CASE WHEN t.s_name = s.s_name THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM supplier t JOIN s ON t.s_suppkey <> s.s_suppkey
    UNION ALL SELECT 's_nationkey' AS unique_index, CAST(sum(CASE WHEN t.s_nationkey = s.s_nationkey THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM supplier t JOIN s ON t.s_suppkey <> s.s_suppkey"""
)
def conflict_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "supplier")
    staged = target.withColumn("s_suppkey", F.col("s_suppkey") + 3)
    return merge.unique_conflicts(target, staged, ["s_suppkey"], [["s_name"], ["s_nationkey"]])


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return merge.last_by_key(df, ["user_id"], [F.col("event_id")])


@query(
    "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'amount: not a int' WHEN event_id % 13 = 0 THEN 'label: longer than 3' "
    "WHEN value < 10 THEN 'check value fails' END AS error_message FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 OR value < 10"
)
def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(table(spark, sf_dir, "events")).select(
        "event_id", "value", F.when(F.col("event_id") % 11 == 0, "many").otherwise("7").alias("amount"), F.when(F.col("event_id") % 13 == 0, "long one").otherwise("ok").alias("label")
    )
    header = Header({"event_id": ColumnDef("bigint", primary=True), "value": ColumnDef("double"), "amount": ColumnDef("int"), "label": ColumnDef("varchar", 3)})
    typed = {n: values.store_value(F.col(n), df.schema[n].dataType, c.type, c.length, c.decimal, CONFIG) for n, c in header.items()}
    _, bad = rejects.split_rows(df, rejects.reason_of(df, typed, header, {"value": "value >= 10"}))
    return bad.select("event_id", "error_message")


@query(
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS int_text, CAST(round(o_totalprice) AS BIGINT) AS double_int, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date_text,
    CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS bool_int, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS text_bool FROM orders"""
)
def type_widen_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("int_text"), F.col("o_totalprice").alias("double_int"), F.col("o_orderdate").alias("date_text"),
        (F.col("o_orderkey") % 2 == 0).alias("bool_int"), F.element_at(F.array(F.lit("on"), F.lit("No"), F.lit("?")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("text_bool"),
    )
    old = Header({"o_orderkey": ColumnDef("bigint"), "int_text": ColumnDef("bigint"), "double_int": ColumnDef("double"), "date_text": ColumnDef("datetime"), "bool_int": ColumnDef("boolean"), "text_bool": ColumnDef("varchar")})
    new = Header({"o_orderkey": ColumnDef("bigint"), "int_text": ColumnDef("varchar"), "double_int": ColumnDef("bigint"), "date_text": ColumnDef("varchar"), "bool_int": ColumnDef("int"), "text_bool": ColumnDef("boolean")})
    return evolve.project(df, old, new)


# Shapes


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_extract_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reshape.parse_json_column(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k bigint")
    return reshape.extract_nested(df, "props", ["event_id"]).select("event_id", "k")


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, e[i] AS value FROM (SELECT vec_id, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def nested_array_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.extract_values(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])


@query(
    "SELECT 1 AS part, o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS a, o_orderstatus AS b FROM orders UNION ALL SELECT 2 AS part, o_orderkey AS k, o_orderpriority AS a, NULL AS b FROM orders"
)
def vertical_split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    key = {"o_orderkey": ColumnDef("bigint", primary=True)}
    header = Header({**key, "o_custkey": ColumnDef("bigint"), "o_orderstatus": ColumnDef("varchar", 6500), "o_orderpriority": ColumnDef("varchar", 4000)})
    one, two = list(reshape.split_columns(df, shape.split_parts("orders", header, {}, CONFIG)).values())
    first = one.select(F.lit(1).alias("part"), F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("a"), F.col("o_orderstatus").alias("b"))
    return first.unionByName(two.select(F.lit(2).alias("part"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("a"), F.lit(None).cast("string").alias("b")))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS surrogate FROM events")
def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.number_new_rows(table(spark, sf_dir, "events").select("event_id"), "surrogate", 1, [F.col("event_id")])


# Whole loads


def _engine(spark: SparkSession, **options: object):
    return Engine(spark, new_path(spark, "store"), LoadConfig(add_timestamps=False, **options))


def _loaded(result) -> None:
    if not result.success:
        raise RuntimeError(result.error)


ORDERS_SQL = f"SELECT {ORDER_COLUMNS} FROM orders"


def _as_orders(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])


@query(ORDERS_SQL)
def chunked_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    engine = _engine(spark)
    _loaded(engine.load_chunks("orders", (df.filter(f"o_orderkey % 4 = {i}") for i in range(4)), ["o_orderkey"]))
    return _as_orders(engine.read("orders"), df)


@query(ORDERS_SQL)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    session = (engine := _engine(spark)).open_stream("orders", ["o_orderkey"])
    for i in range(2):
        session.write(df.filter(f"o_orderkey % 2 = {i}"))
    _loaded(session.end())
    return _as_orders(engine.read("orders"), df)


@query(SQL["upsert_orders"])
def load_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, staged = _orders(spark, sf_dir)
    engine = _engine(spark, add_history=True, drop_unique_constraints=True)
    for batch in (target, staged, staged):
        _loaded(engine.load("orders", batch, ["o_orderkey"]))
    return _as_orders(engine.read("orders"), target)


@query(SQL["before_image_orders"])
def load_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, staged = _orders(spark, sf_dir)
    engine = _engine(spark, add_history=True, drop_unique_constraints=True)
    for batch in (target, staged, staged):
        _loaded(engine.load("orders", batch, ["o_orderkey"]))
    return _as_orders(engine.read("orders__history"), target)


@query(
    f"""SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderkey % 100 <> 0
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 100 = 0"""
)
def small_batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small batch on a table of several files: files without a key of it stay."""
    df = table(spark, sf_dir, "orders")
    engine = _engine(spark, drop_unique_constraints=True)
    _loaded(engine.load_chunks("orders", (df.filter(f"o_orderkey % 3 = {i}") for i in range(3)), ["o_orderkey"]))
    _loaded(engine.load("orders", df.filter("o_orderkey % 100 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)))
    return _as_orders(engine.read("orders"), df)


@query(ORDERS_SQL)
def concurrent_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one table at the same time: both stay."""
    df = table(spark, sf_dir, "orders")
    path = _engine(spark).store.path
    engines = [Engine(spark, path, LoadConfig(add_timestamps=False, drop_unique_constraints=True)) for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        for result in pool.map(lambda i: engines[i].load("orders", df.filter(f"o_orderkey % 2 = {i}"), ["o_orderkey"]), range(2)):
            _loaded(result)
    return _as_orders(engines[0].read("orders"), df)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 ELSE o_orderkey * 1000 END AS v FROM orders")
def chunk_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later chunks widen a column that the first made narrow."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 ELSE o_orderkey * 1000 END").alias("v"))
    engine = _engine(spark)
    _loaded(engine.load_chunks("drift", (df.filter(f"o_orderkey % 2 = {i}") for i in range(2)), ["o_orderkey"]))
    return engine.read("drift").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("v").cast("long").alias("v"))


@query("SELECT o_orderkey, CAST(o_orderkey % 300 AS BIGINT) AS v FROM orders WHERE o_orderkey % 300 <> 13")
def degradation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a declared column does not hold widen it; a check refuses others."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 300).cast("string").alias("v"))
    engine = _engine(spark, rejected_rows_table="rejects", checks={"v": "v <> '13'"})
    declared = {"o_orderkey": ColumnDef("bigint", primary=True), "v": ColumnDef("tinyint", 2)}
    _loaded(engine.load("t", df, assume=declared))
    return engine.read("t").select("o_orderkey", F.col("v").cast("long").alias("v"))


@query(
    """WITH s AS (SELECT s_suppkey + 3 AS s_suppkey, s_name, s_nationkey FROM supplier)
    SELECT s.s_suppkey FROM s WHERE EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = s.s_nationkey AND t.s_suppkey % 2 = s.s_suppkey % 2 AND t.s_suppkey <> s.s_suppkey)"""
)
def composite_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a unique constraint over two columns refuses."""
    target = table(spark, sf_dir, "supplier").withColumn("parity", F.col("s_suppkey") % 2)
    staged = target.withColumn("s_suppkey", F.col("s_suppkey") + 3).withColumn("parity", F.col("s_suppkey") % 2)
    return merge.conflicting_rows(target, staged, ["s_suppkey"], ["s_nationkey", "parity"]).select("s_suppkey")


_CUSTOMER = "SELECT column_name, ordinal_position AS at FROM information_schema.columns WHERE table_name = 'customer'"


def _customer_twice(spark: SparkSession, sf_dir: str):
    df = table(spark, sf_dir, "customer")
    engine = _engine(spark, schema_history=True)
    _loaded(engine.load("customer", df.drop("c_mktsegment"), ["c_custkey"]))
    _loaded(engine.load("customer", df, ["c_custkey"]))
    return engine


@query(
    f"""SELECT 'customer' AS table_name, CAST(v AS BIGINT) AS version, 'applied' AS status,
    (SELECT string_agg(DISTINCT column_name, ',' ORDER BY column_name) FROM ({_CUSTOMER}) WHERE v = 2 OR column_name <> 'c_mktsegment') AS columns FROM (VALUES (1), (2)) t(v)"""
)
def schema_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _customer_twice(spark, sf_dir).catalog.history_frame("customer")
    names = F.array_join(F.array_sort(F.map_keys(F.from_json("new_schema", "map<string, map<string, string>>"))), ",")
    return history.select("table_name", "version", "status", names.alias("columns"))


@query(
    f"""WITH c AS (SELECT DISTINCT column_name FROM ({_CUSTOMER}))
    SELECT 'first' AS asked, CAST(count(*) AS BIGINT) AS n_columns FROM c WHERE column_name <> 'c_mktsegment' UNION ALL SELECT 'latest' AS asked, CAST(count(*) AS BIGINT) AS n_columns FROM c"""
)
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema in force when the first migration was done, and the latest."""
    catalog = _customer_twice(spark, sf_dir).catalog
    first = catalog.schema_at("customer", catalog.events("customer")[0]["time"])
    return spark.createDataFrame([("first", len(first)), ("latest", len(catalog.latest("customer")["new_schema"]))], "asked string, n_columns long")
