"""Value-level rules: typing, numbers, dates, texts."""

from __future__ import annotations

import itertools
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import dates, numbers, typing, values
from lakeloom.functions import typesystem as ts


def column(spark, cases, expression):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string").coalesce(1)
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


TYPES = {
    "tinyint": ["127", "-128", "0", "1", "10"],
    "smallint": ["32767", "-32768", "128"],
    "int": ["2147483647", "2,147,483,647", "2.147.483.647", "-2147483648", "1010001010", "20240115"],
    "bigint": ["9223372036854775807", "-9223372036854775808", "9,223,372,036,854,775,807"],
    "decimal": ["123.45", "123,45", "1,234,567.89", "1,234,567.89012345", "1.234.567,89", "1.234.567,89012345", "5,25", "1,234", "-0.5"],
    "exponent": ["1.23e10", "-3.5E-5", "1e5"],
    "boolean": ["true", "True", "FALSE"],
    "datetimetz": [
        "2023-01-01T12:00:00Z", "2023-01-01T12:00:00.123Z", "2023-01-01 12:00:00+02:00", "/Date(1700000000000+0000)/", "Mon Jan 15 2024 10:00:00 GMT+0100",
        "Jan 15, 2024 10:30 AM EST", "20240115T10:00:00Z", '"2024-01-15T12:00:00.000Z"',
    ],
    "datetime": ["2023-01-01 12:00:00", "2024-01-15T10:30", "/Date(-1700000000000)/", "Mon Jan 15 2024 10:00", "Jan 15, 2024 10:30 PM"],
    "date": ["2023-01-01", "12/31/2020", "31-12-2020", "2024.01.15"],
    "time": ["12:00:00", "9:30", "23:59"],
    "json": ['{"key": "value"}', "[1, 2]", '"quoted"', '  {"a": 1}'],
    "varchar": [
        "Hello", "{key: value}", "9223372036854775808", "01", "007", "07030", "0123456789", "Invalid Date", "2021-05-05 is my birthday", "call me 12-31-2020", ".5", "+5",
        " 5 ", "12,34,567", "1'234.50", "1.2.3", "2023-01-01\n", "25:00", "1,234.567.890",
    ],
    "text": ["a" * 7000],
    "mediumtext": ["a" * 70_000],
}


def test_value_types(spark):
    cases = [(t, v) for t, vs in TYPES.items() for v in vs]
    got = column(spark, [v for _, v in cases], typing.text_type)
    assert [(v[:40], g) for (_, v), g in zip(cases, got, strict=True)] == [(v[:40], t) for t, v in cases]
    assert column(spark, [None], typing.text_type) == [None]


def test_types_follow_the_separators(spark):
    assert column(spark, ["1,234", "1,234.5", "12345"], lambda v: typing.text_type(v, (",", "."))) == ["smallint", "decimal", "smallint"]
    assert column(spark, ["1.234", "1.234,5"], lambda v: typing.text_type(v, (".", ","))) == ["smallint", "decimal"]


def test_double_types(spark):
    df = spark.createDataFrame([(float(x),) for x in ("1", "300", "70000", "5000000000", "0.5", "1e21", "1e-7", "nan")], "v double")
    got = [r[0] for r in df.select(typing.double_type(F.col("v"))).collect()]
    assert got == ["tinyint", "smallint", "int", "bigint", "decimal", "exponent", "exponent", "varchar"]
    df = spark.createDataFrame([(x,) for x in (1e7, 1.0, 0.5, 123456.78, 1e-6, 0.0, -2.25)], "v double")
    assert [r[0] for r in df.select(numbers.js_number_text(F.col("v"))).collect()] == ["10000000", "1", "0.5", "123456.78", "0.000001", "0", "-2.25"]


NUMBERS = {
    "1,234,567.89": "1234567.89", "1,000.50": "1000.50", "1.234.567,89": "1234567.89", "1.000,50": "1000.50", "1 234 567.89": "1234567.89", "1`234`567.89": "1234567.89",
    "1'234'567.89": "1234567.89", "12'345.67": "12345.67", "1,23,45,678.90": "12345678.90", "1,234,567": "1234567", "1.234.567": "1234567", "1000.50": "1000.50", "1000,50": "1000.50",
    "12,34": "12.34", "-112.50": "-112.50", "-127": "-127", "1,234.567.89": None, "1.234,567.89": None, "12,34.56": None, "12.34,56": None, "1..234": None, "1,,234": None, "abc": None,
    "12a34": None, ",": None, ".": None, "": None, "1000": "1000", "9,223,372,036,854,775,807": "9223372036854775807", "1-2": None, "5.": "5", "1,234": "1.234", "-": None,
}


def test_normalize_number(spark):
    assert column(spark, list(NUMBERS), numbers.normalize_number) == list(NUMBERS.values())
    assert column(spark, ["1$234$567^89"], lambda v: numbers.normalize_number(v, ("$", "^"))) == ["1234567.89"]
    assert column(spark, ["1,234", "1.234"], lambda v: numbers.normalize_number(v, (",", "."))) == ["1234", "1.234"]
    assert column(spark, ["1.234", "1,5"], lambda v: numbers.normalize_number(v, (".", ","))) == ["1234", "1.5"]


def test_separator_votes(spark):
    us = ["1,234,567", "12.5", "19.99", "1.23", "1,234.56", "1234.5", "-1,234,567"]
    eu = ["1.234.567", "12,5", "19,99", "1.234,56", "1234,5", "-19,99"]
    none = ["1,234", "1.234", "123,456", "1234", "1.2.3", "192.168.1.1", "hello, world"]
    assert column(spark, us + eu + none, numbers.separator_vote) == ["us"] * len(us) + ["eu"] * len(eu) + [None] * len(none)


def test_rounding_is_half_away_from_zero(spark):
    cases = ["2.345", "-2.345", "2.3449", "9.995", "0.005", "1.10", "7", "123456789012345678901234567.855"]
    assert column(spark, cases, lambda v: numbers.round_half_up(v, 2)) == ["2.35", "-2.35", "2.34", "10", "0.01", "1.10", "7", "123456789012345678901234567.86"]


def test_join_is_a_semilattice(spark):
    for a, b in itertools.product(ts.ALL_TYPES, repeat=2):
        assert ts.join_types(a, b) == ts.join_types(b, a) and ts.join_types(a, a) == a
    some = ("tinyint", "decimal", "exponent", "varchar", "text", "json", "date", "time", "datetime", "datetimetz", "boolean")
    for a, b, c in itertools.product(some, repeat=3):
        assert ts.join_types(ts.join_types(a, b), c) == ts.join_types(a, ts.join_types(b, c))
    sets = [s for n in (1, 2, 3) for s in itertools.combinations(some, n)]
    df = spark.createDataFrame([(i, sum(1 << ts.CODE[t] for t in s)) for i, s in enumerate(sets)], "i int, m long")
    got = [r[0] for r in df.orderBy("i").select(typing.collate_mask(F.col("m"))).collect()]
    assert got == [ts.collate(s) for s in sets]


@pytest.mark.parametrize(
    ("types", "joined"),
    [
        (["int", "decimal"], "decimal"), (["smallint", "int", "bigint"], "bigint"), (["decimal", "exponent"], "exponent"), (["boolean", "binary"], "binary"),
        (["datetimetz", "datetime"], "datetimetz"), (["date", "time"], "datetime"), (["varchar", "text"], "text"), (["int", "varchar"], "varchar"),
        (["boolean", "datetime"], "varchar"), (["json", "int"], "varchar"), (["varchar", None, "varchar"], "varchar"), ([], "varchar"),
    ],
)
def test_collate(types, joined):
    assert ts.collate(types) == joined


def test_dates(spark):
    cases = ["2024-01-15T10:30:45.5Z", "2024-01-15 10:30", "01/02/2024", "31/12/2024", "Jan 15, 2024 10:30 PM", "Mon Jan 15 2024 10:00:05 GMT+0100", "/Date(1700000000000)/", "/Date(-1000)/", "20240115T10:00:00+05:30", "2024-02-30", "x"]
    got = column(spark, cases, dates.to_datetime)
    assert got == [
        datetime(2024, 1, 15, 10, 30, 45, 500_000), datetime(2024, 1, 15, 10, 30), datetime(2024, 1, 2), datetime(2024, 12, 31), datetime(2024, 1, 15, 22, 30),
        datetime(2024, 1, 15, 9, 0, 5), datetime(2023, 11, 14, 22, 13, 20), datetime(1969, 12, 31, 23, 59, 59), datetime(2024, 1, 15, 4, 30), None, None,
    ]
    assert column(spark, ["01/02/2024"], lambda v: dates.to_date(v, "DMY")) == [date(2024, 2, 1)]
    assert column(spark, ["2024-01-15T02:00:00+05:00"], dates.to_date) == [date(2024, 1, 15)]
    assert column(spark, ["9:30", "12:00:01", "2024-01-15T10:30:45.25Z"], dates.to_time_text) == ["09:30:00", "12:00:01", "10:30:45.25"]


def test_zone_changes(spark):
    cases = ["2024-01-15 12:00:00", "2024-07-15 12:00:00", "2024-11-03 01:30:00", "2024-03-10 02:30:00"]
    got = column(spark, cases, lambda v: dates.to_datetime(v, "America/New_York"))
    assert got == [datetime(2024, 1, 15, 17), datetime(2024, 7, 15, 16), datetime(2024, 11, 3, 5, 30), datetime(2024, 3, 10, 6, 30)]


def test_texts(spark):
    assert column(spark, ["a\tb\\c\nd\r", None, ""], values.copy_text) == ["a\\tb\\\\c\\nd\\r", "\\N", ""]
    assert column(spark, ["a\u0000b"], values.sanitize) == ["ab"]
    assert column(spark, ["Yes", " T ", "0", "off", "on"], values.boolean_of) == [True, True, False, None, None]
    assert column(spark, ["on", "N", "2"], lambda v: values.boolean_of(v, widen=True)) == [True, False, None]
    assert column(spark, ['{ "a" : 1 }', "{x"], values.json_text) == ['{"a":1}', "{x"]


def test_lengths_and_predicates():
    assert ts.merge_lengths("5,2", "3,4") == (5, 4) and ts.parse_length("12") == (12, 0) and ts.parse_length(None) == (0, 0)
    assert ts.is_text("json") and not ts.is_date("time") and ts.is_time("time") and ts.is_boolean("boolean") and ts.is_floating("exponent")
    assert ts.text_tier(10) == "varchar" and ts.text_tier(7000) == "text" and ts.text_tier(20_000_000) == "longtext"
    with pytest.raises(ValueError):
        ts.text_tier(4294967295)


def test_numbers_are_worked_out_once(spark):
    def plan(of):
        return spark.createDataFrame([("1",)], "v string").select(of(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()

    assert plan(typing.text_type).count("RLIKE") < 50
    assert plan(numbers.separator_vote).count("translate(") <= 2  # in the expression and in its name


def test_type_from_a_number_column(spark):
    texts = ["7", "-7", "300", "70000", "9223372036854775807", "9223372036854775808", "1.5", "1,234", "1,234.5", "1.234,5", "1'234", "1 234", "01", "1.2.3", "true", "1e5", "2020-01-02", "12:30", "{}", "a", "-", "5."]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for pair in (None, (",", "."), (".", ",")):
        made = df.withColumn("p", typing.number_form(F.col("v"), pair))
        rows = made.select("v", typing.text_type(F.col("v"), pair).alias("a"), typing.text_type(F.col("v"), pair, F.col("p")).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows)
        assert {r["v"]: r["a"] for r in rows} | {"9223372036854775807": "bigint", "9223372036854775808": "varchar", "300": "smallint", "70000": "int", "01": "varchar", "a": "varchar"} == {r["v"]: r["a"] for r in rows}
