"""Column functions on tiny frames: names, whitespace, null tokens, casts."""

import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapforge.functions import coerce as C
from snapforge.functions import names as N
from snapforge.functions import text as TX
from snapforge.constants import TABLE_NAME_STEPS


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def py_clean(name: str) -> str:
    """The fixed pattern table run through Python's regex engine (ASCII mode, like Java's)."""
    n = name[:-4] if name.lower().endswith(".csv") else name
    for pattern, repl in TABLE_NAME_STEPS:
        n = re.sub(pattern.replace("$", r"\Z"), repl, n, flags=re.ASCII)
    n = re.sub(r"^_+|_+\Z", "", n).lower()
    return "_" + n if re.match(r"[0-9]|\Z", n) else n


def test_clean_table_name_examples(spark):
    names = ["codes_20250731.csv", "My Table 31-07-2025.csv", "2024 budget", "__x--y__", "123abc", "", "Brand#12"]
    got = col_values(spark, names, N.clean_table_name)
    assert got == [py_clean(n) for n in names]
    assert got[0] == "codes_20250731"  # no word boundary after '_'
    assert got[1] == "my_table"
    assert got[4] == "_123abc"
    assert got[5] == "_"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab _-1920.csvCSV3", max_size=18), min_size=20, max_size=40))
def test_clean_table_name_property(spark, names):
    assert col_values(spark, names, N.clean_table_name) == [py_clean(n) for n in names]


def test_normalize_name(spark):
    got = col_values(spark, ["  First  Name\t", "a b", "__KEY"], N.normalize_name)
    assert got == ["first_name", "a_b", "__key"]
    up = col_values(spark, ["First Name", "__KEY", "a  b"], N.normalize_upload_name)
    assert up == ["first_name", "__KEY", "a__b"]


def test_short_table_name_and_user_tables(spark):
    assert col_values(spark, ["`c`.`s`.`t`", "s.t", "t", "a.b.c.d"], N.short_table_name) == ["s.t", "s.t", "t", "b.c"]
    got = col_values(spark, ["orders", "orders_staging", "x_current", "y_backup_1", " ", None], N.is_user_table)
    assert got == [True, False, False, False, False, False]


def test_strip_and_collapse(spark):
    assert col_values(spark, ["\t a \n", " ", None], TX.strip) == ["a", "", None]
    assert col_values(spark, ["a \t  b\n", "  x  "], TX.collapse_whitespace) == ["a b", "x"]


def test_null_tokens(spark):
    got = col_values(spark, ["NA", "None", "n/a", "x", "", " NA "], lambda c: TX.null_tokens(c))
    assert got == [None, None, None, "x", None, " NA "]
    got = col_values(spark, [" NaN ", "null", "value"], lambda c: TX.null_tokens(c, side="write"))
    assert got == [None, None, "value"]
    # the token set is a parameter: keep Namibia's code
    assert col_values(spark, ["NA"], lambda c: TX.null_tokens(c, tokens=["", "NULL"])) == ["NA"]


def test_coerce_date(spark):
    vals = ["2024-01-05", "2024/1/5", "5-1-2024", "05/01/2024", "31-02-2024", "31-12-9999", "0001-01-01", "", "abc", "24-1-5"]
    got = col_values(spark, vals, C.coerce_date)
    assert got == [
        dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 1, 5), None,
        dt.date(9999, 12, 31), dt.date(1, 1, 1), None, None, None,
    ]


def test_coerce_numbers_and_bools(spark):
    assert col_values(spark, [" 7 ", "3.0", "1e3", "1.5", "x", None], C.coerce_int) == [7, 3, 1000, None, None, None]
    assert col_values(spark, ["1,5", " 2.25 ", "nan", "1 EUR"], C.coerce_decimal) == [1.5, 2.25, None, None]
    assert col_values(spark, ["Yes", " t ", "0", None, "maybe"], C.coerce_bool) == [True, True, False, False, False]
    assert col_values(spark, ["TRUE", "0", "yes"], lambda c: C.coerce_bool(c, strict=True)) == [True, False, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t0123456789-/,.aE", max_size=12), min_size=10, max_size=30))
def test_cleaning_is_idempotent(spark, values):
    once = col_values(spark, values, TX.collapse_whitespace)
    twice = col_values(spark, once, TX.collapse_whitespace)
    assert once == twice
    d1 = col_values(spark, values, C.coerce_date)
    d2 = col_values(spark, [x.isoformat() if x else None for x in d1], C.coerce_date)
    assert d1 == d2


def test_user_schemas_hide_system_schemas(spark):
    got = col_values(spark, ["Sales", " INFORMATION_SCHEMA ", "app_metadata", "", None, "Testing", "tests"], N.is_user_schema)
    assert got == [True, False, False, False, False, False, True]
