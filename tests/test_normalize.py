"""Normalisers against plain-Python statements of the same rules (brute force)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from razonete.functions import dates, numbers, text

ACC = {"Á": "A", "À": "A", "Â": "A", "Ã": "A", "É": "E", "È": "E", "Ê": "E", "Í": "I", "Ì": "I", "Î": "I",
       "Ó": "O", "Ò": "O", "Ô": "O", "Õ": "O", "Ú": "U", "Ù": "U", "Û": "U", "Ç": "C"}


def py_clean(s):
    if s is None:
        return None
    s = s.upper()
    for a, b in ACC.items():
        s = s.replace(a, b)
    return " ".join(s.split())


def py_squash_upper(s):
    return None if s is None else " ".join(s.split()).upper()


def py_zfill(s):
    s = s.strip()
    return s.zfill(4) if re.fullmatch(r"[0-9]+", s) else s


ALPHABET = list("abcAZ09 \t\n\u00a0\u2003çãéÍõúÑßä-._")
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=25), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_clean_and_squash_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", text.clean_text("s").alias("c"), text.squash_upper("s").alias("u")).collect()
    for r in got:
        assert r.c == py_clean(r.s), repr(r.s)
        assert r.u == py_squash_upper(r.s), repr(r.s)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_normalisers_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    once = df.select(text.clean_text("s").alias("a"), text.squash_upper("s").alias("b"))
    twice = once.select("a", "b", text.clean_text("a").alias("a2"), text.squash_upper("b").alias("b2")).collect()
    for r in twice:
        assert r.a == r.a2 and r.b == r.b2


DIGITS = st.lists(st.one_of(st.text(alphabet="0123456789", min_size=1, max_size=6),
                            st.text(alphabet="0123 x", max_size=6)), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(DIGITS)
def test_zfill(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for r in df.select("s", text.zfill_branch("s").alias("z")).collect():
        assert r.z == py_zfill(r.s)
        if re.fullmatch(r"[0-9]+", r.s.strip()):
            assert len(r.z) >= 4


def test_flexible_dates_in_order(spark):
    rows = [("2024-02-01",), ("01/02/2024",), ("2024/02/01",), ("01-02-2024",), ("1/2/2024",), ("32/01/2024",), ("x",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r.d for r in df.select(dates.parse_date_flex("s").alias("d")).collect()]
    import datetime as dt

    feb1 = dt.date(2024, 2, 1)
    assert got == [feb1, feb1, feb1, feb1, feb1, None, None]


def test_numbers(spark):
    df = spark.createDataFrame([("1.000,50",), ("1,5",), ("2.25",), ("abc",), (None,)], "s string")
    got = df.select(numbers.parse_valor("s").alias("a"), numbers.parse_valor_br("s").alias("b")).collect()
    assert [r.a for r in got] == [None, None, 2.25, None, None]
    assert [r.b for r in got] == [1000.5, 1.5, 2.25, None, None]


def test_display_formats(spark):
    from razonete.functions import format as fmt

    df = spark.createDataFrame([(1234.5,), (-1234.5,), (0.125,), (1.005,)], "v double")
    got = df.select(fmt.money_grouped("v").alias("g"), fmt.money_plain("v").alias("p")).collect()
    py = [("R$ " + f"{v:,.2f}", "R$ " + "%.2f" % v) for v in (1234.5, -1234.5, 0.125, 1.005)]
    assert [(r.g, r.p) for r in got] == py
    assert got[0].g == "R$ 1,234.50" and got[1].g == "R$ -1,234.50"
    hid = spark.createDataFrame([("nan",), (None,), ("NaN",), ("x",)], "s string")
    assert [r.h for r in hid.select(fmt.hide_missing("s").alias("h")).collect()] == ["", "", "NaN", "x"]
