import pytest
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.functions import text as X


def values(spark, rows, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column).collect()]


def test_trim_is_wide_and_anchored(spark):
    rows = [" \t a b 　", "", None, "﻿x\n"]
    assert values(spark, rows, X.trimmed(F.col("x"))) == ["a b", "", None, "x"]
    assert values(spark, ["skills\n", "skills"], X.matches(F.col("x"), "skills")) == [False, True]


def test_round4_goes_by_the_double(spark):
    assert values(spark, [0.00015, 0.75394999, 0.5], X.round4(F.col("x")), "double") == [0.0001, 0.7539, 0.5]


def test_distinct_ignoring_case_keeps_first_spelling(spark):
    assert values(spark, [["Ab", "aB", "c", "C", "d"]], X.distinct_ignoring_case(F.col("x")), "array<string>") == [["Ab", "c", "d"]]


def test_utf16_length(spark):
    assert values(spark, ["ab", "\U0001f600"], X.utf16_length(F.col("x"))) == [2, 2]


def test_to_number(spark):
    rows = ["", " 12 ", "1.5e3", "0x1F", "abc", "1e999", None, "-.5", "1d"]
    assert values(spark, rows, X.to_number(F.col("x"))) == [0.0, 12.0, 1500.0, 31.0, None, None, None, -0.5, None]


@pytest.mark.parametrize(("text", "want"), [("+1 (415) 555-2671", "+14155552671"), ("not-a-phone", None), ("", None), (None, None), ("415-555-2671", None), ("+999 1", None)])
def test_phone(spark, text, want):
    assert values(spark, [text], N.phone(F.col("x"))) == [want]


def test_phone_of_a_calling_code_without_a_row(spark):
    assert values(spark, ["+359 2 123 4567", "+234 803 123 4567", "+210 123456", "+359 12", "+234 12345678901"], N.phone(F.col("x"))) == ["+35921234567", "+2348031234567", "+210123456", None, None]


def test_phone_default_region(spark):
    assert values(spark, ["415-555-2671", "1 415 555 2671", "+44 20 7183 8750"], N.phone(F.col("x"), "US")) == ["+14155552671", "+14155552671", "+442071838750"]


def test_employment_date(spark):
    cases = {
        "Mar 2021": "2021-03", "2021/07/15": "2021-07", "09-2020": "2020-09", "2021": None, "present": None, "not-a-date": None, " may  2020 ": "2020-05", "March 2021": None, "03/04/2021": "2021-03",
        "25/12/2020": "2020-12", "2021-13": None, "2023-02-29": None, "2024-02-29": "2024-02", "2021 Jan": "2021-01", "Jan, 2019": "2019-01", "Sept 2021": None, None: None, "": None, "7.2018": "2018-07",
    }
    assert values(spark, list(cases), N.employment_date(F.col("x"))) == list(cases.values())


def test_country_and_skill(spark):
    assert values(spark, ["U.S.A.", " uk ", "Korea, South", "jp", "xx", None, "constructor", ""], N.country(F.col("x"))) == ["US", "GB", "KR", "JP", None, None, None, None]
    assert values(spark, ["node.JS", "  C   lang ", "", None, "constructor"], N.skill(F.col("x"))) == ["Node.js", "C lang", None, None, "constructor"]


def test_targets(spark):
    rows = ["phones[0]", "a.country", "experience[1].start", "skills[0].name", "name", "skills[]", "headline", None, "skill", "skills[1].skill"]
    assert values(spark, rows, N.target_of(F.col("x"))) == ["phone", "country", "date", "skill", None, "skill", None, None, None, "skill"]


NESTED = "array<struct<name:string,skill:string,dates:struct<start:string>,end:int,extra:map<string,string>>>"


def test_normalising_goes_inside_lists_records_and_maps(spark):
    value = [("ts", "js", ("Mar 2021",), 2021, {"name": "js", "date": "07/2020", "b": "x"}), None, (None, None, None, None, None)]
    rows = spark.createDataFrame([(t, value) for t in ("skill", "date", None)], f"t string, x {NESTED}")
    got = {r[0]: r[1] for r in rows.select("t", N.by_target_within(F.col("t"), F.col("x"), rows.schema["x"].dataType)).collect()}
    skill, date, none = (got[t][0].asDict(True) for t in ("skill", "date", None))
    assert skill == {"name": "TypeScript", "skill": "js", "dates": {"start": "Mar 2021"}, "end": "2021", "extra": {"name": "js", "date": "07/2020", "b": "x"}}
    assert date == {"name": "ts", "skill": "js", "dates": {"start": "Mar 2021"}, "end": None, "extra": {"name": "js", "date": "07/2020", "b": "x"}}
    assert none == {"name": "ts", "skill": "js", "dates": {"start": "Mar 2021"}, "end": "2021", "extra": {"name": "js", "date": "07/2020", "b": "x"}}
    assert all(x[1] is None and x[2].extra is None and x[2].name is None for x in got.values())
    maps = spark.createDataFrame([(t, {"name": ["js", None], "date": ["07/2020"], "b": ["x"], "n": None}) for t in ("skill", "date")], "t string, x map<string,array<string>>")
    got = [r[0] for r in maps.select(N.by_target_within(F.col("t"), F.col("x"), maps.schema["x"].dataType)).collect()]
    assert got == [{"name": ["JavaScript", None], "date": ["07/2020"], "b": ["x"], "n": None}, {"name": ["js", None], "date": ["2020-07"], "b": ["x"], "n": None}]
    texts = spark.createDataFrame([("skill", ["ts", None, " "])], "t string, x array<string>")
    assert texts.select(N.by_target_within(F.col("t"), F.col("x"), texts.schema["x"].dataType)).first()[0] == ["TypeScript", None, None]


def test_serialising_nested_values(spark):
    kind = "struct<b:array<double>,Ca:boolean,a:map<string,array<int>>,c:struct<x:string>>"
    rows = spark.createDataFrame([(([1.0, 2.5, None, -0.0], True, {"z": [1, None], "Y": [], "y": None}, None),), (None,)], f"x {kind}")
    got = [r[0] for r in rows.select(X.serialised(F.col("x"), rows.schema["x"].dataType)).collect()]
    assert got == ["{a:{y:null,Y:[],z:[1,null]},b:[1,2.5,null,0],c:null,Ca:true}", "null"]
