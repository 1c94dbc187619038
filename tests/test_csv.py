"""Typed CSV: missing values, types, rows that don't parse."""

import datetime

import pytest

from millrace.sources.readers import infer_text_types, load_csv, load_table

TEXT = '''whole,part,flag,day,time,mixed,blank,odd name,_record
1,1.5,true,2024-01-02,2024-01-02 03:04:05,x,NA,"a,b",r
NA,3,FALSE,n/a,2024-01-03,2,,"line
break",r
-3,1e3, true ,2024-02-30x,null,N/A,nan," spaced ",r
too,few
9,.5,false,2024-03-01,2024-01-04,3,NULL,"say ""hi""",r,one too many
+4,NaN,<NA>,2024-03-02,2024-05-06 07:08,,None,z,r
'''


@pytest.fixture
def path(tmp_path):
    (tmp_path / "t.csv").write_text(TEXT)
    return str(tmp_path / "t.csv")


def test_types_and_missing_values(spark, path):
    rows, broken = load_csv(spark, path)
    assert dict(rows.dtypes) == {"whole": "bigint", "part": "double", "flag": "boolean", "day": "string", "time": "timestamp", "mixed": "string", "blank": "string", "odd name": "string", "_record": "string"}
    got = rows.collect()
    assert [r.whole for r in got] == [1, None, -3, 4] and [r.part for r in got] == [1.5, 3.0, 1000.0, None] and [r.flag for r in got] == [True, False, True, None]
    assert [r.mixed for r in got] == ["x", "2", None, None] and {r.blank for r in got} == {None}
    assert [r["odd name"] for r in got] == ["a,b", "line\nbreak", " spaced ", "z"] and got[0].time == datetime.datetime(2024, 1, 2, 3, 4, 5) and got[1].time == datetime.datetime(2024, 1, 3)
    assert sorted(r.record.split(",")[0] for r in broken.collect()) == ["9", "too"]
    assert load_table(spark, path).schema == rows.schema


def test_days_and_other_types(spark):
    df = spark.createDataFrame([("2024-01-02", "007", "1d", "9999999999999999999"), (None, "2", "2", "1")], "day string, code string, suffix string, large string")
    assert infer_text_types(df) == {"day": "date", "code": "bigint", "suffix": "string", "large": "double"}
    assert infer_text_types(df.where("false")) == dict.fromkeys(df.columns, "string") and infer_text_types(df.select()) == {}


def test_no_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    rows, broken = load_csv(spark, str(tmp_path / "e.csv"))
    assert rows.dtypes == [("a", "string"), ("b", "string")] and rows.count() == 0 and broken.count() == 0
