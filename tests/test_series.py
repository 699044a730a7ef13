import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import series as S
from ledgerlark.sources import readers, sinks

POINTS = "series string, date date, value double"


def day(i):
    return datetime.date(2000, 1, 1) + datetime.timedelta(days=i)


def model(values):
    """The summary of one series in plain Python."""
    n = len(values)
    last, prev = values[-1], values[-2] if n > 1 else None
    prev = None if prev in (None, 0) else prev
    base = values[-13] if n > 12 else values[0]
    pct = None if prev is None else 100 * ((last - prev) / prev)
    year = None if base == 0 else 100 * ((last - base) / base)
    return last, prev, base, None if prev is None else last - prev, pct, last - base, year, "flat" if pct is None or -1 <= pct <= 1 else "up" if pct > 1 else "down"


def test_summary_against_a_model(spark):
    rng = random.Random(4)
    made = {f"s{n}": [rng.choice([0.0, -3.0, 100.0, 101.0, 99.0, rng.uniform(-5, 5)]) for _ in range(n)] for n in (1, 2, 3, 11, 12, 13, 14, 40)}
    points = [(s, day(i), v) for s, vs in made.items() for i, v in enumerate(vs)]
    rng.shuffle(points)
    got = {r["series"]: r for r in S.summary(spark.createDataFrame(points, POINTS)).collect()}
    for s, vs in made.items():
        r = got[s]
        have = (r["latest"], r["previous"], r["year_base"], r["period_change"], r["period_change_pct"], r["year_change"], r["year_change_pct"], r["trend"])
        for a, b in zip(have, model(vs), strict=True):
            assert a == b or isinstance(a, float) and math.isclose(a, b, rel_tol=1e-12), (s, have, model(vs))


def test_summary_of_nothing(spark):
    assert S.summary(spark.createDataFrame([], POINTS)).count() == 0


@pytest.mark.parametrize("falsy, want", [(False, [0.0, 5.0, 7.0, None]), (True, [3.0, 5.0, 7.0, None])])
def test_observed(spark, falsy, want):
    rows = spark.createDataFrame([(1, 0.0, 3.0), (2, 5.0, None), (3, None, 7.0), (4, None, None)], "k int, value double, close double")
    assert [r[0] for r in rows.orderBy("k").select(S.observed("value", "close", falsy)).collect()] == want


def test_since_keeps_what_lies_wholly_before(spark):
    rows = [("a", datetime.date(2018, 12, 31), 1.0), ("a", datetime.date(2019, 1, 1), 2.0), ("b", datetime.date(2010, 1, 1), 3.0), ("c", datetime.date(2010, 1, 1), 4.0), ("c", datetime.date(2020, 1, 1), 5.0)]
    points = spark.createDataFrame(rows, POINTS)
    values = lambda df: sorted(r["value"] for r in df.collect())
    assert values(S.since(points, "2019-01-01", exempt=["c"])) == [2.0, 3.0, 4.0, 5.0]
    assert values(S.since(points, "2019-01-01", keep_all_if_none=False)) == [2.0, 5.0]


def test_documents_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("x", day(1), 2.0), ("x", day(0), 1.0), ("y", day(0), 0.0)], POINTS)
    names = spark.createDataFrame([(s, s, s, s) for s in "xyz"], "series string, name string, description string, units string")
    sinks.write_series(sinks.series_documents(points, names, "now"), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {r["series"]: r["data_points"] for r in back.collect()} == {"x": 2, "y": 1}
    m = sinks.manifest(points, names, "now").collect()[0]
    assert m["series_count"] == 3 and m["series"] == {"x": 2, "y": 1, "z": 0}


def test_reading_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"series_id": "A", "data": [{"date": "2020-01-01", "value": 0}, {"date": "2020-02-01", "value": 2.5}]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"ticker": "B", "data": [{"date": "2020-01-01", "open": 1, "close": 3, "volume": 7}]}, indent=2))
    (tmp_path / "bad.json").write_text("{oops")
    got = readers.series_points(readers.series_documents(spark, str(tmp_path / "*.json")))
    assert sorted((r["series"], str(r["date"]), r["v"]) for r in got.select("series", "date", S.observed("value", "close").alias("v")).collect()) == [("A", "2020-01-01", 0.0), ("A", "2020-02-01", 2.5), ("B", "2020-01-01", 3.0)]


def test_recessions(spark, tmp_path):
    at = tmp_path / "r.json"
    at.write_text(json.dumps({"recessions": [{"start": "2001-03-01", "end": "2001-11-30", "label": "x"}]}))
    marks = spark.createDataFrame([("s", datetime.date(2001, 3, 1), 1.0), ("s", datetime.date(2001, 11, 30), 2.0), ("s", datetime.date(2001, 12, 1), 3.0)], POINTS)
    got = S.overlay(marks, readers.recessions(spark, str(at)))
    assert {r["value"]: r["label"] for r in got.collect()} == {1.0: "x", 2.0: "x", 3.0: None}


def test_changed(spark):
    a = spark.createDataFrame([("x", day(0), 1.0)], POINTS)
    assert S.changed(a, a).collect()[0]["changed"] is False
    assert S.changed(a, a.withColumn("value", F.lit(2.0))).collect()[0]["changed"] is True


def test_unpivot(spark):
    wide = spark.createDataFrame([(2020, 1.0, 2.0)], "year int, vc double, ma double")
    assert sorted((r["series"], str(r["date"]), r["value"]) for r in readers.unpivoted(wide, ["vc", "ma"]).collect()) == [("ma", "2020-12-31", 2.0), ("vc", "2020-12-31", 1.0)]
