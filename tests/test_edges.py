from pyspark.sql import functions as F

from ledgerlark.__main__ import main
from ledgerlark.functions import numbers, text
from ledgerlark.operators import extraction, fetching


def test_numbers(spark):
    df = spark.createDataFrame([(0, 1234.5, -1500.0), (1, 0.0, 5.0), (2, None, 1.0), (3, -2.0, -1.0)], "i int, a double, b double")
    got = df.orderBy("i").select(numbers.grouped("a"), numbers.dollars("b"), numbers.percent_text("a", "b")).collect()
    assert [tuple(r) for r in got] == [("1,234.50", "-$1,500", "-221.51%"), ("0.00", "$5", None), (None, "$1", None), ("-2.00", "-$1", "-50.00%")]


def test_truncated(spark):
    df = spark.createDataFrame([(0, "one two three four"), (1, "one two three"), (2, "onetwothreefour!!"), (3, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(text.truncated("t", 10)).collect()] == ["one...", "one two three", "onetwot...", None]


def test_fetching_isolates_failures(spark):
    def fetch(name):
        if name == "bad":
            raise ValueError("no such series")
        return '{"data": [{"date": "2020-01-01", "value": 1}, {"date": "2020-02-01", "value": 2}]}'

    names = spark.createDataFrame([("good",), ("bad",)], "series string")
    got = fetching.fetched(names, "series", fetch, at_once=2)
    assert {r["series"]: r["error"] for r in got.collect()} == {"good": None, "bad": "ValueError: no such series"}
    assert {r["series"]: r["n"] for r in fetching.counted(got, "series", "data array<struct<date:string,value:double>>").collect()} == {"good": 2, "bad": 0}


def test_extraction_survives_bad_replies(spark):
    items = spark.createDataFrame([(2**60 + 1, "t", "x" * 9000), (2, None, None)], "item_id long, title string, text string")
    got = {r["item_id"]: r for r in extraction.extract(items, lambda title, body: f'{{"company_name": "{len(body)}"}}' if body else "?").collect()}
    assert got[2**60 + 1]["company"] == "8000" and got[2]["summary_complete"] is False


def test_command_line(spark, capsys, tmp_path):
    assert main([]) == 0 and "series_summary" in capsys.readouterr().out
    assert main(["nothing"]) == 2
    assert main(["table_counts", "/root/testdata/sf0.001", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count(F.lit(1))).collect()[0][0] == 6
