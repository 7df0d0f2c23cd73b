import pytest
from pyspark.sql import functions as F

from moorline.sources import rows as R


def cells(text):
    return [c for _, c in R.split_csv(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a,b\n1,2\n", [["a", "b"], ["1", "2"]]), ('a\n"x,y"\n', [["a"], ["x,y"]]), ('a\n"x\ny"\n', [["a"], ["x\ny"]]), ('a\n"x ""q"" y"', [["a"], ['x "q" y']]),
        ("a\r\n1\r\n", [["a"], ["1"]]), ("a\r1\r", [["a"], ["1"]]), ("\ufeffa\n1", [["a"], ["1"]]), ("a\n\n1\n\n", [["a"], ["1"]]), ("a,b\n1\n", [["a", "b"], ["1"]]), ("a,b\n,\n", [["a", "b"], ["", ""]]), ("", []),
    ],
)
def test_split_csv(text, expected):
    assert cells(text) == expected


def test_verbatim_records():
    assert [r for r, _ in R.split_csv('a,b\r\n"1\n",2\r\n3,4')] == ["a,b", '"1\n",2', "3,4"]


def test_csv_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,a,b\n1,2\n"q\nr",,3\n')
    got = R.read_csv(spark, str(tmp_path / "x.csv")).orderBy("row_seq").collect()
    assert [(r.row_seq, r.raw, r.fields) for r in got] == [(1, "1,2", {"a": "1", "b": ""}), (2, '"q\nr",,3', {"a": "q\nr", "b": "3"})]


def test_json_rows(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"data": {"rows": [{"n": 9074729.0, "x": {"y": [1, "b"]}, "z": null}, {"n": 1.5, "x": {}}]}}')
    got = R.read_snapshot(spark, str(tmp_path), "e", ["n", "x.y[1]", "z", "x"], "data.rows").orderBy("row_seq").collect()
    assert got[0].fields == {"n": "9074729", "x.y[1]": "b", "z": "", "x": '{"y":[1,"b"]}'} and got[1].fields == {"n": "1.5", "x": "{}"}
    with pytest.raises(FileNotFoundError):
        R.read_snapshot(spark, str(tmp_path), "nothing", ["n"])
    with pytest.raises(Exception, match="no array"):
        R.read_snapshot(spark, str(tmp_path), "e", ["n"]).collect()


def test_bound_parameters():
    assert R.bind("a >= $1 and b < $2", ["x'y", "2"]) == "a >= 'x''y' and b < '2'"
    with pytest.raises(ValueError):
        R.bind("$3", ["x"])


def test_dense_sequence(spark):
    got = R.from_table(spark.range(1000).repartition(7).select(F.col("id").alias("k")))
    assert sorted(r.row_seq for r in got.collect()) == list(range(1, 1001))
