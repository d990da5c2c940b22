import csv
import glob
import json

import pytest

from leaksieve.plans import report
from leaksieve.schema import LEAK_COLUMNS

SCHEMA = ", ".join(f"{c} {'int' if c == 'line_number' else 'string'}" for c in LEAK_COLUMNS)
LEAK = (
    "Sensitive information", 42, "John Doe", "abcd1234", "my-repo", "password_leak", "A \"quoted\", message",
    "ann", "ann@example.com", "path/to/file.txt", "2023-05-30",
)
SECOND = ("s = 'ü'\t", 1, "ü", "", "", "r", "", "", "", "/f", "")


@pytest.fixture(scope="module")
def leaks(spark):
    return spark.createDataFrame([LEAK, SECOND, LEAK], SCHEMA).repartition(3)


def document(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def as_dict(row):
    return dict(zip(LEAK_COLUMNS, row))


def test_json(leaks, tmp_path):
    report.write_json_document(leaks, str(tmp_path / "a"))
    got = json.loads(document(tmp_path / "a"))
    key = lambda d: d["line_number"]
    assert sorted(got, key=key) == [as_dict(SECOND), as_dict(LEAK), as_dict(LEAK)]
    assert list(got[0]) == list(LEAK_COLUMNS)
    report.write_json_lines(leaks, str(tmp_path / "b"))
    rows = [json.loads(l) for l in document(tmp_path / "b").splitlines()]
    assert sorted(rows, key=key) == sorted(got, key=key)


def test_empty_documents(spark, leaks, tmp_path):
    none = leaks.limit(0)
    report.write_json_document(none, str(tmp_path / "a"))
    assert json.loads(document(tmp_path / "a")) == []
    report.write_sarif(none, str(tmp_path / "b"))
    assert json.loads(document(tmp_path / "b"))["runs"][0]["results"] == []


def test_csv(leaks, tmp_path):
    report.write_csv(leaks.coalesce(1), str(tmp_path / "a"))
    with open(glob.glob(f"{tmp_path}/a/part-*")[0], encoding="utf-8", newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == list(LEAK_COLUMNS)
    assert sorted(rows[1:]) == sorted([list(map(str, LEAK))] * 2 + [list(map(str, SECOND))])


def test_csv_lines(spark):
    odd = [('a"b', 1, "x,y", "l\r\nm", "", None, " s ", "", "", "", "é"), LEAK]
    got = report.csv_lines(spark.createDataFrame(odd, SCHEMA)).collect()
    text = "\r\n".join(r["csv"] for r in got)
    rows = list(csv.reader(text.splitlines(keepends=True)))
    assert sorted(rows) == sorted([["" if v is None else str(v) for v in row] for row in odd])


def test_documents_run_their_leaks_once(spark, leaks, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            runs.add(1)
            yield r

    once = spark.createDataFrame(leaks.rdd.mapPartitions(count), leaks.schema)
    report.write_json_document(once, str(tmp_path / "a"))
    assert runs.value == 3 and len(json.loads(document(tmp_path / "a"))) == 3


def test_sarif(leaks, tmp_path):
    report.write_sarif(leaks, str(tmp_path / "a"), "tool", "v9")
    doc = json.loads(document(tmp_path / "a"))
    assert doc["version"] == "2.1.0" and doc["$schema"].endswith("sarif-2.1.0-rtm.5.json")
    (run,) = doc["runs"]
    assert run["tool"] == {"driver": {"name": "tool", "semanticVersion": "v9", "rules": []}}
    assert len(run["results"]) == 3
    (first, _) = [r for r in run["results"] if r["properties"]["repo"] == "my-repo"]
    assert first == {
        "message": {"text": "password_leak detected!"},
        "properties": {
            "commit": "abcd1234", "offender": "John Doe", "date": "2023-05-30", "author": "ann",
            "email": "ann@example.com", "commitMessage": 'A "quoted", message', "repo": "my-repo",
        },
        "locations": [
            {
                "physicalLocation": {
                    "artifactLocation": {"uri": "path/to/file.txt"},
                    "region": {"startLine": 42, "snippet": {"text": "Sensitive information"}},
                }
            }
        ],
    }


def test_unknown_format_is_json(leaks, tmp_path):
    report.write_report(leaks, str(tmp_path / "a"), "yaml")
    assert len(json.loads(document(tmp_path / "a"))) == 3
    report.write_report(leaks, str(tmp_path / "b"), "csv")
    assert document(tmp_path / "b").startswith("line,line_number,offender,commit,repo,rule")


def test_table(spark, leaks):
    report.append_to_table(leaks, "leaks_t")
    report.append_to_table(leaks, "leaks_t")
    rows = spark.table("leaks_t").collect()
    assert len(rows) == 6 and len({r["id"] for r in rows}) == 6
    assert min(r["id"] for r in rows) >= 1
    spark.sql("DROP TABLE leaks_t")
