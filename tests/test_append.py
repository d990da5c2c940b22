from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from leaksieve.plans import append as A
from leaksieve.schema import LEAK_COLUMNS


def leaks(spark, name, n, parts=3):
    columns = [F.lit(name).alias(c) if c != "line_number" else F.col("id").cast("int").alias(c) for c in LEAK_COLUMNS]
    return spark.range(0, n, 1, parts).select(*columns)


def content(spark, path):
    rows = A.read_appended(spark, path).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return sorted((r["run"], r["line"], r["line_number"]) for r in rows)


def want(**runs):
    return sorted((run, run, i) for run, n in runs.items() for i in range(n))


def test_runs_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "leaks")
    assert A.append_once(leaks(spark, "a", 25), path, "a")
    assert not A.append_once(leaks(spark, "other", 9), path, "a")
    assert A.append_once(leaks(spark, "2024", 7), path, "2024")
    assert A.append_once(leaks(spark, "none", 0), path, "none")
    assert content(spark, path) == want(**{"a": 25, "2024": 7})
    ids = {r["id"] for r in A.read_appended(spark, path).collect()}
    assert ids == set(range(1, 33))
    with pytest.raises(ValueError):
        A.append_once(leaks(spark, "a", 1), path, "../x")


def test_a_write_that_fails_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "leaks")
    A.append_once(leaks(spark, "a", 10), path, "a")
    broken = leaks(spark, "b", 40, 4).withColumn(
        "offender", F.when(F.col("line_number") > 30, F.raise_error(F.lit("lost"))).otherwise(F.col("offender"))
    )
    with pytest.raises(Exception, match="lost"):
        A.append_once(broken, path, "b")
    assert content(spark, path) == want(a=10)
    # Once more after the ids were reserved, before the rows are published.
    real = A._Folder.publish
    monkeypatch.setattr(A._Folder, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        A.append_once(leaks(spark, "b", 40), path, "b")
    assert content(spark, path) == want(a=10)
    monkeypatch.setattr(A._Folder, "publish", real)
    assert A.append_once(leaks(spark, "b", 40), path, "b")
    assert content(spark, path) == want(a=10, b=40)


def test_two_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "leaks")
    runs = {f"w{i}": 20 + i for i in range(4)}
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(A.append_once, leaks(spark, r, n), path, r) for r, n in runs.items()]
        assert all(j.result() for j in jobs)
    assert not A.append_once(leaks(spark, "w0", 20), path, "w0")
    assert content(spark, path) == want(**runs)
