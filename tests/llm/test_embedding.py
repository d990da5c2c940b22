import numpy as np
import pytest
from pyspark.sql import functions as F

from leaksieve.llm import embedding as E

SCHEMA = "vec_id long, embedding array<float>, label int, node long, vec string"


def brute(rows, cosine=E.COSINE):
    usable = []
    for r in rows:
        v, label = r[1], r[2]
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        usable.append(np.asarray(v, np.float32).astype(float) if ok else None)
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            x, y = usable[i], usable[j]
            if x is None or y is None or rows[i][2] != rows[j][2] or len(x) != len(y):
                continue
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].append(j)
                links[j].append(i)
    seen, out = [False] * n, []
    for i in range(n):
        if seen[i]:
            continue
        stack, part = [i], []
        seen[i] = True
        while stack:
            k = stack.pop()
            part.append(k)
            for m in links[k]:
                if not seen[m]:
                    seen[m] = True
                    stack.append(m)
        ids = [rows[k][0] for k in part if rows[k][0] is not None]
        head = min(ids) if ids else None
        out += [(rows[k][0], len(links[k]), head, rows[k][0] is not None and rows[k][0] == head) for k in part]
    return out


def make(seed, centres=40, size=16, labels=3):
    """Vectors in loose and tight clusters, many near the limit."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(centres):
        c, label = rng.standard_normal(size), int(rng.integers(labels))
        for _ in range(int(rng.integers(1, 9))):
            v = c + rng.standard_normal(size) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append([len(rows), [float(np.float32(x)) for x in v * rng.choice([1, 3])], label])
    return rows


ODD = [
    (None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (9001, [1.0, 0.01], 1), (9000, [2.0, -0.0], 1),
    (9002, None, 1), (9003, [], 1), (9004, [0.0, 0.0], 1), (9005, [1.0, None], 1), (9006, [1.0, float("nan")], 1),
    (9007, [float("inf"), 0.0], 1), (9008, [1.0, 0.0], None), (9009, [1.0, 0.0], None), (9010, [1.0, 0.0, 0.0], 1),
    (9011, [1e38, 0.0], 1), (9012, [-1.0, 0.0], 1), (9013, [0.0, 1e-30], 2), (9014, [0.0, 1e-30], 2),
    (9014, [0.0, 1e-30], 2), (9015, [0.0, 1e30], 2),
]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    key = lambda r: tuple((v is not None, v) for v in r)
    got = E.near_duplicates(df, **kw)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=key), sorted(brute(rows), key=key)


@pytest.mark.parametrize(
    "kw", [{}, {"part": 3}, {"net": E.Net(E.COSINE, 3, 8)}, {"net": E.Net(E.COSINE, 2, 6), "part": 2}]
)
def test_links_and_components_against_brute_force(spark, kw):
    got, want = run(spark, make(5) + ODD, **kw)
    assert got == want
    assert max(r[1] for r in got) > 3


def test_many_copies(spark):
    rows = [(i, [0.6, 0.8], 1) for i in range(500)] + [(i, [0.6, 0.81], 1) for i in range(500, 700)]
    got, want = run(spark, rows + [(700, [0.8, -0.6], 1)], part=4)
    assert got == want


def test_empty_and_wrong_tables(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(TypeError):
        E.near_duplicates(spark.createDataFrame([("a", 1, 2)], "embedding string, vec_id int, label int"))


def test_collisions_against_all_differences():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.standard_normal((7, 5)).round(1), rng.standard_normal((9, 5)).round(1)
        want = (np.abs(a[:, None] - b[None]) <= 0.35).sum(-1)
        assert (E.collisions(a, b, 0.35) == want).all()


def test_calibration():
    """Nets miss what they may, whatever the number of vectors, on pairs at the limit."""
    rng = np.random.default_rng(3)
    for n in (100, 5_000, 10_000_000):
        net = E.Net.of(n)
        x = rng.standard_normal((4000, 48))
        x /= np.linalg.norm(x, axis=1)[:, None]
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1)[:, None] * x
        side /= np.linalg.norm(side, axis=1)[:, None]
        y = 0.98 * x + np.sqrt(1 - 0.98**2) * side
        met = (net.buckets(x) == net.buckets(y)).any(1)
        lines = net.lines_of(48)
        counted = (np.abs(x @ lines - y @ lines) <= net.distance).sum(1) >= E.least_count()
        assert (met & counted).mean() > 0.998
        far = (net.buckets(x) == net.buckets(np.roll(x, 1, 0))).mean()
        assert far * n <= 4 * E.MATES


def test_recall_on_a_table_beyond_one_bucket(spark):
    rows = make(8, centres=700, size=32, labels=1)
    got, want = run(spark, rows)
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
