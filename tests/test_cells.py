import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cells as C
from tessella.sources.views import Views

SCHEMA = "id long, embedding array<double>, kind string, cell string"


def clustered(n=3000, groups=25, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    return [(i, (middles[i % groups] + rng.normal(size=dims) * 0.15).tolist(), "a" if i % 3 else "b", "x") for i in range(n)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered()
    rows += [(5000, None, "a", ""), (5001, [0.0] * 16, "a", ""), (5002, [1.0, 2.0], "b", ""), (5003, [float("nan")] * 16, "a", ""), (5004, [None] * 16, "a", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).drop("cell")
    return rows, C.Cells.build(df, str(tmp_path_factory.mktemp("cells") / "i"), sample=800)


def brute(rows, q, k, kind=None):
    out = []
    for i, v, kd, _ in rows:
        if v is None or any(x is None or x != x for x in v) or (kind and kd != kind):
            continue
        a, b = np.zeros(16), np.asarray(q)
        a[: len(v)] = v
        size = np.linalg.norm(a) * np.linalg.norm(b)
        out.append((-round(float(a @ b) / size, 6) + 0.0 if size else 0.0, i))
    return [(i, -s + 0.0) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("k", [1, 20, 5000])
@pytest.mark.parametrize("at", [0, 7, 2999])
@pytest.mark.parametrize("kind", [None, "b"])
def test_exact_search_equals_brute_force(spark, built, k, at, kind):
    rows, index = built
    keep = F.col("kind") == kind if kind else None
    got, read = index.top(spark, rows[at][1], k, keep)
    got, want = got.orderBy(F.desc("score"), "id").collect(), brute(rows, rows[at][1], k, kind)
    assert [r["score"] for r in got] == pytest.approx([s for _, s in want], abs=2e-6)
    assert dict(want) == pytest.approx({r["id"]: r["score"] for r in got}, abs=2e-6)
    held = int((index.members > 0).sum())
    assert held > 20 and (len(read) < held / 3 if k == 1 else len(read) <= held)


def test_search_of_a_zero_question_and_with_probes(spark, built):
    rows, index = built
    got, _ = index.top(spark, [0.0] * 16, 3)
    assert [r["id"] for r in got.orderBy(F.desc("score"), "id").collect()] == [0, 1, 2]
    near, read = index.top(spark, rows[4][1], 20, probe=0.1)
    assert len(read) <= 0.1 * len(index.members) + 1
    assert len({r["id"] for r in near.collect()} & {i for i, _ in brute(rows, rows[4][1], 20)}) >= 18


def test_cells_that_are_not_asked_for_are_not_read(spark, built):
    plan = built[1].rows(spark, [3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "In(cell, [-1,3,4])" in plan
    assert {r["cell"] for r in built[1].rows(spark, [3, 4]).select("cell").distinct().collect()} == {3, 4, -1}


def test_every_row_is_in_the_cell_of_its_nearest_centre(spark, built):
    rows, index = built
    stored = index.rows(spark, list(range(len(index.members)))).select("id", "cell", "embedding").collect()
    assert len(stored) == 3002 and index.odd == 2
    for r in stored:
        if r["cell"] != C.ODD:
            d = index.distances(r["embedding"])
            assert d[r["cell"]] <= d.min() + 1e-9 and d[r["cell"]] <= index.radii[r["cell"]] + 1e-9


def test_index_of_nothing(spark, tmp_path):
    index = C.Cells.build(spark.createDataFrame([], SCHEMA).drop("cell"), str(tmp_path / "i"))
    assert index.top(spark, [1.0], 5)[0].count() == 0


def test_recall_of_probed_cells(spark):
    """Ids divisible by 100 against all rows, on the larger table."""
    rows = C.cell_recall(Views(spark, "/root/testdata/sf0.1")).collect()
    assert len(rows) >= 15 and sum(r["found"] for r in rows) >= 0.9 * 20 * len(rows)
    assert all(r["cells_read"] <= 0.61 * r["cells"] + 1 for r in rows)


@pytest.mark.parametrize("probe", [0.4, 1.0])
def test_probed_answers_equal_brute_force_over_the_cells(spark, built, probe):
    """Each question against the rows of its cells and the odd one, by single products; no pair of rows is made by a join."""
    index = built[1]
    stored = index.rows(spark, list(range(len(index.members)))).where("size(embedding) > 0").select("id", "cell", "embedding").collect()
    asked = [r for r in stored if r["cell"] != C.ODD][::150]
    questions = spark.createDataFrame([(r["id"], r["embedding"]) for r in asked], "prompt long, v array<double>")
    want = set()
    for r in asked:
        cells, q = {*index.nearest(r["embedding"], probe), C.ODD}, np.array(r["embedding"], "f8")
        near = []
        for x in stored:
            if x["cell"] in cells and x["id"] != r["id"]:
                w = np.zeros(max(len(q), len(x["embedding"])))
                w[: len(x["embedding"])] = x["embedding"]
                size = np.linalg.norm(w) * np.linalg.norm(q)
                near.append((-round(float(w[: len(q)] @ q) / size, 6) if size else 0.0, x["id"]))
        want |= {(r["id"], n, i, s + 0.0 if s == 0 else -s, len(cells) - 1) for n, (s, i) in enumerate(sorted(near)[:7], 1)}
    found = C.probed(index, questions, 7, probe)
    assert {(p, n, i, round(s, 6), c) for p, n, i, s, c in map(tuple, found.collect())} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
