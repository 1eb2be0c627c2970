import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import images as I


def plain_average(grid, width, height):
    """Each new value from every old one and the part of it that lies below."""
    rows, cols = grid.shape
    out = np.zeros((height, width), int)
    for j in range(height):
        for i in range(width):
            total = sum(int(grid[y, x]) * max(0, min((x + 1) * width, (i + 1) * cols) - max(x * width, i * cols)) * max(0, min((y + 1) * height, (j + 1) * rows) - max(y * height, j * rows)) for y in range(rows) for x in range(cols))
            out[j, i] = (2 * total + rows * cols) // (2 * rows * cols)
    return out


@pytest.mark.parametrize("shape", [(1, 1), (8, 9), (16, 16), (7, 23), (40, 13), (3, 2)])
@pytest.mark.parametrize("size", [(9, 8), (16, 16), (1, 1), (4, 3)])
def test_scaling_equals_plain_averages(shape, size):
    grid = np.random.default_rng(sum(shape)).integers(0, 256, shape)
    assert (I.area_average(grid, *size) == plain_average(grid, *size)).all()


@pytest.mark.parametrize(("shape", "want"), [((10, 20), (10, 20)), ((10, 33), (5, 17)), ((130, 7), (17, 1)), ((1000, 3), (63, 1))])
def test_halving(shape, want):
    grid = np.random.default_rng(1).integers(0, 256, shape)
    small = I.halved(grid, side=20)
    assert small.shape == want
    n = (shape[0] + want[0] - 1) // want[0] if small is not grid else 1
    step = 1 << (n - 1).bit_length()
    for j in range(want[0]):
        for i in range(want[1]):
            block = grid[j * step : (j + 1) * step, i * step : (i + 1) * step]
            assert small[j, i] == int(block.mean() + 0.5)


def test_hashes_and_thumbnails_of_columns(spark):
    right = [10 * x for _ in range(16) for x in range(18)]
    left = right[::-1]
    rows = [(1, 18, 16, right), (2, 18, 16, left), (3, 36, 32, [10 * (x // 2) for _ in range(32) for x in range(36)]), (4, 2, 2, [0] * 4), (5, 2, 2, [1]), (6, None, None, None), (7, 0, 0, [])]
    df = spark.createDataFrame(rows, "id int, width int, height int, pixels array<int>").select("id", F.struct("width", "height", "pixels").alias("image"))
    got = {r["id"]: r for r in I.with_thumbnail(I.with_difference_hash(df, "image"), "image", "t").select("id", "h", "t", I.shrunk(F.col("image"), 9)["width"].alias("w")).collect()}
    assert got[1]["h"] == got[3]["h"] == -1 and got[2]["h"] == 0 and got[1]["w"] == 9
    assert abs(sum(x * x for x in got[1]["t"]) - 1) < 1e-9 and sum(x * y for x, y in zip(got[1]["t"], got[3]["t"], strict=True)) > 0.999
    assert got[4]["t"] is None and got[5]["t"] is None and got[6]["w"] is None and got[7]["t"] is None


def test_texts_are_scaled_without_leaving_as_pixels(spark):
    """As by whole images, one column after the other; the plan has one step in Python, which gives small images only."""
    texts = ["", None, "a", "ab", "Grüße " * 7, "xyz" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in I.scaled_texts(docs.selectExpr("doc_id AS id", "CAST(text AS binary) AS bytes"), [(9, 8), (16, 16)]).collect()}
    assert set(got) == {2, 3, 4, 5}

    class Docs:
        def table(self, name):
            return docs

    images = I.text_images(Docs()).where("image.width > 0")
    for r in images.select("doc_id", "image.width", "image.height", I.resized(F.col("image"), 9, 8)["pixels"].alias("a"), I.resized(F.col("image"), 16, 16)["pixels"].alias("b")).collect():
        assert tuple(r) == tuple(got[r["doc_id"]])
    plan = I.image_scaling(Docs())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
