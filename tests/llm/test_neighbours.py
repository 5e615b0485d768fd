import numpy as np
import pytest

from quernstone.llm import neighbours


def _rows(kind: str) -> np.ndarray:
    rng = np.random.default_rng(3)
    if kind == "tight groups":
        return np.repeat(rng.normal(size=(40, 16)), 250, axis=0) + rng.normal(size=(10_000, 16)) * 1e-3
    if kind == "far from zero":
        return rng.normal(size=(10_000, 16)) + 1e4
    if kind == "outliers":
        x = rng.normal(size=(10_000, 16))
        x[::50] *= 1e4
        return x
    if kind == "many scales":
        return rng.normal(size=(10_000, 16)) * np.exp(rng.normal(size=(10_000, 1)) * 4)
    x = rng.normal(size=(10_000, 16))
    x[::1000] = 1e200 * (1 + np.arange(10))[:, None]  # squares beyond doubles
    return x


@pytest.mark.parametrize("kind", ["tight groups", "far from zero", "outliers", "many scales", "huge"])
def test_no_neighbour_is_missed(spark, kind):
    x = _rows(kind)
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(v, v.where("vec_id % 125 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i in range(0, len(x), 125):
        with np.errstate(over="ignore"):
            d = ((x - x[i]) ** 2).sum(1)
        want = [int(k) for k in np.lexsort((np.arange(len(d)), np.sqrt(d))) if k != i][:10]
        assert got[i] == want
