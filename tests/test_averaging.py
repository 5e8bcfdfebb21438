import numpy as np
import pytest
from pyspark.sql import functions as F

from basket_engine.operators import averaging as A, training as T
from basket_engine.operators.training import Model

from .conftest import rows


def expected(data, size):
    """{(key, block): (means, counts)} element by element."""
    seen = {}
    for key, vector in data:
        for pos, value in enumerate(vector or []):
            cell = seen.setdefault((key, pos // size), {}).setdefault(pos % size, [])
            if value is not None:
                cell.append(value)
    return {k: ([float(np.mean(c[p])) if c[p] else None for p in sorted(c)], [len(c[p]) for p in sorted(c)]) for k, c in seen.items()}


def found(df, key="g"):
    out = {}
    for r in df.collect():
        assert (r[key], r["block"]) not in out
        out[r[key], r["block"]] = (r["mean"], r["n"])
    return out


@pytest.mark.parametrize("size", [1, 3, 4096])
@pytest.mark.parametrize("held", [1, 1 << 22])
def test_means_of_blocks(spark, monkeypatch, size, held):
    monkeypatch.setattr(A, "HELD", held)
    rng = np.random.default_rng(size)
    data = [(None if i % 7 == 0 else f"k{i % 3}", [float(v) for v in rng.normal(size=rng.integers(0, 11))]) for i in range(60)]
    data += [("k0", None), ("k1", [None, 1.0, None]), ("only", [None, None])]
    df = spark.createDataFrame(data, "g string, v array<double>").repartition(5)
    got, want = found(A.block_means(A.in_blocks(df, "v", ["g"], size), ["g"])), expected(data, size)
    assert set(got) == set(want)
    for k in want:
        assert got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0])


def test_blocks_with_unequal_numbers_of_rows(spark):
    parts = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 6.0]), (1, [5.0])], "block int, values array<double>")
    assert rows(A.block_means(parts)) == [(0, [2.0, 4.0], [2, 2]), (1, [5.0], [1])]


def test_equal_partitions_give_equal_bits(spark):
    df = spark.range(2000).select(F.array([F.rand(i) for i in range(20)]).alias("v")).repartition(7)
    df = spark.createDataFrame(df.collect(), "v array<double>").repartition(7)
    first, again = (rows(A.block_means(A.in_blocks(df, "v", size=8))) for _ in range(2))
    assert first == again


def test_vector_mean_has_a_row_per_element(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [3.0]), ("b", [None])], "k string, v array<double>")
    assert rows(A.vector_mean(df, "v", ["k"], size=2)) == [("a", 0, 2.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 0, None)]
    assert A.vector_mean(df.limit(0), "v").count() == 0


def test_bad_names_and_sizes(spark):
    df = spark.createDataFrame([(1, [1.0])], "part int, v array<double>")
    with pytest.raises(ValueError):
        A.vector_mean(df, "v", ["part"])
    with pytest.raises(ValueError):
        A.in_blocks(df, "v", size=0)


def test_averaging_in_blocks_is_that_of_the_whole(spark):
    rng = np.random.default_rng(5)
    params, updater = rng.normal(size=(4, 10)), rng.normal(size=(4, 10))
    data = [(params[i].tolist(), updater[i].tolist(), 10 * i, float(i)) for i in range(4)]
    averaged, loss = T.average_results(spark.createDataFrame(data, T.RESULT_SCHEMA), Model.initial("linear", 9, 1), block=3)
    assert averaged.params == pytest.approx(params.mean(axis=0)) and averaged.updater == pytest.approx(updater.mean(axis=0)) and loss == 1.5
    same, loss = T.average_results(spark.createDataFrame([], T.RESULT_SCHEMA), averaged)
    assert same is averaged and np.isnan(loss)
