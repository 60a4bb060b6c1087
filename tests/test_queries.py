"""Every registered query of the core against its SQL on the smallest tables."""

import os

import pytest

from prismlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{SF}/{f}'")
    return con


def rows(df, columns):
    def plain(x):
        if isinstance(x, float):
            return round(float(x), 6) + 0.0
        return [plain(v) for v in x] if hasattr(x, "__len__") and not isinstance(x, str) else x

    return sorted(repr([plain(v.item() if hasattr(v, "item") and not hasattr(v, "__len__") else v) for v in r]) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", ["unit_vectors", "concatenated_vectors", "joint_embeddings"])
def test_zeros_keep_their_sign(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    small = [[1.0, -1e-7, 1e-7, 0.0], [0.6, -0.8, -2e-7, -0.0], [-3e-7, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0, 0.0], [2.0, -5e-7, -1e-6, -4e-6], [1.0, 1.0, -9e-7, -2e-7]]
    rows = [(k, v, k % 2) for k, v in enumerate(small) if name == "unit_vectors" or any(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)), con.execute(registry.ORACLES[name]).fetchall()
    assert "-0.0" in repr(want)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 9
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
