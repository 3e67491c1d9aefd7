"""What a registered query stores of the role layer when it is the first to read a folder."""

from __future__ import annotations

from conftest import SF001
from oracle_compare import canon, duck
from pyspark.sql import DataFrameWriter
from retentia.plans import oracle
from retentia.plans.registry import queries


def test_impossible_dates_stores_the_orders_alone(spark, monkeypatch, tmp_path):
    """All nine role tables used to be built for a query that reads one of them."""
    stored = []

    def spied(save):
        def spy(writer, target, *args, **kwargs):
            stored.append(writer._df.columns[:3])
            return save(writer, target, *args, **kwargs)
        return spy

    for name in ("parquet", "saveAsTable"):
        monkeypatch.setattr(DataFrameWriter, name, spied(getattr(DataFrameWriter, name)))
    folder = tmp_path / "sf"  # another path: a layer of its own
    folder.symlink_to(SF001)
    df = queries()["impossible_dates"](spark, str(folder))
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    assert stored == [["order_id", "customer_id", "order_status"]]
    res = duck(SF001).execute(oracle.oracle_sql()["impossible_dates"])
    assert got == canon([d[0] for d in res.description], res.fetchall())
