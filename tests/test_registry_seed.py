"""registry_seed over the whole supplier table."""

import pyarrow.parquet as pq

from papyra.plans import catalog

D = "/root/testdata/sf0.001"


def test_every_supplier_is_seeded(spark):
    ids = lambda name, key: pq.read_table(f"{D}/{name}.parquet", columns=[key]).column(key).to_pylist()
    found = catalog.registry_seed(spark, D).collect()
    assert sorted(r.id for r in found if r.fresh) == sorted(ids("supplier", "s_suppkey"))
    assert sorted(r.id for r in found if not r.fresh) == sorted(i for i in ids("customer", "c_custkey") if i % 7)
