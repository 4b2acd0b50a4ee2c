"""Pixels of vectors whose components come to a whole number in floats and not in doubles."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from facelake.plans.catalogue import ORACLE_SQL, QUERIES


def edges():
    """Floats for which (x + 1) * 127 has another floor in floats than in doubles."""
    near = ((np.arange(1, 254) / 127) - 1).astype(np.float32)
    x = np.concatenate([near, np.nextafter(near, np.float32(-2)), np.nextafter(near, np.float32(2))])
    return x[np.floor((x + np.float32(1)) * np.float32(127)) != np.floor((x.astype(float) + 1) * 127)]


@pytest.mark.parametrize("name", ["consistency_check", "resize_112", "warp_align", "embed_pixels", "embed_seeded", "tensor_range"])
def test_floats_as_in_sql(spark, tmp_path, name):
    rng, odd = np.random.default_rng(3), edges()
    vectors = rng.uniform(-0.99, 0.99, (6, 64)).astype(np.float32)
    vectors[:3, 20:60] = rng.choice(odd, (3, 40))
    assert len(odd)
    rows = {"vec_id": pa.array(range(6), pa.int64()), "label": pa.array([0, 1] * 3, pa.int32()), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))}
    pq.write_table(pa.table(rows), tmp_path / "embeddings.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
