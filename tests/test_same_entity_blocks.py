"""Unit vectors with a product above a half: blocks against blocks, and to the last bit what the SQL returns."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from oracle import compare, connect
from test_vectors_stay import _folder

from millrace.plans import catalogue

NAME = "mth17_same_entity"


def test_limits_zeros_and_infinities_are_as_in_sql(spark, tmp_path):
    """A zero vector made the query fail."""
    rng = np.random.default_rng(7)
    vectors = [rng.standard_normal(4).astype(np.float32) for _ in range(320)]
    half = [np.float32([1, 1, 1, 1]), np.float32([1, 0, 0, 0]), np.float32([3, 3, 3, 3]), np.float32([0, 7, 0, 0]), np.float32([1, 1, 1, 1.0000001])]
    for at, v in enumerate((*half, np.zeros(4, np.float32), np.float32([np.inf, 1, 1, 1]), np.float32([np.nan, 1, 1, 1]), None)):
        vectors[20 + at] = v
    vectors[0], vectors[100], vectors[200], vectors[300] = half[0], half[1], np.zeros(4, np.float32), None
    folder = _folder(tmp_path, vectors, 3)
    lists = [None if v is None else v.tolist() for v in vectors]  # with pandas, NaN would become null
    pq.write_table(pa.table({"vec_id": range(320), "embedding": pa.array(lists, pa.list_(pa.float32())), "label": [0] * 320}), f"{folder}/embeddings.parquet")
    compare(catalogue.queries()[NAME](spark, folder), connect(folder), catalogue.oracle_sql()[NAME])


def test_vectors_meet_as_blocks(spark, tmp_path):
    """Each pair was a row of its own, with both vectors as arrays."""
    folder = _folder(tmp_path, list(np.random.default_rng(3).standard_normal((600, 4), dtype=np.float32)), 3)
    found = catalogue.queries()[NAME](spark, folder)
    assert "zip_with" not in found._jdf.queryExecution().toString().replace("zipwith", "zip_with")
    compare(found, connect(folder), catalogue.oracle_sql()[NAME])
