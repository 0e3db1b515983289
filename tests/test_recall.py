"""The recall of the registered approximate index, with its own parameters, against brute force."""

import pytest

from palaver import catalog
from palaver.operators import vector_index
from palaver.sources import corpora


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_index_reaches_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    chunks = corpora.vectors(spark, d)
    asked = chunks.where("chunk_pos % 100 = 0").selectExpr("chunk_pos AS query_id", "embedding")
    exact = {(r.query_id, r.chunk_pos) for r in vector_index.join_nearest(asked, chunks).collect()}
    found = {(r.query_id, r.chunk_pos) for r in catalog.QUERIES["v_ann_cells"](spark, d).collect()}
    print(sf, "recall", len(exact & found), "of", len(exact))
    assert len(found) == len(exact) and len(exact & found) >= 0.9 * len(exact)
