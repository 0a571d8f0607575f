"""Pairs of near cells by blocks against all pairs."""

import numpy as np
import pandas as pd
import pytest

from metricloom.operators import clustering


@pytest.mark.parametrize("block_rows", [None, 25])
def test_pairs_of_cells_by_blocks(spark, block_rows):
    rng = np.random.default_rng(9)
    low = rng.normal(size=(300, 3))
    high = low + rng.random((300, 3)) * 0.4
    cells = pd.DataFrame(np.column_stack([low, high]), columns=["lo0", "lo1", "lo2", "hi0", "hi1", "hi2"]).assign(cell=np.arange(300) * 3)
    got = {(r.cell, r.other): r.inside for r in clustering._cell_pairs(spark.createDataFrame(cells), 3, 0.25, block_rows=block_rows).collect()}
    gap = np.maximum(np.maximum(low[None] - high[:, None], low[:, None] - high[None]), 0)
    far = np.maximum(high[None] - low[:, None], high[:, None] - low[None])
    want = {(i * 3, j * 3): bool((far[i, j] ** 2).sum() <= 0.25) for i, j in zip(*np.nonzero((gap**2).sum(axis=2) <= 0.25)) if i != j}
    assert got == want and any(want.values())
