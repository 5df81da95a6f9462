"""Counts of cells travel in few rows."""

import numpy as np

from inkmill.llm import near


def test_commonness_moves_no_row_for_each_cell(spark):
    words = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    texts = spark.createDataFrame([(bytearray(w.encode()),) for w in words * 3], "_text binary").repartition(7)
    cells = near._commonness(texts, 2)
    expected = np.zeros(1 << near.CELLS, dtype=np.int64)
    for w in words * 3:
        np.add.at(expected, near.shingles(w.encode(), 2) >> np.uint64(64 - near.CELLS), 1)
    assert (cells == expected).all()
