"""Fingerprints whose documents have no id link the others."""

import pytest

from vitrine.llm import simhash


@pytest.mark.parametrize("most", [512, 2])
def test_bridge_without_id(spark, most):
    rows = [(2, 0b0000), (None, 0b0011), (1, 0b1111), (None, 7 << 40), (9, -1), (9, 1 << 20 | 1 << 30 | 1 << 50)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.classes(prints, most).collect()}
    assert got == {(2, 0): 1, (None, 3): 1, (1, 15): 1, (None, 7 << 40): None, (9, -1): 9, (9, 1 << 20 | 1 << 30 | 1 << 50): 9}
