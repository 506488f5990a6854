"""Resampling without a row per draw: the draws of the SQL, and intervals over many clusters."""

import hashlib

import numpy as np
import pytest
from comparing import rows_of, rows_of_sql

from attestra import catalog
from attestra.operators import agreement as A


@pytest.mark.parametrize(("replicate", "n", "seed"), [(0, 1, 7), (3, 10, 7), (9999, 12345, 7), (12, 1005, 3)])
def test_draws_are_those_of_md5(replicate, n, seed):
    want = [int(hashlib.md5(f"{seed}:{replicate}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
    assert np.concatenate(list(A.drawn(replicate, n, seed))).tolist() == want


@pytest.mark.parametrize("name", ["sc11_bootstrap_accuracy", "sc12_gap_interval", "sc21_design_effect"])
def test_no_draw_is_a_row(spark, data, duck, name, monkeypatch):
    def rows(*_):
        raise AssertionError("draws as rows")

    monkeypatch.setattr(A, "draws", rows)
    assert rows_of(catalog.QUERIES[name](spark, data)) == rows_of_sql(duck, catalog.SQL[name])
