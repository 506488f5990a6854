"""Every query of the subpackage over empty tables and over rows with nulls, repeats and clashing extra columns."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from attestra.llm import queries

EXTRA = ("tokens", "rep", "t", "k", "bin", "part", "s", "n", "lab", "r", "key", "a", "b", "words")


def _variant(src, out, kind):
    for f in os.listdir(src):
        t = pq.read_table(f"{src}/{f}")
        if kind == "empty":
            t = t.slice(0, 0)
        else:
            t = t.slice(0, min(40, len(t)))
            nulls = pa.table({c.name: pa.nulls(1, c.type) for c in t.schema}, schema=t.schema)
            each = [t.slice(1, 1).set_column(i, c, pa.nulls(1, c.type)) for i, c in enumerate(t.schema)]
            t = pa.concat_tables([t, t.slice(0, 3), nulls, *each])
            for x in EXTRA:
                if x not in t.column_names:
                    t = t.append_column(x, pa.array(["z"] * len(t)))
        pq.write_table(t, f"{out}/{f}")
    return str(out)


@pytest.fixture(scope="module")
def empty(data, tmp_path_factory):
    return _variant(data, tmp_path_factory.mktemp("empty"), "empty")


@pytest.fixture(scope="module")
def dirty(data, tmp_path_factory):
    return _variant(data, tmp_path_factory.mktemp("dirty"), "dirty")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_dirty_rows(spark, dirty, name):
    queries.QUERIES[name](spark, dirty).collect()
