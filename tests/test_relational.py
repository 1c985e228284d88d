"""Keys of tables are of one type, so that joins of them move no side again; tables are opened once."""

import os

import pytest

from linkgraph.operators import graph as G
from linkgraph.sources import relational as R

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_keys_of_all_tables_are_of_one_type(spark):
    g = R.graph(spark, SF)
    types = {g.nodes.schema["id"].dataType.json(), *(g.typed.schema[c].dataType.json() for c in ("src", "dst")), *(g.edges.schema[c].dataType.json() for c in ("src", "dst"))}
    assert len(types) == 1
    plan = G.matrix_status(R.graph(spark, SF, ["CUS", "ORD", "LIN"], ("CUS", "ORD", "LIN")))._jdf.queryExecution().analyzed().toString()
    assert "as struct<" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_table_is_opened_once(spark, monkeypatch):
    opened, real = [], R.table
    monkeypatch.setattr(R, "table", lambda s, d, name: opened.append(name) or real(s, d, name))
    R.graph(spark, SF)
    assert sorted(opened) == sorted({name for name, _, _ in R.TYPES.values()})
