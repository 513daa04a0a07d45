"""Registered queries of the folder against DuckDB on the smallest data set."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_chat_format", "op5_exact_dedup", "op10_quality_cascade",
                                  "op11_fm_decontamination", "op12_lexical_search"])
def test_query_equals_its_twin(spark, name):
    ok, n, message = compare(spark, connect(SF), name, SF)
    assert ok and n, message


def test_all_and_the_pipeline_are_registered():
    names = set(queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14))
    assert set(oracle_sql()) <= names


def test_every_twin_is_sql_and_is_run():
    assert all(isinstance(sql, str) for sql in oracle_sql().values())
    run = next(m.args[1] for m in test_query_equals_its_twin.pytestmark if m.name == "parametrize")
    assert {name for name in oracle_sql() if name.startswith("op") or name == "pipeline"} == set(run)
