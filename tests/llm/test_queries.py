"""Queries with SQL against DuckDB; every query on the smallest tables."""

import pytest

from chronoweave.llm import queries as Q
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_against_sql(spark, small, name):
    compare(Q.QUERIES[name](spark, small), Q.ORACLE[name], small)


def test_names_and_columns(spark, small):
    assert [f"op{n}_" for n in range(1, 11)] == sorted({k[: k.index("_") + 1] for k in Q.QUERIES if k.startswith("op")}, key=lambda s: int(s[2:-1]))
    assert Q.QUERIES["op5_lang_id"](spark, small).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert {"n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"} <= set(Q.QUERIES["op7_pii"](spark, small).columns)
    assert {"n_assign", "n_access", "n_hex", "base_sha256", "spans"} <= set(Q.QUERIES["op8_secret_scan"](spark, small).columns)
