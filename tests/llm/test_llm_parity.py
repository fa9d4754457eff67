"""Queries with SQL equal DuckDB on the small tables."""

import pandas as pd
import pytest

from tablekit.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, duck, sf_small, key):
    got = QUERIES[key](spark, sf_small).toPandas()
    want = duck.execute(ORACLE[key]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key_ = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(norm_rows(got[columns]), key=key_) == sorted(norm_rows(want[columns]), key=key_)


def norm_rows(pdf):
    return [tuple(None if pd.isna(v) else v if isinstance(v, str) else float(v) for v in r) for r in pdf.itertuples(index=False, name=None)]


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 14)] == [1] * 13
