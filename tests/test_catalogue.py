import pytest
from glossarion.plans import catalogue

from .conftest import SF, duck, same_rows


@pytest.mark.parametrize("name", [k for k in catalogue.ORACLE if k not in ("detect_stream", "detect_udf")])
def test_query_equals_its_sql(spark, name):
    same_rows(catalogue.QUERIES[name](spark, SF), *duck(SF, catalogue.ORACLE[name]))


def test_stream_and_udf_agree_with_the_tables(spark):
    want = {r["doc_id"]: r["lang"] for r in catalogue.QUERIES["detect_top"](spark, SF).collect()}
    for name in ("detect_stream", "detect_udf"):
        assert {r["doc_id"]: r["lang"] for r in catalogue.QUERIES[name](spark, SF).collect()} == want


def test_entry_file():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
