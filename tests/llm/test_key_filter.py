import pytest

from fleetsift.llm import common
from fleetsift.llm.common import KeyFilter


@pytest.mark.parametrize("most", [1 << 15, 1 << 28])
def test_no_wanted_key_is_lost(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    rows = spark.range(60_000).selectExpr("if(id % 1000 = 7, null, id) as k", "id as _n")
    wanted = spark.range(0, 60_000, 20).selectExpr("id as w").union(spark.createDataFrame([(None,)], "w bigint"))
    marked = KeyFilter(wanted, "w").mark(rows, "k").collect()
    assert len(marked) == 60_000
    hits = {r.k for r in marked if r._hit}
    assert hits >= {r.w for r in wanted.collect() if r.w is None or r.w % 1000 != 7}
    if most > 1 << 15:
        assert len(hits) < 60_000 * 0.2


def test_empty_filter_lets_nothing_through(spark):
    assert KeyFilter(spark.range(0), "id").keep(spark.range(100), "id").count() == 0
