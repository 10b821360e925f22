import pytest
from oracle import connect, same

from seqloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    same(spark, connect(SF), registry.queries()[name], registry.oracle_sql()[name], SF)


def test_native_operators_run_no_python(spark):
    for name in ("op5_secret_links", "op6_mix_sources"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


def test_names_cover_the_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op")) == list(range(1, 11))
