import pytest
from oracle import connect, same

from seqloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, db, name):
    same(spark, db, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_every_query_but_one_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"constrained_decode"}


@pytest.mark.parametrize("name", ["dfa_contains", "dfa_contains_any", "dfa_then", "dfa_eos", "dfa_word_count", "hmm_loglik", "token_classify", "suffix_overlap"])
def test_folds_run_no_python(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan.replace("ArrowConversion", "")


@pytest.mark.parametrize("name", ["dfa_contains", "dfa_then"])
def test_document_predicates_read_two_columns_and_shuffle_nothing(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
