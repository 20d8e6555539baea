import oracle
import pytest

from tallyweave.plans import queries

SF = "/root/testdata/sf0.001"
#: Those whose plans hold the others' are left to the full comparison at a larger scale
QUICK = ["q_normalize", "q_normalize_matcher", "q_strip_web", "q_skeleton", "q_trigrams", "q_canon_addr", "q_name_core", "q_holdout", "q_folds", "q_tokens", "q_candidates", "q_validate", "q_recall_at_k", "q_feat_lens", "q_pair_cosine", "q_char_tfidf"]


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.connection(SF), queries.ORACLES[name]) > 0


def test_every_query_is_known():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
