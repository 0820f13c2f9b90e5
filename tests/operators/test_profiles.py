from quarry.registry import QUERIES


def test_titles_are_worked_out_once(spark, small):
    """A document's titles were written out anew in each column that uses them."""
    plan = QUERIES["document_profiles"](spark, small)._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_distinct(filter(transform(split(") <= 1
