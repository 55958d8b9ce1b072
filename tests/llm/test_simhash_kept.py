"""One row of each component stays, also where unrelated texts share a key."""

from barloom.llm import simhash

ONE, OTHER = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"


def test_components_that_share_a_key_keep_a_row_each(spark):
    rows = [(1, ONE), (2, ONE), (1, OTHER), (3, OTHER), (None, "a b c d"), (None, "a  B c d")]
    assert (simhash.simhash(ONE) ^ simhash.simhash(OTHER)).bit_count() > 2
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.lower().split()) for r in kept) == [(0, ["a", "b", "c", "d"]), (1, ONE.split()), (1, OTHER.split())]
