from panelforge.queries import QUERIES


def test_frontier_has_the_references_points(spark, sf):
    assert QUERIES["l4_frontier"](spark, sf).count() == 121
