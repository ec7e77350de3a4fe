"""Slices of hierarchies that have cycles and classes among their members."""

from taxospark.sources import slices


def test_slice_without_budget_has_no_cycle_and_no_class_as_member(spark):
    tax = [("a", "root"), ("b", "root"), ("c", "a"), ("c", "b"), ("a", "c"), ("far", "else")]
    members = [("m1", "c"), ("m2", "c"), ("m2", "c"), ("b", "c"), ("m3", "b"), ("m4", "far")]
    hyper = spark.createDataFrame(tax, "child string, parent string")
    listed = spark.createDataFrame(members, "instance string, concept string")
    kept, own = slices.clean_slice(hyper, listed, "root", 5, None, None)
    assert {tuple(r) for r in kept.collect()} == {("a", "root"), ("b", "root"), ("c", "a"), ("c", "b")}
    assert sorted(tuple(r) for r in own.collect()) == [("m1", "c"), ("m2", "c")]
    assert [tuple(r) for r in slices.clean_slice(hyper, listed, "root", 5, 100, 1)[1].collect()] == []  # the first is the class b
