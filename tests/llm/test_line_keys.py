"""Keys that lines are found by: what a line shares with the index is not sent as a probe again."""

from pyspark.sql import functions as F

from taxospark.llm import line_dedup


def test_probes_leave_out_the_index_keys(spark):
    lines = spark.createDataFrame([("one line of more than twenty",)], "line string").withColumn("n", F.length("line"))
    own, probes = (set(line_dedup.keyed(lines, 2, p).first()["keys"]) for p in (False, True))
    assert len(own) == 3 and len(probes) == 9 and not own & probes


def test_replaced_characters_are_found_in_the_index(spark, monkeypatch):
    """Pairs that share segments at their own place alone, with keys broadcast and joined by shuffle."""
    rows = [(1, "abcdefghijklmnopqrstuvwxyz"), (2, "abcXefghijklmnopqrstuvwXyz"), (3, "abcdefghXjklXnopqrstuvwxyz"), (4, "XbcdeXghijklmnopXrstuvwxyz"), (5, "0123456789012345678901234")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (0, 100):
        monkeypatch.setattr(line_dedup, "BROADCAST_IDS", most)
        assert {r["doc_id"] for r in line_dedup.line_report(df).where("n_dropped = 1").collect()} == {2, 3}
