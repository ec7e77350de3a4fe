"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest

from taxospark.llm import decontaminate
from taxospark.llm.decontaminate import contamination, decontaminated, item_windows, spans
from pyspark.sql import functions as F

GAP = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [w for w in GAP.split((text or "").translate(LOWER)) if w]


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(len(w) - width + 1, 1)):
                windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for g, own in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= own
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return out


def got(df):
    return sorted(((r["doc_id"], r["n_words"], list(r["hit"]), list(r["items"])) for r in df.collect()), key=repr)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "Ab", "é", "É", "7", "zzz", "日本", "x", "😀y"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--", "\t", ". "]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 9]))) for i in range(12)] + [(20, None), (21, ""), (22, " .,"), (None, "ab ab ab ab"), (3, "ab x ab x"), (4, "ab x ab x"), (101, "x x x x x"), (11, "x x x x x")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "?!"), (None, "x x x x x"), (5, "ab x ab x"), (5, "ab x ab x"), (6, "x " * 3000)]
    return docs, items


@pytest.mark.parametrize("width", [4, 10])
def test_contamination_against_brute_force(spark, width):
    docs, items = fixture(width)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    d = d.withColumns({"hit": F.lit("own"), "_id": F.lit(1), "words": F.lit(2)})
    want = sorted(brute(docs, items, width), key=repr)
    assert got(contamination(d, b, width)) == want
    assert any(x[2] for x in want) and any(not x[2] for x in want)


def test_slices_of_the_set_give_the_same(spark, monkeypatch):
    docs, items = fixture(3)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 700)
    found = contamination(d, b, 4)
    assert found.columns == ["doc_id", "text_hash", "n_words", "hit", "items"]
    assert got(found) == sorted(brute(docs, items, 4), key=repr)


def test_equal_hashes_alone_are_no_hit(spark):
    """A window in the set whose words are others than those that have its hash."""
    windows, members = item_windows(spark.createDataFrame([(1, "a b c d")], "item_id long, text string"), 4)
    forged = windows.withColumn("gram", F.lit("p q r s"))
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert decontaminate.window_hits(docs, windows).count() == 1
    assert decontaminate.window_hits(docs, forged).count() == 0


def test_empty_tables(spark):
    docs, items = fixture(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contamination(d.limit(0), b).count() == 0
    assert got(contamination(d, b.limit(0))) == sorted(((i, len(words(t)), [], []) for i, t in docs), key=repr)
    assert sorted(map(tuple, decontaminated(d, b.limit(0), "spans").collect()), key=repr) == sorted(docs, key=repr)


def test_removal(spark):
    passage = "One two three four five six seven eight nine ten, eleven"
    docs = [(1, f"Before.  {passage}! After", "a"), (2, "clean text, kept as it is", "b"), (3, passage, "c"), (4, None, "d"), (None, f"x {passage} y", "e"), (5, f"{passage} mid-dle {passage}; end.", "f"), (6, "one two three four five six seven eight nine", "g")]
    d = spark.createDataFrame(docs, "doc_id long, text string, hit string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = {tuple(r) for r in decontaminated(d, b).collect()}
    assert kept == {docs[1], docs[3], docs[6]}
    cut = {tuple(r) for r in decontaminated(d, b, "spans").collect()}
    assert cut == {(1, "Before.  After", "a"), docs[1], docs[3], (None, "x y", "e"), (5, "mid-dle end.", "f"), docs[6]}
    with pytest.raises(ValueError):
        decontaminated(d, b, "lines")
    runs = contamination(d, b).select("doc_id", spans("hit").alias("s")).where("doc_id = 5").first()["s"]
    assert [(s["start"], s["end"]) for s in runs] == [(0, 11), (13, 24)]


def test_query_digest(spark, tmp_path):
    from taxospark.llm.queries import op12_decontamination

    docs, items = fixture(8)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(((d, n, len(h), len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bool(h)) for d, n, h, i in brute(docs, items, 10)), key=repr)
    assert sorted((tuple(r) for r in op12_decontamination(spark, str(tmp_path)).collect()), key=repr) == want
