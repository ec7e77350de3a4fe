"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxospark.llm import spelling

LOWER = {i: i + 32 for i in range(65, 91)}


def near_of(words):
    """word -> near words, by the words that are left when one letter goes or is masked."""
    keys = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            keys[w[:i], w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for own in keys.values():
        for a in own:
            near[a] |= own - {a}
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            if cut in words and cut != w:
                near[w].add(cut)
                near[cut].add(w)
    return near


def groups(n):
    near, out = near_of(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        out[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = []
    for w, form in out.items():
        root = w
        while out[root] is not None:
            root = out[root]
        rows.append((w, form, root, n[w], len(near[w]), n[form] if form else None))
    return sorted(rows, key=repr)


def brute(docs, every=199):
    n = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return groups({w: k for w, k in n.items() if k >= 5 and len(w) >= 6})


def test_query_against_brute_force(spark, tmp_path):
    from taxospark.llm.queries import op11_spelling_variants

    rng = random.Random(4)
    stems = ["".join(rng.choice("abcéÉ÷z") for _ in range(rng.randrange(5, 9))) for _ in range(40)]
    def word():
        w = rng.choice(stems)
        if rng.random() < 0.2:
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "a", "ab"]) + w[i + 1 :]
        return w.upper() if rng.random() < 0.1 and w.isascii() else w
    docs = [(i, " ".join(word() + rng.choice(["", ",", "1", "日"]) for _ in range(400))) for i in range(60)]
    docs += [(None, None), (90, ""), (91, None), (91, "Abcdefgh " * 30), (91, "abcdefgh " * 30), (None, "abcdefg " * 5), (None, "q" * 20_000 + " "), (92, ("p" * 5000 + " ") * 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("own"), "n": F.lit(1), "id": F.lit(2)})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(docs)
    assert sorted((tuple(r) for r in op11_spelling_variants(spark, str(tmp_path)).collect()), key=repr) == want
    assert sum(r[1] is not None for r in want) > 20 and len(want) > 60


@pytest.mark.parametrize("cell, block, sample, leaf", [(10_000, 50_000, 40_000, 24), (20, 15, 100, 3), (50, 1000, 10, 1)])
def test_groups_against_brute_force(spark, monkeypatch, cell, block, sample, leaf):
    """Many cells, blocks and leaves; anagrams; a length that most words have; chains of forms; ties."""
    for name, value in (("CELL", cell), ("BLOCK", block), ("SAMPLE", sample), ("LEAF", leaf)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdeé") for _ in range(rng.choice([6, 7, 7, 7, 7, 8, 9]))) for _ in range(700)}
    letters = list("abcdefg")
    for _ in range(60):  # anagrams, and some with one letter more or another one
        rng.shuffle(letters)
        words |= {"".join(letters), "".join(letters[:-1]) + "h", "".join(letters) + "h"}
    n = {w: rng.choices([5, 6, 25, 125, 700, 4000], [40, 40, 15, 4, 1, 0.3])[0] for w in sorted(words)}
    n |= {"chainaaa": 90_000, "chainaab": 9000, "chainabb": 900, "chainbbb": 90, "chainbb": 9}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    want = groups(n)
    assert sorted((tuple(r) for r in spelling.spelling_groups(df).collect()), key=repr) == want
    assert any(r[1] and r[2] != r[1] for r in want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    for df in (docs, docs.limit(0)):
        assert spelling.spelling_groups(spelling.word_counts(df)).count() == 0


def test_searches_prune(spark):
    """A search looks at a small part of the leaves."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(20_000)})
    vectors = spelling.letter_counts(words)
    tree = spelling.KdTree(vectors, 24)
    q, leaf = tree.reached(vectors[:500], 1)
    assert len(q) / 500 < 0.1 * (tree.letter < 0).sum()
    assert np.array_equal(spelling._own_cell(tree, vectors)[1][tree.rows[int(leaf[0])]], np.full(len(tree.rows[int(leaf[0])]), leaf[0]))
