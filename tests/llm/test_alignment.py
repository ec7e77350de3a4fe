"""Cross-tokenizer alignment against brute force over the libraries' own tokens."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from taxospark.llm import alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", " \n", "\t", "a", "B", "é", "日本", "😀", "<s>", "<|endoftext|>", "</s>", "▁", "\x00", "\x85", "\xa0", "'s", "12", "!", "...", "<0x41>", "　", "ing", "the", "tokenizer", "über"]


def tokens(pair, text):
    """(A ids, B ids, A ends, B ends), or None for a text without tokens."""
    whole = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    if not text or b"".join(x) != whole or b"".join(y) != whole:
        return None
    return a, b, np.cumsum(list(map(len, x))).tolist(), np.cumsum(list(map(len, y))).tolist()


def brute(pair, texts):
    made = [tokens(pair, t or "") for t in texts]
    links, holding = [], collections.Counter()
    for m in made:
        own = []
        if m:
            a, b, ae, be = m
            at = {k: j for j, (start, end) in enumerate(zip([0, *be], be)) for k in range(start, end)}  # B's token at each byte
            own = [(a[i], b[j]) for i, (start, end) in enumerate(zip([0, *ae], ae)) for j in sorted({at[k] for k in range(start, end)})]
        links.append(own)
        holding.update(set(own))
    most = collections.Counter()
    for (a, _), n in holding.items():
        most[a] = max(most[a], n)
    out = []
    for m, own in zip(made, links):
        if not m:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, ae, be = m
        groups, i, j = [], 0, 0
        for cut in sorted(set(ae) & set(be)):
            x, y = [], []
            while i < len(ae) and ae[i] <= cut:
                x.append(str(a[i]))
                i += 1
            while j < len(be) and be[j] <= cut:
                y.append(str(b[j]))
                j += 1
            groups.append(f"{','.join(x)}|{','.join(y)}")
        out.append((len(a), len(b), len(groups), len(own), sum(holding[k] == most[k[0]] for k in own), sum(holding[k] for k in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def rows(seed=1, n=150):
    rng = random.Random(seed)
    return [None, "", " ", "  ", "\n", "x " * 4000, "y" * 3000, "ab cd", "ab cd", "a▁b"] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("part, run, table", [(4_000_000, 1_000_000, 3_000_000), (700, 200, 1000)])
def test_alignment_against_brute_force(spark, tmp_path, monkeypatch, part, run, table):
    from taxospark.llm.queries import op13_alignment

    monkeypatch.setattr(alignment, "PART_PAIRS", part)
    monkeypatch.setattr(alignment, "RUN", run)
    monkeypatch.setattr(alignment, "TABLE_BYTES", table)
    texts = rows()
    ids = [None if i == 8 else 3 if i == 9 else i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumns({"n_a": F.lit("own"), "groups": F.lit(1)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((d, *w) for d, w in zip(ids, brute(alignment.Pair(BYTES, PIECES), texts))), key=repr)
    assert sorted((tuple(r) for r in op13_alignment(spark, str(tmp_path)).collect()), key=repr) == want
    assert sum(w[1] > 0 for w in want) > 50


def test_groups_and_empty_table(spark):
    df = spark.createDataFrame([(1, "unbelievable tokenizers")], "doc_id long, text string")
    r = alignment.aligned(df, BYTES, PIECES).first()
    a, b, ae, be = tokens(alignment.Pair(BYTES, PIECES), "unbelievable tokenizers")
    assert r["has_tokens"] and [x for g in r["groups"].split(";") for x in g.split("|")[0].split(",")] == list(map(str, a))
    assert r["n_groups"] == len(set(ae) & set(be)) and r["n_links"] == r["n_best"] == r["count_sum"]
    assert alignment.aligned(df.limit(0), BYTES, PIECES).count() == 0


def test_coalescing():
    start, end, side = np.array([0, 2, 5, 0, 5, 6]), np.array([2, 5, 9, 5, 6, 9]), np.array([0, 0, 0, 1, 1, 1])
    order, group = alignment.coalesced(start, end, side)
    assert order.tolist() == [0, 3, 1, 2, 4, 5] and group.tolist() == [0, 0, 0, 1, 1, 1]
    assert [x.tolist() for x in alignment.overlaps(start[:3], end[:3], start[3:], end[3:])] == [[0, 1, 2, 2], [0, 0, 1, 2]]


def test_quick_encoder_is_the_library(spark):
    """Every character, next to a letter, a number and itself."""
    pair = alignment.Pair(BYTES, PIECES)
    assert pair.quick and alignment._quick(public_tokenizers.path("word_bpe_49k.json"), alignment.byte_letters()) is None
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} ?" for c in points[k : k + 4000])
        assert pair.quick(text) == pair.a.encode(text, add_special_tokens=False).ids
    pair.quick = None
    chunks = [" a", "  b", " <|endoftext|>x", " é\n\t1"]
    ids, sizes, _, _ = pair.encode(chunks)
    assert ids.tolist() == [i for c in chunks for i in alignment.Pair(BYTES, PIECES).quick(f" {c}")] and sizes.sum() == len(ids)
