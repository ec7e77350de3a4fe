"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxospark.llm import bpe_chunks, jaccard, line_dedup, packing, pii, quality, token_counts, topk, toxicity, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "\n\n", "it's 're we'll 'l 'r they've'x don't  \n\n x\t\ty  z \n 's\n'd''s ' 's", "12a3 4²½ ñ́ 中文字 😀😀  x   y\x00\x1cq",
    "a<|endoftext|> b  <|endoftext|>c<|startoftext|>", "x" * 300 + "!" * 500, "\u0085q​ w ΣΑΣ É́ ﬁ İ", "'r", "a  ", "same words again\n" * 40, "ab" * 6000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    noise = ["".join(rng.choice(["the", "ing", "<|endoftext|>", "'ll", "12", "!!", "Über", " ", "\n", "  "]) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    rows = [(i, t, "doc", 1) for i, t in enumerate(ODD + noise)]
    rows += [(3, ODD[3], "again", 2), (None, "no id here", "x", 3)]  # a repeated row, a null id
    return spark.createDataFrame(rows, "doc_id long, text string, prefix string, n int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def key(rows):
    return sorted(rows, key=repr)


def test_token_counts(docs, none):
    t = Tokenizer.from_file(BYTE)
    want = [(d, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for d, x in texts(docs)]
    assert key(map(tuple, token_counts.token_counts(docs, BYTE).collect())) == key(want)
    assert token_counts.token_counts(none, BYTE).count() == 0


def test_packing(docs, none):
    t = Tokenizer.from_file(BYTE)
    rows = packing.pack(docs, BYTE, 256).collect()
    ids = {}
    for d, x in texts(docs):
        ids.setdefault(d, []).append(t.encode(x, add_special_tokens=False).ids + [0])
    assert sum(r["length"] for r in rows) == sum(len(i) for v in ids.values() for i in v)
    places = {}
    for r in rows:
        own = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(none, BYTE).count() == 0


def test_local_search_empties_bins():
    sizes = [5, 5, 6, 4, 7, 3]
    bins = packing.local_search(sizes, [[0, 3], [1], [2], [4], [5]], 10)
    assert len(bins) == 3 and sorted(r for b in bins for r in b) == list(range(6))


def test_bpe_round_trip(docs, none):
    t = Tokenizer.from_file(WORD)
    want = []
    for d, x in texts(docs):
        ids = t.encode(x, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert key(map(tuple, bpe_chunks.bpe_round_trip(docs, WORD).collect())) == key(want)
    one = docs.where("doc_id = 4")
    assert bpe_chunks.decode(bpe_chunks.encode(one, WORD), WORD).first()["text"] == t.decode(t.encode(ODD[4], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe_chunks.bpe_round_trip(none, WORD).count() == 0


def test_long_stretches_are_repaired():
    t = Tokenizer.from_file(WORD)
    rng = random.Random(2)
    for alphabet in ("abcdeé'!1<|>x", "ab"):
        s = "".join(rng.choice(alphabet) for _ in range(12000))
        assert bpe_chunks.encode_long(s, t, 200) == t.encode(s, add_special_tokens=False).ids


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_of(t):
    out, n = [], []
    for k, p in BASE.items():
        hits = []
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]
            if good:
                hits.append(f"{k}:{m.start()}:{m.end()}")
        out += hits
        n.append(len(hits))
    return (*n, hashlib.sha256(",".join(out).encode()).hexdigest())


def test_pii(spark, docs, none):
    rng = random.Random(3)
    bits = ["1", "22", "333", "4111 1111 1111 1111", "@", "a", "b.c", ".", "-", " ", "+1", "(", ")", "é", "😀", "_", "%", "255", "\n", "x@y.z"]
    cases = ["a@b.c_d@e.f a@b.c.+x@y.z", "1.2.3.4.5 256.1.1.1 001.002.003.0004", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111", "+1 (222) 333-4444 +12345 +123456789012345", "9" * 9000, "1.2.3.4 a@b.cd " * 200]
    cases += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 10_000))
    got = {r["doc_id"]: tuple(r)[1:6] for r in pii.digest(pii.personal_data(df)).collect()}
    assert got == {d: spans_of(t) for d, t in texts(df)}
    assert pii.digest(pii.personal_data(none)).count() == 0


def test_pii_added_kinds_and_masking(spark):
    df = spark.createDataFrame([(1, "my iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789", "x"), (2, "iban GB83 WEST 1234 5698 7654 32", "y"), (3, None, "z"), (4, "mail a@b.cd now", "z")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {1: "my iban [IBAN], ssn [SSN]", 2: "iban GB83 WEST 1234 5698 7654 32", 3: None, 4: "mail [EMAIL] now"}


def counted(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup, cover = set(), 0, set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality_counts(docs, none):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert key(map(tuple, quality.counts(docs).select("doc_id", *cols).collect())) == key((d, *counted(t)) for d, t in texts(docs))
    assert quality.counts(none).count() == 0
    # A filter on a count must not be pushed into the counting.
    assert quality.counts(docs).where("n_repeat_words > 3").count() == sum(counted(t)[4] > 3 for _, t in texts(docs))


def test_quality_rules(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, " ".join(("w%d" % rng.randrange(10**6)) + ("%%%" if bad else "") for _ in range(60)), int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = quality.learn_from(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = quality.apply_rules(quality.counts(df), rules)
    assert {(r["doc_id"] % 3 != 0) == r["kept"] for r in got.collect()} == {True}
    assert str(quality.learn_from(df.limit(0), df.select("doc_id", "quality").limit(0))) == "else keep"


def components(df, n, percent):
    sets = {}
    for d, t in texts(df):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    comp[y] = x
    return {(d, len(sets[d]), root(d)) for d in ids}


def test_jaccard(spark, docs, none, monkeypatch):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 60))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(5)}"
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 500, "text").where("doc_id is not null").distinct().toDF("doc_id", "text"))
    want = components(df, 4, 85)
    assert {tuple(r) for r in jaccard.jaccard_components(df, 4, 85).collect()} == want
    # No leader rounds: the pairwise step alone finds the same, and so do hot n-grams.
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "HOT_TIMES", 0)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in jaccard.jaccard_components(df, 4, 85).collect()} == want


def test_jaccard_within_a_group(spark):
    """Near copies of equal prefix: of a's no other document has an n-gram, of b's others have the late ones."""
    rows = []
    for p, covered in (("a", []), ("b", range(10, 97))):
        words = [f"{p}{i}" for i in range(100)]
        pair = [words + ["x"], words + ["y"]]
        rows += [" ".join(w) for w in pair + [w[-4:] for w in pair] * 3 + [words[i : i + 4] for i in covered]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = components(df, 4, 85)
    assert {(1, 98, 0), (9, 98, 8)} <= want
    assert {tuple(r) for r in jaccard.jaccard_components(df, 4, 85).collect()} == want


def test_jaccard_odd_tables(docs, none):
    assert jaccard.jaccard_components(none).count() == 0
    rows = jaccard.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_line_dedup(spark, docs, none):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(6, 24))) for _ in range(14)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            i, o = rng.randrange(len(s)), rng.randrange(3)
            s[i : i + 1] = [rng.choice("abx😀")] if o == 0 else [] if o == 1 and len(s) > 3 else [s[i], rng.choice("abx")]
        return "".join(s)

    rows = [(i, "\n".join(changed(rng.choice(base)) if rng.random() < 0.8 else rng.choice(["", "  ", base[0]]) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n ")]
    seen, want, clean = [], set(), {}
    for d, t in rows:
        gone, n, left = [], 0, []
        for p, line in enumerate((t or "").split("\n")):
            if re.fullmatch(r"[\x20\x09-\x0D]*", line):
                left.append(line)
                continue
            n += 1
            if any(line == m or (min(len(line), len(m)) >= 10 and distance(line, m) <= 2) for m in seen):
                gone.append(p)
            else:
                left.append(line)
            seen.append(line)
        want.add((d, n, len(gone), ",".join(map(str, gone))))
        if not gone:
            clean[d] = t
        elif any(x.strip() for x in left):
            clean[d] = "\n".join(left)
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, line string")
    assert {tuple(r) for r in line_dedup.line_report(df, 2, 10).collect()} == want
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, 2, 10).collect()} == clean
    assert line_dedup.line_report(none).count() == 0
    assert line_dedup.line_report(docs).count() == docs.select("doc_id").distinct().count()


def test_topk(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(40)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and i < 2000}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = topk.top_k(df, df.where("vec_id % 50 = 0"))
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_prunes_without_loss():
    rng = np.random.default_rng(9)
    blocks = [(np.arange(b * 10, b * 10 + 10), np.floor(rng.normal(size=(10, 4)) * 50 + b)) for b in range(12)]
    q = np.floor(rng.normal(size=(7, 4)) * 50)
    got = topk.search_tile(blocks, np.arange(900, 907), q, 3)
    ids, v = np.concatenate([i for i, _ in blocks]), np.concatenate([x for _, x in blocks])
    for n in range(7):
        s = (v @ q[n]).astype(int)
        assert [(c, x) for k, c, x in got if k == 900 + n] == [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s))[:3]]


def test_warc(spark):
    import base64

    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/ é", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "é" * 40000), (5, "http://d/", "é" * 40000), (6, "http://e/\r\nX: y", "WARC/1.1\r\n\r\n"), (None, "http://f/", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, payload string")
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), i or -1)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = i == best[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""]))
    assert key(map(tuple, warc.warc_round_trip(df).collect())) == key(want)
    assert {r["record_type"] for r in warc.warc_round_trip(df, 10**6).collect()} == {"response"}
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_pushdown(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h{i % 3}/p", f"<p>{i // 2}</p>") for i in range(20)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path, payload=False).where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h1"))
    assert {r["payload"] for r in got.collect()} == {None} and got.count() == sum(i % 2 == 1 and i % 3 == 1 for i in range(20))
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 1)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10


def test_toxicity_marginals():
    import itertools

    rng = np.random.default_rng(0)
    u, opens, moves, start = rng.normal(size=7) * 2, np.array([1, 0, 0, 1, 0, 0, 0], bool), rng.normal(size=(2, 2)), 0.3
    got = toxicity.marginals(u, opens, start, moves)
    for a, b in ((0, 3), (3, 7)):
        total, mean = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            s = np.exp(start * y[0] + float(np.dot(u[a:b], y)) + sum(moves[y[i], y[i + 1]] for i in range(b - a - 1)))
            total, mean = total + s, mean + s * np.array(y)
        assert np.allclose(got[a:b], mean / total)


def test_toxicity(spark, docs, none):
    rng = random.Random(10)
    rows = []
    for i in range(400):
        w = [f"word{rng.randrange(3000)}" for _ in range(80)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(80)] = rng.choice(["nasty", "vileness", "horrid"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).join(df.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(got) > 50 and all((r["score"] >= 0.3) == (r["toxic"] == 1) for r in got.values())
    one = next(r for r in got.values() if r["toxic"])
    assert {rows[one["doc_id"]][1][s["start"] : s["end"]] for s in one["spans"]} <= {"nasty", "vileness", "horrid"} and one["spans"]
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    kept = toxicity.keep(df, model, 0.3)
    assert kept.columns == df.columns and kept.where("toxic = 1").count() == 0 and kept.where("toxic = 0").count() == 300
    empty = toxicity.train(none, df.select("doc_id", "toxic").limit(0))
    assert 0 <= toxicity.score(docs, empty).first()["score"] <= 1
