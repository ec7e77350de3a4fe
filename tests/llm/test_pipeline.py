"""The stages of the corpus pipeline and the whole of it against a brute-force version on a small table."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from taxospark.llm import toxicity

from .test_llm import distance

BYTE = public_tokenizers.path("byte_bpe_50k.json")
BAD = ("nasty", "vileness", "horrid")


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, toxic): random prose, some of it toxic, then copies, near copies, repeated lines and odd texts."""
    rng = random.Random(5)
    out = []
    for i in range(400):
        words = [f"word{rng.randrange(3000)}" for _ in range(60)]
        if i % 4 == 0:
            for k in rng.sample(range(60), 9):
                words[k] = rng.choice(BAD)
        out.append((i, " ".join(words[:30]) + "\n" + " ".join(words[30:]), int(i % 4 == 0)))
    clean = [r[1] for r in out if not r[2]]
    extra = [clean[0], clean[1].replace("\n", " "), "\n".join(["a line of its own"] + clean[2].split("\n")[:1]), clean[3].split("\n")[0][:-1] + "#\nanother line here", None, "", "mail a@b.cd now", "mail a@b.cd now"]
    near = [f"near{k}" for k in range(100)]
    extra += [" ".join(near), " ".join(near[:50] + ["changed"] + near[51:])]
    return out + [(1000 + k, t, None) for k, t in enumerate(extra)]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(d, t, "en", "s", len(t or ""), "x") for d, t, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, spans string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, _, y in rows if y is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def close(x, y):
    """Within two edits: then a third of x is in y as it stands."""
    n = len(x) // 3
    return abs(len(x) - len(y)) <= 2 and any(t in y for t in (x[:n], x[n : 2 * n], x[2 * n :])) and distance(x, y) <= 2


def lines_out(docs):
    seen, out = [], {}
    for d, t in sorted(docs.items()):
        left, gone = [], False
        for line in (t or "").split("\n"):
            if line.strip():
                if any(line == m or (min(len(line), len(m)) >= 20 and close(line, m)) for m in seen):
                    gone = True
                    seen.append(line)
                    continue
                seen.append(line)
            left.append(line)
        if not gone:
            out[d] = t
        elif any(x.strip() for x in left):
            out[d] = "\n".join(left)
    return out


def near_out(docs):
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    top = {d: d for d in docs}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: t for d, t in docs.items() if root(d) == d}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_whole_pipeline(spark, rows, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    left = corpus_pipeline.kept(corpus_pipeline.toxicity_stage(spark, docs, sf_dir), "left")
    assert left.columns == docs.columns
    kept = texts(left)
    assert kept == {d: t for d, t, y in rows if not y}
    for stage, brute in ((corpus_pipeline.line_stage, lines_out), (corpus_pipeline.jaccard_stage, near_out), (corpus_pipeline.pii_stage, lambda x: {d: t and t.replace("a@b.cd", "[EMAIL]") for d, t in x.items()})):
        left = corpus_pipeline.kept(stage(spark, left, sf_dir), "left")
        kept = brute(kept)
        assert left.columns == docs.columns and texts(left) == kept, stage.__name__
        assert left.where("n_chars <> length(text) or spans <> 'x'").count() == 0
    t = Tokenizer.from_file(BYTE)
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in kept.items()}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in fills) <= 2048 and len(fills) <= -(-sum(want.values()) // 2048) + 1


def test_stages_on_empty_and_repeated_rows(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    none = docs.limit(0)
    twice = docs.where("doc_id in (1, 1006)").unionByName(docs.where("doc_id in (1, 1006)")).withColumn("doc_id", F.when(F.col("doc_id") == 1006, F.lit(None)).otherwise(F.col("doc_id")))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
    assert corpus_pipeline.line_stage(spark, twice, sf_dir).count() == 4  # an id's equal lines at one place are one line; null ids stay
    assert corpus_pipeline.jaccard_stage(spark, twice, sf_dir).count() == 4
    assert corpus_pipeline.pii_stage(spark, twice, sf_dir).count() == 4
    assert corpus_pipeline.packing_stage(spark, twice, sf_dir).count() == 4
    assert toxicity.keep(twice, {"weight": {}, "start": 0.0, "moves": [[0.0, 0.0], [0.0, 0.0]], "final": [-2.0, 0.0, 0.0]}, 0.5).count() == 4
