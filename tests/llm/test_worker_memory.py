"""What Python workers take while they work and keep afterwards, and what encoding costs."""

import gc
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxospark.llm import packing, toxicity
from taxospark.llm.common import doc_text

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(10)) for _ in range(n))


def batch(*texts: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])


@pytest.fixture
def traced():
    tracemalloc.start()
    yield
    tracemalloc.stop()


def test_packing_keeps_no_pre_tokens(traced):
    run = packing._piece_map(BYTE, 2048, 0)
    list(run(iter([batch("a word")])))  # the encoder stays
    mine = batch(words(60_000, 1))
    gc.collect()
    before = tracemalloc.get_traced_memory()[0]
    for _ in run(iter([mine])):
        pass
    gc.collect()
    assert tracemalloc.get_traced_memory()[0] - before < 1_000_000


def test_toxicity_works_on_short_runs_of_text(traced):
    class sent:
        value = {"weight": {"": -3.0, b"=word".hex(): 5.0}, "start": -1.0, "moves": [[0.0, -1.0], [0.0, 0.5]], "final": [-2.0, 1.0, 1.0]}

    mine = batch(*["a word of it " * 10_000] * 30)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    rows = sum(b.num_rows for b in toxicity._scorer(sent)(iter([mine])))
    assert rows == 30 and tracemalloc.get_traced_memory()[1] - before < 120_000_000


def test_toxicity_is_fitted_in_runs_of_text(traced):
    own = words(60_000, 5).split(" ")
    rng = random.Random(6)
    labels = np.arange(300) % 3 == 0
    texts = [" ".join(rng.choice(["vile", "foul", "rank"]) if y and rng.random() < 0.1 else rng.choice(own) for _ in range(1_500)) for y in labels]
    size = sum(map(len, texts))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    model = toxicity.fit(texts, labels.astype(np.int64))
    assert model["weight"][b"=vile".hex()] > 0 and tracemalloc.get_traced_memory()[1] - before < 12 * size


def test_rows_go_to_workers_in_short_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    docs = spark.range(3_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text"))
    made = [r["n"] for r in doc_text(docs).mapInArrow(sizes, "n long").collect()]
    assert sum(made) > 30_000_000 and max(made) < 1 << 22


def test_packing_ids_are_the_library_s():
    t = Tokenizer.from_file(BYTE)
    vocab = [t.decode([i]) for i in range(0, 50_000, 7)]
    rng = random.Random(2)
    texts = ["", " ", "\0", "a\0b<|endoftext|>c", "<|endoftext|><|endoftext|>", "'ll 's''", "\n \n\t x", "é" * 3000]
    texts += ["".join(rng.choice(vocab) for _ in range(rng.randint(1, 6))) for _ in range(5000)]
    ids, bounds = packing.token_ids(texts, BYTE, 0)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], text


def test_new_pre_tokens_cost_less_than_the_library_takes():
    t = Tokenizer.from_file(BYTE)
    packing.token_ids(["a word"], BYTE, 0)
    text = words(100_000, 3)
    began = time.thread_time()
    ids, _ = packing.token_ids([text], BYTE, 0)
    own, began = time.thread_time() - began, time.thread_time()
    made = t.encode(text.split(" "), is_pretokenized=True, add_special_tokens=False)
    assert len(made.ids) and own < 0.7 * (time.thread_time() - began)
    assert np.array_equal(ids[:-1], np.array(t.encode(text, add_special_tokens=False).ids))
