"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The field tags each word as toxic or not. It is fitted in one task on a bounded sample of labelled documents: words
whose presence goes with the label are the seed tags of the sample's toxic documents. A word's features are itself
and its beginnings and ends, so unseen forms of a toxic word count too. Scoring is a narrow map over whole texts: the
forward and backward messages of all texts of a block are one chain that is cut at text borders; chunks of it become
2 x 2 matrices, which compose by a prefix scan. Sums of the marginals give a document's score through a logistic
function fitted on the same sample; words with a marginal of a half or more are the offending offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, doc_text, free_caches, kept, short_batches, trim_memory, trimmed

#: Labelled documents of each class that the model is fitted on, at most; a class takes no more once it has so many characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 3_000, 6_000, 50_000_000
MIN_TEXTS, EVIDENCE = 8, 16.0
CHUNK, WINDOW = 32, 8
#: Words whose weights a Python worker keeps, and bytes of text that it works on at a time.
CACHE_WORDS, RUN_BYTES = 100_000, 500_000
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cut(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """The same as words_in, words not yet coded. Nothing but bytes and bits is held for each byte of the texts."""
    raw = [t.encode() for t in texts]
    joined = b"\n".join(raw).lower() + b"\n"
    data = np.frombuffer(joined, np.uint8)
    sep = _SEPARATORS[data]
    at = np.flatnonzero(~sep & np.concatenate([[True], sep[:-1]]))
    ends = np.flatnonzero(sep & np.concatenate([[False], ~sep[:-1]]))
    letters = data[~sep]
    offsets = np.concatenate([[0], np.cumsum(ends - at)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    starts = np.concatenate([[0], np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))])
    return words, np.searchsorted(at, starts), at, raw, starts


def words_in(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Words (runs of letters and digits, A-Z as a-z), where each text's begin, their byte places, the raw texts."""
    words, *rest = _cut(texts)
    return words.dictionary_encode(), *rest


def _coded(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of many texts in order of appearance, the number of each word, where each text's begin."""
    made, sizes = [], [np.zeros(1, np.int64)]
    for a, b in _runs_of(np.cumsum([0, *map(len, texts)]), RUN_BYTES):
        words, first, _, _, _ = _cut(texts[a:b])
        made.append(words)
        sizes.append(np.diff(first))
    words = pa.chunked_array(made, pa.binary()).dictionary_encode().combine_chunks()
    return words.dictionary, words.indices.to_numpy(), np.cumsum(np.concatenate(sizes))


def _runs_of(first: np.ndarray, most: int = RUN_BYTES // 4) -> Iterator[tuple[int, int]]:
    """Neighbouring texts (from, to) of at most so many words (or one text), given where each begins."""
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + most, side="right")) - 1)
        yield a, b
        a = b


#: A word's features besides itself: beginnings and ends of so many bytes, of longer words.
BEGINNINGS, ENDS = (3, 4, 5, 6), (3, 4)


def parts(word: bytes) -> list[bytes]:
    """A word's features: itself, its beginnings and its ends."""
    return [b"=" + word, *(b"<" + word[:k] for k in BEGINNINGS if len(word) > k), *(b">" + word[-k:] for k in ENDS if len(word) > k)]


def feature_columns(words: pa.Array) -> Iterator[tuple[bytes, np.ndarray, pa.Array, np.ndarray]]:
    """The same for many distinct words, one kind of feature at a time: mark, who has it, its values, the codes of those that do."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    kinds = [(b"=", 0, lambda w: w)]
    kinds += [(b"<", k, lambda w, k=k: pc.binary_slice(w, 0, k)) for k in BEGINNINGS] + [(b">", k, lambda w, k=k: pc.binary_slice(w, -k)) for k in ENDS]
    for mark, k, cut in kinds:
        has = np.flatnonzero(size > k)
        made = cut(words.take(pa.array(has))).dictionary_encode()
        yield mark, has, made.dictionary, made.indices.to_numpy()


def _passed(row: list[np.ndarray], step: list[np.ndarray]) -> list[np.ndarray]:
    """A row vector (two arrays) times a 2 x 2 matrix (four arrays)."""
    return [row[0] * step[0] + row[1] * step[2], row[0] * step[1] + row[1] * step[3]]


def _scan(m: list[np.ndarray]) -> list[np.ndarray]:
    """Inclusive products of a sequence of 2 x 2 matrices, each scaled to a sum of 1."""
    m, step = [x.copy() for x in m], 1
    while step < len(m[0]):
        later, ahead = [x[step:] for x in m], [x[:-step] for x in m]
        new = _passed(ahead[:2], later) + _passed(ahead[2:], later)
        scale = new[0] + new[1] + new[2] + new[3]
        for x, y in zip(m, new):
            x[step:] = y / scale
        step *= 2
    return m


def _messages(grid: list[np.ndarray]) -> list[np.ndarray]:
    """Row-vector messages [place, chunk] that reach each step, for steps [place, chunk] of a chain."""
    chunks = grid[0].shape[1]
    at = lambda k: [g[k] for g in grid]
    whole = [x.copy() for x in at(0)]
    for k in range(1, CHUNK):
        step = at(k)
        whole = _passed(whole[:2], step) + _passed(whole[2:], step)
        if k % 4 == 0 or k == CHUNK - 1:
            scale = whole[0] + whole[1] + whole[2] + whole[3]
            whole = [x / scale for x in whole]
    total = _scan(whole)
    row = [np.full(chunks, 0.5), np.full(chunks, 0.5)]
    row[0][1:], row[1][1:] = (total[0] + total[2])[:-1], (total[1] + total[3])[:-1]
    out = [np.empty((CHUNK, chunks)), np.empty((CHUNK, chunks))]
    for k in range(CHUNK):
        scale = row[0] + row[1]
        out[0][k], out[1][k] = row[0] / scale, row[1] / scale
        row = _passed([out[0][k], out[1][k]], at(k))
    return out


def marginals(scores: np.ndarray, opens: np.ndarray, start: float, moves: np.ndarray) -> np.ndarray:
    """P(toxic) for each word. scores: log odds of a word's tag; opens: whether it is its text's first;
    start, moves: log weights of a first toxic tag, and of [from][to]."""
    n = len(scores)
    if not n:
        return np.zeros(0)
    chunks = -(-n // CHUNK)
    size = chunks * CHUNK
    odds = np.ones(size)
    odds[:n] = np.exp(np.clip(scores, -25, 25))
    cut = np.zeros(size, bool)
    cut[:n] = opens
    cut[n:] = True  # filler behind the last text
    m = np.exp(moves)
    steps = [np.where(cut, 1.0, m[0, 0]), np.where(cut, np.exp(start), m[0, 1]) * odds, np.where(cut, 1.0, m[1, 0]), np.where(cut, np.exp(start), m[1, 1]) * odds]
    ahead = _messages([np.ascontiguousarray(x.reshape(chunks, CHUNK).T) for x in steps])
    turned = [steps[0], steps[2], steps[1], steps[3]]  # the same chain, read backwards
    back = _messages([np.ascontiguousarray(x[::-1].reshape(chunks, CHUNK).T) for x in turned])
    flat = lambda x: x.T.reshape(-1)
    alpha = _passed([flat(x) for x in ahead], steps)
    beta = [flat(x)[::-1] for x in back]
    toxic = alpha[1] * beta[1]
    return (toxic / (alpha[0] * beta[0] + toxic))[:n]


def pair_marginals(scores: np.ndarray, cut: np.ndarray, start: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on windows [row, place]: P(toxic) of each word, and the sums over rows and places of the
    probabilities of neighbouring tags [from][to] where no text begins. cut: whether a text begins at a word."""
    rows, n = scores.shape
    node = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -25, 25))], axis=2)
    step = np.where(cut[:, :, None, None], np.array([1.0, np.exp(start)]), np.exp(moves))  # [row, place, from, to]
    ahead, back = np.empty((rows, n, 2)), np.ones((rows, n, 2))
    ahead[:, 0] = node[:, 0] * np.where(cut[:, 0, None], np.array([1.0, np.exp(start)]), 1.0)
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, n):
        x = np.einsum("ri,rij->rj", ahead[:, k - 1], step[:, k]) * node[:, k]
        ahead[:, k] = x / x.sum(axis=1, keepdims=True)
    for k in range(n - 2, -1, -1):
        x = np.einsum("rij,rj->ri", step[:, k + 1], node[:, k + 1] * back[:, k + 1])
        back[:, k] = x / x.sum(axis=1, keepdims=True)
    p = ahead * back
    p /= p.sum(axis=2, keepdims=True)
    pairs = ahead[:, :-1, :, None] * step[:, 1:] * (node[:, 1:] * back[:, 1:])[:, :, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    return p[:, :, 1], (pairs * ~cut[:, 1:, None, None]).sum(axis=(0, 1))


def _fit_field(windows: np.ndarray, tags: np.ndarray, cuts: np.ndarray, uses: np.ndarray, mask: np.ndarray, n: int, rounds: int = 6) -> tuple[np.ndarray, float, np.ndarray]:
    """Likelihood ascent (AdaGrad) on windows of equal length. windows: word numbers; cuts: where a text begins;
    uses[word]: its features."""
    weight, start, moves = np.zeros(n), 0.0, np.zeros((2, 2))
    seen, seen_s, seen_m = np.full(n, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 256)):
            w, y, cut = windows[rows], tags[rows], cuts[rows]
            u = (weight[uses[w]] * mask[w]).sum(axis=2)
            p, expected = pair_marginals(u, cut, start, moves)
            err = y - p
            g = np.bincount(uses[w].ravel(), (err[:, :, None] * mask[w]).ravel(), n) / len(rows) - 1e-5 * weight
            seen += g * g
            weight += 0.3 * g / np.sqrt(seen)
            t = np.stack([1 - y, y], axis=2)
            gm = (np.einsum("nki,nkj->ij", t[:, :-1] * ~cut[:, 1:, None], t[:, 1:]) - expected) / len(rows)
            seen_m += gm * gm
            moves += 0.1 * gm / np.sqrt(seen_m)
            gs = float((err * cut).sum() / len(rows))
            seen_s += gs * gs
            start += 0.1 * gs / np.sqrt(seen_s)
    return weight, start, moves


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: log(1 + sum of squared marginals), in which many faint ones of a long text count little; the largest."""
    n = len(first) - 1
    out = np.zeros((n, 2))
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full, 0] = np.log1p(np.add.reduceat(p * p, first[:-1][full]))
        out[full, 1] = np.maximum.reduceat(p, first[:-1][full])
    return out


def one_of_each(texts: list[str]) -> np.ndarray:
    """Which sample texts to learn from: one of each family of copies, told by two minima over hashed four-word runs.

    Else the words of a text that was copied a hundred times would look like a hundred independent cases.
    """
    _, numbers, first = _coded(texts)
    keep = np.ones(len(texts), bool)
    known: tuple[set[int], set[int]] = set(), set()
    for a, b in _runs_of(first):
        codes = numbers[first[a] : first[b]].astype(np.uint64)
        if len(codes) < 4:
            continue
        runs = codes.copy()
        for k in range(1, 4):
            runs[:-k] = runs[:-k] * np.uint64(0x9E3779B97F4A7C15) + codes[k:]
        for factor, seen in zip((0xBF58476D1CE4E5B9, 0x94D049BB133111EB), known):
            mixed = (runs ^ (runs >> np.uint64(31))) * np.uint64(factor)
            mixed ^= mixed >> np.uint64(29)
            for i in range(a, b):
                if first[i + 1] - first[i] >= 4:
                    low = int(mixed[first[i] - first[a] : first[i + 1] - 3 - first[a]].min())
                    keep[i] &= low not in seen
                    seen.add(low)
    return keep


def fit(texts: list[str], labels: np.ndarray) -> dict:
    """The model, from sample texts and their 0/1 labels, as plain lists.

    Two thirds of the texts fit the field, the others the logistic function over its marginals. Features of fewer than
    MIN_TEXTS texts have no weight, so that the field can't learn its sample by heart.
    """
    keep = one_of_each(texts)
    texts, labels = [t for t, k in zip(texts, keep) if k], labels[keep]
    names, codes, first = _coded(texts)
    of_toxic = np.repeat(labels == 1, np.diff(first))
    n_bad, n_good = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    bad, good = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for a, b in _runs_of(first):  # in how many texts of either label each word is
        doc = np.repeat(np.arange(a, b), np.diff(first[a : b + 1]))
        pairs = np.unique(doc * max(len(names), 1) + codes[first[a] : first[b]])
        sick = labels[pairs // max(len(names), 1)] == 1
        bad += np.bincount(pairs[sick] % max(len(names), 1), minlength=len(names))
        good += np.bincount(pairs[~sick] % max(len(names), 1), minlength=len(names))
    base = n_bad / (n_bad + n_good)
    number = {b"": 0}
    seed = np.zeros(max(len(names), 1), bool)
    uses, mask = np.zeros((len(names) + 1, 2 + len(BEGINNINGS) + len(ENDS)), np.int32), np.zeros((len(names) + 1, 2 + len(BEGINNINGS) + len(ENDS)), bool)
    mask[:, 0] = True
    for column, (mark, has, values, code) in enumerate(feature_columns(names), 1):
        b, g = np.bincount(code, bad[has], len(values)), np.bincount(code, good[has], len(values))
        frequent = np.flatnonzero(b + g >= MIN_TEXTS)
        places = np.zeros(len(values), np.int64)
        places[frequent] = np.arange(len(frequent)) + len(number)
        number |= {mark + values[k].as_py(): int(places[k]) for k in frequent.tolist()}
        uses[has, column], mask[has, column] = places[code], places[code] > 0
        if mark == b"=" or (mark == b"<" and column in (4, 5)):  # a word, or five or six bytes of its beginning
            # Seeds go with toxic texts far beyond chance (log likelihood ratio), over all features tried.
            rate = b / np.maximum(b + g, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = b * np.log(rate / base) + np.where(g > 0, g * np.log((1 - rate) / (1 - base)), 0.0)
            seed[has] |= ((rate > 2 * base) & (rate > 0.7) & (gain > EVIDENCE))[code]
    mask[-1, 0] = True  # a filler beyond the texts' ends
    padded = np.full(len(codes) + 2 * WINDOW, len(names), np.int32)
    padded[WINDOW : WINDOW + len(codes)] = codes
    tagged = np.zeros(len(padded), bool)
    tagged[WINDOW : WINDOW + len(codes)] = seed[codes] & of_toxic
    fits = np.repeat(np.arange(len(texts)) % 3 != 2, np.diff(first))
    rng = np.random.default_rng(11)
    hits = np.flatnonzero(tagged[WINDOW : WINDOW + len(codes)] & fits)
    pool = np.flatnonzero(fits)
    some = lambda x, n: rng.choice(x, min(len(x), n), replace=False)
    # The least likely seeds of clean texts are shown too, so that their beginnings and ends get their due.
    near = np.flatnonzero(seed[codes] & ~of_toxic & fits)
    centres = np.concatenate([some(hits, 8_000), some(near, 4_000), some(pool, 16_000)]).astype(np.int64) + WINDOW
    if not len(hits):
        return {"weight": {}, "start": 0.0, "moves": [[0.0, 0.0], [0.0, 0.0]], "final": [-2.0, 0.0, 0.0]}
    opens = np.zeros(len(codes), bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    cuts = np.ones(len(padded), bool)  # fillers stand alone
    cuts[WINDOW : WINDOW + len(codes)] = opens
    places = centres[:, None] + np.arange(-WINDOW, WINDOW + 1)
    weight, start, moves = _fit_field(padded[places], tagged[places].astype(float), cuts[places], uses, mask, len(number))
    score = np.concatenate([(weight[u] * m).sum(axis=1) for u, m in zip(np.array_split(uses, 16), np.array_split(mask, 16))])
    held = np.arange(2, len(texts), 3)
    x = np.ones((len(held), 3))
    for row, i in enumerate(held.tolist()):
        own = slice(first[i], first[i + 1])
        x[row, 1:] = _summary(marginals(score[codes[own]], opens[own], start, moves), np.array([0, first[i + 1] - first[i]]))
    y, w = labels[held], np.zeros(3)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(3), x.T @ (y - q) - w)
    return {"weight": {k.hex(): float(weight[i]) for k, i in number.items() if weight[i]}, "start": float(start), "moves": moves.tolist(), "final": w.tolist()}


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> dict:
    """Fit the model on a bounded sample of the documents with labels that are not held out.

    Of each class, the ids with the smallest hashes: SAMPLE_TOXIC and SAMPLE_CLEAN of them at most, and no more once
    they have SAMPLE_CHARS characters, whatever the length of each. Labels other than 0 and 1 and null ids are left out;
    an id with several labels counts as toxic if one is; of an id with several texts, the first in order is taken.
    Without labels the model scores every text alike.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = kept(usable.where("y = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(usable.where("y = 0").orderBy(*order).limit(SAMPLE_CLEAN)), "sample")
    texts = doc_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts = kept(texts.withColumn("n", F.length("text")), "sample")
    before = F.sum("n").over(Window.partitionBy("y").orderBy(*order)) - F.col("n")  # over the sample's lengths only
    fitting = texts.select("doc_id", "y", "n").select("doc_id", before.alias("before")).where(F.col("before") < SAMPLE_CHARS).select("doc_id")
    sample = texts.join(F.broadcast(fitting), "doc_id", "left_semi").withColumn("grp", F.lit(0))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        free_caches()
        pdf = pdf.sort_values(["doc_id", "text"])
        made = json.dumps(fit(pdf["text"].tolist(), pdf["y"].to_numpy(np.int64)))
        trim_memory()
        return pd.DataFrame({"model": [made]})

    made = sample.groupBy("grp").applyInPandas(one, "model string").collect()
    return json.loads(made[0]["model"]) if made else fit([], np.zeros(0, np.int64))


def _weights(model: dict) -> dict[bytes, float]:
    return {bytes.fromhex(k): w for k, w in model["weight"].items()}


def _tagged(model: dict, weight: dict[bytes, float], texts: list[str], known: dict[bytes, float]) -> tuple:
    """Words, marginals and scores of a block of texts."""
    words, first, at, raw, starts = words_in(texts)
    if len(known) > CACHE_WORDS:
        known.clear()
    each = []
    for w in words.dictionary.to_pylist():
        s = known.get(w)
        if s is None:
            s = known[w] = weight.get(b"", 0.0) + sum(weight.get(x, 0.0) for x in parts(w))
        each.append(s)
    codes = words.indices.to_numpy()
    opens = np.zeros(len(codes), bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    p = marginals(np.array(each)[codes] if len(codes) else np.zeros(0), opens, model["start"], np.array(model["moves"]))
    x = np.column_stack([np.ones(len(texts)), _summary(p, first)])
    return words, first, at, raw, starts, p, 1 / (1 + np.exp(-np.clip(x @ np.array(model["final"]), -30, 30)))


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        weight, known = _weights(sent.value), {}
        for batch in batches:
            for ids, texts in blocks(batch.column(0), batch.column(1), RUN_BYTES):
                words, first, at, raw, starts, p, score = _tagged(sent.value, weight, texts, known)
                spans: list[list[dict]] = [[] for _ in texts]
                for t in np.flatnonzero(p >= 0.5).tolist():
                    i = int(np.searchsorted(first, t, side="right")) - 1
                    own = raw[i]
                    a = int(at[t] - starts[i])
                    b = a + len(words.dictionary[words.indices[t].as_py()].as_py())
                    begin = len(own[:a].decode(errors="replace"))
                    spans[i].append({"start": begin, "end": begin + len(own[a:b].decode(errors="replace")), "p": round(float(p[t]), 6)})
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))], ["doc_id", "score", "spans"])

    return trimmed(run)


def keep(docs: DataFrame, model: dict, below: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose texts score below a bound: a narrow map, no join."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        weight, known = _weights(sent.value), {}
        for batch in batches:
            at = 0
            for rows, texts in blocks(pa.array(range(batch.num_rows)), batch.column(place).fill_null(""), RUN_BYTES):
                good = _tagged(sent.value, weight, texts, known)[-1] < below
                yield batch.slice(at, len(rows)).filter(pa.array(good))
                at += len(rows)

    return docs.mapInArrow(trimmed(run), docs.schema)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: score (0 to 1), spans (array of start, end in code points, and marginal p) of toxic words.

    A null text is an empty one, which gets the score of a text without toxic words. Null and repeated ids pass through,
    one row out for each row in; an empty table gives an empty result; further columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its features come from the bounded sample
    return doc_text(docs, id_col, text_col).mapInArrow(_scorer(sent), "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
