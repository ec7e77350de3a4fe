"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last bytes says so, at white space wherever there is any: the same passage
is cut alike in every document, and a Python worker encodes each distinct chunk once while it is in use. The words of
a new chunk are looked up in the same way, as the smallest chunks. A join at white space agrees as it stands, since no
token of a word-level BPE crosses it. Only stretches without white space are cut elsewhere; their joins are repaired by
encoding a window around the join, which grows until its tokens agree exactly with those of both chunks. A repair touches
the tokens near its join only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, doc_text

#: Bytes under the rolling hash; a hash with none of the mask's bits set ends a chunk (at one blank in 32).
WINDOW, MASK = 8, 31
#: Stretches without white space longer than this are cut, on average after so many characters.
LONG, LONG_EVERY = 4096, 1024
#: Distinct chunks and words that a Python worker keeps in each of two generations.
CACHE_CHUNKS, CACHE_WORDS = 10_000, 200_000
_FACTOR = 0x9E3779B1
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_loaded: dict = {}


class Recent:
    """A mapping of bounded size: what has not been used since the last turn of generations is dropped."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: list) -> list:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = (t, Recent(CACHE_CHUNKS), Recent(CACHE_WORDS), [t.id_to_token(i) for i in range(t.get_vocab_size())])
    return _loaded[path]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def rolling_hash(data: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes before each place `at`; bytes before `first` (the text's start) count as zero."""
    h = np.zeros(len(at), np.uint32)
    for k in range(WINDOW, 0, -1):
        place = at - k
        h = h * np.uint32(_FACTOR) + np.where(place >= first, data[np.maximum(place, 0)], 0).astype(np.uint32)
    return _mixed(h)


def encode_long(text: str, tokenizer, size: int = LONG_EVERY) -> list[int]:
    """Encode a stretch in content-defined chunks and repair the joins."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.arange(WINDOW, len(points))
    cuts = places[rolling_hash(points, places, np.zeros(1, np.int64)) % np.uint32(size) == 0].tolist()
    bounds = [0, *(c for c in cuts if c + 64 < len(text)), len(text)]
    chunks = [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def tokens(s: str, base: int) -> list[tuple[int, int, int]]:
        e = tokenizer.encode(s, add_special_tokens=False)
        return [(i, base + a, base + b) for i, (a, b) in zip(e.ids, e.offsets)]

    made = tokens(chunks[0], 0)
    for at, chunk in zip(bounds[1:], chunks[1:]):
        right = tokens(chunk, at)
        reach = 64
        while True:
            lo, k = max(0, at - reach), len(made)
            while k and made[k - 1][1] >= lo:
                k -= 1  # tokens from k on begin inside the window
            lo = 0 if lo == 0 else made[k][1] if k < len(made) else at
            hi = min(at + len(chunk), at + reach)
            window = tokens(text[lo:hi], lo)
            # Leave out tokens near cut ends of the window: they agree only by chance.
            left_ok = {made[i]: i for i in range(k, len(made)) if made[i][2] <= at}
            right_ok = {t: i for i, t in enumerate(right)}
            i = 0 if lo == 0 else next((k for k in range(2, len(window) - 2) if window[k] in left_ok and window[k - 1] in left_ok), None)
            j = len(window) if hi == at + len(chunk) else next((k for k in range(len(window) - 3, 0, -1) if window[k] in right_ok and window[k - 1] in right_ok), None)
            if i is not None and j is not None and i <= j:
                del made[left_ok[window[i]] if lo else 0 :]
                made += window[i:j]
                made += right[right_ok[window[j]] :] if j < len(window) else []
                break
            if lo == 0 and hi == at + len(chunk):
                made = window
                break
            reach *= 2
    return [t[0] for t in made]


def _words(words: list[bytes], path: str) -> list[tuple[int, str, str]]:
    tokenizer, _, known, names = _tokenizer(path)
    new = known.missing(words)
    short = [c for c in new if len(c) <= LONG]
    ids = [e.ids for e in tokenizer.encode_batch_fast([c.decode() for c in short], add_special_tokens=False)]
    for c in new:
        if len(c) > LONG:
            short.append(c)
            ids.append(encode_long(c.decode(), tokenizer))
    for c, i in zip(short, ids):
        known.new[c] = (len(i), " ".join(map(str, i)), " ".join([names[k] for k in i]))
    return [known.new[c] for c in words]


def _encoded(chunks: list[bytes], path: str) -> list[tuple[int, str, str]]:
    """For each distinct chunk: number of ids, the ids in decimal, the tokens' strings."""
    known = _tokenizer(path)[1]
    new = known.missing(chunks)
    if new:
        words, first, end = chunks_of(new, 0)
        for c, coded in zip(new, _joined(words, first, end, _words(words.dictionary.to_pylist(), path))):
            known.new[c] = coded
    return [known.new[c] for c in chunks]


def _joined(parts: pa.DictionaryArray, first: np.ndarray, end: np.ndarray, coded: list[tuple[int, str, str]]) -> Iterator[tuple[int, str, str]]:
    """What parts first[i] up to end[i] make together."""
    counts = np.array([c[0] for c in coded], np.int64)
    codes = parts.indices.to_numpy()
    each = counts[codes]
    so_far = np.concatenate([[0], np.cumsum(each)])
    filled = each > 0  # parts of white space alone leave nothing
    place = np.concatenate([[0], np.cumsum(filled)])
    codes = codes[filled].tolist()
    numbers, names = [c[1] for c in coded], [c[2] for c in coded]
    for n, a, b in zip((so_far[end] - so_far[first]).tolist(), place[first].tolist(), place[end].tolist()):
        own = codes[a:b]
        yield n, " ".join([numbers[c] for c in own]), " ".join([names[c] for c in own])


def chunks_of(texts: list, mask: int = MASK) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Chunks of all texts, dictionary-encoded; those of text i are first[i] up to end[i]."""
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    joined = b" ".join(raw).translate(_BLANKS) + b" "
    data = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter((len(r) for r in raw), np.int64, len(raw))
    marks = np.cumsum(lengths + 1) - 1
    begins = marks - lengths
    blanks = np.flatnonzero(data == 32)
    text = np.searchsorted(marks, blanks)
    cut = (rolling_hash(data, blanks, begins[text]) & np.uint32(mask)) == 0 if mask else np.ones(len(blanks), bool)
    cut |= marks[text] == blanks
    ends = blanks[cut] + 1
    offsets = np.append(0, ends).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    end = np.searchsorted(ends, marks + 1) + 1
    return chunks.dictionary_encode(), np.append(0, end[:-1]), end


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch.column(0), batch.column(1)):
                chunks, first, end = chunks_of(texts)
                cols: list[list] = [[], [], []]
                for n, numbers, names in _joined(chunks, first, end, _encoded(chunks.dictionary.to_pylist(), path)):
                    for col, v in zip(cols, (n, hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(names.encode()).hexdigest())):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch.column(0), batch.column(1)):
                chunks, first, end = chunks_of(texts)
                coded = [[int(x) for x in c[1].split()] for c in _encoded(chunks.dictionary.to_pylist(), path)]
                codes = chunks.indices.to_pylist()
                out = [[i for c in codes[a:b] for i in coded[c]] for a, b in zip(first.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _tokenizer(path)[3]
        for batch in batches:
            texts = [" ".join([names[i] for i in row if 0 <= i < len(names)]) for row in (r or [] for r in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of every text (null: empty). A narrow map; repeated and null ids pass through."""
    return doc_text(docs, id_col, text_col).mapInArrow(_tokens(tokenizer), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text: the tokens' strings joined by a blank, which is what a file without a decoder decodes to.

    Ids outside the vocabulary leave nothing; null ids count as none.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_texts(tokenizer), "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, and digests of its ids and of the decoded text.

    A null text is an empty one (no tokens, digests of the empty string); null and repeated ids pass through, one row
    out for each row in; an empty table gives an empty result; further columns are ignored.
    """
    return doc_text(docs, id_col, text_col).mapInArrow(_round_trip(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
