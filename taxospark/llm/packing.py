"""Packing of tokenized documents into sequences of a fixed length.

Documents become token ids in a narrow map; only (id, piece, length) rows are shuffled afterwards. Pieces that fill
a sequence need no packing. The others, at most one for each document, are dealt evenly into groups of bounded size;
each group starts from best fit and is then improved by local search over its underfull bins: documents are moved,
exchanged one for one or two for one whenever that raises the sum of squared fills, so that bins run empty. What the
groups leave underfull is dealt anew and packed together once more.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import quick_encoding
from .common import BLOCK_BYTES, CACHES, blocks, doc_text, kept, safe_cuts, trimmed
from .pretokens import words_of
from .token_counts import byte_letters

#: Documents that one group packs together, and bytes of text that a Python worker works on at a time.
GROUP_ROWS = 8192
RUN_BYTES = 1_500_000
_library: dict = {}
CACHES.append(_library.clear)


def _tokenizer(path: str) -> tuple[Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dict[str, int]]:
    """What gives the ids of pre-tokens in one array, and how many each has; the special tokens."""
    if path not in _library:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        specials = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
        quick = quick_encoding(path, byte_letters())

        def by_pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            made = list(map(quick._core_bpe.encode_single_piece, words))
            return np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

        def by_library(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # Given as pre-tokenized words, none of them is cut again or holds a special token.
            made = t.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
            return np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(words))

        _library[path] = (by_pieces if quick else by_library, specials)
    return _library[path]


def _split_specials(text: str, specials: dict[str, int]) -> list[str | int]:
    parts: list[str | int] = [text]
    for s, i in specials.items():
        if s in text:
            parts = [z for x in parts for z in (_interleaved(x.split(s), i) if isinstance(x, str) else [x])]
    return parts


def _interleaved(parts: list[str], between: int) -> list[str | int]:
    out: list[str | int] = [parts[0]]
    for p in parts[1:]:
        out += [between, p]
    return out


def token_ids(texts: list[str], path: str, closing: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with the closing id behind it, in one array; text i's are those from bounds[i] to bounds[i + 1].

    Distinct pre-tokens of these texts are encoded once; a text's ids are gathered from the table of their ids. The
    table is made anew for each run of texts: encoding a pre-token again costs no more than keeping it.
    """
    encode, specials = _tokenizer(path)
    pieces: list[str] = []
    behind: list[int] = []  # the id that stands at the mark behind each piece, -1 for none
    last = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        for part in _split_specials(t, specials):
            if isinstance(part, int):
                behind[-1] = part
            else:
                cuts = list(safe_cuts(part, BLOCK_BYTES))
                pieces += cuts
                behind += [-1] * len(cuts)
        behind[-1] = closing
        last[k] = len(pieces) - 1
    words, _, end = words_of(pieces)
    flat, size = encode(words.dictionary.to_pylist())
    marks, which = np.unique(np.array(behind, np.int64), return_inverse=True)
    flat = np.concatenate([flat, marks[marks >= 0].astype(np.uint32)])
    size = np.concatenate([size, (marks >= 0).astype(np.int64)])
    entries = words.indices.to_numpy().astype(np.int64)
    entries[end] = len(words.dictionary) + which
    lengths = size[entries]
    so_far = np.concatenate([[0], np.cumsum(lengths)])
    ids = flat[np.repeat((np.cumsum(size) - size)[entries] - so_far[:-1], lengths) + np.arange(so_far[-1])]
    return ids, np.concatenate([[0], so_far[end[last] + 1]])


def _piece_map(path: str, size: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, texts in blocks(batch.column(0), batch.column(1), RUN_BYTES):
                cols: list[list] = [[], [], [], [], []]
                ids, bounds = token_ids(texts, path, closing)
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                for doc, begin, finish in zip(docs, bounds[:-1].tolist(), bounds[1:].tolist()):
                    n = finish - begin
                    at, piece = 0, 0
                    while at < n:
                        step = n % size or size if at == 0 else size
                        for c, v in zip(cols, (doc, piece, at, step, zlib.crc32(raw[4 * (begin + at) : 4 * (begin + at + step)]))):
                            c.append(v)
                        at, piece = at + step, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return trimmed(run)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit in order of falling size: bins of row numbers."""
    bins: list[list[int]] = []
    open_bins: dict[int, list[int]] = defaultdict(list)  # by what is left
    left_mask = 0
    for row in sorted(range(len(sizes)), key=lambda r: -sizes[r]):
        s = sizes[row]
        fitting = left_mask >> s
        if fitting:
            left = s + (fitting & -fitting).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                left_mask &= ~(1 << left)
        else:
            b, left = len(bins), capacity
            bins.append([])
        bins[b].append(row)
        if left > s:
            open_bins[left - s].append(b)
            left_mask |= 1 << (left - s)
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Exchange documents between underfull bins while the sum of squared fills rises; bins that run empty go.

    An exchange gives bin A a bundle of one or two documents of bin B for none, one or two of its own (not two for
    two). Its gain is positive just when A's new fill exceeds B's old one. A pass serves bins from the fullest to the
    emptiest and takes, for each, the exchange that fills it best; passes go on until one changes nothing, which comes,
    as the sum of squared fills rises with each exchange.
    """
    fill = [sum(sizes[r] for r in b) for b in bins]

    def bundles(b: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        seen = set()
        rows = bins[b]
        for i, r in enumerate(rows):
            if sizes[r] not in seen:
                seen.add(sizes[r])
                yield sizes[r], (r,)
            for q in rows[i + 1 :]:
                total = sizes[r] + sizes[q]
                if (total, 2) not in seen:
                    seen.add((total, 2))
                    yield total, (r, q)

    changed = True
    while changed:
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: -fill[b])
        index: dict[tuple[int, int], list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        masks = {1: 0, 2: 0}
        for b in reversed(under):  # emptiest first
            for total, rows in bundles(b):
                index[len(rows), total].append((b, rows))
                masks[len(rows)] |= 1 << total
        changed = False
        for a in under:
            while 0 < fill[a] < capacity:
                gap, best = capacity - fill[a], None
                for give, out in [(0, ()), *bundles(a)]:
                    for many in (1, 2):
                        if many == 2 and len(out) == 2:
                            continue
                        allowed = masks[many] & ((1 << (give + gap + 1)) - (1 << (give + 1)))
                        while allowed:
                            take = allowed.bit_length() - 1
                            gain = take - give
                            if best and gain <= best[0]:
                                break
                            hit = None
                            for b, rows in index[many, take]:
                                if b != a and fill[b] < fill[a] + gain and all(r in bins[b] for r in rows):
                                    hit = (gain, out, b, rows)
                                    break
                            if hit:
                                best = hit
                                break
                            allowed &= ~(1 << take)
                    if best and best[0] == gap:
                        break
                if not best:
                    break
                gain, out, b, rows = best
                bins[a] = [r for r in bins[a] if r not in out] + list(rows)
                bins[b] = [r for r in bins[b] if r not in rows] + list(out)
                fill[a] += gain
                fill[b] -= gain
                changed = True
    return [b for b in bins if b]


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    # An order of its own makes a repeated task return the same bins.
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, kind="stable").reset_index(drop=True)
    sizes = pdf["length"].tolist()
    bins = local_search(sizes, best_fit(sizes, capacity), capacity)
    number, offset, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, rows in enumerate(bins):
        at = 0
        for r in rows:
            number[r], offset[r] = i, at
            at += sizes[r]
        total[rows] = at
    return pdf.assign(sequence_id=(pdf["grp"].astype("int64") * 2 + pdf["again"]) * (1 << 32) + number, offset=offset, fill=total)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized documents, each closed by an id, cut into pieces: doc_id, piece, start, length, ids_crc32."""
    return doc_text(docs, id_col, text_col).mapInArrow(_piece_map(tokenizer, size, closing), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every piece of every document in a sequence of at most `size` tokens: sequence_id, offset.

    A null text is an empty one and leaves only the closing token; null and repeated ids are packed like any others,
    once for each row; an empty table gives an empty result; further columns are ignored. Documents longer than a
    sequence are cut so that only the first piece can be shorter than `size`.
    """
    # Written once: both branches below and every retry read lengths, not texts.
    pieces = kept(token_pieces(docs, tokenizer, size, closing, id_col, text_col), "pieces")
    full = pieces.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < size)
    schema = f"{PACKED}, fill long"

    def packed(rows: DataFrame, again: int, seed: int) -> DataFrame:
        groups = -(-rows.count() // GROUP_ROWS) or 1
        dealt = rows.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32"), F.lit(groups))).withColumn("again", F.lit(again))
        return dealt.groupBy("grp").applyInPandas(lambda pdf: _pack(pdf, size)[[c.split()[0] for c in schema.split(", ")]], schema)

    once = kept(packed(short, 0, 1), "packed")
    slack = F.col("fill") < F.lit(size - size // 64)
    twice = packed(once.where(slack).select(*pieces.columns), 1, 2)
    columns = [c.split()[0] for c in PACKED.split(", ")]
    return full.select(columns).unionByName(once.where(~slack).select(columns)).unionByName(twice.select(columns))
