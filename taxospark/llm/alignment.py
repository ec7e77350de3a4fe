"""Alignment of two tokenizers' tokens over the same bytes, by coalescing intervals.

Every token is a range of bytes. All tokens of a batch, of both sides, are sorted by start (lexsort); a group breaks
where a start reaches the running maximum of ends (maximum.accumulate); inside a group the overlapping ranges expand to
links. Texts are cut into chunks, before a blank that stands behind a character that is no white space, where both
tokenizers surely begin anew; a Python worker aligns each distinct chunk once, and a text is gathered from its chunks.

Two narrow passes over the texts. The first counts in how many documents each pair of ids is linked: a worker sums up
its documents' pairs and gives one row a pair, which Spark sums. The second sums the counts over each document's links.
The pair counts are sent to the workers in parts of bounded size, one narrow pass each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, blocks, doc_text, kept
from .token_counts import byte_letters

if TYPE_CHECKING:
    import tiktoken

#: Pair counts that one pass holds in memory, at most (some 20 bytes each, in the driver and each Python worker).
PART_PAIRS = 4_000_000
#: Bytes of distinct chunks that a worker keeps aligned (some ten times this in memory), and pairs that it sums up, before it starts anew.
TABLE_BYTES, SUM_PAIRS = 4_500_000, 2_000_000
#: Characters of text that are worked on at a time.
RUN = 1_000_000
#: Both sides begin anew at a blank behind a character that is no white space.
_CHUNKS = re.compile(r"(?<=\S) ")
#: Blanks at which they may not: those behind white space.
_INNER = re.compile(r"\s ")
_PIECE_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_A_BITS = 32


# Fixed value: the pre-tokens of a byte-level BPE file that names no pattern of its own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def quick_encoding(path: str, letters: dict[str, int]) -> tiktoken.Encoding | None:
    """tiktoken's encoding over the file's own vocabulary, where ids rise with the merges and nothing else is asked of a text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    own = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)}
    if own or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocab = model["vocab"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    singles = {c: vocab[c] for c in letters if c in vocab}
    if len(singles) < 256 or made != sorted(set(made)) or made and made[0] <= max(singles.values()):
        return None
    import tiktoken

    reached = set(made) | set(singles.values())
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i in reached}
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def _quick(path: str, letters: dict[str, int]) -> Callable[[str], list[int]] | None:
    made = quick_encoding(path, letters)
    return made and made.encode_ordinary


class Pair:
    """The two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.quick = _quick(byte_level, letters)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values(), default=-1) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _PIECE_BYTE.fullmatch(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
            if re.search("[^▁]▁", piece):
                raise ValueError(f"a piece goes beyond a blank, so texts cannot be cut there: {piece!r}")
        self.blank = self.b.piece_to_id("▁")
        self.a_width, self.b_width = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        #: An id behind each mark that can stand before it in a text of groups.
        self.ids = max(len(self.a_bytes), len(self.b_bytes))
        self.marked = [f"{mark}{i}" for mark in ("\n", ",", "|", ";") for i in range(self.ids)]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of side A and how many each chunk has, the same of side B. A chunk's own blank in front is left out of its text."""
        blank = [f" {c}" for c in chunks]
        if self.quick:
            a = list(map(self.quick, blank))
            sizes, ids = np.fromiter(map(len, a), np.int64, len(a)), np.array(list(chain.from_iterable(a)), np.int64)
        else:
            made = self.a.encode(blank, is_pretokenized=True, add_special_tokens=False)
            sizes, ids = np.bincount(np.array(made.word_ids, np.int64), minlength=len(chunks)), np.array(made.ids, np.int64)
        # Side B adds the first blank itself, but adds none to an empty text.
        b = [ids or [self.blank] for ids in self.b.encode(chunks, num_threads=1)]
        b_sizes = np.fromiter(map(len, b), np.int64, len(chunks))
        return ids, sizes, np.array(list(chain.from_iterable(b)), np.int64), b_sizes


def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): tokens by start, and the number of each one's group in that order: a group ends where a start
    reaches the running maximum of ends."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows whose ranges overlap; each side's ranges are sorted and do not overlap each other."""
    first = np.searchsorted(b_end, a_start, side="right")
    last = np.searchsorted(b_start, a_end, side="left")
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]


def _given_back(ids: np.ndarray, sizes: np.ndarray, table: list[bytes], width: np.ndarray, raw: list[bytes], whole: bytes, chunk_bytes: np.ndarray) -> np.ndarray:
    """Whether the tokens of each chunk are its bytes. whole: all of raw; chunk_bytes: their lengths."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(width[ids])])
    if np.array_equal(np.diff(total[np.concatenate([[0], ends])]), chunk_bytes) and b"".join(map(table.__getitem__, ids.tolist())) == whole:
        return np.ones(len(raw), bool)
    own = list(map(table.__getitem__, ids.tolist()))
    return np.fromiter((b"".join(own[a:b]) == r for a, b, r in zip((ends - sizes).tolist(), ends.tolist(), raw)), bool, len(raw))


class ChunkTable:
    """Alignments of distinct chunks in flat arrays, one entry for each chunk."""

    def __init__(self, pair: Pair, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, with_groups: bool = True) -> None:
        self.pair, self.counts, self.with_groups = pair, counts, with_groups
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.groups: list[str] = []
        #: Of each entry: whether both sides give its bytes, n_a, n_b, n_groups, n_links, n_best, count_sum.
        self.sums = np.zeros((0, 7), np.int64)
        self.keys, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def entries(self, chunks: list[str]) -> np.ndarray:
        known = self.known
        found = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            lacking = [chunks[k] for k in missing.tolist()]
            new = list(dict.fromkeys(lacking))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self._align(new)
            found[missing] = list(map(known.__getitem__, lacking))
        return found

    def _align(self, chunks: list[str]) -> None:
        raw = [f" {c}".encode() for c in chunks]
        chunk_bytes, all_bytes = np.fromiter(map(len, raw), np.int64, len(raw)), b"".join(raw)
        self.size += len(all_bytes)
        pair = self.pair
        a, a_n, b, b_n = pair.encode(chunks)
        good = _given_back(a, a_n, pair.a_bytes, pair.a_width, raw, all_bytes, chunk_bytes) & _given_back(b, b_n, pair.b_bytes, pair.b_width, raw, all_bytes, chunk_bytes)
        # Only chunks that both sides give back have tokens; their bytes are laid out one behind the other.
        owner_a, owner_b = np.repeat(np.arange(len(chunks)), a_n), np.repeat(np.arange(len(chunks)), b_n)
        a, owner_a, b, owner_b = a[good[owner_a]], owner_a[good[owner_a]], b[good[owner_b]], owner_b[good[owner_b]]
        a_end, b_end = np.cumsum(pair.a_width[a]), np.cumsum(pair.b_width[b])
        a_start, b_start = a_end - pair.a_width[a], b_end - pair.b_width[b]
        side = np.repeat([0, 1], [len(a), len(b)])
        owner, ids = np.concatenate([owner_a, owner_b]), np.concatenate([a, b])
        order, group = coalesced(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]), side)
        n_groups = int(group[-1]) + 1 if len(group) else 0
        of = np.zeros(n_groups, np.int64)
        of[group] = owner[order]
        i, j = overlaps(a_start, a_end, b_start, b_end)
        keys, owner_k = a[i] << _A_BITS | b[j], owner_a[i]
        per = lambda x: np.bincount(x, minlength=len(chunks))
        best, total = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        if self.counts is not None and len(self.counts[0]) and len(keys):
            held, n, is_best = self.counts
            place = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            there = held[place] == keys
            best, total = there & is_best[place], np.where(there, n[place], 0)
        count_sum = np.zeros(len(chunks), np.int64)
        np.add.at(count_sum, owner_k, total)
        rows = np.stack([good.astype(np.int64), per(owner_a), per(owner_b), per(of), per(owner_k), per(owner_k[best]), count_sum], axis=1)
        self.sums = np.concatenate([self.sums, rows])
        self.keys = np.concatenate([self.keys, keys])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(rows[:, 4])])
        if self.with_groups:
            self.groups += self._texts(ids[order], side[order], group, of, len(chunks))

    def _texts(self, ids: np.ndarray, side: np.ndarray, group: np.ndarray, of: np.ndarray, n: int) -> list[str]:
        """The groups of each chunk as a1,a2|b1;a3|b2."""
        within = np.lexsort((side, group))  # stable: the tokens of a side stay in order
        ids, side, group = ids[within], side[within], group[within]
        mark = np.zeros(len(ids), np.int64)  # what stands before a token
        mark[1:] = np.where(group[1:] != group[:-1], np.where(of[group[1:]] != of[group[:-1]], 0, 3), np.where(side[1:] != side[:-1], 2, 1))
        whole = "".join(map(self.pair.marked.__getitem__, (mark * self.pair.ids + ids).tolist()))
        out = [""] * n
        for k, text in zip(np.unique(of).tolist(), whole.split("\n")[1:]):
            out[k] = text
        return out


_made: dict = {}
CACHES.append(_made.clear)


def _pair(byte_level: str, pieces: str) -> Pair:
    if (byte_level, pieces) not in _made:
        _made[byte_level, pieces] = Pair(byte_level, pieces)
    return _made[byte_level, pieces]


def _cut(text: str) -> list[str]:
    """The chunks of a text, each without the blank in front of it (the first one's is not in the text)."""
    return text.split(" ") if text[0] != " " and not _INNER.search(text) else _CHUNKS.split(text)


def _gathered(table: ChunkTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all texts' chunks, and where each text's begin; the last place is the end. An empty text has none."""
    if table.size > TABLE_BYTES:
        table.clear()
    chunks: list[str] = []
    first = [0]
    for t in texts:
        if t:
            chunks += _cut(t)
        first.append(len(chunks))
    return table.entries(chunks), np.array(first, np.int64)


def _summed(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    so_far = np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows, axis=0)])
    return so_far[first[1:]] - so_far[first[:-1]]


def _runs(batches: Iterator[pa.RecordBatch], table: ChunkTable, column: int):
    """(batch, rows from, rows to, entries, first) of runs of texts of bounded size."""
    for batch in batches:
        at = 0
        for rows, texts in blocks(batch.column(0), batch.column(column), RUN):
            entries, first = _gathered(table, texts)
            yield batch, at, at + len(rows), entries, first
            at += len(rows)


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table of (keys, counts) from several."""
    keys, where = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, where, np.concatenate([n for _, n in counts]))
    return keys, total


def pair_counts(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """key (A's id << 32 | B's id), n (documents that hold the two linked), best (whether n is the highest of A's id).

    docs: doc_id, text. Each row counts as a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(_pair(byte_level, pieces), with_groups=False)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, _, _, entries, first in _runs(batches, table, 1):
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            whole = np.ones(len(first) - 1, bool)
            whole[doc[table.sums[entries, 0] == 0]] = False
            # Each chunk once a document, then each pair once a document.
            once = np.unique(doc[whole[doc]] << 32 | entries[whole[doc]])
            doc, entry = once >> 32, once & 0xFFFFFFFF
            size = table.at[entry + 1] - table.at[entry]
            place = np.repeat(table.at[entry] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            own, number = np.unique(table.keys[place], return_inverse=True)
            once = np.unique(np.repeat(doc, size) << 32 | number)
            held.append((own, np.bincount(once & 0xFFFFFFFF, minlength=len(own)).astype(np.int64)))
            if sum(len(k) for k, _ in held) > SUM_PAIRS:
                held = [_added(held)]
                if len(held[0][0]) > SUM_PAIRS // 2:  # mostly new pairs
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), ["key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _added(held))), ["key", "n"])

    summed = kept(docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("key", _A_BITS)
    highest = summed.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return summed.join(highest, a == F.col("a")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))


_NUMBERS = "n_a long, n_b long, n_groups long, n_links long"


def aligned(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, has_tokens, n_a, n_b, n_groups, n_links, groups (text: a1,a2|b1;a3|b2,b3), n_best, count_sum.

    A side is a byte-level BPE file, which encodes a blank and the text; B a sentencepiece model, which adds the blank
    itself. n_best: links whose pair of ids is, of all pairs with the same A id, linked in most documents (ties
    included); count_sum: the sum over links of how many documents hold their pair linked.

    A text that is null or empty, or that either side does not give back byte by byte, has no tokens: numbers of 0 and
    empty groups. Null and repeated ids pass through, one row out for each row in, each a document of its own; an empty
    table gives an empty result; further columns are ignored. Long texts are worked on whole.
    """
    source = doc_text(docs, id_col, text_col)
    counts = kept(pair_counts(source, byte_level, pieces), "pair-counts")
    parts = max(1, -(-counts.count() // PART_PAIRS))
    numbers = "n_best long, count_sum long"
    rows = source.select("doc_id", "text", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))

    def scored(part: int, last: bool):
        own = counts.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else counts
        got = own.toArrow()  # PART_PAIRS rows or so: the parts are even
        key, n, best = (got.column(c).to_numpy() for c in ("key", "n", "best"))
        order = np.argsort(key)
        sent = docs.sparkSession.sparkContext.broadcast((key[order], n[order], best[order].astype(bool)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = ChunkTable(_pair(byte_level, pieces), sent.value, last)
            for batch, begin, finish, entries, first in _runs(batches, table, 1):
                part_of = batch.slice(begin, finish - begin)
                sums = _summed(table.sums[entries], first)
                whole = (sums[:, 0] == np.diff(first)) & (np.diff(first) > 0)
                sums[~whole] = 0
                held = [pa.array(part_of.column(k).to_numpy() + sums[:, c]) for k, c in ((2, 5), (3, 6))]
                if not last:
                    yield pa.RecordBatch.from_arrays([part_of.column(0), part_of.column(1), *held], ["doc_id", "text", "n_best", "count_sum"])
                    continue
                texts, of = table.groups, entries.tolist()
                groups = [";".join(map(texts.__getitem__, of[a:b])) if ok else "" for a, b, ok in zip(first[:-1].tolist(), first[1:].tolist(), whole.tolist())]
                yield pa.RecordBatch.from_arrays([part_of.column(0), pa.array(whole), *(pa.array(sums[:, c]) for c in range(1, 5)), pa.array(groups, pa.string()), *held], ["doc_id", "has_tokens", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])

        return run

    for part in range(parts):
        last = part == parts - 1
        out = rows.mapInArrow(scored(part, last), f"doc_id long, has_tokens boolean, {_NUMBERS}, groups string, {numbers}" if last else f"doc_id long, text string, {numbers}")
        rows = out if last else kept(out, "scored")  # else all passes, and all parts, would be in memory at once
    return rows
