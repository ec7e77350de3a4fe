"""Token counts by finite-state transducers that are compiled from a byte-level BPE file.

Two deterministic transducers in a row. The first (pretokens.py) finds pre-tokens over character classes, with
chunk state maps composed by a parallel prefix scan. The second reads the bytes of a pre-token; each of its
transitions carries the number of tokens that it adds to (or takes from) the count. Its states are compiled from
the merge table when first needed: a state holds what later bytes can still depend on, namely the longest suffix
that begins some token, and for each place in it where a token may begin the last token of the encoding up to
there with its relative count. Prefixes that agree in this share a state, so the machine stays finite.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, doc_text, safe_cuts
from .pretokens import words_of

#: Compiled transitions and counted words kept by a Python worker; beyond it, the tables start anew.
TABLE_LIMIT = 1_000_000
END = 1 << 60


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class CountTransducer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.made: dict[bytes, tuple[int, tuple[bytes, bytes]]] = {}
        for pair, i in self.rank.items():
            self.made.setdefault(pair[0] + pair[1], (i, pair))
        self.spines: dict[bytes, tuple[list, list]] = {}
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if all(c in letters for c in t)} & ({a + b for a, b in self.rank} | {bytes([b]) for b in range(256)})
        self.openings = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.clear()

    def clear(self) -> None:
        start = (b"", ((None, 0),))
        self.states = [start]
        self.number = {start: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[bytes, int] = {}

    def edges(self, token: bytes) -> tuple[list, list]:
        """The pieces at the left and at the right edge of a token while it is merged, each with the rank that ends it."""
        known = self.spines.get(token)
        if known is None:
            left, right = [(token, END)], [(token, END)]
            for side, spine in ((0, left), (1, right)):
                part = token
                while len(part) > 1:
                    rank, halves = self.made[part]
                    part = halves[side]
                    spine.append((part, rank))
                spine.reverse()
            known = self.spines[token] = (left, right)
        return known

    def fit(self, a: bytes, b: bytes) -> bool:
        """Whether b can follow a. A token sequence is an encoding just when all its neighbours fit.

        They fit if no merge across the border comes up before the edge pieces have become a and b.
        """
        known = self.fits.get((a, b))
        if known is None:
            right, left = self.edges(a)[1], self.edges(b)[0]
            i = j = 0
            while True:
                (x, x_end), (y, y_end) = right[i], left[j]
                across = self.rank.get((x, y), END)
                if across < x_end and across <= y_end and across < END:
                    known = False
                    break
                if x_end == y_end == END:
                    known = True
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            self.fits[(a, b)] = known
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state on a byte: next state, change of the count."""
        suffix, ends = self.states[state]
        text = suffix + bytes([byte])
        for k in range(len(text), 0, -1):
            token = text[-k:]
            if token in self.tokens:
                before, count = ends[-k]
                if before is None or self.fit(before, token):
                    break
        added = count + 1
        keep = next((k for k in range(len(text), 0, -1) if text[-k:] in self.openings), 0)
        row = [*ends, (token, added)]
        new = (text[len(text) - keep :], tuple((row[-1 - k][0], row[-1 - k][1] - added) if not k or text[-k:] in self.openings else None for k in range(keep, -1, -1)))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new], added

    def count(self, word: bytes) -> int:
        state = total = 0
        steps = self.steps
        for byte in word:
            key = state << 8 | byte
            step = steps.get(key)
            if step is None:
                step = steps[key] = self.compile(state, byte)
            state, added = step
            total += added
        return total


@lru_cache(maxsize=4)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def plain_parts(text: str, specials: list[str]) -> tuple[list[str], int]:
    """The text between special tokens, and how many of those there are."""
    parts, n = [text], 0
    for s in specials:
        if s in text:
            parts = [y for x in parts for y in x.split(s)]
            n = len(parts) - 1
    return parts, n


def counter(path: str):
    """Function over Arrow batches (doc_id, text) that counts the tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            totals = []
            for ids, texts in blocks(batch.column(0), batch.column(1)):
                counts = np.zeros(len(ids), np.int64)
                held, owner, size = [], [], 0

                def flush() -> None:
                    if held:
                        np.add.at(counts, owner, _count(held, machine))
                    held.clear()
                    owner.clear()

                for i, text in enumerate(texts):
                    parts, specials = plain_parts(text, machine.specials)
                    counts[i] += specials
                    for part in parts:
                        for piece in safe_cuts(part, BLOCK_BYTES):
                            held.append(piece)
                            owner.append(i)
                            size += len(piece)
                            if size > 2 * BLOCK_BYTES:
                                flush()
                                size = 0
                flush()
                totals.append(counts)
            if totals:
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(np.concatenate(totals))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _count(texts: list[str], machine: CountTransducer) -> np.ndarray:
    words, first, end = words_of(texts)
    if len(machine.known) > TABLE_LIMIT or len(machine.steps) > TABLE_LIMIT:
        machine.clear()
    known = machine.known
    each = []
    for w in words.dictionary.to_pylist():
        n = known.get(w)
        if n is None:
            n = known[w] = machine.count(w)
        each.append(n)
    so_far = np.concatenate([[0], np.cumsum(np.array(each, np.int64)[words.indices.to_numpy()])])
    return so_far[end] - so_far[first]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per document: n_bytes (UTF-8), n_tokens as the tokenizer file gives them without added special tokens, over_limit.

    A narrow map: no shuffle. A null text counts as the empty text (0 bytes, 0 tokens); null and repeated ids pass
    through, one row out for each row in; an empty table gives an empty result; further columns are ignored.
    A special token's string inside a text is one token, as the library takes it by default. Long texts are cut at
    blanks where pre-tokens surely end, and counted whole.
    """
    counted = doc_text(docs, id_col, text_col).mapInArrow(counter(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
