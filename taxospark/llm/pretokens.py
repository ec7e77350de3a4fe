"""The byte-level pre-tokenizer as a deterministic transducer over character classes.

Every transition is annotated with the pre-token starts that it emits. A text is dealt into chunks; each chunk
becomes a map from entry state to exit state; the maps compose by a parallel prefix scan, which gives each chunk
its entry state; a last pass reads off the starts. All three passes run over all chunks at once. A character after
which every state is the same (white space, a digit) makes the map of its chunk constant, so one walk gives it; only
chunks without any such character are walked from all states.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

# Character classes. The letters of the contractions 's 't 'm 'd 're 've 'll need classes of their own.
LETTER, CLOSER, R, V, E, L, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER, RESET = range(12)
LETTERS = (LETTER, CLOSER, R, V, E, L)
# States: nothing open; a run of letters, numbers, others; white space that ends in a blank or another space;
# an apostrophe that may open a contraction, and the same with r, v or l behind it.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_BLANK, AT_SPACE, APOS, APOS_R, APOS_V, APOS_L = range(10)
HERE, BEFORE = 1, 2  # a pre-token starts at this character; at the one before
CHUNK = 256


def _opened(c: int) -> int:
    if c in LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, BLANK: AT_BLANK, SPACE: AT_SPACE, APOSTROPHE: APOS, OTHER: IN_OTHERS, RESET: FRESH}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and emitted starts."""
    new = (_opened(c), HERE)
    if c == RESET:
        return FRESH, HERE | (BEFORE if state in (APOS_R, APOS_V, APOS_L) else 0)
    if state == FRESH:
        return new
    if state == IN_LETTERS:
        return (IN_LETTERS, 0) if c in LETTERS else new
    if state == IN_NUMBERS:
        return (IN_NUMBERS, 0) if c == NUMBER else new
    if state == IN_OTHERS:
        return (IN_OTHERS, 0) if c in (OTHER, APOSTROPHE) else new
    if state in (AT_BLANK, AT_SPACE):
        if c in (BLANK, SPACE):
            return _opened(c), 0
        if state == AT_BLANK:  # the blank goes with what follows
            return (IN_OTHERS if c == APOSTROPHE else _opened(c)), BEFORE
        return _opened(c), HERE | BEFORE
    if state == APOS:
        if c == CLOSER:
            return FRESH, 0
        if c in (R, V, L):
            return {R: APOS_R, V: APOS_V, L: APOS_L}[c], 0
        return (IN_OTHERS, 0) if c in (OTHER, APOSTROPHE) else new
    if c == (L if state == APOS_L else E):
        return FRESH, 0
    return (IN_LETTERS, BEFORE) if c in LETTERS else (_opened(c), HERE | BEFORE)


NEXT = np.array([_step(s, c)[0] for s in range(10) for c in range(12)], np.uint8)
EMIT = np.array([_step(s, c)[1] for s in range(10) for c in range(12)], np.uint8)
#: Classes that lead to one state from all states.
SETTLES = (NEXT.reshape(10, 12) == NEXT[:12]).all(axis=0)

_IS_LETTER, _IS_NUMBER, _IS_SPACE = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")


def _class_of(ch: str) -> int:
    if ch == " ":
        return BLANK
    if ch == "'":
        return APOSTROPHE
    if ch in "stmd":
        return CLOSER
    if ch in "rvel":
        return {"r": R, "v": V, "e": E, "l": L}[ch]
    return LETTER if _IS_LETTER.match(ch) else NUMBER if _IS_NUMBER.match(ch) else SPACE if _IS_SPACE.match(ch) else OTHER


_UNKNOWN = 255
_classes = np.full(0x110000, _UNKNOWN, np.uint8)


def classes(points: np.ndarray) -> np.ndarray:
    found = _classes[points]
    if (found == _UNKNOWN).any():
        for p in np.unique(points[found == _UNKNOWN]).tolist():
            _classes[p] = _class_of(chr(p))
        found = _classes[points]
    return found


def starts(cls: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character; RESET characters stand alone."""
    n = len(cls)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, RESET, np.uint8)
    grid[:n] = cls
    settled = SETTLES[grid].reshape(chunks, CHUNK).any(axis=1)
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    state = np.zeros(chunks, np.uint8)
    for col in grid:
        state = NEXT.take(state * np.uint8(12) + col)
    maps = np.repeat(state[None, :], 10, axis=0)
    unsettled = np.flatnonzero(~settled)
    if len(unsettled):
        own = np.repeat(np.arange(10, dtype=np.uint8)[:, None], len(unsettled), axis=1)
        for col in grid[:, unsettled]:
            own = NEXT.take(own * np.uint8(12) + col)
        maps[:, unsettled] = own
    step = 1
    while step < chunks:  # inclusive scan: maps[c] becomes the composition of chunks 0..c
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        step *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = maps[FRESH, :-1]
    out = np.empty((CHUNK, chunks), np.uint8)
    for k, col in enumerate(grid):
        at = state * np.uint8(12) + col
        out[k] = EMIT.take(at)
        state = NEXT.take(at)
    flat = out.T.reshape(-1)[:n]
    found = (flat & HERE) != 0
    found[:-1] |= (flat[1:] & BEFORE) != 0
    return found


def words_of(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Pre-tokens of all texts, dictionary-encoded, without the marks between texts; where each text's begin and end.

    Text i's pre-tokens are those from first[i] up to end[i].
    """
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    marks = np.cumsum(lengths + 1) - 1
    cls = classes(points)
    cls[marks] = RESET
    at = np.flatnonzero(starts(cls))
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) == len(points):
        place = at
    else:
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        place = (np.cumsum(width) - width)[at]
    offsets = np.append(place, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    end = np.searchsorted(at, marks)
    first = np.concatenate([[0], end[:-1] + 1])
    return words.dictionary_encode(), first, end
