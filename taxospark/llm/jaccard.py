"""Self-join of documents by the Jaccard similarity of their word n-grams, as a grouped prefix join.

Only documents whose rarest n-grams meet can be similar: a set of s n-grams can reach the threshold t only with a set
that shares one of its first s - ceil(t * s) + 1 n-grams in a global order (its prefix). The order is by a count table
of fixed size over hashed n-grams, rarest first, so that passages that many documents share stay out of the prefixes.

1. Documents with equal sets form a class; classes with equal prefix and size form a group with one list of prefix
   n-grams. n-grams of one group only are dropped; the classes of a group meet by the group's own number.
2. Bitmaps of the sets rule out most pairs that cannot reach the threshold before any text is sent. Group pairs are filtered bucket by bucket (the groups that share a prefix n-gram), then expanded to classes: in
   each round every class meets one leader of its buckets (first the class of most copies, then one by lot) that is in
   another component, and the pair is verified on whole sets. A round has as many pairs as classes at most.
3. When rounds find no more, only classes of different components that still share a bucket meet pair by pair, so no
   link between different texts is lost where it matters for a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, doc_text, kept, trimmed

#: Counters of the n-gram count table: its size does not grow with the data.
TABLE = 1 << 20
#: An n-gram is hot if its counter exceeds this and a multiple of the mean counter; hot ones surely belong to several
#: groups and are not gathered to find out.
HOT, HOT_TIMES = 10_000, 8
#: Rounds with one leader for each class, at most; what they leave is compared pair by pair.
ROUNDS = 5
#: The ids of classes to verify are broadcast up to this number (some 50 bytes each), beyond it joined by shuffle.
BROADCAST_IDS = 1_000_000
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLACE = np.uint64(0xFFFF)
#: Bytes from which a word is hashed by itself.
LONG_WORD = 256
#: Partners that meet one copy of a class's text.
FAN = 512
#: Numbers of 64 bits in a set's bitmap: bit h of it is set if an n-gram hashes to h.
BITMAP = 16


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z as a-z), and where each text's begin; the last entry is the end.

    All words take their next eight bytes at once, so there are as many steps as the longest word has; words of more
    than LONG_WORD bytes are hashed one by one instead.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw).lower() + b"\n" + bytes(8), np.uint8)
    sep = _SEPARATORS[data[:-8]]
    begins = np.flatnonzero(~sep & np.concatenate([[True], sep[:-1]]))
    length = np.flatnonzero(sep & np.concatenate([[False], ~sep[:-1]])) - begins
    eight = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
    h = length.astype(np.uint64) * _MIX
    active = np.flatnonzero(length <= LONG_WORD)
    at, left = begins[active], length[active]
    while len(active):
        h[active] = _spread((h[active] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)])) * _MIX)
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        h[k] = xxhash.xxh64_intdigest(data[begins[k] : begins[k] + length[k]])
    starts = np.concatenate([[0], np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))])
    return h, np.searchsorted(begins, starts)


def shingle_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text's whole word sequence is one; no words, none."""
    words, first = word_hashes(texts)
    grams = words[: max(len(words) - n + 1, 0)]
    for k in range(1, n):
        grams = _spread(grams) * _MIX + words[k : k + len(grams)]
    grams = _spread(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            digest = hashlib.blake2b(words[a:b].tobytes(), digest_size=8, key=b"short").digest()
            yield np.frombuffer(digest, np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[s & np.uint64(64 * BITMAP - 1)] = 1
    return np.packbits(bits).view(np.int64)


def may_overlap(x: str, y: str, percent: int) -> Column:
    """Whether two sets (structs with size and bits) can reach the threshold: a bit of one's bitmap that the other lacks
    stands for at least one n-gram that the other lacks. Never false for sets that do."""
    a, b = F.col(f"{x}.bits"), F.col(f"{y}.bits")
    lacks = lambda p, q: sum((F.bit_count(p[k].bitwiseAND(F.bitwise_not(q[k]))) for k in range(BITMAP)), F.lit(0))
    s, t = F.col(f"{x}.size"), F.col(f"{y}.size")
    return (100 + percent) * F.least(s - lacks(a, b), t - lacks(b, a)) >= percent * (s + t)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _slot(h: np.ndarray, counters: int = TABLE) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (counters - 1)


def count_table(docs: DataFrame, n: int, counters: int = TABLE, rows: int = 16) -> np.ndarray:
    """How many documents' n-grams fall on each of the counters (a power of 2): over all documents, summed in two steps."""
    width = counters // rows

    def packed(x: np.ndarray) -> bytes:
        """In as few bytes a counter as the largest needs."""
        return x.astype(np.min_scalar_type(int(x.max()))).tobytes()

    def unpacked(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, f"u{len(raw) // width}").astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for _, texts in blocks(batch.column(0), batch.column(1)):
                total += np.bincount(_slot(np.concatenate(list(shingle_sets(texts, n))), counters), minlength=counters)
        parts = [total[i * width : (i + 1) * width] for i in range(rows)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(rows), pa.int32()), "counts": pa.array([packed(x) for x in parts], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for c in pdf["counts"]:
            total += unpacked(c)
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "salt": [0], "counts": [packed(total)]})

    parts = docs.mapInArrow(trimmed(count), "part int, counts binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    for keys in (["part", "salt"], ["part"]):
        parts = parts.groupBy(*keys).applyInPandas(add, "part int, salt int, counts binary")
    out = np.zeros(counters, np.int64)
    for r in parts.collect():  # the counters, whatever the input
        out[r["part"] * width : (r["part"] + 1) * width] = unpacked(bytes(r["counts"]))
    return out


def prefixes(docs: DataFrame, n: int, percent: int, counters: int = TABLE) -> DataFrame:
    """doc_id, size, set_id, bits (its bitmap), grp (a hash of size and prefix), prefix, cold (how many of the prefix are not hot, in front).

    An entry of the prefix holds 48 bits of the n-gram's hash (more n-grams that fall together only give more pairs to
    verify) and in the lowest 16 its place in the prefix (or 65535, as places only rule pairs out).
    """
    table = count_table(docs, n, counters)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    hot = max(HOT, HOT_TIMES * int(table.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for ids, texts in blocks(batch.column(0), batch.column(1)):
                sizes, sets, maps, groups, firsts, cold = [], [], [], [], [], []
                for s in shingle_sets(texts, n):
                    size = len(s)
                    length = size - -(-percent * size // 100) + 1 if size else 0
                    counts = known[_slot(s, counters)]
                    order = np.lexsort((s, counts))[:length]
                    sizes.append(size)
                    sets.append(_digest(s))
                    maps.append(bitmap(s))
                    groups.append(int.from_bytes(hashlib.blake2b(s[order].tobytes(), digest_size=8, key=str(size).encode()).digest(), "little", signed=True))
                    firsts.append(((s[order] & ~_PLACE) | np.minimum(np.arange(length, dtype=np.uint64), _PLACE)).astype(np.int64))
                    cold.append(int(np.searchsorted(counts[order], hot, side="right")))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary()), pa.array(maps, pa.list_(pa.int64())), pa.array(groups, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(cold, pa.int32())], ["doc_id", "size", "set_id", "bits", "grp", "prefix", "cold"])

    return docs.mapInArrow(trimmed(run), "doc_id long, size int, set_id binary, bits array<long>, grp long, prefix array<long>, cold int")


def _overlaps(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x):
        return False
    place = np.searchsorted(x, y)
    both = int((x[np.minimum(place, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _similar(n: int, percent: int):
    """Pairs (a, b) that reach the threshold, from rows (key, salt, doc_id, text, set_id) in which a's own text comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = own = None
        for batch in batches:
            keys, salts, names = (batch.column(k).to_pylist() for k in (0, 1, 4))
            at, a, b = 0, [], []
            for docs, texts in blocks(batch.column(2), batch.column(3)):
                for doc, s in zip(docs, shingle_sets(texts, n)):
                    key, salt, name = keys[at], salts[at], names[at]
                    at += 1
                    if _digest(s) != name:
                        continue  # another text under the same id
                    if key == doc:
                        head, own = (key, salt), s
                    elif head == (key, salt) and _overlaps(own, s, percent):
                        a.append(key)
                        b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def promising(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids that their bitmaps do not rule out."""
    x, y = (maps.select(F.col("class").alias(c), F.struct("size", "bits").alias(f"m_{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").where(may_overlap("m_a", "m_b", percent)).select(pairs.columns)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose whole sets reach the threshold.

    A class's text, which is smaller than its set, travels once to each of its partners a; a's own goes along, once for
    each FAN partners, so that no task has to take all partners of one class. Sorted, a's text comes before its
    partners', and the comparison holds one set and one batch at a time.
    """
    fans = pairs.groupBy("a").agg((F.floor(F.count("*") / FAN).cast("int") + 1).alias("salts"))
    others = pairs.join(fans, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    owners = fans.select(F.col("a").alias("doc_id"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    needed = kept(others.unionByName(owners).join(classes.select(F.col("class").alias("doc_id"), "set_id"), "doc_id"), "needed")
    found = docs.join(F.broadcast(needed) if pairs.count() <= BROADCAST_IDS else needed, "doc_id").select("key", "salt", "doc_id", "text", "set_id")
    sent = found.repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("doc_id") != F.col("key"))
    return sent.mapInArrow(trimmed(_similar(n, percent)), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component for every id of the links (a, b): the smallest id that can be reached.

    Large-star and small-star steps in turn: every id is linked to the smallest of its neighbourhood until the links are
    stars. Each step is written to the shared folder; the number of steps grows with the logarithm of the longest path.
    """
    links = kept(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = kept(small.where(F.col("u") != F.col("v")).distinct(), "links")
        # Equal sets have equal counts, sums and exclusive sums of hashes.
        h = F.xxhash64("u", "v")
        now = links.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", counters: int = TABLE) -> DataFrame:
    """Per document: n_shingles (the size of its set), component_id (the smallest id reachable by links).

    Two documents link when 100 * |intersection| >= percent * |union|. A document without words is linked with nothing,
    so are null texts; rows with a null id come out with a null component. Rows that repeat an id each come out with
    their own size; if their texts differ, the one whose set has the smallest digest stands for the id's links. An empty
    table gives an empty result; further columns are ignored.
    """
    source = doc_text(docs, id_col, text_col)
    made = kept(prefixes(source, n, percent, counters), "prefixes")
    named = made.where((F.col("size") > 0) & F.col("doc_id").isNotNull())
    single = named.groupBy("doc_id").agg(F.min(F.struct("set_id", "size", "grp", "bits")).alias("m"))
    single = kept(single.select("doc_id", "m.set_id", "m.size", "m.grp", "m.bits"), "single")
    of = single.groupBy("size", "set_id").agg(F.min("doc_id").alias("class"), F.min("grp").alias("grp"), F.count("*").alias("weight"))
    of = kept(of, "classes")
    member = kept(single.select("doc_id", "size", "set_id").join(of, ["size", "set_id"]).select("doc_id", "class"), "members")
    maps = kept(single.join(of.select("class"), F.col("doc_id") == F.col("class"), "left_semi").select(F.col("doc_id").alias("class"), "size", "bits"), "bitmaps")

    token = F.shiftright("entry", 16)
    entry = lambda part: named.select("grp", F.explode(part).alias("entry"))
    # Two numbers a row: the place is read off the entry only behind the shuffle.
    cold = entry(F.slice("prefix", 1, F.col("cold"))).repartition(token).select(token.alias("token"), "grp", "entry")
    cold = cold.select("token", "grp", "entry", F.expr("min(grp) over (partition by token)").alias("lo"), F.expr("max(grp) over (partition by token)").alias("hi")).where("lo < hi").select("token", "grp", "entry").distinct()
    hot = entry(F.slice("prefix", F.col("cold") + 1, F.size("prefix"))).select(token.alias("token"), "grp", "entry").distinct()
    shared = kept(cold.unionByName(hot).select("token", "grp", F.col("entry").bitwiseAND(F.lit(int(_PLACE))).cast("int").alias("pos")), "shared")
    several = of.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp", F.col("grp").alias("token"), F.lit(0).alias("pos"))

    fits = lambda s, t: 100 * F.least(s, t) >= percent * F.greatest(s, t)
    # A pair's first common n-gram leaves room for the overlap that the threshold needs.
    room = lambda s, p, t, q: (100 + percent) * (1 + F.least(s - p - 1, t - q - 1)) >= percent * (s + t)
    # Groups expand to their classes, which also meet by their group's number.
    open_ = kept(shared.unionByName(several).join(of.select("class", "grp", "size", "weight"), "grp").select("token", "class", "size", "pos", "weight"), "open")
    # A bucket of two classes is one pair, read off the aggregation; only larger ones go into the rounds.
    member_of = F.struct("class", "size", "pos")
    buckets = open_.groupBy("token").agg(F.count("*").alias("n"), F.min(member_of).alias("x"), F.max(member_of).alias("y"))
    two = buckets.where((F.col("n") == 2) & fits(F.col("x.size"), F.col("y.size")) & room(F.col("x.size"), F.col("x.pos"), F.col("y.size"), F.col("y.pos")))
    tried = kept(promising(two.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct(), maps, percent), "pairs")
    links = kept(verified(source, of, tried, n, percent), "verified")

    def joined(links: DataFrame) -> DataFrame:
        known = components(links).withColumnRenamed("id", "class")
        return kept(of.select("class").join(known, "class", "left").select("class", F.coalesce("component", "class").alias("comp")), "comps")

    comps = joined(links)
    open_ = kept(open_.join(buckets.where("n > 2").select("token"), "token", "left_semi"), "open")
    for turn in range(ROUNDS):
        own = open_.join(comps, "class")
        rank = F.struct((F.col("weight") if turn == 0 else F.lit(0)).alias("w"), F.xxhash64(F.lit(turn), "class").alias("lot"), "class", "comp", "size", "pos")
        lead = own.groupBy("token").agg(F.max(rank).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "l")
        met = own.join(lead, "token").where((F.col("comp") != F.col("l.comp")) & fits(F.col("size"), F.col("l.size")) & room(F.col("size"), F.col("pos"), F.col("l.size"), F.col("l.pos")))
        met = met.select(F.col("class").alias("b"), F.col("l.class").alias("a"), "l.w", "l.lot").distinct()
        again = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met = promising(met.join(again, ["a", "b"], "left_anti"), maps, percent)
        pairs = kept(met.groupBy("b").agg(F.max(F.struct("w", "lot", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "pairs")
        new = kept(verified(source, of, pairs, n, percent), "verified")
        tried = pairs.unionByName(tried)
        if new.isEmpty() and turn:
            break
        links = new.unionByName(links)
        comps = joined(links)

    own = open_.join(comps, "class")
    mixed = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    # With their bitmaps at hand, only pairs that may be similar leave the join.
    left = kept(own.join(mixed, "token", "left_semi").join(maps.select("class", "bits"), "class"), "left")
    x, y = left.alias("x"), left.alias("y")
    order = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.class") < F.col("y.class")))
    again = (
        x.join(y, F.col("x.token") == F.col("y.token"))
        .where(order & (F.col("x.comp") != F.col("y.comp")) & fits(F.col("x.size"), F.col("y.size")) & room(F.col("x.size"), F.col("x.pos"), F.col("y.size"), F.col("y.pos")) & may_overlap("x", "y", percent))
        .select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
        .distinct()
    )
    known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    again = kept(again.join(known, ["a", "b"], "left_anti"), "pairs")
    more = verified(source, of, again, n, percent)
    final = components(links.unionByName(more))

    by_doc = member.join(final.withColumnRenamed("id", "class"), "class", "left").select("doc_id", F.coalesce("component", "class").alias("component_id"))
    return made.select("doc_id", F.col("size").cast("long").alias("n_shingles")).join(by_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
