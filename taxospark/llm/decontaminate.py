"""Benchmark decontamination: find the word windows of test items in training texts, and take spans or documents out.

DataFrame functions only. The normalised windows of all items are a hash set that is broadcast, in slices of proven size
(as many scans as there are slices), never shuffled. A scan hashes each window of a text's words, probes the set, and
compares the words of every hit, so that equal hashes alone decide nothing. Only hits leave the scan.

Windows that belong to the same items share a number of their item set. Documents that hit the same sets share one list
of items, which is worked out once for them all.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, kept, unused

#: Words of a window; a shorter item is one window of its own length.
WIDTH = 10
#: Bytes of windows (with ENTRY_BYTES of overhead each) that one slice of the broadcast set holds, at most.
SLICE_BYTES, ENTRY_BYTES = 64 << 20, 64
#: A word of a text as it is, and of one whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normalised_words(text: Column) -> Column:
    """The words of a text, A-Z as a-z."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, members): windows has gram (the words, joined by a blank), h (their hash), size, set_id (of the items that
    hold it); members has set_id, item_id.

    Null ids and texts without words have no windows; rows that repeat an id are one item.
    """
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), normalised_words(F.col(text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("w"))
    held = kept(cut.select("item_id", F.array_join("w", " ").alias("gram"), F.xxhash64("w").alias("h"), F.size("w").alias("size")).distinct(), "windows")
    # Equal item sets are told by their number and two sums of hashes, so no list of items is gathered.
    a, b = F.xxhash64("item_id"), F.xxhash64(F.lit("set"), "item_id")
    grams = held.groupBy("gram", "h", "size").agg(F.count("*").alias("n"), F.bit_xor(a).alias("x"), F.sum(b.cast("decimal(38,0)")).alias("s"))
    grams = kept(grams, "grams")
    sets = kept(grams.groupBy("n", "x", "s").agg(F.min(F.struct("h", "gram")).alias("one")).select("n", "x", "s", F.col("one.h").alias("set_id"), F.col("one.gram").alias("gram")), "sets")
    windows = grams.join(sets.drop("gram"), ["n", "x", "s"]).select("gram", "h", "size", "set_id")
    members = held.join(sets.select("gram", "set_id"), "gram").select("set_id", "item_id").distinct()
    return kept(windows, "windows"), kept(members, "members")


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos (of its first word, from 0), size, set_id of every window of docs (doc_id, text) in the set."""
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]  # WIDTH numbers at most
    total = windows.agg(F.sum(F.octet_length("gram") + ENTRY_BYTES)).first()[0] or 0
    slices = max(1, math.ceil(total / SLICE_BYTES))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normalised_words(F.col("text")).alias("words"))
    # The outer form adds no filter on the array, which would make it twice.
    placed = own.select("*", F.posexplode_outer("words").alias("pos", "word"))
    window = lambda size: F.slice("words", F.col("pos") + 1, size)
    if len(sizes) == 1:
        hashed = placed.where(F.col("pos") <= F.size("words") - sizes[0]).withColumns({"size": F.lit(sizes[0]), "h": F.xxhash64(window(sizes[0]))})
    else:
        fitting = F.array(*(F.struct(F.lit(s).alias("size"), F.when(F.col("pos") <= F.size("words") - s, F.xxhash64(window(s))).alias("h")) for s in sizes)) if sizes else F.array().cast("array<struct<size:int,h:bigint>>")
        hashed = placed.select("*", F.inline_outer(fitting)).where(F.col("h").isNotNull())
    out = None
    for k in range(slices):
        part = windows.where(F.pmod("h", F.lit(slices)) == k) if slices > 1 else windows
        part = F.broadcast(part.select("h", "gram", F.col("size").alias("_size"), "set_id"))
        found = hashed.join(part, ["h"]).where((F.col("size") == F.col("_size")) & (F.array_join(window(F.col("size")), " ") == F.col("gram")))
        found = found.select("doc_id", "text_hash", "pos", "size", "set_id")
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_words, hit (places of its hit words from 0, sorted), items (ids as sorted strings).

    A null text has no words; a row without words has no hit. Null and repeated ids pass through, one row out for each row
    in, judged by its own text. An empty table of documents gives an empty result, an empty benchmark no hit; further
    columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    windows, members = item_windows(benchmark, width, item_col, item_text_col)
    hits = window_hits(source, windows)
    gathered = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "size")).alias("places"), F.array_sort(F.collect_set("set_id")).alias("sets"))
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["pos"], p["pos"] + p["size"] - 1)))))
    found = kept(gathered.select("doc_id", "text_hash", words.alias("hit"), "sets"), "hits")
    lists = found.select("sets").distinct().select("sets", F.explode("sets").alias("set_id")).join(members, "set_id").groupBy("sets").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = found.join(lists, "sets").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "hit", "items")
    rows = source.select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select("doc_id", "text_hash", "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def spans(hit: str) -> Column:
    """Runs of hit words as structs (start, end), the end exclusive. The column must be one of its own (see fenced)."""
    edge = lambda step: F.filter(hit, lambda p, i: ~F.coalesce(F.get(hit, i + step) == p + step, F.lit(False)))
    return F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without their contaminated rows (remove="documents"), or with the hit words taken out (remove="spans").

    A hit word goes with what stands between it and the next word; rows that lose all their words go. Rows without a hit
    stay as they are, null texts and null ids among them, as do all other columns, whatever their names.
    """
    if remove not in ("documents", "spans"):
        raise ValueError('remove must be "documents" or "spans"')
    own, digest, hit, words, gaps = unused(docs, "own", "digest", "hit", "words", "gaps")
    found = contamination(docs, benchmark, width, id_col, text_col, item_col, item_text_col).where(F.size("hit") > 0)
    found = found.select(F.col("doc_id").alias(own), F.col("text_hash").alias(digest), F.col("hit").alias(hit)).dropDuplicates([own, digest])
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(digest))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left")
    cut = fenced(joined, *docs.columns, hit, F.when(F.col(hit).isNotNull(), F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))).alias(words), F.when(F.col(hit).isNotNull(), F.split(text_col, WORD, -1)).alias(gaps))
    left = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), F.col(hit))
    clean = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(left, lambda i: F.concat(F.get(words, i), F.get(gaps, i + 1))), ""))
    cut = cut.where(F.col(hit).isNull() | (F.size(words) > F.size(hit)))
    return cut.withColumn(text_col, F.when(F.col(hit).isNotNull(), clean).otherwise(F.col(text_col))).select(docs.columns)
