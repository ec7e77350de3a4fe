"""Removal of lines that repeat an earlier line of the corpus, exactly or within a few edits.

DataFrame functions only. Two lines within k edits share one of the k + 1 segments into which either is cut, at nearly
the same place. Every line puts its segments into an index by (length, segment number, segment) and probes it with the
substrings that a line of each length up to k shorter could share (the multi-match-aware choice of places). Lines
that meet are verified by a bit-parallel edit distance over a band of 2k + 1 diagonals: first against the earliest line
of the key, then what is still open against the others, by semi joins, since one near earlier line is enough.

A line is dropped if an earlier line, in order of (document, place), equals it or is within k edits of it. So the first
line of every family stays, and no decision depends on another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, unused

#: Edits that near lines may differ by, and the length from which lines are compared with edits at all.
MAX_EDITS, MIN_CHARS = 2, 20
#: Ids of lines in question, and keys, are broadcast up to this number (8 or 9 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 2_000_000
EMPTY = r"^[\x20\x09-\x0D]*$"


def segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Place (from 1) and length of segment i (from 1) of k + 1 in a line of that length: the last ones are longer."""
    base, rest = F.floor(length / (k + 1)).cast("int"), length % (k + 1)
    longer = F.greatest(F.lit(i - 1) - (F.lit(k + 1) - rest), F.lit(0))
    return F.lit(i - 1) * base + longer + 1, base + F.when(rest > k + 1 - i, 1).otherwise(0)


def wide(line: Column) -> Column:
    """Four bytes for each character, so that a substring is found without reading what is before it."""
    return F.encode(line, "UTF-32")


def part(line: Column, at: Column, size: Column) -> Column:
    """`size` characters from place `at` (from 1) of a wide line."""
    return F.substring(line, 4 * at - 3, 4 * size)


def keyed(lines: DataFrame, k: int, probes: bool) -> DataFrame:
    """lines (with line and n, its length) with a column keys: the index keys, or the further keys that a line probes with.

    A line probes with its own index keys too, but what these meet is seen in the index itself.
    Places are columns first, so that the expression over them stays small enough to be compiled.
    """
    places, keys = {}, []
    for d in range(k + 1 if probes else 1):
        for i in range(1, k + 2):
            at, size = f"_at_{d}_{i}", f"_size_{d}_{i}"
            places[at], places[size] = segment(F.col("n") - d, i, k)
            shifts = range(max(1 - i, d - (k + 1 - i)), min(i - 1, d + (k + 1 - i)) + 1) if probes else (0,)
            shifts = [o for o in shifts if d or o or not probes]
            keys += [F.xxhash64(F.lit(i), F.col("n") - d, part(F.col("_wide"), F.col(at) + o, F.col(size))) for o in shifts]
    return lines.withColumns({"_wide": wide(F.col("line")), **places}).select(*lines.columns, F.array(*keys).alias("keys"))


def edit_distance(x: Column, y: Column, k: int) -> Column:
    """Edit distance of two arrays of characters, longer than k and of lengths at most k apart; above k if it is above.

    Bit b of a column's words stands for row column - k + b: the words slide down the band with the columns. The
    distance is followed along the band's lowest diagonal and then along the last row.
    """
    full = (1 << (2 * k + 1)) - 1
    m, n = F.size(x), F.size(y)
    flip = lambda w: F.lit(full).bitwiseXOR(w)

    def step(s: Column, j: Column) -> Column:
        c = F.get(y, j)
        equal = F.lit(0)
        for b in range(2 * k + 1):
            row = j - k + b
            equal = equal + F.when((row >= 0) & (F.get(x, row) == c), 1 << b).otherwise(0)
        vp, vn = s["vp"], s["vn"]

        def columns(t: Column) -> Column:
            d0 = ((t["e"].bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(t["e"]).bitwiseOR(vn).bitwiseAND(F.lit(full))
            return F.transform(F.array(d0), lambda d: F.struct(d.alias("d"), vn.bitwiseOR(flip(d.bitwiseOR(vp))).alias("hp"), d.bitwiseAND(vp).alias("hn")))[0]

        def moved(t: Column) -> Column:
            lower = F.shiftright(t["d"], 1)
            diagonal = F.when(t["d"].bitwiseAND(F.lit(1 << (2 * k))) == 0, 1).otherwise(0)
            last = F.element_at(F.array(*(F.lit(1 << b) for b in range(2 * k + 1))), F.greatest(F.least(m - j + k, F.lit(2 * k + 1)), F.lit(1)))
            across = F.when(t["hp"].bitwiseAND(last) != 0, 1).otherwise(0) - F.when(t["hn"].bitwiseAND(last) != 0, 1).otherwise(0)
            return F.struct(
                t["hn"].bitwiseOR(flip(lower.bitwiseOR(t["hp"]))).alias("vp"),
                lower.bitwiseAND(t["hp"]).alias("vn"),
                (s["dist"] + F.when(j < m - k, diagonal).otherwise(across)).alias("dist"),
            )

        # One-element arrays hold what is used more than once.
        found = F.transform(F.transform(F.array(F.struct(equal.alias("e"))), columns), moved)[0]
        return F.when(s["dist"] > 3 * k, s).otherwise(found)  # the last row takes back at most 2k

    start = F.struct(F.lit(full ^ ((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("dist"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["dist"])


def may_be_near(x: Column, y: Column, n: Column, m: Column, k: int, pieces: int) -> Column:
    """False only for wide lines (of n and m characters) more than k edits apart: of the pieces of x all but k are found
    in y, at most k places off."""

    def found(i: Column) -> Column:
        at = F.floor(n * i / pieces).cast("int")
        size = F.floor(n * (i + 1) / pieces).cast("int") - at
        return part(x, at + 1, size).isin(*(part(y, at + 1 + o, size) for o in sorted(range(-k, k + 1), key=abs)))

    hits = F.size(F.filter(F.array(*map(F.lit, range(pieces))), found))
    return (F.abs(n - m) <= k) & (hits >= pieces - k)


def shared_start(x: Column, y: Column, n: Column, m: Column, length: Column, from_end: bool = False, pieces: int = 16) -> Column:
    """How many characters, whole pieces of `length`, two wide lines have in common at their start (or end)."""

    def step(so_far: Column, i: Column) -> Column:
        at = F.floor(length * i / pieces).cast("int")
        end = F.floor(length * (i + 1) / pieces).cast("int")
        a, b = (n - end, m - end) if from_end else (at, at)
        return F.when((so_far == at) & (part(x, a + 1, end - at) == part(y, b + 1, end - at)), end).otherwise(so_far)

    return F.aggregate(F.array(*map(F.lit, range(pieces))), F.lit(0), step)


def within(x: Column, y: Column, xw: Column, yw: Column, n: Column, m: Column, k: int) -> Column:
    """Whether two lines (also given wide, of n and m characters, more than k) are within k edits: may_be_near, then the
    edit distance of what is left without a common start and end. One-element arrays hold what is used more than once."""
    one = lambda **columns: F.array(F.struct(*(c.alias(name) for name, c in columns.items())))
    room = F.least(n, m) - (k + 1)
    start = F.transform(one(r=room), lambda r: F.struct(r["r"].alias("r"), shared_start(xw, yw, n, m, r["r"]).alias("p")))
    both = F.transform(start, lambda s: F.struct(s["p"].alias("p"), F.least(s["r"] - s["p"], shared_start(xw, yw, n, m, s["r"] - s["p"], True)).alias("q")))
    rests = F.transform(both, lambda t: F.struct(F.slice(F.split(x, ""), t["p"] + 1, n - t["p"] - t["q"]).alias("x"), F.slice(F.split(y, ""), t["p"] + 1, m - t["p"] - t["q"]).alias("y")))
    near = F.exists(rests, lambda u: edit_distance(u["x"], u["y"], k) <= k)
    return may_be_near(xw, yw, n, m, k, 8) & may_be_near(xw, yw, n, m, k, 32) & near


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pos, line, n (its length), and two 64-bit hashes of each line that holds more than white space."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return rows.where(~F.col("line").rlike(EMPTY)).withColumns({"n": F.length("line"), "h": F.xxhash64("line"), "g": F.xxhash64(F.lit("line"), "line")})


def near_earlier(lines: DataFrame, made: DataFrame, k: int, min_chars: int) -> DataFrame:
    """h, g of the lines that an earlier, different line is within k edits of.

    lines has the texts; made has h and the index keys of every line.
    """
    long = lines.where(F.col("n") >= max(min_chars, 2 * k + 2))
    index = made.select("h", F.explode("keys").alias("key"))
    # Written, so that a key of very many probes can be split when it is joined. lone: the line of a key of one line, else null.
    heads = index.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    heads = kept(heads.select("key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("lone")), "heads")
    # explode() would add a filter on the array, and with it make the array twice.
    probes = keyed(long, k, True).select("h", F.explode_outer("keys").alias("key"))
    moved = kept(probes.join(heads, "key").where("lone is null or lone <> h").select("key", "h").distinct(), "moved")
    shared = heads.where("lone is null").select("key", F.lit(True).alias("shared"))
    keys = kept(moved.select("key", F.lit(False).alias("shared")).unionByName(shared).groupBy("key").agg(F.max("shared").alias("shared")), "keys")
    few = keys.count() <= BROADCAST_IDS
    met_in = kept(index.join(F.broadcast(keys) if few else keys, "key").select("key", "h", "shared").distinct(), "inside")
    inside = met_in.select("key", "h")
    hits = kept(moved.unionByName(met_in.where("shared").select("key", "h")).distinct(), "hits")

    ids = kept(hits.select("h").unionByName(inside.select("h")).distinct(), "ids")
    small = ids.count() <= BROADCAST_IDS
    found = long.join(F.broadcast(ids) if small else ids, "h", "left_semi").groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos", "line")).alias("t"))
    texts = kept(found.select("h", "g", F.struct("t.doc_id", "t.pos").alias("place"), F.col("t.line").alias("line")), "lines").withColumns({"n": F.length("line"), "wide": wide(F.col("line"))})

    # Every line meets the earliest one of each of its keys.
    placed = inside.join(texts.select("h", "place"), "h")
    lead = kept(placed.groupBy("key").agg(F.min(F.struct("place", "h")).alias("first"), (F.count("*") > 1).alias("many")).select("key", F.col("first.h").alias("lead"), "many"), "lead")
    met = hits.join(lead, "key").where("h <> lead").select(F.least("h", "lead").alias("a"), F.greatest("h", "lead").alias("b")).distinct()
    a, b = (texts.select(*(F.col(c).alias(s if c == "h" else f"{s}_{c}") for c in texts.columns)) for s in "ab")
    both = met.join(a, "a").join(b, "b")
    near = both.where(within(*(F.col(f"{t}_{c}") for c in ("line", "wide", "n") for t in "ab"), k))
    later = F.when(F.col("a_place") < F.col("b_place"), F.struct(F.col("b").alias("h"), F.col("b_g").alias("g"))).otherwise(F.struct(F.col("a").alias("h"), F.col("a_g").alias("g")))
    gone = kept(near.select(later.alias("l")).select("l.h", "l.g").distinct(), "dropped")

    # Keys of several lines: a line that is still open goes if any other line of its key is earlier and near.
    crowd = lead.where("many").select("key")
    probing, indexed = (kept(side.join(crowd, "key", "left_semi").join(texts, "h"), "crowd") for side in (hits, inside))

    def later_of(mine: DataFrame, others: DataFrame) -> DataFrame:
        o = others.select("key", *(F.col(c).alias(f"o_{c}") for c in ("place", "line", "wide", "n")))
        close = (F.col("o_place") < F.col("place")) & within(*(F.col(f"{t}{c}") for c in ("line", "wide", "n") for t in ("", "o_")), k)
        left = mine.join(gone, ["h", "g"], "left_anti").alias("m")
        return left.join(o.alias("o"), (F.col("m.key") == F.col("o.key")) & close, "left_semi").select("h", "g")

    return gone.unionByName(later_of(probing, indexed)).unionByName(later_of(indexed, probing)).distinct()


def judged_lines(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos, gone of every line that holds more than white space."""
    lines = lines_of(docs, id_col, text_col)
    keys = F.when(F.col("n") >= max(min_chars, 2 * k + 2), F.col("keys"))
    made = kept(keyed(lines, k, False).select("doc_id", "pos", "h", "g", keys.alias("keys")), "lines")
    near = near_earlier(lines, made, k, min_chars).withColumn("near", F.lit(True))
    firsts = made.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    firsts = kept(firsts.join(near, ["h", "g"], "left").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near")), "firsts")
    return made.select("doc_id", "pos", "h", "g").join(firsts, ["h", "g"]).select("doc_id", "pos", (F.col("near") | (F.struct("doc_id", "pos") != F.col("first"))).alias("gone"))


def line_report(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document id: n_lines (with more than white space), n_dropped, dropped (their places from 0, joined by commas).

    A null text has no lines, like an empty one. Rows that repeat an id count as one document whose equal lines at the
    same place are one line; a null id is a document of its own that comes first. An empty table gives an empty result;
    further columns are ignored. Lines of white space alone are neither counted nor dropped.
    """
    lines = kept(judged_lines(docs, k, min_chars, id_col, text_col), "judged")
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct().join(lines.select("doc_id", "pos").distinct().groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    gone = lines.where("gone").select("doc_id", "pos").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    return counted.join(gone, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("dropped"))


def dedup_lines(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of their texts; documents that lose all they had go.

    Texts that lose nothing, null ones and rows with a null id stay as they are, as do all other columns, whatever
    their names. Rows that repeat an id lose the places that the id's lines lose. An empty table stays empty.
    """
    own, gone, new = unused(docs, "own", "gone", "new")
    lost = judged_lines(docs, k, min_chars, id_col, text_col).where("gone").select("doc_id", "pos").distinct()
    lost = lost.groupBy("doc_id").agg(F.collect_list("pos").alias(gone)).where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", own)
    joined = docs.join(lost, F.col(id_col).cast("long") == F.col(own), "left")
    clean = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: F.coalesce(~F.array_contains(gone, i), F.lit(True))), "\n")
    cut = joined.withColumn(new, F.when(F.col(gone).isNotNull(), clean).otherwise(F.col(text_col)))
    return cut.where(F.col(gone).isNull() | ~F.col(new).rlike(EMPTY)).withColumn(text_col, F.col(new)).select(docs.columns)
