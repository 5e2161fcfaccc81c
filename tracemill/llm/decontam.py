"""Benchmark decontamination, in DataFrame functions only.

Texts are lower-cased and cut into words (runs of letters and digits); shingles have five words, or all words of an
item that has fewer.  A window of a document is as long as an item and may start at any word; a document that is
shorter than an item is one window.

A window is similar to an item if the weighted similarity of their shingles (sum of the smaller multiplicities over
sum of the larger) is `similarity` or more.  Windows that cannot be are ruled out by what they share, wherever in the
window it stands:

* of an item with n shingles such a window holds at least ceil(similarity * n), so it holds one of the item's
  n - ceil(similarity * n) + 1 rarest (the seeds, shingles in the fewest items first);
* the number of a window's shingles that the item has bounds the sum of the smaller multiplicities from above.

Each remaining window gets a 64-bit SimHash of its shingles.  A multi-index tells whether the item that the window was laid
for is within `radius` bits: the 64 bits are cut into radius + 1 blocks, and two fingerprints within the radius agree in
at least one.  A window that is similar to several items holds a seed of each and is laid for each.  The exact similarity verifies the candidates.  A pair that is similar but farther apart than the radius is
lost by the method; `RADIUS` leaves about 3 in 10,000 of the pairs that are just similar enough, fewer of the others.

Texts are never shuffled: each occurrence of a seed cuts out the words around it, two item lengths at most.  Seeds,
items and found pairs are broadcast only while they number `BROADCAST` at most; beyond, the joins are shuffled.

Defined results: documents and items that are null or have no word match nothing; equal rows count once; items with
equal texts are reported each; of several windows of equal similarity the first is reported; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words in a shingle, least similarity, bits between fingerprints, rows that may be broadcast.
SHINGLE, SIMILARITY, RADIUS, BROADCAST = 5, 0.8, 20, 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that filters above read and do not compute again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def shingle_hashes(ws: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, by position."""

    def hashed(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - size)
        return F.when(F.size(w) >= size, F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))

    return bound(ws, hashed)


def simhash(hashes: Column) -> Column:
    """A bit is 1 if set in over half the hashes."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int")))

    def folded(s: Column) -> Column:
        bit = lambda b: F.call_function("shiftleft", F.when(F.get(s["counts"], b) * 2 > s["n"], F.lit(1)).otherwise(F.lit(0)).cast("long"), b)
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(bit(b)))

    return bound(F.struct(counts.alias("counts"), F.size(hashes).alias("n")), folded)


def blocks(fp: Column, radius: int) -> Column:
    """radius + 1 numbered blocks of the 64 bits: array<struct<block, bits>>."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)).alias("bits")) for k in range(n)))


def prepared(items: DataFrame, item_id: str, item_text: str, similarity: float) -> DataFrame:
    """(number, item, iw words, size, gram, ih hashes, ifp, seeds) of every item with a word; repeated ids are told apart by their words."""
    own = items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("iw")).withColumn("size", F.size("iw")).filter("size > 0")
    own = own.withColumn("number", F.xxhash64("item", "iw")).dropDuplicates(["number"]).withColumn("gram", F.least("size", F.lit(SHINGLE)))
    hashed = F.lit(None)
    for g in range(1, SHINGLE + 1):
        hashed = F.when(F.col("gram") == g, shingle_hashes(F.col("iw"), g)).otherwise(hashed)
    own = materialize(own.withColumn("ih", hashed.cast("array<bigint>")).withColumn("ifp", simhash(F.col("ih"))), "items")
    each = own.select("number", "gram", F.explode("ih").alias("h"))
    counts = each.groupBy("gram", "h").agg(F.count("*").alias("n"))
    ranked = each.join(counts, ["gram", "h"]).groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]).alias("rare"))
    n = F.size("rare")
    seeds = F.array_distinct(F.slice("rare", F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int")))
    return own.join(ranked.select("number", seeds.alias("seeds")), "number")


def cut_out(found: DataFrame) -> DataFrame:
    """The words and hashes around an occurrence of a seed: all that windows with that place reach.

    `found` has id, words ws and hashes hs of the document, pos, and number, size and n (shingles) of the item.
    """
    total = F.size("hs")
    length = F.least("n", total)  # shingles of a window
    low, high = F.greatest(F.lit(0), F.col("pos") - length + 1), F.least(F.col("pos") + length, total)
    reach = (high - low + F.col("gram") - 1).cast("int")
    return found.select("id", "number", "size", "gram", "n", "pos", length.alias("length"), total.alias("total"), low.alias("base"), F.slice("hs", low + 1, high - low).alias("rh"), F.slice("ws", low + 1, reach).alias("rw"))


def laid(around: DataFrame, similarity: float) -> DataFrame:
    """(id, number, size, gram, base, rw, cand): of the windows around a seed's occurrence those that may be similar, with fingerprints.

    A window belongs to the first occurrence of a seed of its item that it holds, so it is laid once.
    """
    before = F.slice("rh", F.lit(1), F.col("pos") - F.col("base"))
    last = F.array_max(F.transform(before, lambda h, i: F.when(F.array_contains("seeds", h), i)))
    first, ends = F.coalesce(last + 1, F.lit(0)) + F.col("base"), F.least(F.col("pos"), F.col("total") - F.col("length"))
    need = F.ceil((F.col("length") + F.col("n")) * (similarity / (1 + similarity)) - 1e-9)
    part = lambda of, s: F.slice(of, s - F.col("base") + 1, F.col("length"))
    n_held = lambda flags: F.size(F.array_remove(flags, False))

    def windows(held: Column) -> Column:
        starts = bound(first, lambda f: F.when(f <= ends, F.filter(F.sequence(f, ends), lambda s: n_held(part(held, s)) >= need)))
        return F.when(n_held(held) >= need, F.transform(starts, lambda s: F.struct(s.alias("start"), simhash(part(F.col("rh"), s)).alias("fp"))))

    cand = bound(F.transform("rh", lambda h: F.array_contains("ih", h)), windows)
    return once(around, "cand", cand).filter(F.size("cand") > 0).select("id", "number", "size", "gram", "base", "rw", "cand")


def overlap(a: Column, b: Column, gram: Column) -> Column:
    """Weighted similarity of the shingles of two lists of words: one fold over both sides' shingles, sorted."""

    def tagged(ws: Column, side: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - gram + 1)), lambda i: F.struct(F.array_join(F.slice(ws, i, gram), " ").alias("s"), F.lit(side).alias("side")))

    start = F.struct(F.lit(None).cast("string").alias("s"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("both"), F.lit(0).alias("any"))

    def step(acc: Column, x: Column) -> Column:
        one, two = (x["side"] == 0).cast("int"), (x["side"] == 1).cast("int")
        same = acc["s"].eqNullSafe(x["s"])
        both, any_ = acc["both"] + F.least(acc["a"], acc["b"]), acc["any"] + F.greatest(acc["a"], acc["b"])
        return F.struct(
            x["s"].alias("s"), F.when(same, acc["a"]).otherwise(F.lit(0)) + one, F.when(same, acc["b"]).otherwise(F.lit(0)) + two,
            F.when(same, acc["both"]).otherwise(both), F.when(same, acc["any"]).otherwise(any_),
        )

    done = lambda x: (x["both"] + F.least(x["a"], x["b"])).cast("double") / (x["any"] + F.greatest(x["a"], x["b"]))
    return F.aggregate(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), start, step, done)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, item id, window_start, window_words, similarity): the best window for each document and item found in it."""
    own = materialize(prepared(items, item_id, item_text, similarity), "prepared")
    seeds = own.select("number", "size", "gram", F.size("ih").alias("n"), F.explode("seeds").alias("h"))
    n_items, n_seeds = own.count(), seeds.count()
    near = F.broadcast if n_seeds <= BROADCAST else (lambda df: df)

    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    windows = None
    for g in sorted(r.gram for r in own.select("gram").distinct().collect()):  # five values at most
        cut = once(once(keyed, "ws", words(F.col("text"))), "hs", shingle_hashes(F.col("ws"), g))
        of_gram = seeds.filter(F.col("gram") == g)
        if n_seeds <= BROADCAST:
            found = cut.select("id", "ws", "hs", F.posexplode("hs").alias("pos", "h")).join(F.broadcast(of_gram), "h")
        else:  # places are shuffled to the seeds, and those found back to their texts
            cut = cut.withColumn("key", F.xxhash64("id", "text"))
            places = cut.select("key", F.posexplode("hs").alias("pos", "h")).join(of_gram, "h").select("key", "pos", "number", "size", "gram", "n").distinct()
            found = cut.select("id", "key", "ws", "hs").join(places, "key")
        rows = laid(cut_out(found).join(near(own.select("number", "ih", "seeds")), "number"), similarity)
        windows = rows if windows is None else windows.unionByName(rows)
    if windows is None:
        return docs.select(F.col(id_col), F.lit(None).cast(items.schema[item_id].dataType).alias(item_id), F.lit(0).alias("window_start"), F.lit(0).alias("window_words"), F.lit(0.0).alias("similarity")).limit(0)
    windows = materialize(windows, "windows")

    # the multi-index: a window was laid for an item, whose seed it holds, and meets that item through equal blocks
    probes = windows.select("number", F.explode("cand.fp").alias("fp")).distinct().withColumn("b", F.explode(blocks(F.col("fp"), radius)))
    index = own.select("number", "ifp", F.explode(blocks(F.col("ifp"), radius)).alias("b")).select("number", "ifp", "b.block", "b.bits")
    index = F.broadcast(index) if n_items * (radius + 1) <= BROADCAST else index
    hits = probes.select("number", "fp", "b.block", "b.bits").join(index, ["number", "block", "bits"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    hits = materialize(hits.select("number", "fp").distinct(), "hits")
    close = F.broadcast if hits.count() <= BROADCAST else (lambda df: df)

    each = windows.select("id", "number", "size", "gram", "base", "rw", F.explode("cand").alias("c")).select("id", "number", "size", "gram", "base", "rw", "c.start", "c.fp")
    pairs = each.join(close(hits), ["number", "fp"]).join(near(own.select("number", "item", "iw")), "number")
    window = F.slice("rw", F.col("start") - F.col("base") + 1, F.col("size"))
    scored = once(pairs, "similarity", overlap(window, F.col("iw"), F.col("gram"))).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("id", "item").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), "size")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_id), (-F.col("b.back")).alias("window_start"), F.col("b.size").alias("window_words"), F.col("b.similarity").alias("similarity"))
