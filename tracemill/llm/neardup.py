"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts.  A tile holds
fingerprints whose two 32-bit halves have given population counts.  Two fingerprints at distance d differ by d at
most in the sum of the half counts' differences, so tile pairs beyond the radius are never formed.  Large cells are
split into several tiles, so no task holds an unbounded group; equal fingerprints are one entry.  A tile pair
returns a spanning forest of its links, at most one row per fingerprint, never all pairs of a dense group.

Defined results: null or empty text has fingerprint zero, which links like any other.  Repeated rows share their
component.  A row without an id gets the component of its fingerprint's group, or null if nobody there has an id.

`similar_groups` links texts whose sets of word shingles have a given Jaccard similarity.  Fingerprints in
order give each text a near other one; the links that hold make the first groups.  What is left are pairs in
different groups, which an equi-join on prefixes of the sets finds without loss.  Before whole sets are compared one
filter is not exact: pairs of large sets whose fingerprints differ by more than `FAR` bits are left out, which a pair of
similarity 0.8 does by 6 standard deviations.
"""

from __future__ import annotations

from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Shared, discard, materialize, released

#: Fingerprints in a tile at most (16 bytes each), and comparisons above which a pair of tiles is cut more finely.
TILE, SUB_TILED = 32_768, 16_000_000


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, in order; of the whole sequence if it has fewer words, none if it has no word."""
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    return np.fromiter(starmap(xxhash.xxh64_intdigest, ((joined[a:b], seed) for a, b in zip(starts, ends, strict=True))), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included."""
    return simhash(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(id, fp long) for every row, without a shuffle."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), "id long, fp long")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of a graph given by its edges: each node that isn't the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _sub_tiles(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the population counts of the four 16-bit quarters; the counts of each run of equal ones, and the runs' bounds."""
    quarters = np.bitwise_count(np.ascontiguousarray(f).view(np.uint16).reshape(-1, 4)).astype(np.int64)
    kinds, at = np.unique(quarters, axis=0, return_inverse=True)
    order = np.argsort(at.ravel(), kind="stable")
    return order, kinds, np.concatenate([[0], np.bincount(at.ravel(), minlength=len(kinds)).cumsum()])


def tile_links(fa: np.ndarray, ra: np.ndarray, fb: np.ndarray, rb: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars, by representative, of the links between two tiles (or within one, given twice).

    Large tiles are cut once more, by the population counts of quarters; pairs of these cuts beyond the radius are skipped.
    """
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    held = 0

    def compare(fa: np.ndarray, ra: np.ndarray, fb: np.ndarray, rb: np.ndarray) -> None:
        nonlocal us, vs, held
        for i in range(0, len(fa), 128):
            left = fa[i : i + 128, None]
            for j in range(0, len(fb), 2048):
                hit = np.bitwise_count(left ^ fb[None, j : j + 2048]) <= radius
                if not hit.any():
                    continue
                x, y = np.nonzero(hit)
                x, y = ra[x + i], rb[y + j]
                if len(x) > 4096:
                    x, y = forest(x, y)
                us.append(x)
                vs.append(y)
                held += len(x)
                if held > 500_000:
                    x, y = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [x], [y], len(x) - 400_000

    if len(fa) * len(fb) <= SUB_TILED:
        compare(fa, ra, fb, rb)
    else:
        same = fa is fb
        oa, ka, ca = _sub_tiles(fa)
        ob, kb, cb = (oa, ka, ca) if same else _sub_tiles(fb)
        fa, ra, fb, rb = fa[oa], ra[oa], fb[ob], rb[ob]
        for g in range(len(ka)):
            near = np.nonzero(np.abs(kb - ka[g]).sum(1) <= radius)[0]
            for h in near[near >= g] if same else near:
                compare(fa[ca[g] : ca[g + 1]], ra[ca[g] : ca[g + 1]], fb[cb[h] : cb[h + 1]], rb[cb[h] : cb[h + 1]])
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(us), np.concatenate(vs))


def paired_tiles(reps: DataFrame, radius: int) -> DataFrame | None:
    """(pair, fps, own): the two tiles, or the one, of each pair of tiles within the radius, from `reps` (fp, rep); None without rows."""
    cells = reps.select("fp", "rep", F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("lo"))
    counts = {(r.hi, r.lo): r.n for r in cells.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}  # 33 x 33 rows at most
    if not counts:
        return None
    spark = reps.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(h, w, -(-n // TILE)) for (h, w), n in counts.items()], "hi int, lo int, parts int"))
    tiled = cells.join(sizes, ["hi", "lo"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1)
        fps, own = (group.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in ("fp", "rep"))
        return pa.table({"hi": first["hi"], "lo": first["lo"], "part": first["part"], "fps": pa.array([fps.tobytes()], pa.binary()), "own": pa.array([own.tobytes()], pa.binary())})

    packed = tiled.select("hi", "lo", "part", "fp", "rep").groupBy("hi", "lo", "part").applyInArrow(pack, "hi int, lo int, part int, fps binary, own binary")
    # each tile meets the tiles of the cells around it (41 at radius 4), itself among them; both ends name the pair alike
    near = [(dh, dl) for dh in range(-radius, radius + 1) for dl in range(-radius, radius + 1) if abs(dh) + abs(dl) <= radius]
    steps = F.array(*(F.struct(F.lit(dh).alias("dh"), F.lit(dl).alias("dl")) for dh, dl in near))
    around = packed.withColumn("step", F.explode(steps)).withColumn("hi2", F.col("hi") + F.col("step.dh")).withColumn("lo2", F.col("lo") + F.col("step.dl"))
    around = around.join(sizes.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("parts").alias("parts2")), ["hi2", "lo2"]).withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    own, other = F.format_string("%02d.%02d.%d", "hi", "lo", "part"), F.format_string("%02d.%02d.%d", "hi2", "lo2", "part2")
    return around.select(F.concat_ws("-", F.least(own, other), F.greatest(own, other)).alias("pair"), "fps", "own")


def _tiles(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints and representatives of a pair's tiles; one tile stands for both."""
    fps = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("fps")]
    own = [np.frombuffer(x.as_py(), np.int64) for x in group.column("own")]
    return fps[0], own[0], fps[-1], own[-1]


def links(reps: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a > b, both representatives) between the distinct fingerprints of `reps` (fp, rep)."""

    def compare(group: pa.Table) -> pa.Table:
        a, b = tile_links(*_tiles(group), radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = paired_tiles(reps, radius)
    return reps.sparkSession.createDataFrame([], "a long, b long") if dealt is None else dealt.groupBy("pair").applyInArrow(compare, "a long, b long")


def tile_nearest(fa: np.ndarray, ra: np.ndarray, fb: np.ndarray, rb: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(representative, its nearest in the other tile, distance) for both tiles' members that have one within the radius."""
    same = fa is fb
    far = radius + 1
    best_a, best_b = np.full(len(fa), far), np.full(len(fb), far)
    to_a, to_b = np.zeros(len(fa), np.int64), np.zeros(len(fb), np.int64)
    for i in range(0, len(fa), 128):
        left = fa[i : i + 128, None]
        for j in range(i - i % 2048 if same else 0, len(fb), 2048):
            d = np.bitwise_count(left ^ fb[None, j : j + 2048])
            if same and i < j + 2048 and j < i + 128:
                k = np.arange(max(i, j), min(i + 128, j + 2048, len(fa)))
                d[k - i, k - j] = 65  # itself
            if not (d <= radius).any():
                continue
            for axis, best, to, own, at in ((1, best_a, to_a, rb[j : j + 2048], slice(i, i + 128)), (0, best_b, to_b, ra[i : i + 128], slice(j, j + 2048))):
                k = d.argmin(axis)
                low = np.take_along_axis(d, np.expand_dims(k, axis), axis).squeeze(axis)
                better = low < best[at]
                best[at] = np.where(better, low, best[at])
                to[at] = np.where(better, own[k], to[at])
    own, to, best = (ra, to_a, best_a) if same else (np.concatenate([ra, rb]), np.concatenate([to_a, to_b]), np.concatenate([best_a, best_b]))
    if same:  # blocks on the diagonal's other side were seen as columns only
        closer = best_b < best_a
        to, best = np.where(closer, to_b, to_a), np.minimum(best_a, best_b)
    keep = best < far
    return own[keep], to[keep], best[keep]


def nearest(reps: DataFrame, radius: int) -> DataFrame:
    """(a, b): for each of `reps` (fp, rep) a near one within the radius, mostly the nearest.

    Fingerprints are put in order four times, each time from another quarter on; in each order a fingerprint meets the
    one before it among those with the same first quarter.  The work grows as the sorting of `reps`.
    """
    turned = F.explode(F.array(*(F.struct(F.lit(16 * k).alias("by"), (F.shiftleft("fp", 16 * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * k)) if k else F.col("fp")).alias("turned")) for k in range(4))))
    rows = reps.select("fp", "rep", turned.alias("t")).select("fp", "rep", "t.by", "t.turned")
    order = W.partitionBy("by", F.shiftrightunsigned("turned", 48)).orderBy("turned", "rep")
    met = rows.select(F.col("rep").alias("a"), F.lag("rep").over(order).alias("b"), F.bit_count(F.col("fp").bitwiseXOR(F.lag("fp").over(order))).alias("d")).filter(F.col("d") <= radius)
    return met.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", F.col("x.b").alias("b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given by edges (a, b): smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so the rounds
    grow with the logarithm of a component's width.  Each round's labels are written to the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels-0")
    for k in range(1, max_rounds + 1):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("top"))
        new = step.join(up, "via").select("node", F.least("via", "top").alias("label"), (F.least("via", "top") != F.col("old")).alias("moved"))
        new = materialize(new, f"labels-{k}")
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) for every row; ids are integers."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep")).filter("rep is not null")
    reps = materialize(reps, "representatives")
    merged = components(links(reps, radius))
    named = reps.join(merged, reps.rep == merged.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Documents whose shingles are counted to put frequent ones last, and frequent shingles that are kept.
ORDER_DOCS, ORDER_SHINGLES = 4_096, 65_536
#: Bits between a text and the nearest one that it is checked against first; texts to check whose ids may be broadcast.
NEAREST, NAMED = 12, 1_000_000
#: Sets of `LARGE` shingles or more whose fingerprints differ by more than `FAR` bits are not checked: at a similarity of
#: 0.8 the distance has a mean of 9.7 bits and a deviation of 2.9.
FAR, LARGE = 28, 64


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; a text of fewer words is one shingle."""
    return np.unique(shingle_hashes(text, shingle, 0).view(np.int64))


def set_key(grams: np.ndarray) -> int:
    """One number for a whole set, as a signed long."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64))


def frequent_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that occur repeatedly in a bounded sample of documents, and their counts."""
    keyed = docs.select(F.xxhash64(text_col).alias("at"), F.col(text_col).alias("text")).filter("text is not null")
    last = keyed.select("at").distinct().orderBy("at").limit(ORDER_DOCS).agg(F.max("at").alias("at")).first().at
    if last is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle))], ["h"])

    counted = keyed.filter(F.col("at") <= last).select("text").mapInArrow(released(run), "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    rows = sorted((r.h, r.n) for r in counted.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).collect())
    return np.array([h for h, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(id, text_key, group_key, component_id) for every row: components of all pairs of texts with a Jaccard similarity of `least` or more.

    A row is known by its id and `text_key`, xxhash64 of its text: an id may stand on several texts.  `group_key` names a
    component, `component_id` is the smallest id in it.

    First each text is checked against its nearest by SimHash.  Shingles are put in one order, rare ones first; of two
    sets this similar, the first n - ceil(least * n) + 1 shingles have one in common, so an equi-join on these prefixes
    loses no pair, whatever the order; sizes, places and fingerprints of the sets rule out most others and the whole sets
    decide.  So that a large group of copies doesn't give all its pairs, each shingle first has its texts checked
    against one of them, and only then all pairs that are still in different groups.
    """
    frequent = Shared(docs.sparkSession, frequent_shingles(docs, text_col, shingle), "neardup")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = texts.select("*", F.xxhash64("text").alias("text_key"))

    def run(batches):
        known, counts = frequent.value
        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            keys, fps, sizes, middles, prefixes = [], [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), shingle, 0)
                grams = np.unique(hashes.view(np.int64))
                keys.append(set_key(grams))
                fps.append(simhash(grams.view(np.uint64)))  # of the set, so that repeats don't hide what is similar
                sizes.append(len(grams))
                often = np.zeros(len(grams), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    often = np.where(known[at] == grams, counts[at], 0)
                    grams = grams[np.argsort(often, kind="stable")]
                middles.append(float(np.log1p(often).mean()) if len(grams) else 0.0)
                prefixes.append(grams[: len(grams) - int(np.ceil(len(grams) * least - 1e-9)) + 1])
            ends = np.cumsum([0, *map(len, prefixes)])
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]))
            columns = [batch.column(0), batch.column(2), pa.array(keys, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(middles, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "key", "fp", "n", "middle", "prefix"])

    rows = materialize(keyed.mapInArrow(released(run), "id long, text_key long, key long, fp long, n long, middle double, prefix array<long>"), "prefixes")
    ids = materialize(rows.select("id", "text_key", "key"), "ids")
    repeated = not ids.groupBy("id", "key").count().filter("count > 1 and id is not null").isEmpty()
    # a set that stands once is its own representative; prefixes are shuffled only where a set is repeated
    known = rows.filter("id is not null")
    again = materialize(ids.filter("id is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("times")).filter("times > 1").select("key", "id"), "repeated")
    few = F.broadcast if again.count() <= NAMED else (lambda df: df)
    first = known.join(few(again), ["key", "id"], "left_semi").groupBy("key").agg(F.min(F.struct("id", "fp", "n", "middle", "prefix")).alias("x")).select("key", F.col("x.id").alias("rep"), "x.fp", "x.n", "x.middle", "x.prefix")
    single = known.join(few(again.select("key")), "key", "left_anti").select("key", F.col("id").alias("rep"), "fp", "n", "middle", "prefix")
    reps = materialize(single.unionByName(first), "representatives")
    discard(rows)

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b: keys) whose whole sets are similar; only texts in question are read again.

        Prefixes come first: beyond the earlier of two prefixes' ends, sets have no more in common than the rest of that
        set, so what the prefixes have in common bounds the whole, and most pairs need no whole sets.
        """
        met = materialize(pairs, "met")
        asked = materialize(met.select(F.col("a").alias("key")).union(met.select("b")).distinct(), "asked")
        own = reps.join(F.broadcast(asked) if asked.count() <= NAMED else asked, "key", "left_semi")
        ends = [own.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}")) for x in ("a", "b")]
        rest = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
        most = F.least(F.size(F.array_intersect("pa", "pb")) + rest, F.col("na"), F.col("nb"))
        pairs = met.join(ends[0], "a").join(ends[1], "b").filter(most >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-6).select("a", "b")
        pairs = materialize(pairs, "pairs")
        named = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(reps.select("key", F.col("rep").alias("id")), "key")
        named = materialize(named, "named")
        own = texts.join(F.broadcast(named) if named.count() <= NAMED else named, "id")

        def grams(batches):
            for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
                keys, sets = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = shingle_set(text.as_py(), shingle)
                    if set_key(found) == key:  # another text of a repeated id is not in question
                        keys.append(key)
                        sets.append(found)
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["key", "grams"])

        sets = own.select("key", "text").mapInArrow(released(grams), "key long, grams array<long>")
        if repeated:
            sets = sets.groupBy("key").agg(F.first("grams").alias("grams"))
        sets = materialize(sets, "sets")
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
        common = F.size(F.array_intersect("ga", "gb"))
        found = materialize(both.filter(common >= (F.size("ga") + F.size("gb") - common) * least - 1e-9).select("a", "b"), "similar")
        discard(met, asked, pairs, named, sets)
        return found

    fps = reps.select("key", "fp", (F.col("n") >= LARGE).alias("large"))
    ends = [fps.select(F.col("key").alias(x), F.col("fp").alias(f"f{x}"), F.col("large").alias(f"l{x}")) for x in ("a", "b")]
    possible = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # in common at most, if this shingle is their first
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & (possible >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)

    def checked(met: DataFrame) -> DataFrame:
        """The similar ones of pairs that share a shingle (a, na, pa, b, nb, pb)."""
        pairs = met.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= FAR) | ~(F.col("la") & F.col("lb"))
        return similar(pairs.join(ends[0], "a").join(ends[1], "b").filter(near).select("a", "b"))

    def grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """Rows (key, ...) with the group c of their text."""
        small = F.broadcast if groups.count() <= NAMED else (lambda df: df)
        return rows.join(small(groups.withColumnRenamed("node", "key")), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")

    def between(own: DataFrame) -> DataFrame:
        """(gram, key, n, pos, c): of places of shingles those of shingles that several groups have."""
        of_gram = W.partitionBy("gram")
        several = own.withColumn("low", F.min("c").over(of_gram)).withColumn("high", F.max("c").over(of_gram)).filter("low < high")
        return materialize(several.select("gram", "key", "n", "pos", "c"), "shared-shingles")

    # first the nearest texts, then of each shingle every text with one of those that have it: the one whose shingles are
    # the most frequent, which of many copies is the one that was changed least
    close = nearest(reps.select("fp", F.col("key").alias("rep")), NEAREST)
    close = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sizes = [reps.select(F.col("key").alias(x), F.col("n").alias(f"n{x}")) for x in ("a", "b")]
    alike = F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9  # sets of other sizes can't be this similar
    edges = similar(close.join(sizes[0], "a").join(sizes[1], "b").filter(alike).select("a", "b"))
    merged = components(edges)
    labelled = grouped(reps.select("key", F.col("n").cast("int").alias("n"), "prefix"), merged)  # whole prefixes, not their places, meet the groups
    shared = between(labelled.select("key", "n", "c", F.posexplode("prefix").alias("pos", "gram"))).join(reps.select("key", "middle"), "key")
    side = lambda x: [F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("c").alias(f"c{x}")]
    hubs = shared.groupBy("gram").agg(F.min(F.struct((-F.col("middle")).alias("m"), "key", "n", "pos", "c")).alias("x")).select("gram", "x.*").select("gram", *side("b"))
    more = checked(shared.select("gram", *side("a")).join(hubs, "gram").filter("ca <> cb"))
    edges = materialize(edges.union(more), "edges")
    merged = components(edges)

    # then all pairs in different groups
    shared = between(grouped(shared.drop("c", "middle"), merged))
    heads = shared.groupBy("gram", "c").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    x, y = heads.alias("x"), heads.alias("y")
    sizes = (F.col("x.most_n") >= F.col("y.least_n") * least - 1e-9) & (F.col("y.most_n") >= F.col("x.least_n") * least - 1e-9)
    # what no two members can have in common, by the best place that a group's members have the shingle at
    sizes &= F.least("x.rest", "y.rest") >= (F.col("x.least_n") + F.col("y.least_n")) * (least / (1 + least)) - 1e-9
    met = x.join(y, F.col("x.gram") == F.col("y.gram")).filter((F.col("x.c") < F.col("y.c")) & sizes).select(F.col("x.gram").alias("gram"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb"))
    more = checked(met.join(shared.select("gram", *side("a")), ["gram", "ca"]).join(shared.select("gram", *side("b")), ["gram", "cb"]))
    if not more.isEmpty():
        merged = components(edges.union(more))

    named = reps.select("key", "rep").join(merged.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").select("key", F.col("component").alias("group_key"), "component_id")
    return ids.join(named, "key", "left").select(F.col("id").alias(id_col), "text_key", "group_key", "component_id")
