"""Dependency graph of skills and references over sessions.

Sets come in long form: triggers (session, skill), reads (session, skill, ref), both distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import DEPGRAPH
from tracemill.storage import written

#: Pairs of references and their owners that may be broadcast.
FEW = 200_000
#: Categories whose sets are the bits of one number, at most.
MASKED = 62
UNCATEGORIZED = "__uncategorized__"


def read_rates(triggers: DataFrame, reads: DataFrame) -> DataFrame:
    """P(ref read | a skill that owns it triggered): (ref, n, numer, rate, advice)."""
    owners = written(reads.select("ref", "skill").distinct(), "owners")
    few = F.broadcast if owners.count() <= FEW else (lambda df: df)  # else a frequent reference would gather its sessions in one task
    own = triggers.select("session", "skill").distinct()
    # exposures are counted by skill before references come in; only references with several owners need their sessions
    owned = owners.groupBy("ref").agg(F.count("*").alias("_o"), F.first("skill").alias("skill"))
    alone = owned.filter("_o = 1").select("ref", "skill")
    n_alone = alone.join(own.groupBy("skill").agg(F.count("*").alias("n")), "skill").select("ref", "n")
    shared = owners.join(owned.filter("_o > 1").select("ref"), "ref", "left_semi")
    n_shared = shared.join(own, "skill").select("ref", "session").distinct().groupBy("ref").agg(F.count("*").alias("n"))
    # a read counts if some owner triggered in its session
    hit = reads.select("ref", "session").distinct().join(few(owners), "ref").join(own, ["session", "skill"], "left_semi").select("ref", "session").distinct().groupBy("ref").agg(F.count("session").alias("numer"))
    rated = n_alone.unionByName(n_shared).join(hit, "ref", "left").select("ref", "n", F.coalesce("numer", F.lit(0)).alias("numer"))
    all_refs = owners.select("ref").distinct().join(rated, "ref", "left").select("ref", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("numer", F.lit(0)).alias("numer"))
    rate = F.when(F.col("n") > 0, F.col("numer") / F.col("n"))
    advice = F.when(rate >= DEPGRAPH["inline"], "inline").when(rate <= DEPGRAPH["external"], "external").when(rate.isNotNull(), "gray-zone-section-split")
    return all_refs.select("ref", "n", "numer", rate.alias("rate"), advice.alias("advice"))


def co_occurrence(members: DataFrame, group: str, item: str, n_groups: int, least: float) -> DataFrame:
    """Pairs of items that share at least a share `least` of all groups: (a, b, both, rate).

    An item of a kept pair is itself in that share of groups, so rarer items are dropped before the self-join; this
    loses no pair and bounds the items of a group that can meet by 1 / least times the mean.
    """
    own = members.select(F.col(group).alias("g"), F.col(item).alias("x")).distinct()
    frequent = own.groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") >= least * n_groups - 1e-9).select("x")
    own = own.join(frequent, "x", "left_semi")
    pairs = own.select("g", F.col("x").alias("a")).join(own.select("g", F.col("x").alias("b")), "g").filter("a < b")
    rate = F.col("both") / F.lit(n_groups)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("both")).withColumn("rate", rate).filter(F.col("rate") >= least)


def co_read_pairs(reads: DataFrame, n_sessions: int, least: float = DEPGRAPH["co_read"]) -> DataFrame:
    return co_occurrence(reads, "session", "ref", n_sessions, least)


def co_trigger_graph(triggers: DataFrame, n_sessions: int, least: float = DEPGRAPH["co_trigger"]) -> tuple[DataFrame, DataFrame]:
    """(nodes: skill, trigger_rate), (edges: a, b, both, rate)."""
    nodes = triggers.select("session", "skill").distinct().groupBy("skill").agg((F.count("*") / F.lit(n_sessions)).alias("trigger_rate"))
    return nodes, co_occurrence(triggers, "session", "skill", n_sessions, least)


def merge_groups(nodes: DataFrame, edges: DataFrame, excluded: tuple[str, ...] = (), max_rounds: int = 60) -> DataFrame:
    """Connected components of two skills or more, without excluded ones: (component, members).

    Smallest-label propagation with pointer jumping; each round's labels are written to the shared folder, and rounds
    grow with the logarithm of a component's width.  Labels that have not settled after `max_rounds` are an error.
    """
    keep = ~F.col("skill").isin(*excluded) if excluded else F.lit(True)
    labels = written(nodes.select("skill").distinct().filter(keep).withColumn("label", F.col("skill")), "labels")
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    both = both.join(labels.select(F.col("skill").alias("a")), "a", "left_semi").join(labels.select(F.col("skill").alias("b")), "b", "left_semi").select("a", "b")
    both = written(both.distinct(), "edges")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("skill").alias("b"), "label"), "b").groupBy(F.col("a").alias("skill")).agg(F.min("label").alias("near"))
        step = labels.join(near, "skill", "left").select("skill", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("via"))
        up = labels.select(F.col("skill").alias("via"), F.col("label").alias("top"))
        new = written(step.join(up, "via").select("skill", "old", F.least("via", "top").alias("label")), "labels")
        labels = new.select("skill", "label")
        if new.filter("old <> label").isEmpty():
            return labels.groupBy(F.col("label").alias("component")).agg(F.sort_array(F.collect_list("skill")).alias("members")).filter(F.size("members") >= 2)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def jaccard_split(sessions: DataFrame, reads: DataFrame) -> DataFrame:
    """Per skill: mean pairwise Jaccard of what its categories read, and whether a split is suggested.

    sessions: (skill, session, category) where the skill triggered; reads: (skill, session, ref) of that skill's refs.
    """
    cats = sessions.withColumn("category", F.coalesce("category", F.lit(UNCATEGORIZED)))
    sizes = cats.select("skill", "session", "category").distinct().groupBy("skill", "category").agg(F.count("session").alias("n"))
    refs = cats.join(reads, ["skill", "session"]).select("skill", "category", "ref").distinct()
    count = refs.groupBy("skill", "category").agg(F.count("*").alias("size"))
    shared = refs.select("skill", "ref", F.col("category").alias("x")).join(refs.select("skill", "ref", F.col("category").alias("y")), ["skill", "ref"]).filter("x < y").groupBy("skill", "x", "y").agg(F.count("*").alias("both"))
    return _split(sizes, count, shared)


def category_bit(category: Column, categories: list[str]) -> Column:
    """A number with one bit set, that of the place of a category among at most `MASKED`."""
    named = F.coalesce(category, F.lit(UNCATEGORIZED))
    return F.coalesce(*(F.when(named == c, F.lit(1 << i).cast("long")) for i, c in enumerate(categories)), F.lit(None).cast("long"))


def jaccard_split_masked(rows: DataFrame) -> DataFrame:
    """`jaccard_split` of rows (skill, session, ref, bit) that name all at once; `bit` is `category_bit`'s, so `MASKED` categories at most.

    A ref's categories are the bits of one number: no ref meets itself, and what is left are counts by skill and number.
    """
    places = F.array(*(F.lit(i) for i in range(MASKED)))
    has = lambda i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0
    # one row for each set of categories, written since each is read twice; an unknown ref counts in each category's size, but is never the same as another
    in_sessions = written(rows.groupBy("skill", "session").agg(F.bit_or("bit").alias("mask")).groupBy("skill", "mask").agg(F.count("*").alias("k")), "sessions")
    in_refs = written(rows.groupBy("skill", "ref").agg(F.bit_or("bit").alias("mask")).groupBy("skill", "mask", F.col("ref").isNotNull().alias("known")).agg(F.count("*").alias("k")), "refs")
    each = lambda df: df.withColumn("of", F.filter(places, has)).withColumn("category", F.explode("of"))
    sizes = each(in_sessions).groupBy("skill", "category").agg(F.sum("k").alias("n"))
    count = each(in_refs).groupBy("skill", "category").agg(F.sum("k").alias("size"))
    pairs = each(in_refs.filter("known")).withColumnRenamed("category", "x").withColumn("y", F.explode(F.filter("of", lambda y: y > F.col("x"))))
    return _split(sizes, count, pairs.groupBy("skill", "x", "y").agg(F.sum("k").alias("both")))


def _split(sizes: DataFrame, count: DataFrame, shared: DataFrame) -> DataFrame:
    """From sessions (n) and refs (size) by skill and category, and the refs (both) that two categories x < y share."""
    sized = sizes.join(count, ["skill", "category"], "left").select("skill", "category", F.coalesce("size", F.lit(0)).alias("size"))
    x, y = sized.select("skill", F.col("category").alias("x"), F.col("size").alias("sx")), sized.select("skill", F.col("category").alias("y"), F.col("size").alias("sy"))
    pairs = x.join(y, "skill").filter("x < y").join(shared, ["skill", "x", "y"], "left")
    both = F.coalesce("both", F.lit(0))
    union = F.col("sx") + F.col("sy") - both
    mean = pairs.groupBy("skill").agg(F.avg(F.when(union == 0, 1.0).otherwise(both / union)).alias("mean_jaccard"))
    gates = sizes.groupBy("skill").agg(F.count("*").alias("categories"), F.min("n").alias("least"), F.sum("n").alias("n"))
    reason = F.when(F.col("categories") < DEPGRAPH["min_categories"], "too-few-categories").when(F.col("least") < DEPGRAPH["min_sessions"], "too-few-sessions-per-category")
    status = F.when(reason.isNotNull(), "insufficient-data").when(F.col("mean_jaccard") < DEPGRAPH["jaccard"], "split-candidate").otherwise("no-split")
    return gates.join(mean, "skill", "left").select("skill", "categories", "n", F.when(reason.isNull(), F.col("mean_jaccard")).alias("mean_jaccard"), status.alias("status"), reason.alias("reason"))


def break_even(groups: DataFrame, p_trigger: str | None = None) -> DataFrame:
    """From (.., sum_desc, merged_desc): resident savings in tokens and the inflation that they allow."""
    saved = (F.col("sum_desc") - F.col("merged_desc")) / F.lit(float(DEPGRAPH["chars_per_token"]))
    out = groups.withColumn("resident_savings", saved)
    return out.withColumn("inflation_ceiling", F.when(F.col(p_trigger) > 0, saved / F.col(p_trigger)) if p_trigger else F.lit(None).cast("double"))


def session_events(observed: DataFrame, declared: DataFrame, tasks: int | None = None) -> DataFrame:
    """Triggers of sessions in order: observed ones by call, then a round's declared ones; first occurrences.

    observed: session, skill, round, ordinal; declared: session, skill, round.  (session, skill, rank, first_ordinal):
    first_ordinal is null for what was only declared, rank 1 is primary.  With `tasks` sessions are dealt once, to so many.
    """
    from pyspark.sql import Window as W

    o = observed.select("session", "skill", "round", F.lit(0).alias("phase"), "ordinal")
    d = declared.select("session", "skill", "round", F.lit(1).alias("phase"), F.lit(None).cast("long").alias("ordinal"))
    both = o.unionByName(d).filter("skill <> ''")
    first = (both.repartition(tasks, "session") if tasks else both).groupBy("session", "skill").agg(F.min(F.struct("round", "phase", "ordinal")).alias("at"), F.min("ordinal").alias("first_ordinal"))
    return first.select("session", "skill", F.row_number().over(W.partitionBy("session").orderBy("at", "skill")).alias("rank"), "first_ordinal")


def provenance_mix(sessions: DataFrame) -> DataFrame:
    """How many sessions were observed, reported by adapters, or say nothing of it: (harness, adapter, unknown)."""
    p = F.coalesce("provenance", F.lit(""))
    return sessions.agg(F.count_if(p == "harness-observed").alias("harness"), F.count_if(p == "adapter-reported").alias("adapter"), F.count_if(~p.isin("harness-observed", "adapter-reported")).alias("unknown"))


def report(sessions: DataFrame, triggers: DataFrame, reads: DataFrame, full: bool = False) -> dict[str, DataFrame]:
    """All graph results of a set of sessions (session, category, provenance); splits only for the full set."""
    n = sessions.select("session").distinct().count()
    nodes, edges = co_trigger_graph(triggers, n)
    out = {"provenance": provenance_mix(sessions), "read_rates": read_rates(triggers, reads), "co_read": co_read_pairs(reads, n), "nodes": nodes, "edges": edges, "merge": merge_groups(nodes, edges)}
    if full:
        named = triggers.join(sessions.select("session", "category"), "session")
        out["split"] = jaccard_split(named.select("skill", "session", "category"), reads.select("skill", "session", "ref"))
    return out


def heat_map(co_read: DataFrame) -> DataFrame:
    """Both halves of the symmetric matrix of co-read rates: (x, y, rate)."""
    return co_read.select(F.col("a").alias("x"), F.col("b").alias("y"), "rate").unionByName(co_read.select(F.col("b").alias("x"), F.col("a").alias("y"), "rate"))
