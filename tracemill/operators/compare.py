"""Old arm against new arm: pairing, layers, coverage and runtime differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.num import js_round, ratio

LAYERS = ("l1", "l2", "l3")


def experiment_arm(reps: DataFrame, has_skills: bool = True) -> DataFrame:
    """Repeats as arm rows: held-out cases go, routing is unknown without skills, results of excluded repeats are unknown."""
    own = reps.filter(~F.coalesce("held_out", F.lit(False)))
    excluded = F.coalesce("excluded", F.lit(False))
    return own.withColumn("l1_pass", F.col("l1_pass") if has_skills else F.lit(None).cast("boolean")).withColumn("l2_pass", F.when(~excluded, F.coalesce(F.col("C") == 1, F.lit(False)))).withColumn("excluded", excluded).withColumn("flow_status", F.coalesce("flow_status", F.lit("complete")))


def layer_label(passed: str) -> Column:
    """pass if at least half of the known values pass; null if none is known."""
    known = F.count(passed)
    return F.when(known > 0, F.when(2 * F.count_if(passed) >= known, "pass").otherwise("fail"))


def case_rates(arm: DataFrame) -> DataFrame:
    """Per case: pass rates over non-excluded repeats, and whether all repeats are excluded."""
    valid = ~F.col("excluded")
    rate = lambda c: ratio(F.count_if(valid & F.col(c)), F.count(F.when(valid, F.col(c))))
    return arm.groupBy("case_id").agg(*(rate(f"{a}_pass").alias(f"{a}_rate") for a in LAYERS), (~F.bool_or(valid)).alias("all_excluded"))


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Case by case over the intersection of ids: differences new minus old in percentage points, null unless both are known."""
    a, b = case_rates(old), case_rates(new)
    for x in ("l1_rate", "l2_rate", "l3_rate", "all_excluded"):
        a, b = a.withColumnRenamed(x, f"old_{x}"), b.withColumnRenamed(x, f"new_{x}")
    both = a.join(b, "case_id")
    deltas = [((F.col(f"new_{x}_rate") - F.col(f"old_{x}_rate")) * 100).alias(f"{x}_delta") for x in LAYERS]
    worse = [F.coalesce(F.col(f"new_{x}_rate") < F.col(f"old_{x}_rate"), F.lit(False)) for x in LAYERS]
    return both.select("case_id", *deltas, (F.col("old_all_excluded") | F.col("new_all_excluded")).alias("excluded"), (worse[0] | worse[1] | worse[2]).alias("regressed"))


def exclusion_pct(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.count_if("excluded").alias("excluded_cases"), js_round(100 * ratio(F.count_if("excluded"), F.count("*"))).alias("exclusion_pct"))


def read_set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(case_id, added, removed) references between arms.  old, new: case_id, refs (array)."""
    both = old.select("case_id", F.col("refs").alias("_o")).join(new.select("case_id", F.col("refs").alias("_n")), "case_id")
    return both.select("case_id", F.array_sort(F.array_except("_n", "_o")).alias("added"), F.array_sort(F.array_except("_o", "_n")).alias("removed"))


def coverage_delta(old: DataFrame, new: DataFrame, low: int = 5) -> DataFrame:
    """Per skill: change of the pooled trigger rate over the cases that both arms have; null below `low` attempts a side.

    old, new: skill, case_id, triggered, attempted.
    """
    o = old.select("skill", "case_id", F.col("triggered").alias("_to"), F.col("attempted").alias("_ao"))
    n = new.select("skill", "case_id", F.col("triggered").alias("_tn"), F.col("attempted").alias("_an"))
    g = o.join(n, ["skill", "case_id"]).groupBy("skill").agg(F.count("*").alias("cases"), *(F.sum(c).alias(c) for c in ("_to", "_ao", "_tn", "_an")))
    enough = (F.col("_ao") >= low) & (F.col("_an") >= low)
    return g.select("skill", "cases", F.when(enough, js_round(100 * (ratio(F.col("_tn"), F.col("_an")) - ratio(F.col("_to"), F.col("_ao"))))).alias("delta_pp"), (~enough).alias("low_sample"))


def only_in(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cases of one arm alone: (case_id, side)."""
    o, n = old.select("case_id").distinct(), new.select("case_id").distinct()
    return o.join(n, "case_id", "left_anti").withColumn("side", F.lit("old")).unionByName(n.join(o, "case_id", "left_anti").withColumn("side", F.lit("new")))


def runtime_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and changed settings between arms: (key, change, old_value, new_value)."""
    both = old.select("key", F.col("value").alias("old_value")).join(new.select("key", F.col("value").alias("new_value")), "key", "full_outer")
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("key", change.alias("change"), "old_value", "new_value")


def opportunities(groups: DataFrame, meta: DataFrame) -> DataFrame:
    """Tokens that a group of references would save, known only if every member's size is.  groups: group_id, ref; meta: ref, tokens."""
    g = groups.join(meta, "ref", "left").groupBy("group_id").agg(F.count("*").alias("members"), F.count("tokens").alias("_k"), F.sum("tokens").alias("_t"))
    return g.select("group_id", "members", F.when(F.col("_k") == F.col("members"), F.col("_t")).alias("tokens"))


def mixed_arm(old: DataFrame, new: DataFrame, choice: dict[str, str], default: str = "old") -> DataFrame:
    """An arm that takes each skill's rows from the arm named for it."""
    side = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in choice.items() for x in kv)), F.col("skill")), F.lit(default)) if choice else F.lit(default)
    return old.filter(side == "old").unionByName(new.filter(side == "new"))


def budget_spent(reps: DataFrame, by: list[str]) -> DataFrame:
    """Sessions, hours and cost that an experiment took; hours and cost are null if nobody reported any."""
    ms = F.sum(F.coalesce("duration_ms", "wall_ms", F.lit(0)))
    return reps.groupBy(*by).agg(F.count("*").alias("sessions"), F.when(ms > 0, js_round(ms / 3.6e6)).alias("hours"), js_round(F.sum(F.coalesce("cost_usd", "cost_usd_reported"))).alias("usd"))


def probe_hits(excluded: DataFrame, exclusion_pct: float | None, tripwire: float = 12.0) -> DataFrame:
    """Commands of excluded runs by arm, and whether exclusions trip the wire.  excluded: arm, tool, cmd."""
    g = excluded.groupBy("arm", "tool").agg(F.sort_array(F.collect_set("cmd")).alias("cmds"))
    return g.withColumn("tripwired", F.lit(exclusion_pct is not None and exclusion_pct > tripwire))


def version_quads(arms: DataFrame) -> DataFrame:
    """What was compared: (arm, cli_version, model, harness_version, isolation_verified, skills as name and digest).

    arms: those columns and one row per skill (name, sha256); missing parts stay null.
    """
    head = ["arm", "cli_version", "model", "harness_version", "isolation_verified"]
    return arms.groupBy(*head).agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "sha256")))).alias("skills"))


def arms_isolated(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Skills that an arm had and should not have had; empty if isolated.  Rows: arm, name."""
    return actual.select("arm", "name").distinct().join(expected.select("arm", "name"), ["arm", "name"], "left_anti")


def build_repeats(runs: DataFrame, results: DataFrame, routing: DataFrame, safety: DataFrame) -> DataFrame:
    """Repeats assembled from their parts by rep_id: outcome, scores, routing, safety and the verdict on all axes.

    runs: rep_id and the columns of `scoring.score_repeat`; results: rep_id, cls, passed; routing: rep_id, routing;
    safety: rep_id, verdict.  A repeat without verifiers has outcome 0; unknown axes stay null.
    """
    from tracemill.operators.grading import case_verdict
    from tracemill.operators.scoring import gate, score_repeat

    out = score_repeat(runs).join(gate(results, ["rep_id"]), "rep_id", "left").join(routing.select("rep_id", "routing"), "rep_id", "left").join(safety.select("rep_id", F.col("verdict").alias("safety")), "rep_id", "left")
    out = out.withColumn("C", F.coalesce("C", F.lit(0)))
    l1, l2, l3, passed = case_verdict(F.col("routing"), F.col("C") == 1, F.col("safety"))
    return out.select("rep_id", "C", "P", "H", "activated", "tool_err_rate", "hit_max_turns", "routing", "safety", l1.alias("l1_pass"), l2.alias("l2_pass"), l3.alias("l3_pass"), passed.alias("passed"))


def probe_blocks(sessions: DataFrame, triggers: DataFrame, commands: DataFrame, events: DataFrame, declared: DataFrame, arms: tuple[str, ...] = ("old", "new")) -> dict[str, DataFrame]:
    """What probes say of each arm: coverage, skill_commands, sequences, proximity, paired (one row), excluded_hits.

    sessions: arm, case_id, session, excluded; triggers: session, skill; commands: session, tool, cmd, ordinal;
    events: session, type, id, ordinal; declared: tool, cmd.  Excluded sessions count nowhere; a case is excluded if any
    of its sessions is.  Arms are few: one plan branch each.
    """
    from functools import reduce

    from tracemill.config import VERDICT
    from tracemill.operators import coverage, proximity

    excluded = F.coalesce("excluded", F.lit(False))
    valid = sessions.filter(~excluded).select("arm", "case_id", "session")
    tools = declared.select("tool").distinct()

    def per_arm(of) -> DataFrame:
        parts = []
        for arm in arms:
            own = valid.filter(F.col("arm") == arm).select("session", "case_id")
            parts.append(of(own).select(F.lit(arm).alias("arm"), "*"))
        return reduce(DataFrame.unionByName, parts)

    def sequences(own: DataFrame) -> DataFrame:
        c = commands.join(own, "session").join(tools, "tool", "left_semi")
        return proximity.ngrams(c.select(F.concat_ws("|", "session", "tool").alias("run_id"), "case_id", "cmd", F.col("ordinal").alias("ord")))

    cases = sessions.groupBy("case_id").agg(F.bool_or(excluded).alias("_x"))
    pct = js_round(100 * F.coalesce(ratio(F.count_if("_x"), F.count("*")), F.lit(0.0)), 4)
    hits = sessions.filter(excluded).select("arm", "case_id", "session").join(commands, "session")
    return {
        "coverage": per_arm(lambda own: coverage.command_coverage(declared, commands.join(own, "session", "left_semi").join(tools, "tool", "left_semi"))),
        "skill_commands": per_arm(lambda own: coverage.skill_commands(triggers.join(own, "session", "left_semi").withColumnRenamed("session", "run_id"), commands.join(own, "session", "left_semi").withColumnRenamed("session", "run_id"))),
        "sequences": per_arm(sequences),
        "proximity": per_arm(lambda own: proximity.matrix(events.join(own, "session").select(F.col("session").alias("run_id"), "case_id", "type", "id", "ordinal", F.col("ordinal").alias("pos")))),
        "paired": cases.agg(F.count("*").alias("cases"), pct.alias("exclusion_pct")).withColumn("tripwired", F.col("exclusion_pct") > VERDICT["tripwire_pct"]),
        "excluded_hits": hits.groupBy("arm", "case_id", "session", "tool").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "cmd"))), lambda x: x["cmd"]).alias("cmds")).select("arm", "case_id", "tool", "cmds"),
    }


def probe_deltas(coverage: DataFrame, tripwired: bool = False, old: str = "old", new: str = "new") -> DataFrame:
    """Change of command coverage by tool, new minus old: (tool, comparable, reason, ratio_delta, status).

    coverage: arm, tool, declared, ratio.  Tools whose declared commands differ in number are not compared.
    """
    side = lambda arm, x: coverage.filter(F.col("arm") == arm).select("tool", F.col("declared").alias(f"d{x}"), F.col("ratio").alias(f"r{x}"))
    both = side(old, "o").join(side(new, "n"), "tool", "full_outer")
    missing, same = F.col("do").isNull() | F.col("dn").isNull(), F.col("do") == F.col("dn")
    reason = F.when(missing, "one-arm-only").when(~same, "command-surface-differs")
    return both.select("tool", reason.isNull().alias("comparable"), reason.alias("reason"), F.when(reason.isNull(), js_round(F.col("rn") - F.col("ro"), 4)).alias("ratio_delta"), F.lit("inconclusive" if tripwired else "ok").alias("status"))


def budget(reps: DataFrame) -> DataFrame:
    """One row: what both arms took, beside an estimate that nobody made and that is therefore null."""
    spent = budget_spent(reps.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    return spent.select(*(F.lit(None).cast("double").alias(f"est_{c}") for c in ("sessions", "hours", "usd")), *(F.col(c).alias(f"actual_{c}") for c in ("sessions", "hours", "usd")))


def assert_frozen() -> None:
    """The constants of comparison can't be changed by whoever aggregates."""
    from types import MappingProxyType

    from tracemill import config

    loose = [n for n in ("VERDICT", "TOKEN_WEIGHTS", "WEIGHTS", "DEPGRAPH", "PROBES", "PROXIMITY") if not isinstance(getattr(config, n), MappingProxyType)]
    if loose:
        raise RuntimeError(f"{loose[0]} is not frozen; nothing is aggregated")


def verdict_footer(reports: DataFrame) -> DataFrame:
    """Adds `footer` to reports (id, tests): the constants that were in force, and which corrections were made, as JSON."""
    from tracemill.config import TOKEN_WEIGHTS, VERDICT

    assert_frozen()
    v = F.struct(*(F.lit(x).alias(k) for k, x in VERDICT.items()), F.struct(*(F.lit(x).alias(k) for k, x in TOKEN_WEIGHTS.items())).alias("token_weights"))
    tests = F.struct(F.col("tests").alias("count"), F.lit("none").alias("global_correction"), F.lit("benjamini-hochberg").alias("per_skill_correction"))
    return reports.withColumn("footer", F.to_json(F.struct(v.alias("config"), tests.alias("tests"))))


def check_arms(a: dict, b: dict) -> None:
    """Two arms that resumed one journal, or are one build, are not compared.  a, b: resume_key, identity; unknown ones pass."""
    for field, what in (("resume_key", "resume the same journal"), ("identity", "are the same build")):
        if a.get(field) is not None and a.get(field) == b.get(field):
            raise ValueError(f"the arms {what}: {a[field]}")


def arm_identity(arms: DataFrame) -> DataFrame:
    """(arm, identity): digest over an arm's label, tool version and its skills' digests, in order of name; null without any of them.

    arms: arm, label, cli_version and one row for each skill (name, sha256).
    """
    skills = F.array_join(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.concat_ws("=", "name", "sha256")))), ",")
    g = arms.groupBy("arm", "label", "cli_version").agg(skills.alias("_s"))
    known = F.col("label").isNotNull() | F.col("cli_version").isNotNull() | (F.col("_s") != "")
    return g.select("arm", F.when(known, F.sha2(F.concat_ws("|", F.coalesce("label", F.lit("")), F.coalesce("cli_version", F.lit("")), "_s"), 256)).alias("identity"))
