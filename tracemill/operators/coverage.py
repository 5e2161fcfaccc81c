"""Coverage of skills, references and commands over cases.

Probabilities count distinct cases.  Held-out cases leave first, then excluded repeats; what is left is valid, has no
session, or names a run that is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.config import PROBES


def resolve_reps(reps: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds `bucket` to reps (task_id, repeat, run_ids as comma-joined text, held_out, excluded), given known runs (run_id)."""
    ids = F.filter(F.transform(F.split("run_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = reps.withColumn("_ids", ids)
    wanted = rows.select("task_id", "repeat", F.explode("_ids").alias("run_id"))
    missing = wanted.join(runs.select("run_id").distinct(), "run_id", "left_anti").select("task_id", "repeat").distinct().withColumn("_missing", F.lit(True))
    bucket = (
        F.when(F.coalesce("held_out", F.lit(False)), "heldOutExcluded").when(F.coalesce("excluded", F.lit(False)), "excluded")
        .when(F.col("run_ids").isNull(), "noSession").when(F.col("_missing"), "unresolved").otherwise("valid")
    )
    return rows.join(missing, ["task_id", "repeat"], "left").withColumn("bucket", bucket).drop("_ids", "_missing")


def bucket_counts(resolved: DataFrame, by: list[str]) -> DataFrame:
    names = {"n_coverage_valid": "valid", "n_excluded": "excluded", "held_out_excluded": "heldOutExcluded", "no_session": "noSession", "n_unresolved": "unresolved"}
    return resolved.groupBy(*by).agg(F.count("*").alias("n_raw"), *(F.count_if(F.col("bucket") == b).alias(n) for n, b in names.items()))


def ever_triggered(triggers: DataFrame) -> DataFrame:
    """From (case_id, skill, is_primary): distinct cases, cases as primary, and the rest as auxiliary."""
    out = triggers.groupBy("skill").agg(F.count_distinct("case_id").alias("cases"), F.count_distinct(F.when(F.col("is_primary"), F.col("case_id"))).alias("primary_cases"))
    return out.withColumn("auxiliary", F.col("cases") - F.col("primary_cases"))


def trigger_rate(tasks: DataFrame) -> DataFrame:
    """From tasks (expected_skill, triggered, attempted)."""
    return tasks.filter("expected_skill is not null").groupBy(F.col("expected_skill").alias("skill")).agg(F.sum("triggered").alias("triggered"), F.sum("attempted").alias("attempted"))


def untriggered(installed: DataFrame, triggers: DataFrame, tasks: DataFrame) -> DataFrame:
    """Installed skills that never triggered: neverTriggered if a task targets them, else notExercised."""
    rest = installed.select("skill").distinct().join(triggers.select("skill").distinct(), "skill", "left_anti")
    targets = tasks.select(F.col("expected_skill").alias("skill")).distinct().withColumn("_t", F.lit(True))
    return rest.join(targets, "skill", "left").select("skill", F.when(F.col("_t"), "neverTriggered").otherwise("notExercised").alias("status"))


def case_join(tasks: DataFrame, triggers: DataFrame) -> DataFrame:
    """Per case with a target: attempted, triggered, and what fired instead.

    fired_instead: null while the target triggered or nothing is known of the case; else the sorted other skills.
    """
    fired = triggers.groupBy("case_id").agg(F.collect_set("skill").alias("_all"))
    out = tasks.filter("expected_skill is not null").join(fired, "case_id", "left")
    other = F.sort_array(F.array_remove("_all", F.col("expected_skill")))
    return out.select("case_id", F.col("expected_skill").alias("skill"), F.coalesce("attempted", F.lit(0)).alias("attempted"), F.coalesce("triggered", F.lit(0)).alias("triggered"), F.when(F.coalesce("triggered", F.lit(0)) == 0, other).alias("fired_instead"), (F.coalesce("triggered", F.lit(0)) == 0).alias("missed"))


def ref_coverage(inventory: DataFrame, reads: DataFrame, triggers: DataFrame, artifact_reads: DataFrame, excluded_reads: DataFrame) -> DataFrame:
    """Per shipped reference: reads by runs and cases, co-triggered cases, blocked, exemption and unread flags.

    inventory (skill, ref, bytes), reads (run_id, case_id, ref) over valid runs, triggers (case_id, skill).
    """
    counts = reads.groupBy("ref").agg(F.count_distinct("run_id").alias("reads_runs"), F.count_distinct("case_id").alias("reads_cases"))
    both = triggers.select("case_id", "skill").distinct().join(reads.select("case_id", "ref").distinct(), "case_id").groupBy("skill", "ref").agg(F.count("*").alias("cases_co_triggered"))
    artifact = artifact_reads.select("ref").distinct().withColumn("_a", F.lit(True))
    excluded = excluded_reads.select("ref").distinct().withColumn("_e", F.lit(True))
    used = triggers.select("skill").distinct().withColumn("_x", F.lit(True))
    out = inventory.join(counts, "ref", "left").join(both, ["skill", "ref"], "left").join(artifact, "ref", "left").join(excluded, "ref", "left").join(used, "skill", "left")
    read = F.col("reads_runs").isNotNull()
    shared = F.col("ref").rlike("(^|/)_shared/")
    return out.select(
        "skill", "ref", F.when(~shared, F.col("bytes")).alias("bytes"), F.when(shared, "shared-hash-namespace").alias("reason"),
        F.coalesce("reads_runs", F.lit(0)).alias("reads_runs"), F.coalesce("reads_cases", F.lit(0)).alias("reads_cases"), F.coalesce("cases_co_triggered", F.lit(0)).alias("cases_co_triggered"),
        (~read & F.col("_a").isNotNull()).alias("blocked"), (~read & F.col("_a").isNull() & F.col("_e").isNotNull()).alias("excluded_only"),
        F.col("_x").isNull().alias("not_exercised"), (F.col("_x").isNotNull() & ~read & F.col("_a").isNull() & F.col("_e").isNull()).alias("unread"),
    )


def skill_refs(coverage: DataFrame) -> DataFrame:
    """`ref_coverage` rolled up by skill: shipped, read, unread references."""
    return coverage.groupBy("skill").agg(F.count("*").alias("shipped"), F.count_if(F.col("reads_runs") > 0).alias("read"), F.count_if("unread").alias("unread"), F.bool_and("not_exercised").alias("not_exercised"))


def exemptions(reads: DataFrame, artifact_reads: DataFrame, excluded_reads: DataFrame) -> DataFrame:
    """References seen only through blocked or only through excluded runs."""
    valid, artifact = reads.select("ref").distinct(), artifact_reads.select("ref").distinct()
    a = artifact.join(valid, "ref", "left_anti").withColumn("kind", F.lit("artifactOnly"))
    e = excluded_reads.select("ref").distinct().join(valid, "ref", "left_anti").join(artifact, "ref", "left_anti").withColumn("kind", F.lit("excludedOnly"))
    return a.unionByName(e)


def infer_refs(reads: DataFrame) -> DataFrame:
    """Without an inventory: references by the skill that their path names."""
    own = reads.select("ref").distinct().withColumn("skill", F.regexp_extract("ref", "^([^/]+)/references/", 1)).filter("skill <> ''")
    return own.groupBy("skill").agg(F.count("*").alias("read"), F.sort_array(F.collect_list("ref")).alias("refs"))


def command_coverage(declared: DataFrame, invoked: DataFrame) -> DataFrame:
    """Per tool: how much of its declared command surface was used, what was not, and what is not declared."""
    d = declared.select("tool", "cmd").distinct().withColumn("_d", F.lit(1))
    i = invoked.select("tool", "cmd").distinct().withColumn("_i", F.lit(1))
    both = d.join(i, ["tool", "cmd"], "full_outer").groupBy("tool").agg(
        F.count("_d").alias("declared"), F.count("_i").alias("invoked"), F.count_if(F.col("_d").isNotNull() & F.col("_i").isNotNull()).alias("covered"),
        F.sort_array(F.collect_list(F.when(F.col("_i").isNull(), F.col("cmd")))).alias("unused"), F.sort_array(F.collect_list(F.when(F.col("_d").isNull(), F.col("cmd")))).alias("undeclared"),
    )
    ratio = F.when(F.col("declared") > 0, F.least(F.lit(1.0), F.col("covered") / F.col("declared")))
    status = F.when(F.col("declared") == 0, "unavailable").when(F.col("invoked") == 0, "suspect").otherwise("available")
    return both.withColumn("ratio", ratio).withColumn("status", status)


def skill_commands(triggers: DataFrame, commands: DataFrame) -> DataFrame:
    """Per skill and command: runs in which both appear, of all runs of the skill."""
    t = triggers.select("run_id", "skill").distinct()
    runs = t.groupBy("skill").agg(F.count("*").alias("skill_runs"))
    pairs = t.join(commands.select("run_id", "cmd").distinct(), "run_id").groupBy("skill", "cmd").agg(F.count("*").alias("runs"))
    return pairs.join(runs, "skill").withColumn("status", F.when(F.col("skill_runs") < PROBES["min_runs"], "insufficient-data").otherwise("ok"))


def blocked_refs(reads: DataFrame, declared: DataFrame) -> DataFrame:
    """References that some read was denied, observed (outcome) or declared (status): (ref)."""
    seen = reads.filter(F.col("outcome") == "permission-artifact").select("ref")
    return seen.union(declared.filter(F.col("status") == "blocked").select("ref")).filter("ref is not null").distinct()


def excluded_hits(triggers: DataFrame, reps: DataFrame) -> DataFrame:
    """Skills that excluded runs triggered: a tripwire for exclusions that hide something.  (skill, runs)."""
    out = reps.filter("excluded").select("run_id").distinct()
    return triggers.join(out, "run_id", "left_semi").groupBy("skill").agg(F.count_distinct("run_id").alias("runs"))


def provenance(runs: DataFrame) -> DataFrame:
    """Runs by where their facts come from; an unknown source is its own class."""
    kind = F.when(F.col("source") == "adapter-trace", "adapter-reported").when(F.col("source").isNull(), "unknown").otherwise("harness-observed")
    return runs.groupBy(kind.alias("provenance")).agg(F.count_distinct("run_id").alias("runs"))


def axes_omitted(experiments: DataFrame) -> DataFrame:
    """Adds `omitted`: sections that an experiment can't have.  has_inventory, n_probes, n_valid."""
    return experiments.withColumn("omitted", F.array_compact(F.array(F.when(~F.col("has_inventory"), F.lit("refCoverage")), F.when(F.col("n_probes") == 0, F.lit("cli")), F.when(F.col("n_valid") == 0, F.lit("proximity")))))


def inventory_status(experiments: DataFrame) -> DataFrame:
    """Adds what the reference inventory of an experiment rests on, and why a section is null.  runtime, snapshot, declared, backfill."""
    status = F.when(F.col("snapshot"), "snapshot").when(F.col("declared"), "adapter-declared").when(F.col("runtime") != "claude-code", "external-runtime").when(F.col("backfill"), "none-backfill").otherwise("unknown")
    out = experiments.withColumn("status", status)
    return out.withColumn("reason", F.when(F.col("status") == "external-runtime", "external-runtime-self-managed").when(F.col("status") == "none-backfill", "no-inventory-snapshot").when(F.col("status") == "unknown", "unknown-inventory-status"))


def declared_inventory(experiments: DataFrame) -> DataFrame:
    """References that adapters declared: (id, skill, version_sha, refs sorted).  experiments: id, inventory (JSON text or null).

    What isn't an object declares nothing; digests and references that aren't text are dropped.
    """
    entries = F.from_json("inventory", "map<string,variant>")
    rows = experiments.select("id", F.explode(entries).alias("skill", "entry"))
    text = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    refs = F.filter(F.transform(F.coalesce(F.try_variant_get("entry", "$.refs", "array<variant>"), F.array().cast("array<variant>")), lambda r: F.when(F.schema_of_variant(r) == "STRING", F.try_variant_get(r, "$", "string"))), lambda r: r.isNotNull())
    return rows.select("id", "skill", text(F.col("entry"), "$.versionSha").alias("version_sha"), F.array_sort(refs).alias("refs"))


def backfill_inventory(experiments: DataFrame) -> DataFrame:
    """What statistics that are made afterwards can rest on: (id, status, skills).  experiments: id, runtime, inventory.

    A declared inventory first; other runtimes manage their own skills, so nothing is known; else references are inferred from reads.
    """
    declared = declared_inventory(experiments).groupBy("id").agg(F.count("*").alias("skills"))
    status = F.when(F.col("skills").isNotNull(), "adapter-declared").when(~F.col("runtime").eqNullSafe(F.lit("claude-code")), "external-runtime").otherwise("none-backfill")
    return experiments.select("id", "runtime").join(declared, "id", "left").select("id", status.alias("status"), F.coalesce("skills", F.lit(0)).alias("skills"))
