"""Commands: `python -m tracemill.cli ingest|skill|search|export|prune|watch|stats|compare|report|lint|adapter-check|preflight ...`.

Most take a folder of logs.  `compare`, `report` and `preflight` take two files or folders of repeats as JSON lines, the old arm and
the new one; `lint` takes a suite file, `adapter-check` adapter outputs, one a line.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import VERDICT


def tables(spark: SparkSession, path: str):
    from tracemill.sources import logs

    return logs.parse(logs.read_lines(spark, path))


def ingest(spark: SparkSession, path: str, out: str | None = None, store: str | None = None) -> DataFrame:
    """Runs with their metrics; written by run below `out`, or kept in a keyed store, replacing what was there of the same runs.

    A folder for each run suits few runs; a store keeps them in hash buckets.
    """
    from tracemill.operators import metrics
    from tracemill.sources import logs
    from tracemill.store import KeyedStore

    p = tables(spark, path)
    m = p.runs.drop("agent_id").join(metrics.run_metrics(logs.run_rounds(p), p.runs), "run_id")
    if out:
        m.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(out)
    if store:
        KeyedStore(spark, store, m.schema, ["run_id"]).replace(m)
    return m


def skill(spark: SparkSession, path: str) -> DataFrame:
    from tracemill.operators import metrics
    from tracemill.sources import logs

    s = metrics.skill_metrics(logs.run_rounds(tables(spark, path)))
    return s.groupBy("skill").agg(F.count_distinct("run_id").alias("runs"), F.sum("rounds").alias("rounds"), F.sum("tokens_out").alias("tokens_out"), F.sum("tool_errors").alias("tool_errors")).orderBy("skill")


def search(spark: SparkSession, path: str, text: str) -> DataFrame:
    from tracemill.operators import trend
    from tracemill.sources import logs

    return trend.search(logs.read_lines(spark, path), "raw", "source", text).select("source", "line_no", "snippet")


def export(spark: SparkSession, path: str, out: str) -> None:
    from tracemill.sources import otel

    p = tables(spark, path)
    runs = p.runs.select("run_id", "model", F.unix_millis("started_at").alias("start_ms"), F.unix_millis("ended_at").alias("end_ms"))
    rounds = p.rounds.select("run_id", "agent_id", "seq", F.unix_millis(F.try_to_timestamp("ts")).alias("start_ms"), "duration_ms", "model", F.col("usage.in").alias("u_in"), F.col("usage.out").alias("u_out"), "stop_reason")
    otel.write_otlp(otel.run_spans(runs, rounds, p.tool_calls), out)


def prune(spark: SparkSession, path: str, now_ms: int, older_than: str | None, most: int | None) -> DataFrame:
    from tracemill.functions.num import parse_duration
    from tracemill.operators import trend

    ms = spark.range(1).select(parse_duration(F.lit(older_than)).alias("ms")).first().ms if older_than else None
    runs = tables(spark, path).runs.select(F.col("run_id").alias("id"), F.unix_millis("started_at").alias("ts_ms"))
    return trend.prune(runs, [], now_ms, ms, most)


def watch(spark: SparkSession, path: str, out: str, once: bool = False):
    """Follow growing logs: all tables of their runs, with rounds, calls and metrics, below `out`, one state a run."""
    from tracemill.streaming import tail

    return tail.watch(spark, path, tail.RunTables(spark, f"{out}/tables").keep, f"{out}/checkpoint", once=once)


def stats(spark: SparkSession, path: str, out: str | None = None) -> dict[str, DataFrame]:
    """Sections of statistics of all runs below a folder; written as JSON below `out`, replacing what was there."""
    from tracemill.operators import report
    from tracemill.sources import files, logs

    p = tables(spark, path)
    found = report.stats(logs.run_rounds(p), p.tool_calls, p.self_reports, p.runs)
    for name, df in found.items() if out else ():
        files.write_sidecar(df, f"{out}/{name}")
    return found


def adapter_check(spark: SparkSession, path: str) -> DataFrame:
    """What adapter outputs (one JSON document a line) lack or misspell: (check, subject, detail)."""
    from tracemill.operators import lint

    raw = spark.read.text(path).filter("trim(value) <> ''").withColumnRenamed("value", "raw")
    found = lint.adapter_channels(raw)
    total = found.agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("ok", *lint.CHANNELS)))
    counts = total.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("subject"), F.col(c).alias("seen")) for c in ("ok", *lint.CHANNELS)))).alias("x"))
    rows = counts.select(F.when(F.col("x.subject") == "ok", "output").otherwise("channel").alias("check"), F.col("x.subject").alias("subject"), F.concat_ws(" of ", F.col("x.seen").cast("string"), F.col("n").cast("string")).alias("detail"))
    near = lint.near_misses(lint.adapter_keys(raw).filter("level = 'top'"), ["result", "trace", *lint.CHANNELS[3:]])
    return rows.unionByName(near.select(F.lit("near-miss").alias("check"), F.col("key").alias("subject"), F.col("meant").alias("detail")))


def preflight(spark: SparkSession, old: str, new: str) -> DataFrame:
    """What stands in the way of comparing two arms' repeats (JSON lines with the columns of `ARM`): (check, subject, detail)."""
    from tracemill.operators import compare

    arms = [spark.read.schema(ARM).json(p) for p in (old, new)]
    pairs = compare.paired(*(compare.experiment_arm(a) for a in arms))
    few = pairs.agg(F.count("*").alias("n")).filter(F.col("n") < VERDICT["min_pairs"]).select(F.lit("pairs").alias("check"), F.lit("cases in both arms").alias("subject"), F.col("n").cast("string").alias("detail"))
    alone = compare.only_in(*(a.select("case_id").distinct() for a in arms))
    return few.unionByName(alone.select(F.lit("only in one arm").alias("check"), F.col("case_id").cast("string").alias("subject"), F.col("side").alias("detail")))


ARM = "case_id string, held_out boolean, excluded boolean, C int, l1_pass boolean, l3_pass boolean, flow_status string, u_in long, u_out long, u_cache_r long, u_cache_w long"


def comparison(spark: SparkSession, old: str, new: str, intent: str) -> DataFrame:
    """One row that compares two arms' repeats (JSON lines with the columns of `ARM`)."""
    from tracemill.operators import compare, report

    arms = [compare.experiment_arm(spark.read.schema(ARM).json(p)) for p in (old, new)]
    return report.comparison(*arms, intent)


def lint(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a suite file (commented JSON with `cases`)."""
    from tracemill.operators import report
    from tracemill.sources import files

    suite = files.parse_jsonc(spark.read.text(path, wholetext=True).first().value)
    cases = [c for c in suite.get("cases", []) if isinstance(c, dict)]
    many = lambda v: [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) and x]
    rows = [(str(c.get("id")), c.get("superseded_by"), many(c.get("expected_skill")), many(c.get("allowed_auxiliary")), many(c.get("multi_intent")), c.get("tier")) for c in cases]
    df = spark.createDataFrame(rows, "id string, superseded_by string, expected array<string>, allowed array<string>, multi_intent array<string>, tier string")
    broken = [("case", str(c.get("id")), p) for c in cases for p in files.case_problems(c)]
    return report.findings(df).unionByName(spark.createDataFrame(broken, "check string, subject string, detail string"))


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    sub = a.add_subparsers(dest="verb", required=True)
    for verb in ("ingest", "skill", "search", "export", "prune", "watch", "stats", "compare", "report", "lint", "adapter-check", "preflight"):
        p = sub.add_parser(verb)
        p.add_argument("path")
        if verb in ("ingest", "export", "watch", "stats", "report"):
            p.add_argument("--out", required=verb not in ("ingest", "stats"))
        if verb in ("compare", "report", "preflight"):
            p.add_argument("new")
        if verb in ("compare", "report"):
            p.add_argument("--intent", choices=("cost-opt", "quality-fix", "neutral-refactor"), required=True)
        if verb == "search":
            p.add_argument("text")
        if verb == "ingest":
            p.add_argument("--store")
        if verb == "watch":
            p.add_argument("--once", action="store_true")
        if verb == "prune":
            p.add_argument("--older-than")
            p.add_argument("--max", type=int)
            p.add_argument("--now-ms", type=int, required=True)
    o = a.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.verb == "ingest":
        ingest(spark, o.path, o.out, o.store).show(truncate=False)
    elif o.verb == "skill":
        skill(spark, o.path).show(1000, truncate=False)
    elif o.verb == "search":
        search(spark, o.path, o.text).show(50, truncate=False)
    elif o.verb == "export":
        export(spark, o.path, o.out)
    elif o.verb == "prune":
        prune(spark, o.path, o.now_ms, o.older_than, o.max).show(1000, truncate=False)
    elif o.verb == "stats":
        for name, df in stats(spark, o.path, o.out).items():
            print(name)
            df.show(50, truncate=False)
    elif o.verb == "compare":
        comparison(spark, o.path, o.new, o.intent).select("line", "causes").show(truncate=False)
    elif o.verb == "report":
        from tracemill.operators import report
        from tracemill.sources import files

        files.write_report(report.document(comparison(spark, o.path, o.new, o.intent)), o.out)
    elif o.verb == "adapter-check":
        adapter_check(spark, o.path).show(1000, truncate=False)
    elif o.verb == "preflight":
        preflight(spark, o.path, o.new).show(1000, truncate=False)
    elif o.verb == "lint":
        lint(spark, o.path).orderBy("check", "subject").show(1000, truncate=False)
    else:
        watch(spark, o.path, o.out, o.once).awaitTermination()


if __name__ == "__main__":
    main()
