"""Configuration and small files: commented JSON, probes, cases, inventories, digests, journals, write-once sinks.

Configuration is read on the driver (it is a few files); inventories and digests of directories are DataFrames over
Spark's binary source.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.num import tokens_est_cjk

_JSONC = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)


def parse_jsonc(text: str):
    """JSON with line and block comments; strings are left alone."""
    return json.loads(_JSONC.sub(lambda m: m.group(1) or "", text))


def load_suite(text: str) -> dict:
    """Strict JSON first, comments only if that fails; cases are checked."""
    try:
        suite = json.loads(text)
    except ValueError:
        suite = parse_jsonc(text)
    if isinstance(suite, dict) and isinstance(suite.get("cases"), list):
        problems = [p for c in suite["cases"] for p in case_problems(c)]
        ids = [c.get("id") for c in suite["cases"] if isinstance(c, dict)]
        problems += [f"case {i}: duplicate id" for i in dict.fromkeys(ids) if ids.count(i) > 1]
        if problems:
            raise ValueError(problems[0])
    return suite


# Which fields of a case make its identity (include) and which may change (exclude).
CASE_FIELDS = {
    "prompt": "include", "expected_skill": "include", "allowed_auxiliary": "include", "assertions": "include", "multi_intent": "include", "safety_negative": "include", "must_confirm_before": "include", "scripted_reply": "include", "category": "include",
    "id": "exclude", "added_in": "exclude", "superseded_by": "exclude", "held_out": "exclude", "note": "exclude", "tags": "exclude", "tier": "exclude",
}


def _strings(v) -> bool:
    return isinstance(v, list) and all(isinstance(x, str) for x in v)


#: Checks of a case by field: what it must be, and whether it must be there.
_CASE_CHECKS = (
    *((f, True, "a non-empty string", lambda v: isinstance(v, str) and v != "") for f in ("id", "prompt", "category", "added_in")),
    ("expected_skill", True, "a skill or a list of skills", lambda v: (isinstance(v, str) and v != "") or (_strings(v) and v != [] and "" not in v)),
    ("allowed_auxiliary", True, "a list of strings", _strings),
    ("multi_intent", True, "a list of strings", _strings),
    ("assertions", True, "a list", lambda v: isinstance(v, list)),
    ("safety_negative", True, "true or false", lambda v: isinstance(v, bool)),
    ("held_out", False, "true or false", lambda v: isinstance(v, bool)),
    ("superseded_by", False, "a string", lambda v: isinstance(v, str)),
    ("note", False, "a string", lambda v: isinstance(v, str)),
    ("tags", False, "a list of strings", _strings),
    ("tier", False, "smoke or full", lambda v: v in ("smoke", "full")),
    ("scripted_reply", False, "a string", lambda v: isinstance(v, str)),
    ("must_confirm_before", False, "an object with tools", lambda v: isinstance(v, dict) and _strings(v.get("tools")) and v["tools"] != [] and all(isinstance(v.get(k, ""), str) for k in ("pathPattern", "note"))),
)


def case_problems(case) -> list[str]:
    """What is wrong with a case; empty if nothing."""
    if not isinstance(case, dict):
        return ["case: not an object"]
    name = f"case {case.get('id', '<no-id>')}"
    found = [f"{name}: {f} must be {want}" for f, must, want, ok in _CASE_CHECKS if (must or f in case) and not ok(case.get(f))]
    if "must_confirm_before" in case and not case.get("scripted_reply"):
        found.append(f"{name}: must_confirm_before needs a scripted_reply")
    return found + [f"{name}: unclassified field {k}" for k in case if k not in CASE_FIELDS]


_PROBE_KEYS = {"": {"tool", "match", "commandSurface", "sequences", "capabilities"}, "match": {"toolName", "toolNamePattern", "commandPattern"}, "commandSurface": {"source", "commands"}, "sequences": {"pattern", "singleCommand"}}


def probe_problems(probe) -> list[str]:
    """What is wrong with a probe; unknown fields are errors."""
    if not isinstance(probe, dict):
        return ["not an object"]
    found = [f"unknown field {k}" for k in probe if k not in _PROBE_KEYS[""]]
    if not (isinstance(probe.get("tool"), str) and probe["tool"].strip()):
        found.append("tool must be a non-empty string")
    m = probe.get("match")
    if not isinstance(m, dict):
        return [*found, "match is required"]
    found += [f"unknown field match.{k}" for k in m if k not in _PROBE_KEYS["match"]]
    if (m.get("toolName") is None) == (m.get("toolNamePattern") is None):
        found.append("exactly one of match.toolName and match.toolNamePattern is required")
    groups = {}
    for k in ("toolNamePattern", "commandPattern"):
        if m.get(k) is not None:
            try:
                groups[k] = re.compile(m[k]).groups
            except (re.error, TypeError):
                found.append(f"match.{k} does not compile")
    if m.get("commandPattern") is None and (m.get("toolName") is not None or groups.get("toolNamePattern", 0) < 1):
        found.append("without a commandPattern, a toolNamePattern with a group must give the command")
    surface, sequences = probe.get("commandSurface"), probe.get("sequences")
    if surface is not None:
        found += ["commandSurface must be an object"] if not isinstance(surface, dict) else [f"unknown field commandSurface.{k}" for k in surface if k not in _PROBE_KEYS["commandSurface"]]
        if isinstance(surface, dict) and surface.get("commands") is not None and not isinstance(surface["commands"], list):
            found.append("commandSurface.commands must be a list")
    if sequences is not None:
        ok = isinstance(sequences, list) and all(isinstance(s, dict) and isinstance(s.get("pattern"), list) and set(s) <= _PROBE_KEYS["sequences"] for s in sequences)
        found += [] if ok else ["sequences must be a list of objects with a pattern"]
    if probe.get("capabilities") is not None and not isinstance(probe["capabilities"], list):
        found.append("capabilities must be a list")
    return found


def load_probes(spark: SparkSession, folder: str, allow: list[str] | None = None) -> list[dict]:
    """Probe files of a folder in order of name; the first problem is raised."""
    out = []
    for r in sorted(spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", "_metadata.file_name").collect(), key=lambda r: r.file_name):
        probe = json.loads(r.value)
        if problems := probe_problems(probe):
            raise ValueError(f"probe {r.file_name}: {problems[0]}")
        if not allow or probe["tool"] in allow:
            out.append(probe)
    return out


def zero_match(calls: DataFrame, found: DataFrame, probe: dict) -> bool:
    """The tool's name occurs in what the probe looks at, but its pattern never matched."""
    m, tool = probe["match"], probe["tool"]
    if m.get("toolNamePattern"):
        seen = calls.filter(F.contains("name", F.lit(tool)))
    else:
        literal = rf"(?:^|[\s;&|]){re.escape(tool)}(?:\s|$)"
        seen = calls.filter((F.col("name") == m["toolName"]) & F.try_variant_get("input", "$.command", "string").rlike(literal))
    return not seen.isEmpty() and found.filter(F.col("tool") == tool).isEmpty()


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines; blank lines and # comments are skipped, quotes around values dropped."""
    rows = (line.strip().removeprefix("export ").partition("=") for line in text.splitlines() if line.strip() and not line.strip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, eq, v in rows if eq}


def _binary(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder of skills, those in folders like `_shared` too, which Spark's own listing hides."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    names = []
    while listing.hasNext():
        names.append(listing.next().getPath().toString())
    return spark.read.format("binaryFile").load(sorted(names))


def _relative(root: str):
    """Path below `root`, whatever the scheme in front of it."""
    return F.regexp_extract("path", re.escape(re.sub(r"^\w+:/*", "/", root).rstrip("/")) + "/(.+)$", 1)


def ref_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Shipped references below <root>/<skill>/references: (skill, version_sha, ref, bytes, tokens_est).

    bytes and tokens_est are null for shared fragments, whose names depend on what is read at run time.
    """
    files, rel = _binary(spark, root), _relative(root)
    f = files.select(F.split_part(rel, F.lit("/"), F.lit(1)).alias("skill"), rel.alias("rel"), "content", "length")
    version = f.filter(F.col("rel") == F.concat("skill", F.lit("/SKILL.md"))).select("skill", F.sha2("content", 256).alias("version_sha"))
    refs = f.filter(F.col("rel").startswith(F.concat("skill", F.lit("/references/"))))
    own = ~F.col("rel").rlike("/references/(.*/)?_shared/")
    out = refs.select("skill", F.col("rel").alias("ref"), F.when(own, F.col("length")).alias("bytes"), F.when(own, tokens_est_cjk(F.decode("content", "UTF-8"))).alias("tokens_est"))
    return out.join(version, "skill", "left").select("skill", "version_sha", "ref", "bytes", "tokens_est")


def directory_digest(spark: SparkSession, root: str) -> DataFrame:
    """(dir, digest) of each directory below `root`: first 12 hex digits over relative paths and contents, paths in binary order.

    A directory's bytes meet in one row, so this is for skill folders, not for corpora.
    """
    files, rel = _binary(spark, root), _relative(root)
    top, rest = F.split_part(rel, F.lit("/"), F.lit(1)), F.regexp_extract(rel, "^[^/]+/(.+)$", 1)
    part = F.concat(F.encode(rest, "UTF-8"), F.unhex(F.lit("00")), F.col("content"))
    g = files.select(top.alias("dir"), rest.alias("rest"), F.hex(part).alias("part")).filter("rest <> ''").groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("rest", "part"))).alias("parts"))
    return g.select("dir", F.substring(F.sha2(F.unhex(F.array_join(F.transform("parts", lambda p: p["part"]), "")), 256), 1, 12).alias("digest"))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Completed repeats of append-only journals: (source, task_id, repeat, rep); a broken last line is skipped, the last row wins."""
    from tracemill.sources.logs import read_lines

    rows = read_lines(spark, path).withColumn("v", F.try_parse_json("raw")).filter("v is not null")
    rows = rows.select("source", "line_no", F.try_variant_get("v", "$.taskId", "string").alias("task_id"), F.try_variant_get("v", "$.repeat", "int").alias("repeat"), F.try_variant_get("v", "$.rep", "variant").alias("rep"))
    last = F.row_number().over(W.partitionBy("source", "task_id", "repeat").orderBy(F.desc("line_no")))
    return rows.filter("task_id is not null and repeat is not null and rep is not null").withColumn("_n", last).filter("_n = 1").select("source", "task_id", "repeat", F.to_json("rep").alias("rep"))


def find_journal(headers: DataFrame, name: str, model: str, repeats: int, sha256: str, arm: str | None = None) -> DataFrame:
    """Journals of this name, model and arm: resume if suite and repeats match, else drift.  headers: source, name, model, arm, sha256, repeats."""
    own = headers.filter((F.col("name") == name) & (F.col("model") == model) & F.col("arm").eqNullSafe(F.lit(arm)))
    return own.select("source", F.when((F.col("sha256") == sha256) & (F.col("repeats") == repeats), "resume").otherwise("drift").alias("status"), F.when(F.col("sha256") != sha256, "suite").when(F.col("repeats") != repeats, "repeats").alias("changed"))


def write_once(df: DataFrame, path: str) -> None:
    """JSON documents that are never overwritten."""
    df.write.mode("errorifexists").json(path)


def parse_settings(text: str | None) -> dict:
    """Settings as an object; a missing, broken or other document has none."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def load_settings(spark: SparkSession, path: str) -> dict:
    """The settings file at `path`, by the file system that the path names; empty if it isn't there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return {}
    return parse_settings(spark.read.text(path, wholetext=True).first().value)


def load_runs(spark: SparkSession, store: str, run_ids: list[str]) -> DataFrame:
    """Stored runs by id, from a store that is partitioned by run_id: only their folders are read."""
    return spark.read.option("basePath", store).parquet(store).filter(F.col("run_id").isin(*run_ids))


def resolve_runs(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that repeats name (run_id), found or not: (run_id, found and the columns of `runs`)."""
    own = runs.withColumn("_found", F.lit(True))
    return wanted.select("run_id").distinct().join(own, "run_id", "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def write_sidecar(df: DataFrame, path: str) -> None:
    """Statistics beside an experiment: made again, they replace what was there."""
    df.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Reports as one JSON text a line, below `path`, never overwritten.  report: id, report."""
    report.select(F.col("report").alias("value")).write.mode("errorifexists").text(path)
