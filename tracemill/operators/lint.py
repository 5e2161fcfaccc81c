"""Integrity checks of datasets, skills and adapter outputs; each returns findings as rows."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.config import DATASET, DESCRIPTION_MAX, TOKEN_CHARS, VERDICT


def canonical_json(value) -> str:
    """JSON with keys sorted by UTF-16 unit, no spaces, and integral numbers without a fraction."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return json.dumps(value, ensure_ascii=False)


def case_sha256(case: dict, fields: dict[str, str]) -> str:
    """Digest of a case's included fields; a field that is in no class is an error."""
    unknown = [k for k in case if k not in fields]
    if unknown:
        raise ValueError(f"case {case.get('id', '<no-id>')}: unclassified field {unknown[0]}")
    return hashlib.sha256(canonical_json({k: v for k, v in case.items() if fields[k] == "include"}).encode()).hexdigest()


def canonical_sha(rows: DataFrame, json_col: str) -> DataFrame:
    """Adds `sha` of the canonical form of a JSON column (null where it isn't JSON); Arrow batches."""
    @F.pandas_udf("string")
    def canon(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return canonical_json(json.loads(t))
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return rows.withColumn("sha", F.sha2(canon(json_col), 256))


def duplicates(cases: DataFrame) -> DataFrame:
    """Ids that occur again: (id, occurrences)."""
    return cases.groupBy("id").agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def dangling(cases: DataFrame) -> DataFrame:
    """Cases replaced by something that isn't there: (id, superseded_by)."""
    return cases.filter("superseded_by is not null").select("id", "superseded_by").join(cases.select(F.col("id").alias("superseded_by")).distinct(), "superseded_by", "left_anti").select("id", "superseded_by")


def lineage(old: DataFrame, new: DataFrame) -> DataFrame:
    """A new version must keep every old case as it was: (id, code).  old, new: id, sha."""
    gone = old.join(new.select("id"), "id", "left_anti").select("id", F.lit("not-superset").alias("code"))
    changed = old.select("id", F.col("sha").alias("_o")).join(new.select("id", F.col("sha").alias("_n")), "id").filter("_o <> _n").select("id", F.lit("content-changed").alias("code"))
    return gone.unionByName(changed)


def shared_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def tiers(cases: DataFrame) -> DataFrame:
    """Adds `part`: smoke or full; untagged cases are full."""
    return cases.withColumn("part", F.when(F.col("tier") == "smoke", "smoke").otherwise("full"))


def skill_coverage(cases: DataFrame) -> DataFrame:
    """Skills with too few cases: (skill, current_n, need_more).  cases: expected (array of skills)."""
    target = VERDICT["min_pairs_skill"]
    n = cases.select(F.explode("expected").alias("skill")).groupBy("skill").agg(F.count("*").alias("current_n")).filter(F.col("current_n") < target)
    return n.withColumn("need_more", target - F.col("current_n"))


def multi_intent(cases: DataFrame) -> DataFrame:
    """One row if cases with several intents are too few a share."""
    g = cases.agg(F.count_if(F.size("multi_intent") > 0).alias("with_multi"), F.count("*").alias("total"))
    return g.filter("total > 0").withColumn("pct", F.col("with_multi") / F.col("total")).filter(F.col("pct") < DATASET["multi_intent_share"])


def smoke_size(cases: DataFrame) -> DataFrame:
    """One row if the smoke tier's size is out of its band."""
    n = cases.agg(F.count_if(F.col("tier") == "smoke").alias("n"))
    return n.filter((F.col("n") < DATASET["smoke_min"]) | (F.col("n") > DATASET["smoke_max"]))


def redundant_auxiliary(cases: DataFrame) -> DataFrame:
    return cases.select("id", F.explode(F.array_intersect("expected", "allowed")).alias("skill"))


def description_length(skills: DataFrame, limit: int = DESCRIPTION_MAX) -> DataFrame:
    """Descriptions longer than the limit, in code points."""
    return skills.select("name", F.length("description").alias("chars")).filter(F.col("chars") > limit)


def trigger_collisions(triggers: DataFrame) -> DataFrame:
    """Trigger terms, trimmed and lower-cased, that two skills or more claim: (term, skills).  triggers: name, term."""
    norm = triggers.select("name", F.lower(F.trim("term")).alias("term")).filter("term <> ''").distinct()
    return norm.groupBy("term").agg(F.sort_array(F.collect_list("name")).alias("skills")).filter(F.size("skills") >= 2)


def shared_drift(fragments: DataFrame) -> DataFrame:
    """Shared paths whose content differs between skills: (path, variants, owners).  fragments: name, path, content."""
    g = fragments.groupBy("path").agg(F.count_distinct(F.md5("content")).alias("variants"), F.count_distinct("name").alias("owners"))
    return g.filter("variants > 1")


def tax_table(skills: DataFrame) -> DataFrame:
    """What a skill costs by being listed.  skills: name, description, triggers, shared (arrays)."""
    chars = F.length(F.coalesce("description", F.lit("")))
    return skills.select("name", chars.alias("desc_chars"), F.coalesce(F.size("triggers"), F.lit(0)).alias("trigger_count"), F.coalesce(F.size("shared"), F.lit(0)).alias("shared_refs"), F.ceil(chars / TOKEN_CHARS).alias("tax_tokens"))


def declared_versions(arms: DataFrame) -> DataFrame:
    """One row if arms that should be alike declare different versions."""
    return arms.agg(F.count_distinct("version").alias("versions"), F.sort_array(F.collect_set("version")).alias("seen")).filter("versions > 1")


def near_misses(keys: DataFrame, known: list[str], within: int = 2) -> DataFrame:
    """Unknown keys that are almost a known one: (key, meant), the first known key in order within the distance.

    Each key meets a fixed list of known ones; keys that begin with `x_` are free.
    """
    fresh = keys.select("key").distinct().filter(~F.col("key").isin(*known) & ~F.col("key").startswith("x_"))
    close = F.filter(F.array(*map(F.lit, known)), lambda k: F.levenshtein(F.col("key"), k) <= within)
    return fresh.select("key", F.get(close, F.lit(0)).alias("meant")).filter("meant is not null")


CHANNELS = ("trace", "usage", "triggers", "refReads", "skills_inventory", "runtime_info", "observability")


def adapter_channels(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Per adapter output: whether it parses, has its result, and which channels it carries."""
    v = F.try_parse_json(raw)
    got = lambda path, kind="variant": F.try_variant_get(v, path, kind)
    is_array = lambda path: F.coalesce(F.schema_of_variant(got(path)).startswith("ARRAY"), F.lit(False))
    is_object = lambda path: F.coalesce(F.schema_of_variant(got(path)).startswith("OBJECT"), F.lit(False))
    steps = F.coalesce(got("$.trace", "array<variant>"), F.array().cast("array<variant>"))
    some = lambda path, test: F.exists(steps, lambda s: F.coalesce(test(F.try_variant_get(s, path, "variant")), F.lit(False)))
    listy = lambda x: F.schema_of_variant(x).startswith("ARRAY")
    string_result = F.coalesce(F.schema_of_variant(got("$.result")) == "STRING", F.lit(False))
    return outputs.select(
        "*", v.isNotNull().alias("parses"), is_object("$").alias("is_object"), string_result.alias("has_result"), (is_object("$") & string_result).alias("ok"),
        (F.size(steps) > 0).alias("trace"), some("$.usage", lambda x: x.isNotNull() & ~F.is_variant_null(x)).alias("usage"), some("$.triggers", listy).alias("triggers"), some("$.refReads", listy).alias("refReads"),
        (is_object("$.skills_inventory") & (F.schema_of_variant(got("$.skills_inventory")) != "OBJECT<>")).alias("skills_inventory"), is_object("$.runtime_info").alias("runtime_info"), is_array("$.observability").alias("observability"),
    )


def digest_drift(rows: DataFrame, by: list[str], payload: str) -> DataFrame:
    """Groups in which a payload that should be constant has several digests, with the first by order."""
    return rows.groupBy(*by).agg(F.count_distinct(F.sha2(payload, 256)).alias("digests"), F.min_by(payload, "ord").alias("hoisted")).withColumn("drift", F.col("digests") > 1)


def model_mismatch(asked: Column, ran: Column) -> Column:
    """The model that ran is not the one asked for (neither name holds the other); unknown is no mismatch."""
    a, r = F.lower(asked), F.lower(ran)
    return F.coalesce(~(F.contains(r, a) | F.contains(a, r)), F.lit(False))


def merge_adapter_meta(metas: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row for all steps of a run: sorted unions of the keys seen, declarations one after the other in the order of the steps.

    metas: top_keys, round_keys, tool_call_keys, observability (sets of strings; a null `observability` was not declared)
    and declared_triggers, declared_ref_reads (lists of strings).  Unions of nothing are empty; `observability` stays null
    where no step declares it.
    """
    sets, lists = ("top_keys", "round_keys", "tool_call_keys", "observability"), ("declared_triggers", "declared_ref_reads")
    # keys are few distinct words: united as they are, whatever the number of steps
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.col(c)))))
    steps = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("x")))), lambda s: s["x"]))
    found = metas.groupBy(*by).agg(*(union(c).alias(c) for c in sets), *(steps(c).alias(c) for c in lists), F.count("observability").alias("_declared"))
    return found.withColumn("observability", F.when(F.col("_declared") > 0, F.col("observability"))).drop("_declared")


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def adapter_keys(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Distinct keys that adapter outputs use, by level: (level, key) for top, round and toolCall."""
    v = F.try_parse_json(raw)
    steps = F.coalesce(F.try_variant_get(v, "$.trace", "array<variant>"), F.array().cast("array<variant>"))
    keys = lambda x: F.map_keys(F.try_variant_get(x, "$", "map<string,variant>"))
    per_step = lambda s: F.coalesce(F.try_variant_get(s, "$.toolCalls", "array<variant>"), F.array().cast("array<variant>"))
    none = F.array().cast("array<string>")
    level = lambda name, arr: outputs.select(F.lit(name).alias("level"), F.explode(arr).alias("key"))
    return (
        level("top", F.coalesce(keys(v), none)).union(level("round", F.flatten(F.transform(steps, lambda s: F.coalesce(keys(s), none)))))
        .union(level("toolCall", F.flatten(F.transform(F.flatten(F.transform(steps, per_step)), lambda c: F.coalesce(keys(c), none))))).distinct()
    )


def resolve_meta(*layers: tuple[str, dict]) -> dict[str, dict]:
    """Metadata from layers in rising precedence: {key: {value, source}}; keys and values are checked."""
    import re

    out = {}
    for source, values in layers:
        for k, v in values.items():
            if not re.fullmatch(r"[A-Za-z0-9._-]{1,64}", k):
                raise ValueError(f"invalid key {k}")
            if not isinstance(v, (str, int, float, bool)):
                raise ValueError(f"{k}: a value must be a string, number or boolean")
            out[k] = {"value": v, "source": source}
    return out


def resolve_variables(text: str, values: dict[str, str], reserved: tuple[str, ...] = ("PROMPT", "MODEL", "SUITE_DIR", "REPLY")) -> str:
    """Fills `{{NAME}}`; reserved names are left, an unknown name is an error."""
    import re

    def fill(m: re.Match) -> str:
        if m[1] in reserved:
            return m[0]
        if values.get(m[1]) is None:
            raise ValueError(f"variable {m[1]} is unresolved")
        return str(values[m[1]])

    return re.sub(r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}", fill, text)
