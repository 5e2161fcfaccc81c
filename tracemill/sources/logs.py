"""Session logs (JSON lines) as relational tables.

Files are read by line and in splits, so a long log is read by many tasks and has no size limit; `line_no` grows along
a file.  Stateful steps of log reading are windows or joins over what belongs together (a request, a call) and scans in
segments of `line_no` over what spans a file (numbers of rounds and calls, the next round's time, boundaries), so no
window holds a file.  Nothing throws on bad input: lines that don't parse, aren't objects or have an unknown type count as
warnings of their file.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.num import utf16_len
from tracemill.functions.scan import ordered, segment_of

# Line types that carry data, and types that are known and skipped.
DATA_TYPES = ("assistant", "user", "attachment", "compact-boundary", "result")
SKIP_TYPES = ("system", "progress", "summary", "mode", "permission-mode", "last-prompt", "queue", "file-history-snapshot", "todo", "checkpoint", "thinking-budget")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, raw) of all `.jsonl` files below a folder.

    line_no orders the lines of a file: 64 KB blocks of the split's beginning, then the row's place in its task.
    """
    rows = spark.read.text(path, lineSep="\n", recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.jsonl$", "")
    line_no = F.shiftleft(F.shiftright("begin", 16), 33).bitwiseOR(F.col("place"))
    return rows.select(stem.alias("source"), line_no.alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("raw")).filter(F.trim("raw") != "")


def lines_of(texts: DataFrame) -> DataFrame:
    """From (source, value): one row per non-blank line."""
    return texts.select("source", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "raw")).filter(F.trim("raw") != "")


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def truthy(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


@dataclass
class Parsed:
    runs: DataFrame
    rounds: DataFrame
    tool_calls: DataFrame
    user_events: DataFrame
    compactions: DataFrame
    self_reports: DataFrame


def classify(lines: DataFrame) -> DataFrame:
    """Adds obj, type, is_side, ts and `bad` to raw lines."""
    v = lines.withColumn("obj", F.try_parse_json("raw"))
    is_object = F.col("obj").isNotNull() & F.coalesce(F.schema_of_variant("obj").startswith("OBJECT") | F.schema_of_variant("obj").startswith("ARRAY"), F.lit(False))
    kind = get(F.col("obj"), "$.type")
    known = F.coalesce(kind.isin(*DATA_TYPES, *SKIP_TYPES), F.lit(False))
    return v.select(
        "source", "line_no", "obj", kind.alias("type"), F.coalesce(get(F.col("obj"), "$.isSidechain", "boolean"), F.lit(False)).alias("is_side"),
        get(F.col("obj"), "$.timestamp").alias("ts"), (~is_object | ~known).alias("bad"), is_object.alias("is_object"),
    )


def segments(rows: DataFrame) -> DataFrame:
    """Assistant lines as segments of rounds: `key` of the request, chain and what a segment carries."""
    obj = F.col("obj")
    usage = get(obj, "$.message.usage", "variant")
    token = lambda name: F.coalesce(F.try_variant_get(usage, f"$.{name}", "long"), F.lit(0))
    usage_struct = F.when(usage.isNotNull() & ~F.is_variant_null(usage), F.struct(token("input_tokens").alias("in"), token("output_tokens").alias("out"), token("cache_creation_input_tokens").alias("cache_w"), token("cache_read_input_tokens").alias("cache_r")))
    blocks = F.coalesce(get(obj, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    said = lambda kind, field: F.array_join(F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == kind), lambda b: F.coalesce(F.try_variant_get(b, f"$.{field}", "string"), F.lit(""))), "")
    agent = F.coalesce(get(obj, "$.agentId"), get(obj, "$.subagentType"), F.lit("sidechain"))
    return rows.filter("type = 'assistant' and is_object").select(
        "*", F.coalesce(get(obj, "$.requestId"), get(obj, "$.uuid")).alias("key"), F.when(F.col("is_side"), agent).otherwise(F.lit("")).alias("agent"), get(obj, "$.message.model").alias("model"),
        truthy(get(obj, "$.attributionSkill")).alias("skill"), truthy(get(obj, "$.message.stop_reason")).alias("stop"), usage_struct.alias("usage"), said("text", "text").alias("text"), said("thinking", "thinking").alias("thinking"),
    )


def round_keys(lines: DataFrame) -> DataFrame:
    """Segments with `round_id`: lines of one request merge until the other chain uses the same key."""
    w = W.partitionBy("source", "key").orderBy("line_no")
    a = segments(lines)
    fresh = F.when(F.lag("is_side").over(w) == F.col("is_side"), F.lit(None)).otherwise(F.col("line_no"))
    return a.withColumn("round_id", F.last(fresh, ignorenulls=True).over(w))


def parse(lines: DataFrame) -> Parsed:
    """All tables of a set of logs from `read_lines` or `lines_of`."""
    rows = classify(lines)
    obj = F.col("obj")
    seg = round_keys(rows)
    by_line = lambda c: F.struct("line_no", c.alias("x"))
    latest = lambda c: F.max(F.when(c.isNotNull(), by_line(c)))["x"]
    earliest = lambda c: F.min(F.when(c.isNotNull(), by_line(c)))["x"]
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col(c).alias("x")))), lambda s: s["x"]), "")
    agg = seg.groupBy("source", "round_id", "agent").agg(
        F.min_by("ts", "line_no").alias("ts"), F.min_by("model", "line_no").alias("model"),
        earliest(F.col("skill")).alias("attribution_skill"), latest(F.col("stop")).alias("stop_reason"),
        F.coalesce(latest(F.col("usage")), F.struct(*(F.lit(0).cast("long").alias(k) for k in ("in", "out", "cache_w", "cache_r")))).alias("usage"),
        joined("text").alias("text"), joined("thinking").alias("thinking"),
    )

    # a file whose only rounds are those of one side chain is that agent's own transcript
    shape = agg.groupBy("source").agg(F.count_if(F.col("agent") == "").alias("_main"), F.count_distinct(F.when(F.col("agent") != "", F.col("agent"))).alias("_agents"), F.max("agent").alias("_agent"))
    promoted = shape.select("source", ((F.col("_main") == 0) & (F.col("_agents") == 1)).alias("promoted"), "_agent")

    first = lambda c: F.min(F.when(c.isNotNull(), F.struct("line_no", c.alias("x"))))["x"]
    good = rows.filter("is_object")
    heads = good.groupBy("source").agg(
        first(truthy(get(obj, "$.sessionId"))).alias("session_id"), first(truthy(get(obj, "$.cwd"))).alias("cwd"), first(truthy(get(obj, "$.version"))).alias("version"),
        first(truthy(F.col("ts"))).alias("started_raw"), latest(truthy(F.col("ts"))).alias("ended_raw"),
    )
    warned = rows.groupBy("source").agg(F.count_if("bad").alias("parse_warnings"))

    # a boundary marks the next round that begins in its own chain
    marks = rows.filter("type = 'compact-boundary'").select("source", "is_side", F.col("line_no").alias("at"), F.lit(0).alias("round_id"))
    begun = agg.select("source", (F.col("agent") != "").alias("is_side"), F.col("round_id").alias("at"), F.col("round_id"))
    both = marks.withColumn("b", F.lit(1)).unionByName(begun.withColumn("b", F.lit(0)))
    both = ordered(both, ["source", "is_side"], ["at"], segment_of(F.col("at")), before={"last_b": "b"})
    armed = both.filter("b = 0 and last_b = 1").select("source", "round_id", F.lit(True).alias("compact_before"))

    r = agg.join(promoted, "source").join(heads.select("source", "ended_raw"), "source").join(armed, ["source", "round_id"], "left")
    r = r.withColumn("chain", F.when((F.col("agent") == "") | F.col("promoted"), "main").otherwise("side"))
    r = ordered(r, ["source", "agent"], ["round_id"], segment_of(F.col("round_id")), number="seq", after={"next_ts": "ts"})
    until = F.coalesce("next_ts", F.col("ended_raw"))
    gap = F.unix_millis(F.try_to_timestamp(until)) - F.unix_millis(F.try_to_timestamp("ts"))
    rounds = r.select(
        F.col("source").alias("run_id"), "chain", F.when(F.col("agent") != "", F.col("agent")).alias("agent_id"), "round_id", F.col("seq").cast("int").alias("seq"), "ts", "model", "attribution_skill", "stop_reason",
        F.coalesce(F.greatest(F.lit(0), gap), F.lit(0)).alias("duration_ms"), "usage", (F.col("usage.in") + F.col("usage.cache_r") + F.col("usage.cache_w")).alias("footprint"),
        F.coalesce("compact_before", F.lit(False)).alias("compact_before"), "text", "thinking", utf16_len(F.col("text")).alias("text_chars"), utf16_len(F.col("thinking")).alias("thinking_chars"),
    )

    calls = tool_calls(seg, rows, rounds)
    events = user_events(rows, promoted)
    prompt = events.filter("chain = 'main' and kind = 'user'").groupBy("run_id").agg(F.min_by("text", "line_no").alias("prompt"))
    model = rounds.groupBy("run_id").agg(F.min(F.when(truthy(F.col("model")).isNotNull(), F.struct((F.col("chain") != "main").alias("side"), "round_id", "model")))["model"].alias("model"))
    runs = (
        warned.join(heads, "source", "left").join(promoted, "source", "left").withColumnRenamed("source", "run_id").join(prompt, "run_id", "left").join(model, "run_id", "left")
        .select("run_id", "session_id", "model", "cwd", "version", "started_raw", "ended_raw", F.try_to_timestamp("started_raw").alias("started_at"), F.try_to_timestamp("ended_raw").alias("ended_at"), "prompt", F.when(F.col("promoted"), F.col("_agent")).alias("agent_id"), "parse_warnings", F.lit(1).alias("tag_version"))
    )
    compactions = rows.filter("type = 'compact-boundary'").select(F.col("source").alias("run_id"), F.when(F.col("is_side"), "side").otherwise("main").alias("chain"), "ts", "line_no")
    reports = rows.filter("type = 'result' and is_object").select(F.col("source").alias("run_id"), "line_no", *(get(obj, f"$.{n}", k).alias(n) for n, k in (("total_cost_usd", "double"), ("num_turns", "long"), ("duration_ms", "long"), ("is_error", "boolean"))))
    return Parsed(runs, rounds, calls, events, compactions, reports)


def result_text(content: Column) -> Column:
    """A tool result as text: strings as they are, blocks joined by line, anything else as JSON."""
    shape = F.schema_of_variant(content)
    block = lambda b: F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")).when(F.try_variant_get(b, "$.type", "string") == "text", F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))).otherwise(F.concat(F.lit("["), F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit("block")), F.lit("]")))
    many = F.array_join(F.transform(F.try_variant_get(content, "$", "array<variant>"), block), "\n")
    return F.when(content.isNull() | F.is_variant_null(content), F.lit(None)).when(shape == "STRING", F.try_variant_get(content, "$", "string")).when(shape.startswith("ARRAY"), many).otherwise(F.to_json(content))


def tool_calls(seg: DataFrame, rows: DataFrame, rounds: DataFrame) -> DataFrame:
    """Calls of all rounds with what came back for them.

    A result belongs to the latest call before it with its id; results without such a call are dropped.
    """
    obj = F.col("obj")
    blocks = F.coalesce(get(obj, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    used = seg.select("source", "round_id", "line_no", F.posexplode(blocks).alias("pos", "b")).filter(F.try_variant_get("b", "$.type", "string") == "tool_use")
    name = F.coalesce(F.try_variant_get("b", "$.name", "string"), F.lit("unknown"))
    c = used.select("source", "round_id", "line_no", "pos", F.try_variant_get("b", "$.id", "string").alias("call_id"), name.alias("name"), F.when(name == "Skill", F.try_variant_get("b", "$.input.skill", "string")).alias("skill"), F.try_variant_get("b", "$.input", "variant").alias("input"))
    again = F.row_number().over(W.partitionBy("source", "round_id", F.coalesce("call_id", F.concat(F.lit("#"), F.lit("null")))).orderBy("line_no", "pos"))
    c = c.withColumn("_n", again).filter("_n = 1").drop("_n")

    users = rows.filter("type = 'user' and is_object")
    inner = F.coalesce(get(obj, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    back = users.select("source", F.col("line_no").alias("rl"), F.posexplode(inner).alias("rp", "b")).filter(F.try_variant_get("b", "$.type", "string") == "tool_result")
    back = back.select("source", "rl", "rp", F.try_variant_get("b", "$.tool_use_id", "string").alias("call_id"), F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False)).alias("e"), F.try_variant_get("b", "$.toolDenialKind", "string").alias("d"), result_text(F.try_variant_get("b", "$.content", "variant")).alias("res"))
    bodies = users.filter(F.coalesce(get(obj, "$.isMeta", "boolean"), F.lit(False)) & truthy(get(obj, "$.sourceToolUseID")).isNotNull()).select("source", F.col("line_no").alias("rl"), get(obj, "$.sourceToolUseID").alias("call_id"), user_text(obj).alias("body"))

    ids = c.filter(truthy(F.col("call_id")).isNotNull()).select("source", "call_id", F.col("line_no").alias("cl"), F.col("pos").alias("cp"), "round_id")
    nearest = lambda df, keep: df.join(ids, ["source", "call_id"]).filter("rl > cl").withColumn("_k", F.row_number().over(W.partitionBy("source", "call_id", *keep).orderBy(F.desc("cl"), F.desc("cp")))).filter("_k = 1")
    at = ["source", "round_id", "call_id"]
    got = nearest(back, ["rl", "rp"]).groupBy(*at).agg(F.bool_or("e").alias("is_error"), F.max(F.when(F.col("d").isNotNull(), F.struct("rl", "rp", "d")))["d"].alias("denial_kind"), F.max(F.struct("rl", "rp", "res"))["res"].alias("result"))
    body = nearest(bodies, ["rl"]).groupBy(*at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rl", "body"))), lambda x: x["body"]), "\n").alias("skill_body"))
    out = c.join(got, at, "left").join(body, at, "left").join(rounds.select(F.col("run_id").alias("source"), "round_id", "chain", "agent_id", "seq"), ["source", "round_id"])
    # 0-based position of a call among all calls of main rounds; numbers of rounds grow with the line that they begin at
    out = ordered(out, ["source", "chain"], ["seq", "line_no", "pos"], segment_of(F.col("round_id")), number="place")
    return out.select(
        F.col("source").alias("run_id"), "chain", "agent_id", "round_id", F.col("seq").alias("round_seq"), "line_no", "pos", F.when(F.col("chain") == "main", (F.col("place") - 1).cast("int")).alias("ordinal"),
        "call_id", "name", "skill", "input", F.coalesce("is_error", F.lit(False)).alias("is_error"), "denial_kind", "result", "skill_body",
    )


def user_text(obj: Column) -> Column:
    content = get(obj, "$.message.content", "variant")
    parts = F.transform(F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.array_join(parts, "\n"), F.lit("")))


def attachment_text(text: Column) -> Column:
    """Strings longer than two characters in an attachment, in order, joined by line; at most 81, down to depth 4."""
    @F.pandas_udf("string")
    def strings(raw: pd.Series) -> pd.Series:
        def walk(v, out, depth):
            if depth > 4 or len(out) > 80:
                return out
            if isinstance(v, str):
                if len(v) > 2:
                    out.append(v)
            elif isinstance(v, (list, dict)):
                for x in v.values() if isinstance(v, dict) else v:
                    walk(x, out, depth + 1)
            return out

        return raw.map(lambda t: "\n".join(walk(json.loads(t).get("attachment"), [], 0)) if t else "")

    return strings(text)


def user_events(rows: DataFrame, promoted: DataFrame) -> DataFrame:
    """What entered the context from the user's side, tagged by kind of source; blank texts are no events."""
    obj = F.col("obj")
    meta = F.coalesce(get(obj, "$.isMeta", "boolean"), F.lit(False))
    has_result = F.exists(F.coalesce(get(obj, "$.message.content", "array<variant>"), F.array().cast("array<variant>")), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_result")
    src = F.when(meta & truthy(get(obj, "$.sourceToolUseID")).isNotNull(), "skill-body").when(has_result, "tool-result-side").when(meta, "meta-injected").otherwise("user")
    users = rows.filter("type = 'user' and is_object").select("source", "line_no", "is_side", "ts", user_text(obj).alias("text"), F.lit("user").alias("kind"), src.alias("src_kind"))
    files = rows.filter("type = 'attachment' and is_object").select("source", "line_no", "is_side", "ts", attachment_text(F.to_json(obj)).alias("text"), F.lit("attachment").alias("kind"), F.lit("attachment").alias("src_kind"))
    both = users.unionByName(files).filter(F.trim(F.regexp_replace("text", r"\s", " ")) != "").join(promoted.select("source", "promoted"), "source", "left")
    chain = F.when(F.col("is_side") == F.coalesce("promoted", F.lit(False)), "main").otherwise("side")
    return both.select(F.col("source").alias("run_id"), chain.alias("chain"), "ts", "text", utf16_len(F.col("text")).alias("chars"), "kind", "src_kind", "line_no")


def triggers(calls: DataFrame) -> DataFrame:
    """Per run: skills in order of first use on the main chain, the first being primary."""
    firsts = calls.filter("chain = 'main' and name = 'Skill' and skill is not null").groupBy("run_id", "skill").agg(F.min("ordinal").alias("first_ordinal"))
    return firsts.withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy("first_ordinal"))).withColumn("is_primary", F.col("rank") == 1)


def attribute_read(path: Column, result: Column) -> Column:
    """struct(skill, ref_path, logical_ref, shared) of a read below skills/<skill>/; null for other paths.

    Shared fragments are named by their content, so equal copies in several skills are one reference.
    """
    norm = F.regexp_replace(path, r"\\", "/")
    skill, rest = F.regexp_extract(norm, r"(?:^|/)skills/([^/]+)/(.+)$", 1), F.regexp_extract(norm, r"(?:^|/)skills/([^/]+)/(.+)$", 2)
    shared = F.regexp_extract(rest, r"(?:^|/)_shared/(.+)$", 1)
    own = F.concat(skill, F.lit("/"), rest)
    logical = F.when(shared != "", F.concat(F.lit("_shared/"), shared, F.lit("#"), F.coalesce(F.md5(result), F.lit("no-content")))).otherwise(own)
    return F.when(skill != "", F.struct(skill.alias("skill"), own.alias("ref_path"), logical.alias("logical_ref"), (shared != "").alias("shared")))


def reads(calls: DataFrame) -> DataFrame:
    """Successful reads of skill files on the main chain: first occurrence of each reference in a run."""
    r = calls.filter("chain = 'main' and name = 'Read' and not is_error").withColumn("a", attribute_read(F.try_variant_get("input", "$.file_path", "string"), F.col("result"))).filter("a is not null")
    r = r.select("run_id", "a.*", "ordinal")
    return r.groupBy("run_id", "logical_ref").agg(F.min_by("skill", "ordinal").alias("skill"), F.min_by("ref_path", "ordinal").alias("ref_path"), F.min_by("shared", "ordinal").alias("shared"), F.min("ordinal").alias("first_ordinal"))


def invocations(calls: DataFrame, probes: list[dict]) -> DataFrame:
    """Commands that probes find in main-chain calls: (run_id, tool, cmd, round_seq, ordinal, seq).

    A probe names a tool (tool_name or tool_name_pattern) and may give a command pattern, which is applied to every
    segment of a shell command; its first two groups are the command.  Probes are few: one plan branch each.
    """
    own = calls.filter("chain = 'main'")
    out = None
    for p in probes:
        m = p["match"]
        rows = own.filter(F.col("name").rlike(m["toolNamePattern"])) if m.get("toolNamePattern") else own.filter(F.col("name") == m.get("toolName"))
        if m.get("commandPattern"):
            segment = F.filter(F.split(F.try_variant_get("input", "$.command", "string"), r"\s*(?:;|&&|\|\||\|)\s*"), lambda s: s != "")
            rows = rows.select("run_id", "round_seq", "ordinal", F.posexplode(segment).alias("seq", "s"))
            g1, g2 = F.regexp_extract("s", m["commandPattern"], 1), (F.regexp_extract("s", m["commandPattern"], 2) if _groups(m["commandPattern"]) > 1 else F.lit(""))
        else:
            rows = rows.select("run_id", "round_seq", "ordinal", F.lit(0).alias("seq"), F.col("name").alias("s"))
            g1, g2 = F.regexp_extract("s", m["toolNamePattern"], 1), F.lit("")
        cmd = F.when(g2 != "", F.concat(g1, F.lit(" "), g2)).otherwise(g1)
        found = rows.withColumn("cmd", cmd).filter("cmd <> ''").select("run_id", F.lit(p["tool"]).alias("tool"), "cmd", "round_seq", "ordinal", "seq")
        out = found if out is None else out.unionByName(found)
    return out


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def run_rounds(p: Parsed) -> DataFrame:
    """Rounds joined with their calls' counts, in the shape that the metric operators read."""
    c = p.tool_calls.groupBy("run_id", "round_id").agg(F.count("*").alias("n_calls"), F.count_if("is_error").alias("n_errors"), F.collect_set("skill").alias("call_skills"), F.sum(F.coalesce(utf16_len(F.col("result")), F.lit(0))).alias("result_chars"))
    r = p.rounds.join(c, ["run_id", "round_id"], "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return r.select("run_id", "round_id", "chain", "seq", "ts", "model", "attribution_skill", "stop_reason", "duration_ms", "footprint", "compact_before", *(F.col(f"usage.{k}").alias(f"u_{k}") for k in ("in", "out", "cache_w", "cache_r")), zero("n_calls"), zero("n_errors"), zero("result_chars"), "call_skills")


def hash_lite(s: Column) -> Column:
    """run-<hex> of a 31-hash over UTF-16 units with 32-bit wrap-around."""
    code = F.encode(s, "UTF-16BE")
    units = F.transform(F.sequence(F.lit(1), (F.octet_length(code) / 2).cast("int")), lambda i: F.conv(F.hex(F.substring(code, i * 2 - 1, F.lit(2))), 16, 10).cast("long"))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, u: (a * 31 + u).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.concat(F.lit("run-"), F.lower(F.hex(F.when(F.length(s) > 0, h).otherwise(F.lit(0).cast("long")))))
