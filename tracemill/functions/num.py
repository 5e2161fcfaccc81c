"""Scalar functions as column expressions: rounding, intervals, estimators, random draws, text measures.

All are built-in expressions that Catalyst inlines; none is a UDF.  Unknown stays null: no function turns null into 0
unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracemill.config import TOKEN_WEIGHTS


def js_round(x: Column, digits: int = 3) -> Column:
    """Half towards plus infinity, at `digits` decimals."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5).cast("double") / scale


def clamp01(x: Column) -> Column:
    """Between 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def utf16_len(s: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, three decimals; (0, 0) without samples."""
    s, m = successes.cast("double"), n.cast("double")
    p, z2 = s / m, z * z
    centre = p + z2 / (2 * m)
    spread = z * F.sqrt((p * (1 - p) + z2 / (4 * m)) / m)
    scale = 1 + z2 / m
    lo, hi = F.greatest(F.lit(0.0), (centre - spread) / scale), F.least(F.lit(1.0), (centre + spread) / scale)
    return tuple(F.when(n == 0, F.lit(0.0)).otherwise(js_round(x)) for x in (lo, hi))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Unbiased estimate that k of n samples hold one of c successes; null where k > n or n = 0."""
    miss = F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(1.0), lambda acc, i: acc * (n - c - i).cast("double") / (n - i).cast("double"))
    return F.when((k > n) | (n == 0), F.lit(None)).when(c <= 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(js_round(1 - miss))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by the five-term polynomial (absolute error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    d = 0.3989422804014327 * F.exp(-x * x / 2)
    p = d * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - p).otherwise(p)


def two_proportion(x1: Column, n1: Column, x2: Column, n2: Column) -> tuple[Column, Column]:
    """(z, one-sided p-value) of pooled proportions, unrounded z; null where a side is empty."""
    a, b = ratio(x1, n1), ratio(x2, n2)
    pool = (x1 + x2).cast("double") / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1 / n1.cast("double") + 1 / n2.cast("double")))
    z = F.when(a.isNull() | b.isNull(), F.lit(None)).when(se > 0, (a - b) / se).otherwise(F.lit(0.0))
    return z, js_round(1 - normal_cdf(z))


def splitmix32(k: Column, seed: int) -> Column:
    """The k-th draw (from 1) of a 32-bit SplitMix generator, in [0, 1): a function of the counter alone."""
    mask = F.lit(0xFFFFFFFF)
    a = (F.lit(seed & 0xFFFFFFFF) + k.cast("long") * F.lit(0x9E3779B9)).bitwiseAND(mask)
    t = a.bitwiseXOR(F.shiftright(a, 16))
    t = (t * F.lit(0x21F0AAAD)).bitwiseAND(mask)
    t = t.bitwiseXOR(F.shiftright(t, 15))
    t = (t * F.lit(0x735A2D97)).bitwiseAND(mask)
    return t.bitwiseXOR(F.shiftright(t, 15)) / F.lit(4294967296.0)


def equiv_tokens(usage_in: Column, out: Column, cache_r: Column, cache_w: Column) -> Column:
    """Weighted sum of token kinds; an unreported kind counts nothing."""
    return sum((F.coalesce(c.cast("double"), F.lit(0.0)) * TOKEN_WEIGHTS[k] for k, c in (("in", usage_in), ("out", out), ("cacheR", cache_r), ("cacheW", cache_w))), F.lit(0.0))


#: Ranges of characters that count one token each.
CJK = "\\u3000-\\u303f\\u3400-\\u4dbf\\u4e00-\\u9fff\\uff00-\\uffef"


def tokens_est_cjk(s: Column) -> Column:
    """One token per CJK character, one per four others, rounded up."""
    wide = F.length(F.regexp_replace(s, f"[^{CJK}]", ""))
    return (wide + F.ceil((F.length(s) - wide) / 4)).cast("long")


# Fixed value: what counts as a number in a text.
NUMBER = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"


def extract_numbers(s: Column) -> Column:
    """All numbers of a text, thousands separators removed."""
    return F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


#: Tools that the runtime itself brings; launchers of agents.
BUILTIN_TOOLS = (
    "Read", "Write", "Edit", "MultiEdit", "NotebookEdit", "NotebookRead", "Bash", "BashOutput", "KillShell", "Glob", "Grep", "LS", "WebFetch", "WebSearch", "TodoWrite", "TodoRead",
    "ExitPlanMode", "AskUserQuestion", "SlashCommand", "ListMcpResources", "ReadMcpResource",
)
AGENT_TOOLS = ("Task", "Agent")


def tool_kind(name: Column) -> Column:
    """skill, agent, mcp, builtin or other, the first that fits; null names are other."""
    return F.when(name == "Skill", "skill").when(name.isin(*AGENT_TOOLS), "agent").when(name.startswith("mcp__"), "mcp").when(name.isin(*BUILTIN_TOOLS), "builtin").otherwise("other")


def mcp_server(name: Column) -> Column:
    """Server of a qualified tool name: what precedes the last double underscore, or the whole remainder."""
    rest = F.regexp_replace(name, "^mcp__", "")
    head = F.regexp_extract(rest, "^(.+)__", 1)
    return F.when(head != "", head).otherwise(rest)


#: What a secret in captured output looks like, and what replaces it.
SECRETS = (
    (r"sk-[A-Za-z0-9_-]{8,}", "***"),
    (r"\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\b", "***"),
    (r"(?i)\b(token|secret|password|apikey|api_key)\s*[=:]\s*\S+", "$1=***"),
)


def redact_secrets(s: Column) -> Column:
    for pattern, put in SECRETS:
        s = F.regexp_replace(s, pattern, put)
    return s


def parse_duration(s: Column) -> Column:
    """Milliseconds of `10s`, `5m`, `2h`, `7d`, `1w`; null for anything else."""
    unit = F.regexp_extract(F.trim(s), r"(?i)^\d+\s*([smhdw])$", 1)
    size = F.element_at(F.create_map(*(F.lit(x) for kv in (("s", 1000), ("m", 60_000), ("h", 3_600_000), ("d", 86_400_000), ("w", 604_800_000)) for x in kv)), F.lower(unit))
    return F.when(unit != "", F.regexp_extract(F.trim(s), r"^(\d+)", 1).cast("long") * size)


def format_bytes(n: Column) -> Column:
    """`512 B`, `1.5 KB`, `2.0 MB`."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576.0), F.lit(" MB")))


#: The generator as SQL; each step is bound by a lambda, so it is computed once.
SPLITMIX_SQL = (
    "transform(transform(transform(array((2654435769L + k * 2654435769L) & 4294967295L), a -> ((a ^ shiftright(a, 16)) * 569420461L) & 4294967295L),"
    " t -> ((t ^ shiftright(t, 15)) * 1935289751L) & 4294967295L), t -> (t ^ shiftright(t, 15)) / 4294967296D)[0]"
)


def register(spark: SparkSession) -> None:
    """The scalar kernel as temporary SQL functions, inlined by the analyzer."""
    for name, args, returns, body in (
        ("js_round", "x DOUBLE, k INT", "DOUBLE", "floor(x * power(10, k) + 0.5D) / power(10, k)"),
        ("splitmix32_at", "k BIGINT", "DOUBLE", SPLITMIX_SQL),
        ("equiv_tokens", "i DOUBLE, o DOUBLE, r DOUBLE, w DOUBLE", "DOUBLE", "coalesce(i, 0) + 5 * coalesce(o, 0) + 0.1D * coalesce(r, 0) + 1.25D * coalesce(w, 0)"),
        ("mcp_server", "n STRING", "STRING", "coalesce(nullif(regexp_extract(regexp_replace(n, '^mcp__', ''), '^(.+)__', 1), ''), regexp_replace(n, '^mcp__', ''))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
