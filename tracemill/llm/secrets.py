"""Secret scans with a trigram inverted index, in DataFrame functions only.

Every rule's regular expression yields a Boolean trigram query: an OR of ANDs of trigrams that each match must hold.
The index keeps postings (trigram, row key) over ASCII-lower-cased texts, for the trigrams that queries name.
Intersecting postings by row key gives the candidates of a rule, and only candidates are verified with the rule.
A rule without mandatory trigrams (long runs of hex digits) scans every text.

Row keys are hashes of id and text; a collision adds a candidate, which verification rejects.  The posting table is
shuffled by row key, so no trigram, however frequent, lands in one task.  The candidates' keys are broadcast while they
number `HITS` at most, so texts stay where they are read; beyond, they are joined by key.

Offsets and masked texts take time in proportion to a text's length (times its logarithm), however many matches it has.

Defined results: null text is empty and has no spans; offsets are code points; equal rows are scanned each on its own
and give equal results; null ids are kept; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class Rule:
    """`pattern` works alike in Java and Python; matches whose `group` is shorter than `least` are dropped.

    `search`, where given, finds just the matches that are not dropped: for a run of characters, the run's least length.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    search: str = ""

    @property
    def kept(self) -> str:
        return self.search or self.pattern


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, True, r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Strings that a part of an expression may stand for before it counts as free, and trigrams used of one AND.
EXPAND, CONJUNCTS = 64, 4
#: Candidates whose keys may be broadcast, and characters (a power of two) of the pieces that masking cuts texts into.
HITS, PIECE = 1_000_000, 1 << 12


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The pattern's mandatory trigrams as an OR of ANDs, lower-cased; None where there are none."""

    def exact(node) -> set[str] | None:
        op, arg = node
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            chars = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
            return chars if len(chars) <= 8 else None
        if name == "SUBPATTERN":
            return sequence(arg[-1])
        if name == "BRANCH":
            parts = [sequence(s) for s in arg[1]]
            return set().union(*parts) if all(p is not None for p in parts) else None
        if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 2:
            one = sequence(arg[2])
            if one is not None:
                return {"".join(x) for k in range(arg[0], arg[1] + 1) for x in product([one] * k)}
        return None

    def product(parts: list[set[str]]) -> list[tuple[str, ...]]:
        return reduce(lambda acc, p: [(*a, x) for a in acc for x in sorted(p)], parts, [()])

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for n in nodes:
            e = exact(n)
            if e is None or len(e) * len(out) > EXPAND:
                return None
            out = {a + b for a in out for b in e}
        return out

    def anded(a, b):
        if a is None or b is None:
            return a if b is None else b
        return pruned({x | y for x in a for y in b})

    def pruned(ors: set[frozenset[str]]) -> set[frozenset[str]] | None:
        if frozenset() in ors:
            return None
        return {x for x in ors if not any(y < x for y in ors)}

    def of_strings(strings: set[str]):
        return pruned({frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings})

    def walk(nodes):
        query, run = None, {""}
        for n in nodes:
            e = exact(n)
            if e is not None and len(e) * len(run) <= EXPAND:
                run = {a + b for a in run for b in e}
                continue
            query, run = anded(query, of_strings(run)), {""}
            if e is not None:
                run = e
            elif str(n[0]) == "SUBPATTERN":
                query = anded(query, walk(n[1][-1]))
            elif str(n[0]) in ("MAX_REPEAT", "MIN_REPEAT") and n[1][0] >= 1:
                query = anded(query, walk(n[1][2]))
            elif str(n[0]) == "BRANCH":
                parts = [walk(s) for s in n[1][1]]
                query = anded(query, None if any(p is None for p in parts) else pruned(set().union(*parts)))
        return anded(query, of_strings(run))

    found = walk(sre.parse(pattern))
    if found is None:
        return None
    # part of an AND is still mandatory; a few trigrams, spread over it, select as well as all
    cut = {frozenset(sorted(a)[:: max(1, len(a) // CONJUNCTS)][:CONJUNCTS]) for a in found}
    return sorted(pruned(cut), key=sorted)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, key), one row for each of the trigrams that a text holds."""
    low = docs.select(row_key(id_col, text_col).alias("key"), F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.filter("low is not null").select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(key, rules): the bit set of rules whose trigram query the row satisfies, by intersecting postings."""
    branches = [(rule, b, t, 1 << k, (1 << len(conj)) - 1) for rule, ors in queries.items() for b, conj in enumerate(ors) for k, t in enumerate(sorted(conj))]
    wanted = F.broadcast(index.sparkSession.createDataFrame(branches, "rule int, branch int, trigram string, bit long, full long"))
    met = index.join(wanted, "trigram").groupBy("key", "rule", "branch", "full").agg(F.bit_or("bit").alias("bits")).filter("bits = full")
    return met.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine) -> Column:
    """Running totals, by doubling strides: log2(n) linear passes, where a fold that appends to an array is quadratic."""

    def totals(v: Column) -> Column:
        strides = F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

        def step(acc: Column, k: Column) -> Column:
            stride = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(acc, lambda x, i: F.when(i >= stride, combine(x, F.get(acc, i - stride))).otherwise(x))

        return F.aggregate(strides, v, step)

    return bound(values, totals)


def matches(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, kind, end>> of a rule: the text between matches and the matches give the offsets."""
    pattern = F.lit(rule.kept)
    cut = F.struct(F.split(text, rule.kept, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))

    def spans(s: Column) -> Column:
        steps = F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["found"])), s["found"], lambda g, m: F.length(g) + F.length(m))

        def placed(ends: Column) -> Column:
            every = F.transform(s["found"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), F.get(ends, i).alias("end"), F.length(F.get(s["part"], i)).alias("size")))
            return F.transform(F.filter(every, lambda x: x["size"] >= rule.least), lambda x: F.struct(x["start"], x["ord"], x["kind"], x["end"]))

        return bound(running(steps, lambda x, y: x + y), placed)

    return bound(cut, spans)


_SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or what of it is not yet masked, replaced by its kind."""

    def masked(s: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first, last = F.shiftright(a, PIECE.bit_length() - 1), F.shiftright(b - 1, PIECE.bit_length() - 1)
            held = F.array_join(F.slice(s["pieces"], first + 1, last - first + 1), "")
            return F.when(b > a, F.substring(held, a.bitwiseAND(F.lit(PIECE - 1)) + 1, b - a)).otherwise(F.lit(""))

        def one(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(s["ends"], i - 1), F.lit(0))
            return F.when(x["end"] > before, F.concat(piece(before, x["start"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(spans, one), ""), piece(F.element_at(s["ends"], -1), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = F.struct(pieces.alias("pieces"), running(F.transform(spans, lambda x: x["end"]), lambda x, y: F.greatest(x, y)).alias("ends"))
    return F.when(F.size(spans) > 0, bound(cut, masked)).otherwise(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, found_col: str = "found") -> DataFrame:
    """All columns of `docs`, and `found_col`: spans as array<struct<start, ord, kind, end>>, sorted."""
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if q is not None}
    index = postings(docs, id_col, text_col, sorted({t for q in indexed.values() for conj in q for t in conj}))
    hits = materialize(candidates(index, indexed).withColumnRenamed("key", "_tm_key").withColumnRenamed("rules", "_tm_rules"), "candidates")
    keyed = docs.withColumn("_tm_key", row_key(id_col, text_col)).join(F.broadcast(hits) if hits.count() <= HITS else hits, "_tm_key", "left")
    text, empty = F.coalesce(F.col(text_col), F.lit("")), F.array().cast(_SPANS)
    columns = []
    for k, r in enumerate(rules):
        test = text.rlike(r.kept)
        if k in indexed:
            test = (F.coalesce("_tm_rules", F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0) & test
        columns.append(F.when(test, matches(text, r, k)).otherwise(empty))
    return keyed.withColumn(found_col, F.array_sort(F.concat(*columns))).drop("_tm_key", "_tm_rules")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    base = [r.kind for r in RULES if r.base]
    found = scan(docs.select(id_col, text_col), id_col, text_col)
    own = F.filter("found", lambda s: s["kind"].isin(base))
    counts = [F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select(id_col, *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
