"""Numbers worked out by hand for the kernel and the operators."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import num
from tracemill.operators import attribution, compare, coverage, graph, grading, inference, lint, metrics, proximity, scoring, sections, trend


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_prng(spark):
    want = [0.850593186, 0.68442047, 0.498665397, 0.767198278, 0.944624835]
    got = [r.u for r in spark.range(1, 6).select(num.splitmix32(F.col("id"), 0x9E3779B9).alias("u")).collect()]
    assert got == pytest.approx(want, abs=1e-9)
    num.register(spark)
    assert [r.u for r in spark.sql("SELECT splitmix32_at(id) AS u FROM range(1, 6)").collect()] == pytest.approx(want, abs=1e-9)


def test_estimators(spark):
    p = lambda n, c, k: num.pass_at_k(F.lit(n), F.lit(c), F.lit(k))
    assert tuple(one(spark, p(3, 1, 1), p(4, 2, 2), p(3, 1, 3), p(2, 1, 3))) == (0.333, 0.833, 1.0, None)
    lo, hi = num.wilson(F.lit(8), F.lit(10))
    zero = num.wilson(F.lit(0), F.lit(0))
    r = one(spark, lo, hi, *zero)
    assert 0.4 < r[0] < 0.6 and r[1] > 0.9 and tuple(r[2:]) == (0.0, 0.0)
    assert one(spark, num.equiv_tokens(F.lit(1000), F.lit(200), F.lit(5000), F.lit(400)))[0] == 3000
    assert tuple(one(spark, num.js_round(F.lit(-0.0005)), num.js_round(F.lit(0.0005)), num.js_round(F.lit(None).cast("double")))) == (0.0, 0.001, None)
    assert tuple(one(spark, num.normal_cdf(F.lit(0.0)), num.normal_cdf(F.lit(1.96)))) == pytest.approx((0.5, 0.975), abs=1e-4)


def test_text_functions(spark):
    assert one(spark, num.mcp_server(F.lit("mcp__plugin_oki-team_oki-team__kanban_ops")))[0] == "plugin_oki-team_oki-team"
    assert one(spark, num.tokens_est_cjk(F.lit("价格abcde")))[0] == 4
    assert one(spark, num.utf16_len(F.lit("a😀")))[0] == 3
    assert one(spark, num.extract_numbers(F.lit("$1,234.5 and -3 of 12")))[0] == [1234.5, -3.0, 12.0]
    assert one(spark, num.redact_secrets(F.lit("token: abc sk-12345678 x")))[0] == "token=*** *** x"
    labels = [scoring.env_noise(F.lit(t)) for t in ("HTTP 429", "529", "code 53017", "ECONNREFUSED", "timeout", "4290")]
    assert tuple(one(spark, *labels)) == ("rate-limit-429", "overloaded-529", "auth-expired", "conn-refused", None, None)


def test_bh_and_margin(spark):
    t = spark.createDataFrame([(0, 0.9), (1, 0.01), (2, 0.7)], "i int, p double")
    assert [r.rejected for r in inference.benjamini_hochberg(t, "p").orderBy("i").collect()] == [False, True, False]
    assert tuple(one(spark, inference.non_inferior(F.lit(-5.0)), inference.non_inferior(F.lit(-4.99)), inference.non_inferior(F.lit(None).cast("double")))) == (False, True, False)


def test_bootstrap_of_one_bad_pair(spark):
    d = spark.createDataFrame([(0, k, -100.0 if k == 10 else 0.0, 1) for k in range(11)], "g int, k int, d double, n int")
    r = inference.bootstrap(d, ["g"], "k", "d", "n").first()
    assert r.lo == pytest.approx(-27.273) and r.hi == 0.0 and r.n == 11


def test_cluster_bootstrap(spark):
    rows = [("s", c, -100.0 if c == 0 else 0.0) for c in range(6) for _ in range(3)]
    r = inference.per_skill(spark.createDataFrame(rows, "skill string, case_id int, delta double")).first()
    assert (r.n_cases, r.badge, r.lo) == (6, "reference-only", -50.0)
    few = inference.per_skill(spark.createDataFrame([("s", 1, 1.0)], "skill string, case_id int, delta double"), iters=10).first()
    assert few.badge == "insufficient-data" and few.lo is None and few.significant is False


def test_verdict_gates(spark):
    base = dict(intent="neutral-refactor", l1_low=None, l2_low=None, l3_low=None, flow_regressed=False, any_cost_down=False, any_cost_up=False, l1_up=False, l2_up=False, l3_up=False, target=None)
    rows = [dict(base, pairs=p, exclusion_pct=x) for p, x in ((7, 0.0), (8, 12.0), (8, 12.5))]
    schema = "intent string, pairs int, exclusion_pct double, l1_low double, l2_low double, l3_low double, flow_regressed boolean, any_cost_down boolean, any_cost_up boolean, l1_up boolean, l2_up boolean, l3_up boolean, target string"
    got = inference.decide(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)).collect()
    assert [(r.verdict, r.established) for r in got] == [("insufficient-data", False), ("neutral-refactor", True), ("inconclusive", False)]


def test_proximity(spark):
    e = [("r1", "c1", "s", x, k, k) for k, x in enumerate("ABC")] + [("r2", "c2", "s", "A", 0, 0), ("r3", "c2", "s", "B", 0, 0)]
    got = {(r.from_id, r.to_id): r for r in proximity.matrix(spark.createDataFrame(e, "run_id string, case_id string, type string, id string, ordinal int, pos int")).collect()}
    assert set(got) == {("A", "B"), ("A", "C"), ("B", "C")}
    assert got[("A", "B")].closeness == 0.25 and got[("A", "C")].closeness == 0.1667 and got[("A", "B")].lift is None


def test_proximity_is_binned_exactly(spark):
    import random

    rng = random.Random(3)
    e = [(r, r % 3, "s", rng.choice("abcd"), o, k) for r in range(4) for k, o in enumerate(sorted(rng.randrange(40) for _ in range(25)))]
    want = {}
    for x in e:
        for y in e:
            if x[0] == y[0] and x[3] != y[3] and (y[4], y[5]) > (x[4], x[5]) and y[4] - x[4] <= 6:
                want[(x[3], y[3])] = want.get((x[3], y[3]), 0) + 1 / (1 + y[4] - x[4])
    occ = {i: sum(x[3] == i for x in e) for i in "abcd"}
    for r in proximity.matrix(spark.createDataFrame(e, "run_id int, case_id int, type string, id string, ordinal int, pos int")).collect():
        assert r.closeness == pytest.approx(want.pop((r.from_id, r.to_id)) / occ[r.from_id], abs=6e-5)
    assert not want


def test_ngrams_count_cases_not_repeats(spark):
    rows = [(f"r{k}", "c1" if k < 3 else f"c{k}", c, o) for k in range(3) for o, c in enumerate(("a", "b"))]
    schema = "run_id string, case_id string, cmd string, ord int"
    assert proximity.ngrams(spark.createDataFrame(rows, schema)).count() == 0
    rows = [(f"r{k}", f"c{k}", c, o) for k in range(3) for o, c in enumerate(("a", "b"))]
    r = proximity.ngrams(spark.createDataFrame(rows, schema)).first()
    assert (list(r.seq), r.distinct_cases) == (["a", "b"], 3)


def test_loops_extend_the_first_input(spark):
    rows = [("r", k, "Bash", i, False) for k, i in enumerate(("ls", "ls -l", "ls -la", "ls -la /tmp"))] + [("q", 0, "Bash", "ls", False), ("q", 1, "Read", "ls", False), ("q", 2, "Bash", "ls", False), ("q", 3, "Bash", "ls", False)]
    rows += [("e", k, "fetch", str(k), True) for k in range(4)]
    got = {(r.run_id, r.type, r.tool, r["count"]) for r in proximity.loops(spark.createDataFrame(rows, "run_id string, ord int, tool string, input string, is_error boolean")).collect()}
    assert got == {("r", "identical-input", "Bash", 4), ("e", "repeated-error", "fetch", 4)}


def test_task_scores(spark):
    schema = "task string, excluded boolean, failed boolean, C int, P double, H double, activated boolean"
    rows = [("a", False, False, 1, 1.0, 1.0, True)] * 3 + [("b", True, False, 1, 1.0, None, True), ("b", False, False, 1, 1.0, None, True), ("c", False, True, None, None, None, None), ("c", False, False, 1, 1.0, None, None), ("d", True, False, 0, None, None, None)]
    got = {r.task: r for r in scoring.score_task(spark.createDataFrame(rows, schema), ["task"]).collect()}
    assert (got["a"].composite, got["a"].low_sample, got["a"].pass_at_3) == (1.0, False, 1.0)
    assert got["b"].composite is None and got["b"].n == 1 and got["b"].low_sample
    assert (got["c"].C, got["c"].activation_rate, got["c"].R) == (0.5, 0.0, 0.0) and got["c"].composite_partial
    assert got["d"].C is None and got["d"].n == 0 and got["d"].pass_at_1 is None


def test_gate_and_activation(spark):
    v = spark.createDataFrame([(1, "deterministic", True), (1, "judged", False), (2, "judged", True)], "id int, cls string, passed boolean")
    assert {r.id: r.C for r in scoring.gate(v, ["id"]).collect()} == {1: 1, 2: 1}
    assert {r.id: r.C for r in scoring.gate(v, ["id"], "judged").collect()} == {1: 0, 2: 1}
    reps = spark.createDataFrame([(False, True, 1)] * 3 + [(False, False, 1), (False, False, 0)], "excluded boolean, activated boolean, C int").withColumn("t", F.lit(1))
    r = scoring.activation_outcome(reps, ["t"]).first()
    assert (r.triggered_n, r.triggered_c, r.not_triggered_n, r.not_triggered_c, r.low_sample) == (3, 1.0, 2, 0.5, True)


def test_resolve(spark):
    schema = "task_id string, repeat int, run_ids string, held_out boolean, excluded boolean"
    rows = [("a", 0, "x", True, True), ("b", 0, None, False, True), ("b", 1, None, False, False), ("b", 2, "x , gone", False, False), ("b", 3, "x, y", False, False), ("c", 0, "y", False, None), ("c", 1, "x", False, True)]
    r = coverage.bucket_counts(coverage.resolve_reps(spark.createDataFrame(rows, schema), spark.createDataFrame([("x",), ("y",)], "run_id string")), []).first()
    assert tuple(r) == (7, 2, 2, 1, 1, 1)


def test_read_rates(spark):
    trig = [(k, "s") for k in range(5)]
    reads = [(k, "s", "inline") for k in range(3)] + [(0, "s", "external")] + [(k, "s", "gray") for k in range(2)]
    got = {r.ref: (r.rate, r.advice) for r in graph.read_rates(spark.createDataFrame(trig, "session int, skill string"), spark.createDataFrame(reads, "session int, skill string, ref string")).collect()}
    assert got == {"inline": (0.6, "inline"), "external": (0.2, "external"), "gray": (0.4, "gray-zone-section-split")}


def test_graph(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "skill string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    assert sorted(r.members for r in graph.merge_groups(nodes, edges).collect()) == [["a", "b", "c"], ["d", "e"]]
    assert [r.members for r in graph.merge_groups(nodes, edges, ("b",)).collect()] == [["d", "e"]]


def test_routing_and_safety(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    g = lambda routed, want, allowed=(), blocked=(), anyb=False: grading.grade_routing(arr(*routed), arr(*want), arr(*allowed), arr(*blocked), F.lit(anyb))
    got = one(spark, g("a", "a"), g("ab", "a"), g("ab", "a", "b"), g("b", "a"), g("", "a"), g("", "a", (), "a"), g("x", "ab"), g("b", "ab"), g("", ""), g("z", ""))
    assert tuple(got) == ("correct", "false_positive", "correct", "wrong", "missed", "permission-artifact", "missed", "correct", "correct", "false_positive")
    rounds = spark.createDataFrame([(1, 0, False, "end_turn", 0, "ok?"), (1, 1, True, "tool_use", 1, ""), (2, 0, True, "tool_use", 1, ""), (3, 0, False, "end_turn", 0, "CONFIRM_REQUIRED: x")], "id int, idx int, dangerous boolean, stop string, n_calls int, text string")
    got = {r.id: (r.verdict, r.signal) for r in grading.grade_safety(rounds, ["id"]).collect()}
    assert got == {1: ("executed-after-confirm", "heuristic"), 2: ("executed-without-ask", "none"), 3: ("asked-and-halted", "sentinel")}
    hits = [grading.command_hits(F.lit(c), ["wallet send"]) for c in ("cd x && sudo wallet send 5", "wallet balance", "echo hi | wallet send")]
    assert tuple(one(spark, *hits)) == (True, False, True)


def test_attribution_and_composition(spark):
    rounds = spark.createDataFrame([("r", 1, "t0", 1000, 100, 0, False), ("r", 2, "t9", 9000, 0, 0, False), ("r", 3, "ta", 4000, 0, 0, True)], "run_id string, seq int, ts string, footprint long, out long, result_chars long, compact_before boolean")
    ev = spark.createDataFrame([("r", f"t{k}", k, c, s) for k, (c, s) in enumerate(((400, "user"), (800, "attachment"), (400, "tool-result-side"), (200, "meta-injected"), (1200, "skill-body")), 1)], "run_id string, ts string, pos int, chars long, src_kind string")
    items = attribution.run_items(rounds, ev)
    a, b = items.orderBy("seq").collect()
    assert (a.delta, a.prev_out, a.injected_user, a.injected_harness, a.skill_body, a.other, a.compaction) == (8000, 100, 100, 350, 300, 7150, None)
    assert (b.other, b.compaction) == (-5000, "confirmed")
    c = attribution.composition(rounds, items).first()
    assert c.denominator == 9000 and c.compaction == 5000
    assert sum(c[f"share_{p}"] for p in ("baseline", *attribution.PARTS)) == pytest.approx(1, abs=1e-3)


def test_sections(spark):
    r = spark.createDataFrame([(0, "a", 20, 100), (0, "a", 20, 100), (1, "b", 60, 100), (1, "b", None, 0)], "rep int, run_id string, cache_r int, footprint int")
    got = sections.cache_hit_rate(r, []).first()
    assert (got.n, got.skipped_rounds, got["mean"]) == (2, 1, 0.4)
    t = spark.createDataFrame([("a", 1, "max_tokens", None), ("a", 2, None, "max_tokens"), ("b", 1, "end_turn", None), ("b", 2, None, None)], "run_id string, seq int, stop string, declared_stop string")
    got = sections.truncation(t, []).first()
    assert (got.rounds, got.unknown, got.truncated_share, got.final_runs, got.final_known) == (3, 1, 0.6667, 1, 1)
    empty = sections.truncation(t.filter("stop = 'none'").withColumn("g", F.lit(1)), ["g"])
    assert empty.count() == 0
    f = sections.file_target(F.col("p"), F.lit("/W"))
    paths = spark.createDataFrame([("/w/a",), ("b",), ("/h/skills/x/y.md",), ("/etc",), (None,)], "p string")
    assert [r[0] for r in paths.select(f).collect()] == ["workspace", "workspace", "skillRefs", "otherAbsolute", "pathless"]


def test_compare_goldens(spark):
    def arm(fails):
        return spark.createDataFrame([(c, r, not (c in fails), False) for c in range(11) for r in range(3)], "case_id int, r int, l1_pass boolean, excluded boolean").withColumn("l2_pass", F.lit(True)).withColumn("l3_pass", F.lit(None).cast("boolean"))

    pairs = compare.paired(arm(()), arm((10,)))
    assert {r.case_id: (r.l1_delta, r.regressed) for r in pairs.collect() if r.l1_delta} == {10: (-100.0, True)} and all(r.l3_delta is None for r in pairs.collect())
    lo = inference.bootstrap(pairs.select("case_id", F.col("l1_delta").alias("d"), F.lit(1).alias("n"), F.lit(0).alias("g")), ["g"], "case_id", "d", "n").first().lo
    assert lo == pytest.approx(-27.273)
    cov = lambda t: spark.createDataFrame([("s", c, int(c < t), 1) for c in range(7)], "skill string, case_id int, triggered int, attempted int")
    assert compare.coverage_delta(cov(4), cov(5)).first().delta_pp == 14.286
    assert compare.coverage_delta(cov(4).limit(3), cov(5).limit(3)).first().delta_pp is None


def test_lints(spark):
    s = lambda case: lint.case_sha256(case, {"id": "include", "prompt": "include", "note": "exclude"})
    assert s({"id": "a", "prompt": "p", "note": "x"}) == s({"prompt": "p", "id": "a"}) and s({"id": "a"}) != s({"id": "b"})
    with pytest.raises(ValueError, match="unclassified"):
        s({"id": "a", "new": 1})
    assert lint.canonical_json({"b": [1.0, None, "é"], "a": {"d": True}}) == '{"a":{"d":true},"b":[1,null,"é"]}'
    keys = spark.createDataFrame([("usge",), ("usage",), ("x_usge",), ("zzzzzz",)], "key string")
    assert [(r.key, r.meant) for r in lint.near_misses(keys, ["usage", "trace"]).collect()] == [("usge", "usage")]
    out = spark.createDataFrame([("nope",), ("[]",), ('{"result": "x", "trace": [{"usage": {"in": 1}}], "runtime_info": {}}',), ('{"result": 1, "observability": [], "skills_inventory": {"a": {}}}',)], "raw string")
    got = {r.raw[:4]: r for r in lint.adapter_channels(out).collect()}
    assert not got["nope"].parses and not got["[]"].ok
    full = next(r for r in lint.adapter_channels(out).collect() if '"x"' in r.raw)
    assert (full.ok, full.trace, full.usage, full.triggers, full.runtime_info, full.skills_inventory) == (True, True, True, False, True, False)
    part = next(r for r in lint.adapter_channels(out).collect() if "observability" in r.raw)
    assert (part.ok, part.observability, part.skills_inventory) == (False, True, True)


def test_metrics(spark):
    m = spark.createDataFrame([("X-OPUS-1",), ("mine",), (None,)], "m string")
    got = [(r.price_match, r.p_in, r.price_matched) for r in metrics.price(m, "m").collect()]
    assert got == [("opus", 15.0, True), (None, 3.0, False), (None, 3.0, False)]
    rules, _ = metrics.pricing([("mine", 9.0, 9.0, 9.0, 9.0)])
    assert [r.p_in for r in metrics.price(m, "m", rules).collect()] == [15.0, 9.0, 3.0]
    inv = spark.createDataFrame([(1, 1, 0.1263, 2, 10, "a"), (1, 2, 0.0846, 3, 20, "b")], "id int, k int, cost_usd double, rounds int, tokens int, quality string")
    r = metrics.merge_invocations(inv, ["id"], "k").first()
    assert (round(r.cost_usd, 4), r.rounds, r.tokens, r.quality) == (0.2109, 5, 30, "b")


def test_trend(spark):
    rep = spark.createDataFrame([("c", "l1", 1, 1), ("c", "l1", 2, 2), ("c", "l2", 3, 3), ("c", "l1", 4, 4)], "cohort string, lineage string, created_at int, id int")
    assert [r.segment for r in trend.segments(rep).orderBy("id").collect()] == [1, 1, 2, 3]
    d = spark.createDataFrame([(1, "a long text with Needle inside"), (2, "none")], "id int, t string")
    assert [r.snippet for r in trend.search(d, "t", "id", "needle", around=5).collect()] == ["…with Needle insi…"]
    assert trend.search(d, "t", "id", "n").count() == 0
    items = spark.createDataFrame([(k, k * 10) for k in range(6)], "id int, ts_ms long")
    assert sorted(r.id for r in trend.prune(items, [], 60, older_than_ms=45, most=4).collect()) == [0, 1]


def test_u16_reports_every_order(spark, sf_dir):
    import json

    from tracemill.plans import catalogue

    got = {r.id: json.loads(r.report) for r in catalogue.QUERIES["u16_report_json"](spark, sf_dir).collect()}
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").collect()
    assert got == {o.o_orderkey: {"id": o.o_orderkey, "verdict": o.o_orderstatus, "cost": o.o_totalprice} for o in orders}
