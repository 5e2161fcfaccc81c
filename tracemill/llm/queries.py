"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepairs, decontam, langid, lattice, lexical, neardup, pieces, pii, resample, rollups, runs, secrets, topk
from .common import fold, materialize, shared_path, table

PIECES, RANKS, MULTI_RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """A vocabulary file: in the folder that spark.tracemill.tokenizers names, else that of the public package."""
    folder = spark.conf.get("spark.tracemill.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7, 2)
    scorer = lattice.learn(docs, pieces.PieceModel.load(tokenizer_path(spark, PIECES)), ~held_out, beside=1)
    scored = lattice.score(docs, scorer)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(scorer.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "fitted_score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs)).drop("redacted")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_documents(docs, pieces.PieceModel.load(tokenizer_path(spark, PIECES)), with_ids=False)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _secrets_sql() -> str:
    """Matches by rule, their offsets from the lengths of what lies between them, and the digests of the spans."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        # letters spelt out in both cases: the engines differ in how they fold other alphabets
        key = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
        pattern = (r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", key)).replace("'", "''")
        parts.append(f"SELECT id, doc_id, '{r.kind}' AS kind, {k} AS ord, {r.least} AS least, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, regexp_split_to_array(t, '{pattern}') AS s FROM d")
    base = [r.kind for r in secrets.RULES if r.base]
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)
    listed = "coalesce(string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, ord){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents), x AS ({' UNION ALL '.join(parts)}),
u AS (SELECT id, kind, ord, least, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM x),
v AS (SELECT id, kind, ord, CAST(list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM u WHERE length(g[i]) >= least),
w AS (SELECT id, kind, ord, a, a + n AS e FROM v)
SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256({listed.format(" FILTER (WHERE kind IN ('" + "', '".join(base) + "'))")}) AS base_sha256, {listed.format(" FILTER (WHERE kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN w USING (id) GROUP BY id
"""


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(langid.training_rows(docs))
    # the prediction sees the text alone; the id passes by
    return langid.predict(docs.select("doc_id", "text"), profiles).select("doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def _crc32(number: str) -> str:
    """SQL of crc32 over the digits of a number."""
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))"
    byte = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda a, b: {byte}), 4294967295)"


def _langid_sql() -> str:
    """Ranked n-grams of languages and documents, and the sum of their distances."""
    size = langid.PROFILE
    code = lambda c: f"CASE WHEN {c} = ' ' THEN 1 ELSE CAST(unicode({c}) AS BIGINT) END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, lang, text, coalesce({_crc32('doc_id')} % 4 = 2, false) AS held_out, regexp_replace(lower(text), '[^\\p{{L}}]', ' ', 'g') AS low FROM documents),
c AS (SELECT id, string_split(' ' || low || '  ', '') AS s FROM d WHERE regexp_matches(low, '\\p{{L}}')),
t AS (SELECT id, unnest(list_zip(s[1:len(s) - 2], s[2:len(s) - 1], s[3:])) AS z FROM c), p AS (SELECT id, z[1] AS x, z[2] AS y, z[3] AS w FROM t), k AS (SELECT id, x, y, w, {code('x')} AS a, {code('y')} AS b, {code('w')} AS e FROM p WHERE y <> ' ' OR x <> ' '),
g AS (SELECT id, b AS gram FROM k WHERE y <> ' ' UNION ALL SELECT id, a * 2097152 + b FROM k UNION ALL SELECT id, (a * 2097152 + b) * 2097152 + e FROM k WHERE y <> ' '),
n AS MATERIALIZED (SELECT id, gram, count(*) AS n FROM g GROUP BY ALL), own AS (SELECT id, gram, r - 1 AS place FROM (SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY n DESC, gram) AS r FROM n) z WHERE r <= {size}),
f AS (SELECT lang, gram, r - 1 AS rank FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) AS r FROM n JOIN d USING (id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram) z WHERE r <= {size}),
names AS (SELECT DISTINCT lang AS name FROM f), known AS (SELECT DISTINCT gram FROM f),
m AS (SELECT id, name, sum(CASE WHEN known.gram IS NULL THEN {size} ELSE abs(coalesce(rank, {size}) - place) END) AS distance, count(*) AS size FROM own CROSS JOIN names LEFT JOIN known ON known.gram = own.gram LEFT JOIN f ON f.gram = own.gram AND f.lang = name GROUP BY id, name),
best AS (SELECT id, min_by(name, lpad(CAST(distance AS VARCHAR), 12, '0') || name) AS name, min(distance) AS distance, any_value(size) AS size FROM m GROUP BY id)
SELECT doc_id, held_out, coalesce(name, '{langid.UND}') AS lang_pred, CASE WHEN distance < {size} * size THEN 1 - CAST(distance AS DOUBLE) / ({size} * size) ELSE 0e0 END AS score FROM d LEFT JOIN best USING (id)
"""


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _decontam_sql() -> str:
    """The weighted similarity of every window of an item's length that shares a shingle with the item."""
    cut = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {cut} AS ws FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id, {cut} AS ws FROM benchmark WHERE text IS NOT NULL),
it AS (SELECT item_id, ws, len(ws) AS size, least({decontam.SHINGLE}, len(ws)) AS g FROM i WHERE len(ws) > 0), gs AS (SELECT DISTINCT g FROM it),
ds AS (SELECT doc_id, ws AS dw, g, len(ws) - g + 1 AS total, unnest(range(0, len(ws) - g + 1)) AS pos FROM d, gs WHERE len(ws) >= g), dx AS (SELECT doc_id, dw, g, total, pos, array_to_string(dw[pos + 1:pos + g], ' ') AS sh FROM ds),
ns AS (SELECT item_id, ws AS iw, size, g, size - g + 1 AS n, array_to_string(ws[p + 1:p + g], ' ') AS sh FROM (SELECT *, unnest(range(0, size - g + 1)) AS p FROM it) z), nx AS (SELECT item_id, iw, size, g, n, sh, count(*) AS c FROM ns GROUP BY ALL),
hit AS MATERIALIZED (SELECT doc_id, md5(array_to_string(dw, ' ')) AS own, item_id, md5(array_to_string(iw, ' ')) AS item, size, n, least(n, total) AS length, total, pos, sh, c FROM dx JOIN nx USING (g, sh)),
st AS (SELECT DISTINCT doc_id, own, item_id, item, size, n, length, unnest(range(greatest(0, pos - length + 1), least(pos, total - length) + 1)) AS s FROM hit),
w AS (SELECT st.doc_id, st.own, st.item_id, st.item, st.size, st.n, st.length, s, sh, least(count(*), any_value(c)) AS m FROM st JOIN hit ON hit.doc_id IS NOT DISTINCT FROM st.doc_id AND hit.own = st.own AND hit.item_id IS NOT DISTINCT FROM st.item_id AND hit.item = st.item AND pos >= s AND pos < s + st.length GROUP BY ALL),
v AS (SELECT doc_id, own, item_id, item, size, s, sum(m) / CAST(any_value(length) + any_value(n) - sum(m) AS DOUBLE) AS sim FROM w GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, s, size DESC) AS r FROM v WHERE sim >= {decontam.SIMILARITY})
SELECT doc_id, item_id, s AS window_start, size AS window_words, sim AS similarity FROM b WHERE r = 1
"""


def op9_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted; a fifth revised, their texts turned round and longer by their source; a seventh of all deleted as they then are; the first batch replayed, which must change nothing."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    turned = F.concat_ws(" ", F.reverse(F.split("text", " ")), F.col("source"))
    both = docs.select("*", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("state")).withColumn("revised", fold(F.col("doc_id"), 5, 1)).withColumn("dropped", fold(F.col("doc_id"), 7, 3))
    both = both.filter("state = 'before' or revised").withColumn("text", F.when(F.col("state") == "after", turned).otherwise(F.col("text")))
    counted = rollups.count_tokens(both, tokenizer_path(spark, RANKS), public_tokenizers.PATTERN, "byte_bpe_50k")
    counted = materialize(counted.select(*rollups.GROUP, "tokens", "state", "revised", "dropped"), "counted")
    before, after = counted.filter("state = 'before'"), counted.filter("state = 'after'")
    now = before.filter("not revised").unionByName(after)
    roll = rollups.Rollup(spark, shared_path(spark, "rollup"))
    for batch, rows in (("load", rollups.inserts(before)), ("revise", rollups.revisions(before.filter("revised"), after)), ("drop", rollups.deletes(now.filter("dropped"))), ("load", rollups.inserts(before))):
        roll.apply(batch, rows)
    return roll.totals()


def op10_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return resample.resample(docs, good)


def op11_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytepairs.encode_documents(docs, bytepairs.Vocabulary.load(tokenizer_path(spark, MULTI_RANKS)), public_tokenizers.PATTERN, with_ids=False)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark WHERE text IS NOT NULL GROUP BY item_id),
s AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(ts) AS t FROM i) z GROUP BY ALL),
p AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) z WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY t),
x AS (SELECT item_id, row, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN p USING (t), s GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), change=runs.planted, full=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lattice, op2_topk, op3_pii, op4_pieces, op5_secrets, op6_neardup, op7_langid, op8_decontam, op9_rollups, op10_resample, op11_bytepairs, op12_lexical, op13_periodic)
}
ORACLE_SQL: dict[str, str] = {"op2_topk": OP2_SQL, "op5_secrets": _secrets_sql(), "op7_langid": _langid_sql(), "op8_decontam": _decontam_sql(), "op12_lexical": OP12_SQL}
