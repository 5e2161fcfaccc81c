"""The pipeline's stages against what they are for."""

import random

import corpus_pipeline
from tracemill.llm import neardup


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == first.columns and out.dtypes == first.dtypes, name
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert after.keys() <= before.keys() and out.count() == len(after)
        if name == "language":
            assert all(any(c.isalpha() for c in t) for t in after.values())
        if name == "near_duplicates":
            assert len(after) < len(before)
        if name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert not any(i in t for i in items for t in after.values())
        if name == "mask_secrets":
            assert after.keys() == before.keys() and all(r.n_chars == len(r.text) for r in out.collect())
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert 0 < len(rows) < 200 and all(r.n_tokens == len(r.ids) for r in rows)


def test_edges_extra_columns_and_empty(spark, sf_dir):
    """Nulls, repeated rows and columns named like an operator's own pass through every stage."""
    rows = [(1, "some words here", None, "s", None, 0.5, "x"), (1, "some words here", None, "s", None, 0.5, "x"), (2, None, "en", None, 3, None, None), (None, "some words here", "en", "s", 3, None, None), (None, None, None, None, None, None, None), (3, "12345", "en", "s", 5, 0.1, "y"), (4, "token = abcdef123456", "en", "s", 5, 0.1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, found string")
    wanted = {"language": [None, 1, 1, 4], "near_duplicates": [None, 1, 4], "decontaminate": [None, 1, 4], "mask_secrets": [None, 1, 4]}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = stage(spark, now, sf_dir)
        got = out.collect()
        assert out.columns == docs.columns
        assert sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x) == wanted[name], name
        now = spark.createDataFrame(got, docs.schema)
    masked = [r for r in now.collect() if r.doc_id == 4][0]
    assert masked.text == "[assign]" and masked.n_chars == 8 and masked.found == "y"
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, now, sf_dir).count() == 3 and last(spark, docs.limit(0), sf_dir).count() == 0


def test_near_duplicates_finds_every_pair_of_similarity_0_8(spark, sf_dir):
    """Planted copies of similarity about 0.5 to 0.95, chains, boilerplate and short texts against brute force."""
    rng = random.Random(8)
    texts = ["one two three", "One  two three", "one two three four", "", "a b c d e"]
    for k in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 200]))] + ["the same licence line under every text"] * (k % 2)
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            words = list(words)
            for _ in range(rng.randrange(1, 1 + max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))

    def root(i):
        return i if top[i] == i else root(top[i])

    found = []
    for i in range(len(texts)):
        for j in range(i):
            common, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or 10 * common >= 8 * every > 0:
                found.append(common / every if every else 1.0)
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    assert sum(0.8 <= s < 0.95 for s in found) >= 20
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert got == {k for k in range(len(texts)) if root(k) == k}


def test_decontaminate_takes_rows_without_an_id(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, f"before {item} after"), (None, "clean words without an id"), (1, f"{item} again"), (2, "clean words"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.decontaminate(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {rows[1], rows[3], rows[4]}


def test_long_texts_pass_all_stages(spark, sf_dir):
    """Texts of several hundred thousand characters: of prose, of one word, with a secret and with a benchmark passage."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rng = random.Random(1)
    prose = lambda seed, n=60_000: " ".join(f"word{random.Random(seed + k).randrange(5000)}" for k in range(n))
    first = prose(1)
    texts = {1: first, 2: first.replace("word7 ", "word8 "), 3: prose(200_000), 4: "x" * 400_000, 5: f"{prose(400_000)} {item} {prose(600_000)}", 6: prose(800_000, 20_000) + " token=abcdef123456 " + "0123456789abcdef" * 10_000, 7: "1 " * 200_000, 8: "".join(rng.choices("ab ", k=300_000))}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = {"language": {1, 2, 3, 4, 5, 6, 8}, "near_duplicates": {1, 3, 4, 5, 6, 8}, "decontaminate": {1, 3, 4, 6, 8}, "mask_secrets": {1, 3, 4, 6, 8}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf_dir).collect()
        assert {r.doc_id for r in rows} == kept[name], name
        docs = spark.createDataFrame(rows, docs.schema)
    masked = {r.doc_id: r.text for r in docs.collect()}[6]
    assert masked.endswith(" [assign] [hex]") and len(masked) < 250_000
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == 5


def test_near_duplicates_judges_every_text_of_an_id(spark, sf_dir):
    """One id on several texts, in any order of the rows, and repeated rows that differ in another column."""
    copy, other = "the words of a copy that is there twice", "words that nobody else has at all"
    rows = [(0, copy, "a"), (1, copy, "a"), (1, other, "a"), (2, other + " but for these many more words here", "b"), (2, copy, "c"), (5, "again and again", "y"), (5, "again and again", "x")]
    wanted = {(0, copy, "a"), (1, other, "a"), (2, other + " but for these many more words here", "b"), (5, "again and again", "x")}
    for k in range(4):
        random.Random(k).shuffle(rows)
        docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(1 + k)
        got = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
        assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted(wanted)


def test_a_shingle_in_a_third_of_many_texts(spark, sf_dir):
    """A line that a third of 20,000 texts share makes no group of them, and their planted copies are found."""
    rng = random.Random(4)
    line = "every right is reserved by the owner of this page"
    texts = [" ".join(f"v{rng.randrange(3000)}" for _ in range(12)) + (f" {line}" if k % 3 == 0 else "") for k in range(20_000)]
    copies = {k: texts[k] for k in range(0, 3000, 100)}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in [*enumerate(texts), *((20_000 + k, t) for k, t in copies.items())]], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).select("doc_id").collect()}
    assert got == set(range(20_000))


def test_near_texts_meet_without_copies_of_tiles(spark):
    """Each fingerprint is dealt four times, however many there are, and those three bits apart still meet."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = neardup.nearest(spark.createDataFrame(list(zip(signed, range(600), strict=True)), "fp long, rep long"), 12)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()
    near = {frozenset((r.a, r.b)) for r in found.collect()}
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 12 for a, b in near)
    assert {frozenset((k, k + 300)) for k in range(300)} <= near


def test_batches_are_small_and_memory_is_given_back(spark, sf_dir, monkeypatch):
    """Stages with workers lower the texts of a batch, and a task ends by giving back what it freed."""
    from tracemill.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for given, left in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("100", 100)):
            spark.conf.set(name, given)
            corpus_pipeline.encode(spark, docs, sf_dir)
            assert int(spark.conf.get(name)) == left
    finally:
        spark.conf.set(name, before)
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.released(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and calls == [1]
