"""Byte-level BPE against the public library."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_contracts import documents, edge, empty, place  # noqa: F401  fixtures
from tracemill.llm import bytepairs, queries

PATH = public_tokenizers.path(queries.MULTI_RANKS)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bytepairs.Vocabulary.load(PATH)


def row(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_op11(spark, place, library):  # noqa: F811
    got = Counter(tuple(r) for r in queries.op11_bytepairs(spark, place).collect())
    assert got == Counter((i, *row(library, t)) for i, t in documents(spark, place))


def test_op11_on_an_empty_table(spark, empty):  # noqa: F811
    assert queries.op11_bytepairs(spark, empty).count() == 0


def odd_texts():
    rng = random.Random(11)
    spaces = [" ", " ", "  ", "\n", " \n", "\n ", "\t", " ", " ", "　", "\x1c", "\x85", "\r\n", "   "]
    words = ["word", "ärger", "Привет", "数字", "12", "٣٤", "don't", "we'LL", "'s", "…", "====", "👍🏽", "a_b", "x", "", "ﬁ", "é", "<|endoftext|>"]
    texts = ["".join(rng.choice(words) + rng.choice(spaces) * rng.randrange(3) for _ in range(rng.randrange(30))) for _ in range(300)]
    long = ["=" * 5000, " " * 3000, "ab" * 2000, "abc" * 1500, "".join(rng.choices("abcdefgh", k=6000)), "".join(rng.choices("etaoinshrdlu", k=4000)), "\n" * 1000, "数" * 700, "x" * 513, "9" * 2000, "\U0001f600" * 400]
    return texts + long + [f"before {x} after" for x in long]


def test_odd_texts_ids_and_decoding(spark, library, vocabulary, monkeypatch):
    """White space of all kinds, scripts, long words with and without a repeated part; numbering that begins anew."""
    monkeypatch.setattr(bytepairs, "WORDS", 200)
    texts = odd_texts()
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, codes string").repartition(2)
    rows = bytepairs.encode_documents(frame, vocabulary, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == want and bytes(r.decoded) == texts[r.doc_id].encode() and (r.n_tokens, r.ids_sha256, r.decoded_sha256) == row(library, texts[r.doc_id])


def test_fold_and_decode_of_columns(spark, library, vocabulary):
    words = [" the", "Hello", " ciónadoñado", "==========", "x", "", "数字", "\n\n"]
    frame = spark.createDataFrame([(w, list(w.encode())) for w in words], "w string, bytes array<int>")
    rows = frame.select("w", bytepairs.fold(F.col("bytes"), vocabulary).alias("ids")).withColumn("back", bytepairs.decoded(F.col("ids"), vocabulary)).collect()
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(r.w) and bytes(r.back).decode() == r.w


def test_windows_without_a_common_token_are_merged_whole(vocabulary, library):
    sizes = [len(p) for p in vocabulary.pieces]
    assert bytepairs.stitched([library.encode_ordinary("aaaa"), library.encode_ordinary("bbbb")], sizes) is None
    for text in ("abcabcabc" * 50, "".join(random.Random(2).choices("lmnop", k=700))):
        ids = [library.encode_single_token(bytes([b])) for b in text.encode()]
        assert bytepairs.merged(ids, vocabulary.pairs) == library.encode_ordinary(text)


def test_a_vocabulary_that_merging_does_not_reach_is_refused(tmp_path):
    lines = [*(bytes([b]) for b in range(256)), b"abcd"]
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % k for k, p in enumerate(lines)))
    with pytest.raises(ValueError):
        bytepairs.Vocabulary.load(str(tmp_path / "ranks"))


def test_two_bytes_begin_as_what_they_make(spark, vocabulary):
    """The states that a fold begins with are literals: each byte before each other one, and before none."""
    states = bytepairs.literal_map(vocabulary)[0]
    found = spark.range(1).select(states.alias("s")).first().s
    single = {p[0]: i for i, p in enumerate(vocabulary.pieces) if len(p) == 1}
    none = 2**31 - 1
    assert found == [vocabulary.pairs.get((single[a], single.get(b)), none) << 32 | single[a] for a in range(256) for b in range(257)]


def test_ranks_that_words_hold(vocabulary):
    """Every piece of two bytes or more among a word's bytes, ascending, each once; by all of its substrings."""
    ranks = {vocabulary.pieces[r]: r for r in vocabulary.pairs.values()}
    rng = random.Random(5)
    words = [" the", "Hello", "aaaaaaa", "x", "数字", "...", "====" * 40, *("".join(rng.choices(" etaoinsé數", k=rng.randrange(1, 12))) for _ in range(300))]
    words = [b"", *(w.encode() for w in words), b""]
    want = [sorted({ranks[w[a:b]] for a in range(len(w)) for b in range(a + 2, len(w) + 1) if w[a:b] in ranks}) for w in words]
    known = bytepairs.prefixes(vocabulary)
    assert bytepairs.held(words, known).to_pylist() == want and bytepairs.held([], known).to_pylist() == []
    bare = bytepairs.Vocabulary(tuple(bytes([b]) for b in range(256)), {})
    assert bytepairs.held(words, bytepairs.prefixes(bare)).to_pylist() == [[] for _ in words]


def test_a_step_of_the_fold_is_one_replacement(spark, sf_dir):
    """The query folds over ranks, each by one replacement; it doesn't look for the lowest pair at every step."""
    plan = queries.op11_bytepairs(spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "replace(" in plan and "aggregate(" in plan and "array_min" not in plan and "array_position" not in plan


def test_characters_of_tokens():
    import pyarrow as pa

    ids = [0, 44, 255, 0xD800 - 257, 0xD800 - 256, 0xD800, 0xDFFF, 0xFFFF, 200_000]
    assert bytepairs.tokens(pa.array(["".join(map(bytepairs.char, ids[:4])), "", "".join(map(bytepairs.char, ids[4:]))])).tolist() == ids
