"""Byte-level BPE encoding and decoding: higher-order functions fold ranked merges over the byte arrays of distinct words.

A text is cut by the vocabulary's pattern; each match, a word, is merged on its own: of all adjacent tokens the pair with
the lowest rank becomes one token, leftmost first, until no pair has a rank.  In a vocabulary that was made by merging,
every token has one last merge, and no other pair of tokens that spell it is ever merged.  So a literal map between pairs of
tokens and the token that they make, which is its rank, is all that a fold needs.  What a merge makes has a higher rank than
its parts, so all merges of one rank come before all of the next, and a rank that was passed never comes again.

The query's fold, `ranked`, is over the ranks in ascending order, of the pieces that a word holds anywhere among its bytes
(no other piece can be made): each step replaces a pair of tokens by what it makes, in a string that has a character for each
token.  `fold` is for columns of byte arrays: it looks for the pair of lowest rank itself.

One pass without a shuffle: workers cut texts and number the distinct words of a task (a new numbering begins after `WORDS`
words, so memory is bounded), each document's row carries the bytes of the words that are new with it and the ranks to try,
Spark folds these, and workers lay the ids of each document side by side; decoding concatenates the binary pieces of the ids.

The fold takes time with the square of a word, so words of over `WINDOW` bytes are folded in windows that overlap.  Two
windows that have a token in common, at the same place, continue each other there: a row of tokens is right if all its
neighbours are, and every pair of neighbours is one of a window's.  Where windows have no common token the word is merged
with a heap.

Defined results: null and empty texts have no ids; repeated rows are encoded each on its own; special tokens are text;
columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared

#: Distinct words that are numbered before a new numbering begins; bytes of a window, and those that it shares with the next; buckets of the literal map.
WORDS, WINDOW, OVERLAP, BUCKETS = 250_000, 512, 256, 4_093
#: White space of the pattern's `\\s`.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE, _LOW = (2**31 - 1) << 32, 2**32 - 1
#: A token's character is its id and this, beyond surrogates.
FIRST, SURROGATES, HIDDEN = 256, 0xD800, 0x800


@dataclass(frozen=True)
class Vocabulary:
    """Binary pieces by id, and for each piece of two bytes or more the pair of ids that makes it."""

    pieces: tuple[bytes, ...]
    pairs: dict[tuple[int, int], int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        pieces = [b""] * (max(ranks.values()) + 1)
        pairs: dict[tuple[int, int], int] = {}
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):  # a pair is known before what is made of it
            pieces[rank] = piece
            if len(piece) > 1:
                parts = merged([ranks[piece[k : k + 1]] for k in range(len(piece))], pairs)
                if len(parts) != 2:
                    raise ValueError(f"piece {rank} isn't made of two pieces of lower rank")
                pairs[parts[0], parts[1]] = rank
        return Vocabulary(tuple(pieces), pairs)


def merged(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Ids after all merges, with a heap of the pairs by rank and place."""
    n = len(ids)
    after, before, ids = [*range(1, n), -1], list(range(-1, n - 1)), list(ids)
    heap = [(r, k) for k in range(n - 1) if (r := pairs.get((ids[k], ids[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        j = after[k]
        if ids[k] < 0 or j < 0 or pairs.get((ids[k], ids[j])) != rank:
            continue
        ids[k], ids[j], after[k] = rank, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = k
            if (r := pairs.get((rank, ids[after[k]]))) is not None:
                heapq.heappush(heap, (r, k))
        if before[k] >= 0 and (r := pairs.get((ids[before[k]], rank))) is not None:
            heapq.heappush(heap, (r, before[k]))
    return [i for i in ids if i >= 0]


def literal_map(vocabulary: Vocabulary) -> tuple[Column, Column]:
    """As literals: the state of each byte before each other one (or none, 256), and in buckets what each pair makes (in the upper half of a long)."""
    single = {p[0]: i for i, p in enumerate(vocabulary.pieces) if len(p) == 1}
    made = lambda a, b: vocabulary.pairs.get((single[a], single.get(b))) if b < 256 else None
    states = [(_NONE if (r := made(a, b)) is None else r << 32) | single[a] for a in range(256) for b in range(257)]
    buckets: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
    for (a, b), rank in vocabulary.pairs.items():
        buckets[(a << 32 | b) % BUCKETS][a << 32 | b] = rank << 32
    table = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")
    return F.split(F.lit(",".join(map(str, states))), ",").cast("array<bigint>"), table


def char(token: int) -> str:
    """The character that stands for a token."""
    return chr(token + FIRST if token + FIRST < SURROGATES else token + FIRST + HIDDEN)


def tokens(words: pa.StringArray) -> np.ndarray:
    """int32, the tokens that the characters of all words stand for."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int32)
    return np.where(points < SURROGATES, points, points - HIDDEN) - np.int32(FIRST)


def prefixes(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What pieces of two bytes or more begin with, numbered: the number by two bytes (-1: none); (number << 9 | next byte), sorted, and the numbers there; the piece's rank by number (-1: only a beginning)."""
    number: dict[bytes, int] = {}
    for rank in vocabulary.pairs.values():
        for k in range(2, len(vocabulary.pieces[rank]) + 1):
            number.setdefault(vocabulary.pieces[rank][:k], len(number))
    two, ranks = np.full(1 << 18, -1, np.int64), np.full(len(number), -1, np.int64)
    for p, k in number.items():
        if len(p) == 2:
            two[p[0] << 9 | p[1]] = k
    ranks[[number[vocabulary.pieces[r]] for r in vocabulary.pairs.values()]] = list(vocabulary.pairs.values())
    longer = sorted((number[p[:-1]] << 9 | p[-1], k) for p, k in number.items() if len(p) > 2)
    keys, to = np.array(longer, np.int64).reshape(-1, 2).T.copy()
    return two, keys, to, ranks


def held(words: list[bytes], known: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> pa.ListArray:
    """For each word the ranks of the pieces of two bytes or more that it holds, ascending; `known`: `prefixes`."""
    two, keys, to, ranks = known
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    which = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(which)) + which
    flat = np.full(len(which) + len(words), 256, np.int64)  # no byte stands after each word
    flat[at] = np.frombuffer(b"".join(words), np.uint8)
    place, found, size = two[flat[at] << 9 | flat[at + 1]], [], 2
    while True:
        there = np.nonzero(place >= 0)[0]
        if not len(there):
            break
        at, which, place = at[there], which[there], place[there]
        own = ranks[place]
        pieces = np.nonzero(own >= 0)[0]
        found.append(which[pieces] << 32 | own[pieces])
        if not len(keys):
            break
        key = place << 9 | flat[at + size]
        near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        place = np.where(keys[near] == key, to[near], -1)
        size += 1
    every = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
    every = every[np.append(True, every[1:] != every[:-1])[: len(every)]]  # np.unique takes 30 times as long
    ends = np.cumsum(np.append(0, np.bincount(every >> 32, minlength=len(words))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((every & _LOW).astype(np.int32)))


def ranked(words: Column, ranks: Column, vocabulary: Vocabulary) -> Column:
    """array<string>, words after all merges; a word has a character for each token, its ranks (an array for each word) ascend."""
    made = dict.fromkeys(range(len(vocabulary.pieces)), ("", "")) | {r: (char(a) + char(b), char(r)) for (a, b), r in vocabulary.pairs.items()}
    pairs, to = (F.split(F.lit(",".join(x[k] for x in made.values())), ",") for k in range(2))
    return F.zip_with(words, ranks, lambda word, own: F.aggregate(own, word, lambda q, r: F.replace(q, F.get(pairs, r), F.get(to, r))))


def fold(word: Column, vocabulary: Vocabulary) -> Column:
    """array<int>, the ids of a word that is given as an array of byte values.

    The state is an array of longs: in the lower half a token, in the upper half what it makes with the next.  A token of no
    vocabulary stands at either end.  Spark interprets lambdas node by node, so a step has as few as it can: it looks up
    the new token with both neighbours and lays the rest around these.
    """
    states, table = literal_map(vocabulary)
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  a value that is computed once
    none, low, high = (F.lit(x).cast("long") for x in (_NONE, _LOW, _NONE))
    end = F.array(F.lit(_NONE | _NONE >> 32).cast("long"))

    def made(pair: Column) -> Column:
        return F.coalesce(F.get(table, (pair % BUCKETS).cast("int"))[pair], none)

    def step(q: Column, _: Column) -> Column:
        def at(i: Column) -> Column:
            left, own, right = F.get(q, i - 2), F.get(q, i - 1), F.get(q, i + 1)
            token = F.shiftright(own, 32)
            new = F.array(made(F.shiftleft(left, 32).bitwiseOR(token)).bitwiseOR(left.bitwiseAND(low)), made(own.bitwiseAND(high).bitwiseOR(right.bitwiseAND(low))).bitwiseOR(token))
            return F.when(own >= none, q).otherwise(F.concat(F.slice(q, F.lit(1), i - 2), new, F.slice(q, i + 2, F.size(q))))

        return bound(F.array_position(q, F.array_min(q)).cast("int"), at)

    rest = F.slice(word, F.lit(2), F.size(word))
    start = F.concat(end, F.zip_with(word, F.concat(rest, F.array(F.lit(256))), lambda a, b: F.get(states, a * 257 + b)), end)
    ids = F.aggregate(rest, start, step, lambda q: F.transform(F.slice(q, F.lit(2), F.size(q) - 2), lambda x: x.bitwiseAND(low).cast("int")))
    return F.when(F.size(word) > 0, ids).otherwise(F.array().cast("array<int>"))


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """binary: the pieces of an array of ids, one after the other."""
    pieces = F.split(F.lit(",".join(p.hex() for p in vocabulary.pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def pattern_of(pattern: str) -> str:
    """The pattern with white space spelt out: libraries differ in what theirs holds."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def windows(word: bytes) -> list[bytes]:
    return [word[k : k + WINDOW] for k in range(0, max(1, len(word) - OVERLAP), WINDOW - OVERLAP)]


def stitched(parts: list[list[int]], sizes: list[int]) -> list[int] | None:
    """Ids of a word from those of its windows; None if two of them have no token in common. `sizes`: bytes by id."""
    out: list[tuple[int, int]] = []  # (where it ends, id)
    for k, ids in enumerate(parts):
        end = k * (WINDOW - OVERLAP)
        own = [(end := end + sizes[i], i) for i in ids]
        if not k:
            out = own
            continue
        known = {x: n for n, x in enumerate(out)}
        meet = next(((known[x], n) for n, x in enumerate(own) if x in known), None)
        if meet is None:
            return None
        out = out[: meet[0]] + own[meet[1] :]
    return [i for _, i in out]


def cut(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """(id, codes, words, ranks, fresh): numbers of a document's words; those that are new, a character for each byte, and the ranks that they hold; whether numbers begin anew.

    A long word is minus the number of its windows and then their numbers.  Texts are cut after every stretch without white
    space first, where the pattern always cuts, so that it is matched once for a distinct stretch.
    """
    pattern = pattern_of(pattern)
    single = {p[0]: char(i) for i, p in enumerate(vocabulary.pieces) if len(p) == 1}
    shared = Shared(docs.sparkSession, (single, prefixes(vocabulary)), "bytepairs")

    def run(batches):
        import regex

        chars, known_pieces = shared.value

        found = regex.compile(pattern).findall
        stretches, odd = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall, re.compile(f"[{SPACE}] (?:[{SPACE}]|\\Z)").search
        known: dict[str | bytes, int] = {}
        seen: dict[str, tuple[int, ...]] = {}
        fresh = True
        for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            codes, ends, new, new_ends, starts = [], [0], [], [0], []

            def number(stretch: str, own: list[bytes]) -> tuple[int, ...]:
                out = []
                for word in found(stretch):
                    if word not in known or len(word) > WINDOW // 4:
                        data = word.encode("utf-8", "replace")
                        parts = windows(data) if len(data) > WINDOW else [word]
                        if len(parts) > 1:
                            out.append(-len(parts))
                        for p in parts:
                            if p not in known:
                                known[p] = len(known)
                                own.append(p if isinstance(p, bytes) else data)
                            out.append(known[p])
                    else:
                        out.append(known[word])
                return tuple(out)

            for text in batch.column(1):
                if len(known) >= WORDS or len(seen) >= WORDS:
                    known, seen, fresh = {}, {}, True
                own: list[bytes] = []
                whole_text = text.as_py() or ""
                if odd(whole_text):
                    parts = stretches(whole_text)
                else:  # no space between white space: the pattern cuts before every space
                    first, *parts = whole_text.split(" ")
                    parts = [first, *[f" {p}" for p in parts]] if first else [f" {p}" for p in parts]
                for part, got in zip(parts, map(seen.get, parts), strict=True):
                    if got is None:
                        got = seen.get(part) or number(part, own)
                        if len(part) <= WINDOW:
                            seen[part] = got
                    codes += got
                ends.append(len(codes))
                new += own
                new_ends.append(len(new))
                starts.append(fresh)
                fresh = False
            words = pa.array([w.decode("latin-1").translate(chars) for w in new], pa.string())
            new_ends = pa.array(new_ends, pa.int32())
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int32())), *(pa.ListArray.from_arrays(new_ends, x) for x in (words, held(new, known_pieces))), pa.array(starts)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "codes", "words", "ranks", "fresh"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, codes array<int>, words array<string>, ranks array<array<int>>, fresh boolean")


class _Encoded:
    """Ids of numbered words, one after the other."""

    def __init__(self):
        self.flat, self.starts, self.used, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0, 0

    def add(self, words: pa.StringArray) -> None:
        ids, sizes = tokens(words), pc.utf8_length(words).to_numpy()
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n + 1 : self.n + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.n += len(sizes)

    def ids(self, codes: np.ndarray) -> np.ndarray:
        a = self.starts[codes]
        sizes = self.starts[codes + 1] - a
        end = np.cumsum(sizes)
        return self.flat[np.repeat(a - (end - sizes), sizes) + np.arange(int(end[-1]) if len(end) else 0)]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: the id, n_tokens, the ids and the decoded bytes (unless `with_ids` is off), ids_sha256, decoded_sha256.  No shuffle."""
    shared = Shared(docs.sparkSession, (vocabulary.pieces, vocabulary.pairs), "bytepairs")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, " + "ids array<int>, decoded binary, " * with_ids + "ids_sha256 string, decoded_sha256 string"

    def long_words(codes: list[int], table: _Encoded, pieces: tuple[bytes, ...], pairs: dict) -> np.ndarray:
        """Ids of a document with words that were cut into windows."""
        out, k = [], 0
        sizes, single = [len(p) for p in pieces], {p[0]: i for i, p in enumerate(pieces) if len(p) == 1}
        while k < len(codes):
            if codes[k] >= 0:
                out.append(table.ids(np.array(codes[k : k + 1])))
                k += 1
                continue
            n = -codes[k]
            parts = [table.ids(np.array([c])).tolist() for c in codes[k + 1 : k + 1 + n]]
            ids = stitched(parts, sizes)
            if ids is None:
                data = [b"".join(pieces[i] for i in p) for p in parts]
                data = b"".join([d[: WINDOW - OVERLAP] for d in data[:-1]] + data[-1:])
                ids = merged([single[b] for b in data], pairs)
            out.append(np.array(ids, np.int32))
            k += 1 + n
        return np.concatenate(out)

    def run(batches):
        pieces, pairs = shared.value
        table = _Encoded()
        for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            rows: list[np.ndarray] = []
            texts, ids_sha, text_sha = [], [], []
            for codes, words, fresh in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if fresh:
                    table = _Encoded()
                if len(words.values):
                    table.add(words.values)
                numbers = codes.values.to_numpy(zero_copy_only=False)
                ids = table.ids(numbers) if not len(numbers) or numbers.min() >= 0 else long_words(numbers.tolist(), table, pieces, pairs)
                text = b"".join([pieces[i] for i in ids.tolist()])
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(text).hexdigest())
                rows.append(ids if with_ids else len(ids))
                if with_ids:
                    texts.append(text)
            columns = {id_col: batch.column(0), "n_tokens": pa.array([len(r) for r in rows] if with_ids else rows, pa.int64())}
            if with_ids:
                ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                columns |= {"ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *rows]))), "decoded": pa.array(texts, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    folded = cut(docs, vocabulary, pattern, id_col, text_col).select(id_col, "codes", ranked(F.col("words"), F.col("ranks"), vocabulary).alias("words"), "fresh")
    return folded.mapInArrow(run, schema)
