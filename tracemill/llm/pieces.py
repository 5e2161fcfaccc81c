"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a stretch of text, byte-pair merging ends in exactly one last token.  An Aho-Corasick automaton
lists the vocabulary entries that end at each position; the entry that is compatible with the last token of the
prefix before it (merging the two strings together yields just these two tokens) is the unique last token.  The ids
follow by walking the table backwards.  The work is linear in the text, however long a stretch without spaces is.

Defined results: null text encodes as empty; an empty text has no ids; characters outside the vocabulary become
their UTF-8 byte pieces; repeated rows are encoded each on its own; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Shared, released, worker_cache

SPACE = "▁"
#: Entries of a worker's cache of encoded stretches, the longest stretch that is cached, and misses of a full cache
#: after which it starts anew (so it follows the texts, without the cost of an eviction for every miss).
CACHE_ENTRIES, CACHE_CHARS, STALE = 300_000, 48, 3_000_000
#: Remembered pairs in each of two generations, and rows of a batch that are encoded before their results go out.
PAIRS, ROWS = 500_000, 1024


@dataclass(frozen=True)
class PieceModel:
    """The parts of a vocabulary file that encoding needs; its size is that of the vocabulary."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]

    @staticmethod
    def load(path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        return PieceModel(
            tuple(sp.id_to_piece(i) for i in ids),
            tuple(sp.get_score(i) for i in ids),
            tuple(not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in ids),
            tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)),
        )


class PrefixTable:
    """Encoder for one vocabulary."""

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.model = model
        self.rank = {p: (model.scores[i], i) for i, p in enumerate(model.pieces) if model.normal[i]}
        self.chars = frozenset(p for p in self.rank if len(p) == 1)
        self.by_byte = {i: b for b, i in enumerate(model.byte_ids)}
        self.fits: dict[int, bool] = {}  # by first id << 24 | second id
        self.fitted: dict[int, bool] = {}  # the generation before
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            if self.merged(p) == [p]:  # entries that merging can never reach are no tokens
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """Plain merging, for strings of two tokens at most: join the best adjacent pair, leftmost first, until none is left."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = rank.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self.fits.get(key)
        if known is None:
            known = self.fitted.get(key)
            if known is None:
                x, y = self.model.pieces[a], self.model.pieces[b]
                known = self.merged(x + y) == [x, y]
            if len(self.fits) >= PAIRS:
                self.fits, self.fitted = {}, self.fits
            self.fits[key] = known
        return known

    def _stretch(self, s: str, out: list[int]) -> None:
        """Ids of a stretch whose characters are all in the vocabulary."""
        n = len(s)
        last, sizes = [-1] * (n + 1), [0] * (n + 1)
        compatible = self.compatible
        fits = self.fits.get
        for end, (token, size) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            if end > size:
                before = last[end - size]
                if before < 0:
                    continue
                ok = fits(before << 24 | token)
                if not (compatible(before, token) if ok is None else ok):
                    continue
            last[end], sizes[end] = token, size
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= sizes[at]
        ids.reverse()
        out += ids

    def encode_normalized(self, s: str) -> list[int]:
        out: list[int] = []
        if self.chars.issuperset(s):
            if s:
                self._stretch(s, out)
            return out
        begin = 0
        for k, c in enumerate(s):
            if c not in self.chars:
                if begin < k:
                    self._stretch(s[begin:k], out)
                out.extend(self.model.byte_ids[b] for b in c.encode())
                begin = k + 1
        if begin < len(s):
            self._stretch(s[begin:], out)
        return out

    def decode_raw(self, ids: list[int]) -> str:
        """Text of the ids with word marks as spaces; runs of byte pieces are read as UTF-8."""
        out, pending = [], bytearray()
        for i in ids:
            b = self.by_byte.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            out.append(self.model.pieces[i])
        if pending:
            out.append(pending.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def encode(self, text: str) -> list[int]:
        return [i for part in stretches(text) for i in self.encode_normalized(part)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_raw(ids).removeprefix(" ")


#: No token crosses from another character to a word mark, and a line feed is no token: these cuts change nothing.
_CUT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def stretches(text: str) -> list[str]:
    """The text with its leading word mark and marks for spaces, cut into parts that are encoded independently."""
    return _CUT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def encode_documents(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Per row: the id, n_tokens, the ids (unless `with_ids` is off), ids_sha256, decoded_sha256.  No shuffle.

    A worker remembers `cache_entries` encoded stretches at most, at some 400 bytes each.
    """
    id_type = docs.schema[id_col].dataType
    shared = Shared(docs.sparkSession, model, "pieces")
    schema = f"`{id_col}` {id_type.simpleString()}, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches):
        m = shared.value
        table = worker_cache(("pieces", "table", len(m.pieces), hash(m.pieces)), lambda: PrefixTable(m))
        cache = worker_cache(("pieces", "stretches", len(m.pieces), hash(m.pieces), with_ids), dict)
        missed = worker_cache(("pieces", "missed", len(m.pieces), hash(m.pieces), with_ids), lambda: [0])

        def one(part: str) -> tuple[str, int, str, bytes]:
            ids = table.encode_normalized(part)
            found = (",".join(map(str, ids)), len(ids), table.decode_raw(ids), array("i", ids).tobytes() if with_ids else b"")
            if len(part) <= CACHE_CHARS:
                if len(cache) < cache_entries:
                    cache[part] = found
                else:
                    missed[0] += 1
                    if missed[0] > STALE:
                        cache.clear()
                        missed[0] = 0
            return found

        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            n_tokens, packed, ids_sha, text_sha = [], [], [], []
            for text in batch.column(1):
                get = cache.get
                found = [get(p) or one(p) for p in stretches(text.as_py() or "")]
                n_tokens.append(sum([f[1] for f in found]))
                ids_sha.append(hashlib.sha256(",".join([f[0] for f in found]).encode()).hexdigest())
                text_sha.append(hashlib.sha256("".join([f[2] for f in found]).removeprefix(" ").encode()).hexdigest())
                if with_ids:
                    packed.append(b"".join([f[3] for f in found]))
            columns = {id_col: batch.column(0), "n_tokens": pa.array(n_tokens, pa.int64())}
            if with_ids:
                ends = np.cumsum([0, *n_tokens]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_pydict(columns | {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return docs.select(id_col, text_col).mapInArrow(released(run), schema)
