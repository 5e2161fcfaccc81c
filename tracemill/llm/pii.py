"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans (e-mail, IPv4, card, phone) follow fixed formats and always stay.  On top of them high-recall generators
propose overlapping candidates: written-out e-mail addresses, dotted quads with spaces, digit groups with other
separators, telephone numbers without country prefix.  Trees learn which of them to add, from all
documents.  Positive are candidates on base spans, and candidates on base spans that were disguised first: written out,
with other separators, without their prefix.  Negative are candidates on other kinds' spans, those that fail a check of
their kind, and disguised spans that were spoiled (a check digit, a part, the ending).  Well-formed candidates elsewhere
may be what is looked for and carry no label.  Features are format, checks and context.  Per kind, the lowest
calibrated probability with the wanted precision on held-back documents (a third, by their texts) is the threshold;
candidates above it that touch no base span are added, best first.

Training: examples' features are whole numbers, so equal examples become one row with a count, and all that the trees, the
calibration and the thresholds need are sums of counts (`gbt`), which Spark makes; the driver gets histograms only.

Defined results: null text is empty and has no spans; empty text too; offsets are code points; repeated rows are
treated each on its own; other columns are not read.  With no labelled candidates of a kind, nothing is added to it.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import Shared, materialize

KINDS = ("email", "ip", "card", "phone")
#: Precision wanted from added spans; labelled candidates without which nothing is learnt, and positive ones of a kind; numbers of a candidate.
PRECISION, LEAST, LEAST_HITS, FEATURES = 0.98, 30, 10, 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Candidate generators by kind: high recall, checked by the trees alone.
_GENERATORS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|<at>|@| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.| dot ) ?[A-Za-z0-9-]{2,63})+", re.ASCII)),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])", re.ASCII)),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ._/-]{0,2}[0-9]){13,18}(?![0-9A-Za-z])", re.ASCII)),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?(?:[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?(?:[ .-]{1,2}[0-9]{2,4}){1,4}(?![0-9A-Za-z])", re.ASCII)),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", re.ASCII)),
)
_HINT = re.compile(r"[0-9@]|(?:\(at\)|\[at\]|\{at\}|<at>)| at [A-Za-z0-9-]+(?: dot |\.)", re.ASCII)
#: Forms that mark an address as written out, and a group of digits as a telephone number.
_MARKED = re.compile(r"@|[(\[{<]at[)\]}>]| at .*(?:[(\[{]dot[)\]}]| dot )")
_DIALLED = re.compile(r"\+|00[1-9]|.*\(|(?:[0-9]{1,3}[ .-])?[0-9]{3}[ .-]{1,2}[0-9]{3}[ .-]{1,2}[0-9]{4}$")
_COUNTRY = re.compile(r"^\+(?:[0-9]{1,3}[ .-])?")
_CUES = {
    "email": ("mail", "contact", "@"), "ip": ("ip", "host", "addr", "server"), "card": ("card", "visa", "pay", "iban"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end) of the base formats, in linear time, sorted."""
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        begin, groups = m.start(), m.group().split(".")
        for k in range(0, len(groups) - 3, 4):  # leftmost matches take four groups each
            four = groups[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four):
                found.append((begin, 1, end))
            begin = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every generator's proposals; they may overlap."""
    if not _HINT.search(text):
        return []
    return sorted({(m.start(), KINDS.index(kind), m.end()) for kind, rule in _GENERATORS for m in rule.finditer(text) if kind != "email" or "@" in m.group() or "at" in m.group()})


def well_formed(s: str, kind: int) -> bool:
    """Whether a candidate that is no base span has the form of its kind all the same."""
    digits = re.sub("[^0-9]", "", s)
    if kind == 0:
        return bool(_MARKED.search(s))
    if kind == 1:
        return all(int(g) <= 255 for g in re.findall("[0-9]+", s))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(_DIALLED.match(s))


class Places:
    """Spans that don't overlap each other; finds those that touch a given one in logarithmic time."""

    def __init__(self, spans=()):
        """Overlapping spans are merged."""
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touch(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start

    def add(self, start: int, end: int) -> None:
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def labels(text: str, spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[int | None]:
    """Per candidate: 1 on a base span of its kind, 0 on another kind's or if not well-formed, else unknown."""
    by_kind = [Places((s, e) for s, k, e in base if k == kind) for kind in range(len(KINDS))]
    out = []
    for start, kind, end in spans:
        if by_kind[kind].touch(start, end):
            out.append(1)
        elif any(p.touch(start, end) for p in by_kind):
            out.append(0)
        else:
            out.append(None if well_formed(text[start:end], kind) else 0)
    return out


def disguises(s: str, kind: int) -> tuple[list[str], list[str]]:
    """Other ways to write a base span, and spoiled ones that look alike."""
    digits = re.sub("[^0-9]", "", s)
    if kind == 0:
        name, host = s.split("@", 1)
        parts = host.split(".")
        return [f"{name}{at}{dot.join(parts)}" for at, dot in ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), ("(at)", "."))], [f"{name} at {parts[0]}. {parts[-1].title()}"]
    if kind == 1:
        parts = s.split(".")
        spoiled = [*parts[:3], str(256 + int(parts[3]))]
        return [sep.join(parts) for sep in (" . ", ". ", " .")], [sep.join(spoiled) for sep in (" . ", ". ")]
    if kind == 2:
        cut = lambda d: [d[k : k + 4] for k in range(0, len(d), 4)]
        spoiled = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [sep.join(cut(digits)) for sep in (".", "/", "_", "- ", "  ")], [sep.join(cut(spoiled)) for sep in (".", "/", "_", "- ")]
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits[:-10] or 1} {a} {b} {c}"], [f"{a} {b}", f"{b}-{c}", f"{c} {c} {c}"]


def examples(text: str) -> tuple[list[list[float]], list[int]]:
    """Labelled candidates of a document, and of its base spans disguised (each one way, chosen by its text) in their context."""
    base = base_spans(text)
    spans = candidates(text)
    marked = [(c, y) for c, y in zip(spans, labels(text, spans, base), strict=True) if y is not None]
    x, y = (features(text, [c for c, _ in marked]).tolist() if marked else []), [y for _, y in marked]
    for start, kind, end in base:
        good, bad = disguises(text[start:end], kind)
        pick = zlib.crc32(text[start:end].encode("utf-8", "replace"))
        for form, is_good in ((good[pick % len(good)], 1), (bad[pick // 8 % len(bad)], 0)):
            before = text[max(0, start - 40) : start]
            around, a, b = before + form + text[end : end + 40], len(before), len(before) + len(form)
            # a candidate that is the whole disguise; those that hold a part of it say nothing
            own = [c for c in candidates(around) if c[1] == kind and c[0] < b and c[2] > a and (not is_good or (c[0] == a and c[2] == b))]
            x += features(around, own).tolist()
            y += [is_good] * len(own)
    return x, y


def features(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Format, checks and context of candidates, whole numbers of 16 bits at most; the country prefix is not among them."""
    out = np.zeros((len(spans), FEATURES))
    for row, (start, kind, end) in zip(out, spans, strict=True):
        s, before, after = _COUNTRY.sub("", text[start:end]), text[max(0, start - 24) : start], text[end : end + 12]
        groups = re.findall("[0-9]+", s)
        letters = sum(c.isalpha() for c in s)
        row[0], row[1], row[2], row[3] = kind, len(s), sum(map(len, groups)), letters
        row[4], row[5], row[6] = len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0)
        row[7], row[8], row[9], row[10] = s.count("."), s.count("-"), s.count(" "), s.count("(")
        row[11] = len(groups[-1]) if groups else 0
        row[12] = max((int(g) for g in groups if len(g) <= 4), default=0)
        row[13] = any(cue in before.lower() for cue in _CUES[KINDS[kind]])
        row[14] = before[-1:].isalnum() + 2 * before[-1:].isspace() if before else 3
        row[15] = after[:1].isalnum() + 2 * after[:1].isspace() if after else 3
        row[16] = sum(c.isdigit() for c in before)
        row[17] = len(re.findall(r"[A-Za-z0-9-]{2,}$", s))
        row[18] = well_formed(s, kind)
        row[19] = luhn("".join(groups))
    return np.minimum(out, 2**16 - 1)


@dataclass
class Detector:
    trees: gbt.Trees | None
    thresholds: dict[int, float]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if self.trees is None or not self.thresholds:
            return []
        taken = Places((s, e) for s, _, e in base)
        free = [c for c in candidates(text) if c[1] in self.thresholds and not taken.touch(c[0], c[2])]
        if not free:
            return []
        p = self.trees.probability(features(text, free))
        out: list[tuple[int, int, int]] = []
        # the best first; of equally good ones the longest
        for k in sorted(range(len(free)), key=lambda k: (-p[k], free[k][0] - free[k][2], free[k])):
            c = free[k]
            if p[k] >= self.thresholds[c[1]] and not taken.touch(c[0], c[2]):
                out.append(c)
                taken.add(c[0], c[2])
        return out


def counted_examples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, x, y, held, n): distinct labelled candidates of all documents, packed, and how many there are of each."""

    def run(batches):
        for batch in (whole.slice(k, 64) for whole in batches for k in range(0, whole.num_rows, 64)):
            rows, labels, held = [], [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                x, y = examples(text)
                if y:
                    rows.append(np.array(x))
                    labels += y
                    held += [zlib.crc32(text.encode("utf-8", "replace")) % 3 == 0] * len(y)
            packed = np.concatenate(rows).astype("<u2") if rows else np.zeros((0, FEATURES), "<u2")
            columns = [pa.array(packed[:, 0].astype(np.int32)), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(labels, pa.int32()), pa.array(held, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "x", "y", "held"])

    found = docs.select(text_col).mapInArrow(run, "kind int, x binary, y int, held boolean")
    return found.groupBy("kind", "x", "y", "held").agg(F.count("*").alias("n"))


def train(docs: DataFrame, text_col: str = "text", precision: float = PRECISION, few: int = gbt.FEW) -> Detector:
    """Fit on the examples of two thirds of the documents, calibrate and set thresholds on the rest's."""
    rows = materialize(counted_examples(docs, text_col), "examples")
    own = ~F.col("held")
    found = rows.agg(F.sum("n").alias("n"), F.sum(F.when(own, F.col("n"))).alias("own"), F.sum(F.when(own, F.col("n") * F.col("y"))).alias("hits")).first()
    if (found.n or 0) < LEAST or not found.own or found.hits in (0, found.own):
        return Detector(None, {})
    trees, binned = gbt.fit(rows, FEATURES, found.own, found.hits, few)
    margins = gbt.margins(binned.filter("held"), trees)
    gbt.calibrate(trees, margins.margin, margins.n, margins.hits)
    thresholds = {}
    for kind in range(len(KINDS)):
        m = margins.of(kind)
        if m.hits.sum() < LEAST_HITS:
            continue
        p = trees.scaled(m.margin)  # margins descend, so do probabilities; equal ones are one threshold
        share = m.hits.cumsum() / m.n.cumsum()
        good = np.nonzero(np.append(p[1:] < p[:-1], True) & (share >= precision) & (p >= 0.5))[0]
        if len(good):
            thresholds[kind] = float(p[good[-1]])
    return Detector(trees, thresholds)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base counts by kind, base_sha256, all spans, the redacted text."""
    shared = Shared(docs.sparkSession, detector, "pii")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        d = shared.value
        for batch in batches:
            counts, sha, spans, redacted = [[] for _ in KINDS], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                both = sorted(base + d.added(text, base))
                for k, c in enumerate(counts):
                    c.append(sum(b[1] == k for b in base))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(both))
                redacted.append(redact(text, both))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (sha, spans, redacted))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, redacted string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end > at:
            out += [text[at : max(at, start)], f"[{KINDS[kind]}]"]
            at = end
    return "".join(out) + text[at:]
