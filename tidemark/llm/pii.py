"""Personal data: base patterns, and candidate spans that boosted trees accept.

The base finds e-mail addresses, IP addresses, card numbers and telephone numbers by fixed rules. High-recall generators
propose further, overlapping spans (numbers with other separators, national telephone numbers, IPv6 and bracketed
addresses, spelled-out e-mail addresses). Gradient-boosted trees judge each one by its format and context; those over
their kind's calibrated threshold are added, the likeliest first, where nothing found before overlaps them.

No labelled spans exist, so the trees are trained on made phrases (`phrases.py`) of personal data and of look-alikes
(dates, versions, prices, order numbers, card-like numbers that fail the Luhn rule) in neutral and telling contexts. The
thresholds come from phrases of other templates, and tests measure recall and precision on a third set.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from ipaddress import ip_address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, phrases
from .common import lean, pieces, strings

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind's place in KINDS, start, end

# Fixed patterns. Possessive repeats match the same as plain ones here and keep the time linear.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start: leftmost matches of each kind without overlap; failing ones dropped, not retried."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # Without leading zeros first: a part may be longer than any number Python would read.
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


# High-recall generators of further candidates; each starts at a rare character, so scanning is fast.
_AT = re.compile(r"(?<=[A-Za-z0-9])(?:[ ]?[\[({<][ ]?(?:at|AT|At|@)[ ]?[\])}>][ ]?|[ ]@[ ])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ ](?:at|AT|At)[ ](?=[A-Za-z0-9.-]++[ ](?:dot|DOT|Dot)[ ])")
_DOTTED = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|[ ]?[\[({<][ ]?(?:\.|dot|DOT|Dot)[ ]?[\])}>][ ]?|[ ](?:dot|DOT|Dot)[ ])[A-Za-z0-9-]++)++")
_MORE = (
    (1, re.compile(r"(?<![0-9])[0-9]{1,3}(?:[ ]?[\[({]?[.][\])}]?[ ]?[0-9]{1,3}){3}(?![0-9])")),
    (1, re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4})?:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    (2, re.compile(r"(?<![0-9])[0-9](?:(?:[ ]?[./_:-][ ]?|[ ])?[0-9]){12,18}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{1,5}\)[ ./-]{0,2}[0-9]{2,8}|[0-9]{1,5}[ ./-]{1,2}[0-9]{2,8})(?:[ ./-]{1,2}[0-9]{2,8}){0,5}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])[(]?\+[(]?[0-9](?:[ ()./-]{0,2}[0-9]){7,14}(?![0-9])")),
)
_INNER = re.compile("(?<=[ ./-])0[1-9]")
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9]+")
#: Words near a span that tell its kind (fixed values).
_CUES = (
    ("email", "mail", "e-mail", "contact", "write", "address", "correo", "courriel", "schreiben"),
    ("ip", "host", "server", "address", "ping", "gateway", "login", "from"),
    ("card", "visa", "credit", "debit", "payment", "pay", "tarjeta", "carte", "karte"),
    ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "teléfono", "téléphone", "ring", "whatsapp", "dial"),
)
_AGAINST = ("order", "version", "invoice", "isbn", "id", "number", "date", "ref", "build", "serial", "page", "price", "section", "on", "until", "at")
#: Usual ends of host names besides those of two letters (fixed values).
_TOPS = frozenset(("com", "org", "net", "edu", "gov", "mil", "info", "biz", "name", "app", "dev", "example"))


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data."""
    found: list[Span] = []
    for m in _AT.finditer(text):
        # Back to the first character that a local part can't have: no further than the sign before, so all walks are one.
        start = m.start()
        while start and text[start - 1] in _LOCAL_SET:
            start -= 1
        tail = _DOTTED.match(text, m.end())
        if tail and start < m.start():
            found.append((0, start, tail.end()))
    if _DIGIT.search(text):
        for kind, pattern in _MORE:
            for m in pattern.finditer(text):
                found.append((kind, *m.span()))
                if kind == 3:
                    # A number may follow others: what begins with a group that has a leading zero is a candidate, too.
                    found += [(3, i.start(), m.end()) for i in _INNER.finditer(text, m.start(), m.end())]
    return found


def _address(span: str) -> int:
    """4 or 6 for an IP address, once blanks and brackets are left out; else 0."""
    try:
        return ip_address(re.sub(r"[\s\[\](){}]", "", span)).version
    except ValueError:
        return 0


def features(text: str, span: Span) -> list[float]:
    """The format and context of a candidate."""
    kind, a, b = span
    s = text[a:b]
    found = _GROUP.findall(s)
    digits = "".join(found)
    groups = [len(g) for g in found]
    marks = [s.count(c) for c in " -./:()+[@_"]
    before = re.findall(r"[\w-]+", text[max(0, a - 40) : a].lower())[-4:]
    after = re.findall(r"[\w-]+", text[b : b + 20].lower())[:2]
    near = before + after
    left, right = text[a - 1 : a], text[b : b + 1]
    numbers = [int(g) for g in found if len(g) < 7]
    top = re.split("[^A-Za-z]", s)[-1].lower() if kind == 0 else ""
    year = [len(g) == 4 and "1900" <= g <= "2039" for g in found]
    return [
        kind,
        min(len(s), 200),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[0] if groups else 0,
        groups[1] if len(groups) > 1 else 0,
        groups[-1] if groups else 0,
        *marks,
        13 <= len(digits) <= 19 and luhn(digits),
        int(digits[0]) if digits else -1,
        int(digits[1]) if len(digits) > 1 else -1,
        max(numbers, default=0) <= 255,
        any(year),
        len(groups) == 3 and sum(year) == 1 and all(n <= 31 for n, y in zip(numbers, year, strict=False) if not y),
        len(groups) > 1 and groups[0] <= 3 and groups[1:] == [3] * (len(groups) - 1) and digits[0] != "0",
        len(set(groups[1:])) == 1,
        len({c for c in s if c in " -./_"}),
        s[:1] == "(",
        digits[:1] == "0",
        sum(c in "abcdefABCDEF" for c in s) if kind == 1 else 0,
        _address(s) if kind == 1 else 0,
        "::" in s,
        len(top) == 2 or top in _TOPS,
        any(c in "[({<" for c in s),
        any(w in _CUES[kind] for w in near),
        any(w in _CUES[kind] for w in before[-1:]),
        any(w in _AGAINST for w in before[-2:]),
        left.isalnum() or left in tuple("$€£#=_/.,-:"),
        right.isalnum() or right in tuple("%=_/$€£-:") or right in tuple(".,") and text[b + 1 : b + 2].isdigit(),
    ]


@dataclass
class Detector:
    trees: boosting.Boosted
    thresholds: tuple[float, ...]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The accepted candidates that overlap no base span and no likelier candidate, by kind and start."""
        proposed = [c for c in dict.fromkeys(candidates(text)) if not any(c[1] < e and s < c[2] for _, s, e in base)] if len(base) < 8 else _clear(candidates(text), base)
        if not proposed:
            return []
        p = self.trees.probabilities(np.array([features(text, c) for c in proposed], np.float64))
        chosen: list[Span] = []
        taken = _Taken()
        for i in np.argsort(-p, kind="stable"):
            kind, a, b = proposed[i]
            if p[i] >= self.thresholds[kind] and taken.add(a, b):
                chosen.append(proposed[i])
        return sorted(chosen)


class _Taken:
    """Disjoint intervals in order."""

    def __init__(self) -> None:
        self._starts: list[int] = []
        self._ends: list[int] = []

    def free(self, a: int, b: int) -> int:
        from bisect import bisect_right

        i = bisect_right(self._starts, a)
        clear = (i == 0 or self._ends[i - 1] <= a) and (i == len(self._starts) or self._starts[i] >= b)
        return i if clear else -1

    def add(self, a: int, b: int) -> bool:
        i = self.free(a, b)
        if i >= 0:
            self._starts.insert(i, a)
            self._ends.insert(i, b)
        return i >= 0


def _clear(proposed: list[Span], base: list[Span]) -> list[Span]:
    merged = _Taken()
    for a, b in sorted((s, e) for _, s, e in base):
        if merged._ends and a < merged._ends[-1]:
            merged._ends[-1] = max(merged._ends[-1], b)
        else:
            merged._starts.append(a)
            merged._ends.append(b)
    return [c for c in dict.fromkeys(proposed) if merged.free(c[1], c[2]) >= 0]


def judged(rng: random.Random, which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels (1 where a candidate is just the personal data of its phrase) and kinds of the candidates of `size` phrases."""
    rows, labels, kinds = [], [], []
    for _ in range(size):
        kind, before, span, after = phrases.phrase(rng, which)
        text, a, b = before + span + after, len(before), len(before) + len(span)
        base = base_spans(text)
        for c in dict.fromkeys(candidates(text)):
            if not any(c[1] < e and s < c[2] for _, s, e in base):
                rows.append(features(text, c))
                labels.append(int(KINDS[c[0]] == kind and c[1:] == (a, b)))
                kinds.append(c[0])
    return np.array(rows, np.float64), np.array(labels, np.float64), np.array(kinds)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least of the scores p from which on all candidates together have the precision; 2, which none reaches, if there is none."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    # Equal scores stand or fall together.
    last = np.flatnonzero(np.append(p[order][1:] != p[order][:-1], True)) if len(p) else np.array([], int)
    passing = last[hits[last] >= precision]
    return float(p[order][passing[-1]]) if len(passing) else 2.0


@lru_cache
def detector(size: int = 6_000, precision: float = 0.95, seed: int = 29) -> Detector:
    """Train the trees on `size` made phrases; calibrate them, and choose each kind's least threshold of that precision, on phrases of other templates."""
    rng = random.Random(seed)
    x, y, _ = judged(rng, 0, size)
    trees = boosting.train(x, y)
    x, y, kinds = judged(rng, 1, size)
    trees.calibrate(x, y)
    p = trees.probabilities(x)
    return Detector(trees, tuple(threshold(p[kinds == k], y[kinds == k], precision) for k in range(len(KINDS))))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _listed(spans: list[Span]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]


def find(docs: DataFrame, model: Detector | None = None, key: str = "doc_id") -> DataFrame:
    """key, base and spans (arrays of kind, start, end in code points, end exclusive) for every row of docs (key, text).

    `spans` has the base ones and those that the trees add, by kind as in KINDS, then start. A null text counts as an
    empty one, which has none. Extra columns are ignored; repeated rows give a row each.
    """
    model = model or detector()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text"):
            texts = strings(x.column(1))
            base = [base_spans(t) for t in texts]
            every = [sorted(b + model.added(t, b)) for t, b in zip(texts, base, strict=True)]
            yield pa.record_batch([x.column(0), pa.array([_listed(b) for b in base], _SPANS), pa.array([_listed(s) for s in every], _SPANS)], names=[key, "base", "spans"])

    lean(docs.sparkSession)
    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, base {kind}, spans {kind}")


def redact(docs: DataFrame, model: Detector | None = None) -> DataFrame:
    """docs with every span of personal data in `text` replaced by [KIND]; null texts stay null, other columns as they are.

    Where spans of two kinds overlap, the joint stretch is replaced once, by the kind that starts first. If docs has
    n_chars, it becomes the length of the new text.
    """
    model = model or detector()
    at = docs.columns.index("text")

    def clean(text: str) -> str:
        base = base_spans(text)
        out, done = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in base + model.added(text, base)):
            if a >= done:
                out += [text[done:a], f"[{KINDS[k].upper()}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches, "text"):
            new = pa.array([None if t is None else clean(t) for t in x.column(at).to_pylist()], pa.string())
            yield pa.record_batch([new if i == at else c for i, c in enumerate(x.columns)], names=x.schema.names)

    lean(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def personal_data_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: the digests of the spans of every document.

    The counts and the hash are of the base spans. A null or empty text has zeros, the hash of an empty string and empty
    spans. A null doc_id stays null; repeated rows give a row each; other columns of docs are ignored, whatever their names;
    an empty table gives an empty result.
    """
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
