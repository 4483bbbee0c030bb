"""Personal data by weak supervision.

Candidate spans come from strict patterns (the base, whose valid matches always stay) and from looser ones: addresses
spelled with (at) and (dot), numbers grouped in other ways, IPv6.  Four labelers look at each candidate and vote yes, no
or nothing: a shape regex, a validity check, a gazetteer of prefixes and endings, and the words around it.  How reliable
each labeler is, is estimated by expectation-maximisation over the votes of all candidates of all documents; the
resulting probabilities train a logistic classifier over votes and span features, and spans that it is sure of are added.

Votes and features are few-valued, so the corpus is summed up as counts of their combinations: one aggregation with
partial sums, whose result does not grow with the corpus beyond the number of combinations.  A second pass over the
texts applies the classifier.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewing.llm import shared

KINDS = ("email", "ip", "card", "phone")

#: The base patterns of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # four numbers of such a row are an ip
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DIGIT = re.compile("[0-9]")
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?", re.I)
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]+)+", re.I)
_LOOSE_PHONE = re.compile(r"(?<![\w+.(-])(?:\([0-9]{2,5}\)[ ./-]?|0[0-9]{1,4}[ ./-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,6}(?![\w.-]?[0-9])")
_LOOSE_CARD = re.compile(r"(?<![\w.])[0-9]{4}(?:[._/]| - |  )[0-9]{4}(?:[._/]| - |  )[0-9]{4}(?:[._/]| - |  )[0-9]{4}(?!\w)")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")

#: Gazetteers.
ENDINGS = frozenset("com net org edu gov mil int info biz io ai co uk de fr es it nl be ch at pl se no fi dk pt ie eu us ca au nz jp cn in br mx ru".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "60", "61", "62", "63", "64", "65", "66", "81", "82", "86", "90", "91", "351", "352", "353", "358", "420")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "38", "6011", "65")
#: Words of the context, before a span.
FOR = {
    "email": re.compile(r"\b(?:e-?mails?|mail|contact|write to|reach|correo|courriel|kontakt)\b"),
    "ip": re.compile(r"\b(?:ip|host|server|address|addr|from|client|adresse|dirección)\b"),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|carte|karte|tarjeta)\b"),
    "phone": re.compile(r"\b(?:tel|telephone|phone|call|mobile|cell|fax|whatsapp|téléphone|telefon|teléfono)\b"),
}
AGAINST = {
    "email": re.compile(r"\b(?:git|ssh|user|import)\b"),
    "ip": re.compile(r"\b(?:version|release|section|chapter|v|build|license)\b"),
    "card": re.compile(r"\b(?:isbn|order|invoice|serial|id|sku|version)\b"),
    "phone": re.compile(r"\b(?:isbn|order|invoice|serial|id|date|version)\b"),
}


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    end: int
    base: bool
    barred: bool  # a match of a base pattern that its check dropped
    votes: tuple[int, ...] = ()
    features: tuple[int, ...] = ()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _local_start(text: str, low: int, at: int) -> int:
    """Where the run of characters of a local part begins that ends at ``at``, not before ``low``."""
    size = 64
    while True:
        part = text[max(low, at - size) : at][::-1]
        n = _LOCAL.match(part).end()
        if n < len(part) or at - size <= low:
            return at - n
        size *= 4


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, valid) of all matches of the base patterns, leftmost and non-overlapping for each kind."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:  # a match holds one "@", and starts where the run before it does
        start = _local_start(text, last, at)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((0, start, last, True))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                found.append((1, at, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four)))
                at = end + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _digits(m[0])
                if len(digits) >= 13:
                    found.append((2, m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                found.append((3, m.start(), m.end(), 8 <= len(_digits(m[0])) <= 15))
    return found


def _loose_matches(text: str) -> Iterator[tuple[int, int, int]]:
    if "(" in text or "[" in text or "{" in text:
        last = 0
        for m in _AT.finditer(text):  # the rare part first, then outwards
            start = _local_start(text, last, m.start())
            if start < m.start() and (domain := _LOOSE_DOMAIN.match(text, m.end())):
                last = domain.end()
                yield 0, start, last
    if _DIGIT.search(text):
        if text.count(":") >= 7:
            for m in _IP6.finditer(text):
                yield 1, m.start(), m.end()
        for m in _LOOSE_CARD.finditer(text):
            yield 2, m.start(), m.end()
        for m in _LOOSE_PHONE.finditer(text):
            yield 3, m.start(), m.end()


def _sign(yes: bool) -> int:
    return 1 if yes else -1


def label(kind: int, text: str, start: int, end: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The four labelers' votes, and span features: digits, groups, length (each in few steps)."""
    found, name = text[start:end], KINDS[kind]
    before = text[max(0, start - 40) : start].lower()
    context = -1 if AGAINST[name].search(before) else 1 if FOR[name].search(before) else 0
    digits = _digits(found)
    if kind == 0:
        local, _, domain = re.split(r"( ?(?:@|\(at\)|\[at\]|\{at\}) ?)", found, maxsplit=1, flags=re.I)
        end_part = re.split(r"[^A-Za-z0-9-]+", domain)[-1].lower()
        votes = (_sign(bool(re.search("[A-Za-z]", local))), _sign(".." not in found and local[:1].isalnum()), _sign(end_part in ENDINGS), context)
    elif kind == 1:
        parts = found.split("." if "." in found else ":")
        plain = all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in parts) if "." in found else True
        valid = all(int(p) <= 255 for p in parts if len(p) < 9) if "." in found else len(parts) == 8
        first = parts[0]
        votes = (_sign(plain), _sign(valid), 0 if first in ("0", "10", "127", "255") else 1, context)
    elif kind == 2:
        votes = (_sign(len(digits) == 16), _sign(luhn(digits)), _sign(digits.startswith(CARD_PREFIXES)), context)
    else:
        plus = found.startswith("+")
        known = digits.startswith(COUNTRY_CODES) if plus else found.startswith(("(", "0"))
        votes = (1 if plus else 0, _sign(8 <= len(digits) <= 15), _sign(known), context)
    groups = min(5, len(re.findall("[0-9]+", found)))
    return votes, (min(20, len(digits)), groups, min(7, (end - start) // 6))


class _Taken:
    """Intervals, and whether another overlaps none of them."""

    def __init__(self, intervals: Iterable[tuple[int, int]]):
        own = sorted(intervals)
        self.starts = [a for a, _ in own]
        self.reach = list(accumulate((b for _, b in own), max))  # the furthest end so far
        self.added: list[tuple[int, int]] = []

    def free(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        if before and self.reach[before - 1] > start:
            return False
        at = bisect_left(self.added, (end,))
        return not at or self.added[at - 1][1] <= start

    def add(self, start: int, end: int) -> None:
        """An interval that is free."""
        insort(self.added, (start, end))


def candidates(text: str) -> list[Span]:
    """All candidates of a text, with votes and features."""
    spans = []
    for kind, start, end, valid in base_matches(text):
        spans.append(Span(kind, start, end, valid, not valid, *label(kind, text, start, end)))
    taken = _Taken((s.start, s.end) for s in spans)
    for kind, start, end in _loose_matches(text):
        if taken.free(start, end):
            spans.append(Span(kind, start, end, False, False, *label(kind, text, start, end)))
    return spans


@dataclass
class Model:
    """A logistic classifier for each kind: weights of (place, value) of votes and features."""

    weights: dict[int, dict[tuple[int, int], float]]
    bias: dict[int, float]
    reliability: dict[int, np.ndarray]  # kind -> labeler x (no, nothing, yes) x class

    def sure(self, span: Span, least: float) -> bool:
        if span.kind not in self.bias:
            return False
        w = self.weights[span.kind]
        z = self.bias[span.kind] + sum(w.get((i, v), 0.0) for i, v in enumerate(span.votes + span.features))
        return 1.0 / (1.0 + np.exp(-z)) >= least


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each vote pattern is true, and P(vote | class) of each labeler, smoothed by one vote each."""
    n, labelers = votes.shape
    truth = 1.0 / (1.0 + np.exp(-1.5 * votes.sum(1)))
    chances = np.zeros((labelers, 3, 2))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - truth), counts * truth], 1)
        prior = (weight.sum(0) + 1.0) / (counts.sum() + 2.0)
        for j in range(labelers):
            for v in (-1, 0, 1):
                chances[j, v + 1] = weight[votes[:, j] == v].sum(0) + 1.0
        chances /= chances.sum(1, keepdims=True)
        log = np.log(prior)[None] + sum(np.log(chances[j, votes[:, j] + 1]) for j in range(labelers))
        log -= log.max(1, keepdims=True)
        truth = np.exp(log[:, 1]) / np.exp(log).sum(1)
    return truth, chances


def _logistic(rows: list[tuple[int, ...]], targets: np.ndarray, counts: np.ndarray) -> tuple[dict[tuple[int, int], float], float]:
    names = sorted({(i, v) for row in rows for i, v in enumerate(row)})
    at = {name: k for k, name in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for r, row in enumerate(rows):
        x[r, [at[i, v] for i, v in enumerate(row)]] = 1.0
    x[:, -1] = 1.0
    w = np.zeros(x.shape[1])
    weight = counts / counts.sum()
    penalty = 1e-4 * np.eye(len(w))
    for _ in range(25):  # Newton steps
        p = 1.0 / (1.0 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - targets)) + penalty @ w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        w -= np.linalg.solve(bend, slope)
    return {name: float(w[k]) for name, k in at.items()}, float(w[-1])


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Learns from the candidates of all ``docs``. Kinds without candidates get no classifier and add no spans."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.lean(batches):
            counts: dict[tuple, int] = {}
            for value in batch.column(0):
                for s in candidates(value.as_py() or ""):
                    key = (s.kind, s.votes, s.features)
                    counts[key] = counts.get(key, 0) + 1
            kinds = pa.array([k[0] for k in counts], pa.int32())
            lists = [pa.array([k[i] for k in counts], pa.list_(pa.int32())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([kinds, *lists, pa.array(list(counts.values()), pa.int64())], names=["kind", "votes", "features", "n"])

    made = docs.select(text).mapInArrow(patterns, "kind int, votes array<int>, features array<int>, n bigint")
    rows = made.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).orderBy("kind", "votes", "features").collect()
    model = Model({}, {}, {})
    for kind in range(len(KINDS)):
        own = [r for r in rows if r.kind == kind]
        if not own:
            continue
        counts = np.array([r.n for r in own], float)
        truth, model.reliability[kind] = expectation_maximisation(np.array([r.votes for r in own]), counts)
        model.weights[kind], model.bias[kind] = _logistic([tuple(r.votes) + tuple(r.features) for r in own], truth, counts)
    return model


def spans_of(text: str | None, model: Model, least: float) -> list[Span]:
    """The base spans and the spans that the method adds, by kind and start. Added ones overlap no other."""
    found = candidates(text or "")
    kept = [s for s in found if s.base]
    taken = _Taken((s.start, s.end) for s in kept)
    for s in found:
        if not s.base and not s.barred and model.sure(s, least) and taken.free(s.start, s.end):
            kept.append(s)
            taken.add(s.start, s.end)
    return sorted(kept, key=lambda s: (s.kind, s.start))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.kind]}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def with_spans(docs: DataFrame, model: Model, text: str = "text", into: str = "pii", least: float = 0.95) -> DataFrame:
    """``docs`` with a struct ``into``: n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, masked.  A column of
    that name, in any case, is replaced.

    Null texts count as empty and stay null when masked.  Each row is read on its own, whole; repeated rows give the same
    spans; an empty table gives an empty table.  No shuffle.
    """
    made = [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("masked", pa.string())]
    ddl = ", ".join(f"{n}: {'bigint' if k == pa.int64() else 'string'}" for n, k in made)

    @F.arrow_udf(f"struct<{ddl}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in shared.lean(batches):
            rows = []
            for value in whole:
                source = value.as_py()
                spans = spans_of(source, model, least)
                base = [s for s in spans if s.base]
                counts = [sum(s.kind == k for s in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), masked(source, spans)))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(made)], names=[n for n, _ in made])

    return docs.withColumn(into, find(F.col(text)))


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` masked; all other columns as they are. Cases as in ``with_spans``."""
    (into,) = shared.free_names(docs.columns, "pii")
    found = with_spans(docs, fit(docs, text), text, into)
    return found.withColumn(text, F.col(f"{into}.masked")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs, fit(docs)).select("doc_id", "pii.*").drop("masked")
