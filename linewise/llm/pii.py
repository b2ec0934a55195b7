"""Personal data by weak supervision.

Candidates are spans that look like an e-mail address, an IP address, a card or a phone number, by loose
patterns. Labelling functions vote on each candidate (yes, no, or nothing): strict patterns, checksums, digit
counts, gazetteers (top-level domains, card issuers, country codes), and words before it. Expectation-maximisation
over the counted vote patterns of all candidates of the corpus estimates each function's reliability and the
chance that a candidate is real; a logistic classifier over votes and shape is trained on these
chances and decides. Spans of the base patterns are always kept; the classifier adds others.

Vote patterns have bounded numbers (three to the number of functions, times the shapes), so their counts, over
all candidates of all texts, are gathered on the driver; texts and spans are not.

Scanning is linear in the text: a base pattern can start only where its first character follows none of its
own, so long runs of digits or letters are read once. Loose forms are limited by rule: a local part of at most 64 characters,
at most five labels of at most 63 after the first, numbers of 7 to 25 digits; votes on context read the 24 characters before a span.

Defined results: null and empty text has no spans; a kind without candidates has no classifier and only base
spans; equal rows have equal spans; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.llm.arrow import small_batches

KINDS = ("email", "ip", "card", "phone")

# A digit, + or ( and what may stand in a number after it: no numeric pattern leaves such a region.
REGION = re.compile(r"[0-9+(][0-9().+\x20-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]")

# Loose forms beyond the base patterns.
LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\s?[\[(]\s?(?:at|@)\s?[\])]\s?([A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[A-Za-z0-9-]{1,63}){1,5})")
LOOSE_NUMBER = re.compile(r"[+(]?[0-9](?:[().\x20-]{0,3}[0-9])+")

# Fixed values of the gazetteers and context words.
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz example test".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "6011", "65", "2")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "63", "64", "65", "81", "82", "86", "90", "91")
CONTEXT = {
    "email": re.compile(r"(?:e-?mail|mail|contact|write|correo|courriel)\W{0,3}$", re.I),
    "ip": re.compile(r"(?:ip|address|host|server|from|login)\W{0,3}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|credit|payment|karte|tarjeta|carte)\W{0,3}(?:(?:no|number)\W{0,3})?$", re.I),
    "phone": re.compile(r"(?:phone|tel|telephone|mobile|call|fax|telefon|tel[eé]fono)\W{0,3}(?:(?:no|number)\W{0,3})?$", re.I),
}
AGAINST = re.compile(r"(?:version|order|isbn|item|page|section|chapter|id|token|key|no|nr)\W{0,3}$", re.I)


def luhn(digits: str) -> bool:
    values = np.frombuffer(digits.encode(), np.uint8)[::-1].astype(np.int64) - 48
    doubled = values[1::2] * 2
    return int(values[::2].sum() + (doubled - 9 * (doubled > 9)).sum()) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping local@domain matches: a local part is the whole run before the @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted by start, then kind."""
    spans = [(start, 0, end) for start, end in base_mails(text)]
    for region in REGION.finditer(text):
        part, shift = region.group(), region.start()
        if len(part) < 7:
            continue
        if part.count(".") >= 3:
            spans += [(shift + m.start(), 1, shift + m.end()) for m in IP.finditer(part) if all(map(_small, m.group().split(".")))]
        if len(part) >= 14:
            for m in CARD.finditer(part):
                digits = NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((shift + m.start(), 2, shift + m.end()))
        if "+" in part:
            for m in PHONE.finditer(part):
                if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    spans.append((shift + m.start(), 3, shift + m.end()))
    return sorted(spans)


PRIOR_VOTES = 20.0


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


def _votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[str, str]:
    """Votes of the labelling functions, and the shape, of one candidate."""
    value, before = text[start:end], text[max(0, start - 24):start]
    digits = NOT_DIGIT.sub("", value) if kind else ""
    context = _vote(bool(CONTEXT[KINDS[kind]].search(before)), bool(AGAINST.search(before)))
    inside = _vote(False, (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()))
    if kind == 0:
        last = re.split(r"\W+", value)[-1].lower()
        own = _vote(base) + _vote(last in DOMAINS, not last.isalpha()) + _vote(2 <= len(last) <= 6, len(last) < 2)
        shape = f"{min(value.count('.'), 3)}{int('@' in value)}"
    elif kind == 1:
        parts = value.split(".")
        own = _vote(base, not base) + _vote(False, parts[0].startswith("0")) + _vote(all(p == "0" or p[:1] != "0" for p in parts), True)
        shape = f"{min(len(value), 15)}"
    elif kind == 2:
        sums = luhn(digits)
        own = _vote(base) + _vote(sums, not sums) + _vote(digits.startswith(ISSUERS), True) + _vote(13 <= len(digits) <= 19, True)
        shape = f"{min(len(digits), 20)}{_separators(value)}"
    else:
        plus = value.startswith("+")
        own = _vote(base) + _vote(plus) + _vote(10 <= len(digits) <= 15, True) + _vote(plus and digits.startswith(COUNTRIES))
        shape = f"{min(len(digits), 16)}{_separators(value)}"
    return own + context + inside, shape


def _separators(value: str) -> str:
    return "".join(c for c in "( -." if c in value)


def candidates(text: str) -> list[tuple[int, int, int, bool, str, str]]:
    """(start, kind number, end, base, votes, shape), sorted. Loose spans that touch a base span are left out."""
    base = base_spans(text)
    taken = [(start, end) for start, _, end in base]
    apart: list[list[int]] = []  # base spans of all kinds joined where they overlap
    for start, end in taken:
        if apart and start < apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], end)
        else:
            apart.append([start, end])
    starts = [start for start, _ in apart]

    def free(start: int, end: int) -> bool:
        at = bisect_left(starts, end) - 1
        return at < 0 or apart[at][1] <= start

    loose = []
    if "[at" in text or "(at" in text or "[@" in text or "(@" in text or "[ at" in text or "( at" in text:
        loose += [(m.start(), 0, m.end()) for m in LOOSE_MAIL.finditer(text)]
    for region in REGION.finditer(text):
        part, shift = region.group(), region.start()
        if len(part) < 7:
            continue
        for m in LOOSE_NUMBER.finditer(part):
            value, start, end = m.group(), shift + m.start(), shift + m.end()
            count = len(value) if value.isdigit() else len(NOT_DIGIT.sub("", value))
            if not 7 <= count <= 25:
                continue
            if value.count(".") == 3 and not set("+( -") & set(value):
                loose.append((start, 1, end))
            elif 13 <= count <= 19 and value[0] not in "+(":
                loose.append((start, 2, end))
            elif count <= 15 and (value[0] in "+(" or not value.isdigit()):
                loose.append((start, 3, end))
    spans = [(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in loose if free(s, e)]
    return [(s, k, e, b, *_votes(text, k, s, e, b)) for s, k, e, b in sorted(spans)]


@dataclass(frozen=True)
class PiiModel:
    """Per kind: weight of every (function, vote) and (shape), and an intercept. reliability: for reading."""

    weights: dict[int, dict[str, float]] = field(default_factory=dict)
    reliability: dict[int, list[float]] = field(default_factory=dict)


def _terms(votes: str, shape: str) -> list[str]:
    return [f"{i}{v}" for i, v in enumerate(votes) if v != "0"] + [f"shape {shape}", "one"]


def reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM with one accuracy a function, nothing voted being uninformative: chance of each pattern, accuracies.

    The first two functions of a kind test its form and its checksum, gazetteer or mark. They start far more reliable than
    the rest, which fixes which class is the real one; ``PRIOR_VOTES`` votes a function hold that belief against few data, and
    the votes of a large corpus alone set its estimate.
    """
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[v] for v in p] for p in patterns], float)
    believed = np.where(np.arange(votes.shape[1]) < 2, 0.97, 0.65)
    accuracy, share = believed, 0.5
    chance = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + votes @ np.log(accuracy / (1 - accuracy))
        chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        right = ((votes > 0) * chance[:, None] + (votes < 0) * (1 - chance[:, None])) * counts[:, None]
        cast = (votes != 0) * counts[:, None]
        accuracy = np.clip((right.sum(0) + PRIOR_VOTES * believed) / (cast.sum(0) + PRIOR_VOTES), 0.51, 0.99)
        share = float(np.clip((chance * counts).sum() / counts.sum(), 0.02, 0.98))
    return chance, accuracy


def fit(docs: DataFrame) -> PiiModel:
    """Vote patterns of all candidates of all texts are counted; EM and the classifier work on the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small_batches(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update((k, votes, shape) for _, k, _, _, votes, shape in candidates(text))
        kinds, votes, shapes = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(votes, pa.string()), pa.array(shapes, pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["kind", "votes", "shape", "n"],
        )
    counted = docs.select("text").mapInArrow(run, "kind int, votes string, shape string, n long")
    rows = counted.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n")).orderBy("kind", "votes", "shape").collect()  # bounded patterns
    weights, reliability = {}, {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        n = np.array([r["n"] for r in own], float)
        chance, accuracy = reliabilities([r["votes"] for r in own], n)
        reliability[kind] = accuracy.tolist()
        names = sorted({t for r in own for t in _terms(r["votes"], r["shape"])})
        place = {name: i for i, name in enumerate(names)}
        x = np.zeros((len(own), len(names)))
        for i, r in enumerate(own):
            x[i, [place[t] for t in _terms(r["votes"], r["shape"])]] = 1
        weights[kind] = dict(zip(names, _soft_logistic(x, chance, n).tolist(), strict=True))
    return PiiModel(weights, reliability)


def _soft_logistic(x: np.ndarray, chance: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights for soft labels of counted rows, by Newton's method."""
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (n * (chance - p)) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def accepted(kind: int, votes: str, shape: str, model: PiiModel) -> bool:
    """Whether the classifier takes a candidate that is no base span."""
    own = model.weights.get(kind)
    return own is not None and sum(own.get(t, 0.0) for t in _terms(votes, shape)) > 0


def find_spans(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, base: array of (kind, start, end) of the base patterns, spans: these and the added ones; code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches):
            base, spans = [], []
            for text in batch.column("text").to_pylist():
                found = candidates(text) if text else []
                row = lambda c: {"kind": KINDS[c[1]], "start": c[0], "end": c[2]}
                base.append([row(c) for c in found if c[3]])
                spans.append([row(c) for c in found if c[3] or accepted(c[1], c[4], c[5], model)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
