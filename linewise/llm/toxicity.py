"""Toxicity by maximum-scoring segments.

Token scores are log-odds between toxic and other labelled texts under a Dirichlet prior in
proportion to the tokens' counts; tokens whose log-odds are not significant share one small negative
score, that of a token that tells nothing. A linear scan finds every maximal segment of positive
sum. Segment scores are calibrated as extreme values: with n tokens, the chance of a segment of
score S or more in harmless text is 1 - exp(-K n exp(-lambda S)), lambda from the score
distribution and K from the maxima of harmless labelled texts. A passage is significant at
``significance``; a document's score joins its best passage and the sum of its significant passages
through a logistic fit on the labelled texts.

The model is fitted on at most ``labelled_rows`` labelled documents, chosen by a hash of doc_id (a documented
bound; all labelled rows below it). Its token table is bounded by that sample, is gathered on the driver
and sent to the tasks. Scoring reads every whole text. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null, empty and wordless text has no segment and the score of a text without one;
a doc_id labelled twice is toxic if either is; null labels and ids are not learned from; without both
classes every score is 0; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.llm.arrow import small_batches
from linewise.session import stored

TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicRule:
    labelled_rows: int = 50_000   # labelled documents the model is fitted on, at most
    prior: float = 20_000.0       # total weight of the Dirichlet prior, in tokens
    least_z: float = 3.0          # significance of a token's log-odds
    least_odds: float = 1.0       # size of a token's log-odds
    significance: float = 0.01    # of a passage


@dataclass(frozen=True)
class ToxicModel:
    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.05          # score of every other token
    decay: float = 1.0            # lambda
    scale: float = 1.0            # K
    weights: tuple[float, ...] = ()  # intercept, best passage, significant passages; empty: no model
    significance: float = 0.01


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def maximal_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time."""
    held: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    total = 0.0
    for i, value in enumerate(values):
        before, total = total, total + value
        if value <= 0:
            continue
        start, low = i, before
        while held:
            # the nearest segment that begins lower: all between cannot be joined to this one
            k = len(held) - 1
            while k >= 0 and held[k][2] >= low:
                k -= 1
            if k < 0 or held[k][3] >= total:
                break
            start, low = held[k][0], held[k][2]
            del held[k:]
        held.append((start, i + 1, low, total))
    return [(start, end, through - low) for start, end, low, through in held]


def _compressed(text: str | None, model: ToxicModel) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of tokens; places and scores of the tokens with a score of their own."""
    words = tokens(text)
    scores = model.scores
    places = [i for i, word in enumerate(words) if word in scores]
    return len(words), np.array(places, np.int64), np.array([scores[words[i]] for i in places])


def passages(text: str | None, model: ToxicModel) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and segments as (first token, end, score). Stretches of other tokens are one step of the scan."""
    count, places, scores = _compressed(text, model)
    if not len(places):
        return count, []
    gaps = np.diff(places, prepend=-1) - 1
    steps, ends = [], []
    for place, gap, score in zip(places.tolist(), gaps.tolist(), scores.tolist(), strict=True):
        if gap:
            steps.append(gap * model.other)
            ends.append(place)
        steps.append(score)
        ends.append(place + 1)
    return count, [(ends[start] - 1, ends[end - 1], score) for start, end, score in maximal_segments(steps)]


def features(text: str | None, model: ToxicModel) -> tuple[float, float]:
    """Normalised score of the best passage, and the sum over significant passages."""
    return features_of(*passages(text, model), model)


def features_of(count: int, found: list[tuple[int, int, float]], model: ToxicModel) -> tuple[float, float]:
    """``features`` from the passages of a text."""
    if not found:
        return -10.0, 0.0
    bits = model.decay * np.array([score for _, _, score in found]) - np.log(max(model.scale * count, 1e-9))
    # 1 - exp(-exp(-bits)) <= significance
    least = -np.log(-np.log1p(-model.significance))
    return float(np.clip(bits.max(), -10, 60)), float(np.clip(bits[bits >= least].sum(), 0, 200))


def probability(pair: tuple[float, float], model: ToxicModel) -> float:
    if not model.weights:
        return 0.0
    a, b, c = model.weights
    return float(1 / (1 + np.exp(-np.clip(a + b * pair[0] / 10 + c * pair[1] / 50, -50, 50))))


def labelled_sample(labels: DataFrame, rule: ToxicRule) -> DataFrame:
    """doc_id, toxic of at most ``labelled_rows`` labelled documents: those with the least hash of doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.labelled_rows)


def _token_counts(train: DataFrame) -> DataFrame:
    """token, and the numbers of toxic and of other texts that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for part in small_batches([batch]):
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    (toxic if label else clean).update(set(tokens(text)))
            words = list(toxic | clean)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())],
                names=["token", "toxic", "clean"],
            )
    return train.mapInArrow(run, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def token_scores(counts: DataFrame, rule: ToxicRule) -> tuple[dict[str, float], float, list[tuple[float, float]]]:
    """Scores of significant tokens, the score of any other, and (score, share) in harmless text."""
    whole = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    toxic, clean = float(whole["toxic"] or 0), float(whole["clean"] or 0)
    if not toxic or not clean:
        return {}, -0.05, []
    prior = rule.prior * (F.col("toxic") + F.col("clean")) / (toxic + clean)

    def log_odds(name: str, total: float):  # noqa: ANN202
        mass = F.col(name) + prior
        return F.log(mass / (total + rule.prior - mass))

    scored = counts.select(
        "token", "toxic", "clean", (log_odds("toxic", toxic) - log_odds("clean", clean)).alias("odds"),
        F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("error"),
    ).where((F.abs("odds") >= rule.least_odds) & (F.abs(F.col("odds") / F.col("error")) >= rule.least_z))
    rows = scored.collect()  # bounded by the labelled sample
    told_toxic, told_clean = sum(r["toxic"] for r in rows), sum(r["clean"] for r in rows)
    other = float(np.log((toxic - told_toxic + 1) / (toxic + 1)) - np.log((clean - told_clean + 1) / (clean + 1)))
    other = min(other, -0.005)  # a scan needs a drift downwards
    shares = [(r["odds"], r["clean"] / clean) for r in rows] + [(other, 1 - told_clean / clean)]
    return {r["token"]: r["odds"] for r in rows}, other, shares


def decay_of(shares: list[tuple[float, float]]) -> float:
    """The positive root of sum(share * exp(x * score)) = 1; 1 if there is none."""
    score, share = (np.array(x) for x in zip(*shares, strict=True))
    value = lambda x: float((share * np.exp(np.clip(x * score, -700, 700))).sum()) - 1
    if value(1e-6) >= 0 or not ((score > 0) & (share > 0)).any():
        return 1.0
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights with an intercept, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    weights, penalty = np.zeros(x.shape[1]), np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(x.shape[1]), x.T @ (y - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, rule: ToxicRule = ToxicRule()) -> ToxicModel:
    """The model from labelled documents; ``labels`` holds only rows that may be learned from."""
    sample = stored(labelled_sample(labels, rule))
    train = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"))  # at most labelled_rows ids
    scores, other, shares = token_scores(stored(_token_counts(train)), rule)
    if not scores:
        return ToxicModel()
    raw = ToxicModel(scores, other, decay_of(shares), significance=rule.significance)

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [passages(text, raw) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.int64()), pa.array([max((s for *_, s in f), default=0.0) for _, f in found], pa.float64()), batch.column("toxic").cast(pa.int64())],
                names=["n", "best", "toxic"],
            )
    hazard = train.mapInArrow(maxima, "n long, best double, toxic long").where("toxic = 0 and n > 0").agg(
        F.count("*").alias("rows"), F.sum(F.col("n") * F.exp(-raw.decay * F.col("best"))).alias("sum")
    ).first()
    scaled = ToxicModel(scores, other, raw.decay, hazard["rows"] / hazard["sum"] if hazard["sum"] else 1.0, (), rule.significance)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            pairs = [features(text, scaled) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in pairs], pa.float64()), pa.array([b for _, b in pairs], pa.float64()), batch.column("toxic").cast(pa.int64())],
                names=["best", "sum", "toxic"],
            )
    # equal features are counted, then weighed by repeating: the rows are bounded by the labelled sample
    counted = train.mapInArrow(described, "best double, sum double, toxic long").groupBy("best", "sum", "toxic").count().collect()
    seen = [r for r in sorted(tuple(row) for row in counted) for _ in range(r[3])]  # in one order, so that reruns agree
    x = np.array([[best / 10, total / 50] for best, total, _, _ in seen])
    weights = logistic(x, np.array([float(toxic > 0) for _, _, toxic, _ in seen]))
    return ToxicModel(scores, other, scaled.decay, scaled.scale, tuple(weights.tolist()), rule.significance)


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, predicted, passages: array of (first token, end, score) of significant passages."""
    least = float(-np.log(-np.log1p(-model.significance)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in small_batches(batches):
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                count, found = passages(text, model)
                scores.append(probability(features_of(count, found, model), model))
                spans.append([
                    {"start": a, "end": b, "score": s} for a, b, s in found
                    if model.decay * s - np.log(max(model.scale * count, 1e-9)) >= least
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)],
                names=["doc_id", "score", "predicted", "passages"],
            )
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, score double, predicted int, passages array<struct<start:long,end:long,score:double>>"
    )


def keep_harmless(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches):
            keep = [probability(features(text, model), model) < 0.5 for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """True for rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
