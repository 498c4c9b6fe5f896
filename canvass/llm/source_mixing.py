"""Mixing to target weights by soft membership. DataFrame functions only.

Domains are ``clean``, ``low`` (quality 0) and ``toxic``. A labelled table trains a classifier: the
words and marks of style that tell the domains low and toxic apart in a labelled sample are its
markers, and a multinomial logistic regression on them gives each document its posteriors.
A document counts towards each domain by its posterior times its words.

Nonnegative rates for the documents are then fitted by projected gradient steps on the squared
difference between the domains' expected word totals and their targets. The steps are taken in the
metric in which long and short documents move alike, and differences are measured in the inverse of
the domains' Gram matrix, so that a small domain weighs as much as a large one. Documents of equal posteriors share a row of
totals; a step is one small aggregate over these. Rates are a nested expression of the posteriors,
so no state is written between steps.

The targets are WEIGHTS of the largest budget, up to all words, that asks no domain for more than
MAX_EPOCHS of its words. Only where a domain is so scarce that clean words would have to go for
it, it takes what MAX_EPOCHS allows and the others keep their weights among themselves. Where the
classifier can't tell domains apart, nonnegative rates can leave a share short of its target. The
report (``Plan.report``) has targets, goals and what is reached; both cases are logged as warnings
with these figures, and ``strict`` turns the second into an error.

The labelled sample is bounded by MAX_LABELLED rows (least hash of the id), the word list by
MARKERS a domain; word totals and the fit cover all documents.

Defined cases: null or empty text has no words and takes the posterior of a text without
words; without labels every document is clean; labels with a null quality count as
quality 1, a null toxic as 0; rows that repeat an id are documents of their own; an empty table
gives an empty table.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fresh, written

DOMAINS = ("clean", "low", "toxic")
#: Share of all words that each domain should have.
WEIGHTS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}
#: A domain's words are never asked for more often than this.
MAX_EPOCHS = 1.05
MAX_LABELLED = 8_000
MARKERS = 400
#: Posteriors are multiples of 1 / GRID, so the fit runs over a table of bounded size.
GRID = 100
STEPS = 12
#: Shares further than this from their goals are not met.
TOLERANCE = 0.02
LOG = logging.getLogger(__name__)


def _words(text_col: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")


class Classifier:
    """Multinomial logistic regression on which of a bounded list of markers a text has."""

    def __init__(self, markers: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.markers, self.weights, self.bias = markers, weights, bias

    def posteriors(self, marks: Column) -> Column:
        """Array of a domain's posterior each, in steps of 1 / GRID, from the places (from 1) of a text's markers."""
        if not self.markers:
            p = np.exp(self.bias - self.bias.max())
            return F.array(*[F.lit(float(x)) for x in np.round(p / p.sum() * GRID) / GRID])
        tables = [F.lit([float(x) for x in column]) for column in self.weights.T]
        total = lambda k: F.aggregate(marks, F.lit(float(self.bias[k])), lambda s, at: s + F.element_at(tables[k], at.cast("int")))
        scores = F.array(*[total(k) for k in range(len(DOMAINS))])
        powers = F.transform(scores, lambda x: F.exp(F.greatest(x, F.lit(-60.0))))
        sums = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
        return F.transform(powers, lambda x: F.round(x / sums * GRID) / GRID)

    def marks(self, tokens: Column) -> Column:
        """The places of a text's markers."""
        if not self.markers:
            return F.array().cast("array<bigint>")
        known = F.lit(self.markers)
        return F.transform(F.array_intersect(tokens, known), lambda w: F.array_position(known, w))


def _tokenized(frame: DataFrame, text_col: str, words: str, tokens: str) -> DataFrame:
    """``frame`` plus its number of words and the tokens by which a text is classified: its words and
    marks of length, symbols and repetition, whose first character no word has."""
    split, measured = (fresh([*frame.columns, words, tokens], c) for c in ("mix_split", "mix_measured"))
    own = [F.col(f"`{c}`") for c in frame.columns]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # explode() of one element keeps the optimizer from computing a value anew for each of its uses.
    apart = frame.select(*own, F.explode(F.array(F.struct(_words(text_col).alias("w"), (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).alias("symbols")))).alias(split))
    n = F.size(f"{split}.w")
    distinct = fresh([*frame.columns, words, tokens, split, measured], "mix_distinct")
    apart = apart.select(*own, n.alias(words), F.col(f"{split}.symbols").alias(split), F.explode(F.array(F.array_distinct(f"{split}.w"))).alias(distinct))
    n = F.greatest(F.col(words), F.lit(1))
    apart = apart.select(*own, words, distinct, F.struct(n.alias("n"), (F.col(split) / n).alias("symbols"), (F.size(distinct) / F.pow(n, F.lit(0.8))).alias("variety")).alias(measured))

    def graded(name: str, steps: tuple) -> Column:
        return F.concat(F.lit(f"\n{name}"), sum((F.when(F.col(f"{measured}.{name}") >= k, 1).otherwise(0) for k in steps), F.lit(0)).cast("string"))

    marks = F.array(graded("n", (20, 50)), graded("symbols", (0.01, 0.05, 0.2, 0.6)), graded("variety", (0.3, 0.6, 1.0, 1.4)))
    return apart.select(*own, F.col(words).cast("bigint").alias(words), F.concat(distinct, marks).alias(tokens))


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, ridge: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by accelerated gradient steps on the bounded labelled sample."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    size = max(1.0, float((x.astype(np.float64) ** 2).sum(axis=1).mean()) * len(x) / 2 + ridge)
    w = ahead = np.zeros((x.shape[1], y.shape[1]), np.float32)
    keep = np.append(np.full(x.shape[1] - 1, ridge), 1e-3).astype(np.float32)[:, None]
    size = np.float32(size)
    for step in range(steps):
        score = x @ ahead
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        before, w = w, ahead - (x.T @ (p - y) + keep * ahead) / size
        ahead = w + np.float32(step / (step + 3)) * (w - before)
    return w[:-1].astype(float), w[-1].astype(float)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Classifier:
    quality, toxic = F.coalesce("quality", F.lit(1)), F.coalesce("toxic", F.lit(0))
    domain = F.when(toxic == 1, "toxic").when(quality == 0, "low").otherwise("clean")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(domain.alias("domain")), F.struct(quality, toxic)).alias("d")).select("doc_id", "d.domain")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    sample = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(_tokenized(sample.select("domain", "text"), "text", "n", "tokens").select("domain", "tokens"), "labelled")
    n = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    rest = {d: sum(n.values()) - n.get(d, 0) for d in DOMAINS}
    if not n:
        return Classifier([], np.zeros((0, len(DOMAINS))), np.array([0.0, -60.0, -60.0]))
    counts = sample.select("domain", F.explode("tokens").alias("token")).groupBy("token").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    markers: set[str] = set()
    for d in DOMAINS[1:]:
        if not n.get(d) or not rest[d]:
            continue
        other = sum((F.col(x) for x in DOMAINS if x != d), F.lit(0))
        share = (F.col(d) + other) / (n[d] + rest[d])
        score = (F.col(d) / n[d] - other / rest[d]) / F.sqrt(share * (1 - share) * (1 / n[d] + 1 / rest[d]) + 1e-12)
        ranked = counts.where((F.col(d) >= 3) & (F.col(d) / n[d] > 3 * other / rest[d])).select("token", score.alias("z")).where("z > 4")
        markers |= {r.token for r in ranked.orderBy(F.desc("z"), "token").limit(MARKERS).collect()}
    model = Classifier(sorted(markers), np.zeros((len(markers), len(DOMAINS))), np.zeros(len(DOMAINS)))
    rows = sample.select("domain", model.marks(F.col("tokens")).alias("marks")).collect()  # MAX_LABELLED rows of at most 2 MARKERS places
    x, y = np.zeros((len(rows), len(markers)), np.float32), np.zeros((len(rows), len(DOMAINS)), np.float32)
    for k, r in enumerate(rows):
        x[k, [m - 1 for m in r.marks]] = 1
        y[k, DOMAINS.index(r.domain)] = 1
    model.weights, model.bias = _fit_logistic(x, y)
    model.bias[[k for k, d in enumerate(DOMAINS) if not n.get(d)]] = -60.0
    return model


def goals(have: np.ndarray, share: np.ndarray, max_epochs: float) -> np.ndarray:
    """The words that each domain should have."""
    total = have.sum()
    there = (share > 0) & (have > 1e-9 * total)
    budget = min([total, *(max_epochs * have[there] / share[there])])
    if share[0] > 0:
        budget = max(budget, have[0] / share[0])  # so large that clean words need not go for a scarce domain
    return np.minimum(share * budget, max_epochs * have)


def fit(totals: DataFrame, weights: dict[str, float], max_epochs: float) -> tuple[list[np.ndarray], dict]:
    """Step vectors, and a report, for rows (p_<domain>, words)."""
    k = len(DOMAINS)
    p = [F.col(f"p_{d}") for d in DOMAINS]

    def state(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The domains' expected words, and their Gram matrix over documents that have a rate yet."""
        r = rate(steps, p)
        live = F.when(r > 0, F.col("words")).otherwise(F.lit(0.0))
        sums = [F.sum(F.col("words") * x * r) for x in p] + [F.sum(live * p[i] * p[j]) for i in range(k) for j in range(k)]
        got = np.array([float(v or 0.0) for v in totals.agg(*sums).first()])
        return got[:k], got[k:].reshape(k, k)

    steps: list[np.ndarray] = []
    have, whole = state(steps)
    total, share = have.sum(), np.array([weights[d] for d in DOMAINS])
    goal = goals(have, share, max_epochs)
    now, gram = have, whole
    inverse = lambda m: np.linalg.pinv(m + np.eye(k) * 1e-9 * max(1.0, total))
    fixed = inverse(whole)
    miss = lambda v: float((v - goal) @ fixed @ (v - goal))
    while len(steps) < STEPS and np.abs(now - goal).max() > 1e-6 * max(1.0, total):
        # The step over documents whose rates are above 0 is the longer one; the step over all can't overshoot.
        tried = []
        for metric in (inverse(gram), fixed):
            step = metric @ (now - goal)
            tried.append((miss(state([*steps, step])[0]), step))
            if tried[-1][0] < 0.5 * miss(now):
                break
        least, step = min(tried, key=lambda t: t[0])
        if least > miss(now) * (1 - 1e-4):
            break  # as near as nonnegative rates come
        steps.append(step)
        now, gram = state(steps)
    shares = lambda v: dict(zip(DOMAINS, (v / max(1e-9, v.sum())).tolist(), strict=True))
    return steps, {"target": dict(weights), "present": shares(have), "goal": shares(goal), "reached": shares(now), "words": float(total), "goal_words": float(goal.sum()), "reached_words": float(now.sum()), "steps": len(steps)}


def rate(steps: list[np.ndarray], p: list[Column]) -> Column:
    r = F.lit(1.0)
    for step in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.lit(float(c)) * x for c, x in zip(step, p, strict=True)), F.lit(0.0)))
    return r


class Plan:
    """A trained classifier and fitted rates. ``report`` has the shares of the domains among all
    words: target, present, goal (the target, but for domains too scarce for it) and reached."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, weights: dict[str, float], max_epochs: float) -> None:
        self.id_col, self.text_col = id_col, text_col
        self.model = train(docs, labels, id_col, text_col)
        words, posterior = "mix_words", "mix_posterior"
        tally = self._features(docs.select(text_col), words, posterior).groupBy(posterior).agg(F.sum(words).alias("words"))
        totals = written(tally.select(F.col("words").cast("double"), *[F.col(posterior)[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]), "mix-totals")
        self.steps, self.report = fit(totals, weights, max_epochs)
        gap = lambda a, b: max(abs(self.report[a][d] - self.report[b][d]) for d in DOMAINS)
        empty = not self.report["words"]
        self.met = empty or gap("goal", "reached") <= TOLERANCE
        LOG.log(logging.INFO if empty or gap("target", "reached") <= TOLERANCE else logging.WARNING, "mixing shares: %s", self.report)

    def _features(self, frame: DataFrame, words: str, posterior: str) -> DataFrame:
        tokens, marks = (fresh([*frame.columns, words, posterior], c) for c in ("mix_tokens", "mix_marks"))
        own = [F.col(f"`{c}`") for c in frame.columns]
        apart = _tokenized(frame, self.text_col, words, tokens).select(*own, words, F.explode(F.array(self.model.marks(F.col(tokens)))).alias(marks))
        return apart.select(*own, words, F.explode(F.array(self.model.posteriors(F.col(marks)))).alias(posterior))

    def apply(self, docs: DataFrame) -> DataFrame:
        words, posterior = (fresh(docs.columns, c) for c in ("mix_words", "mix_posterior"))
        added: list[str] = []
        for c in ("n_mix_words", *[f"p_{d}" for d in DOMAINS], "rate", "copies"):
            added.append(fresh([*docs.columns, words, posterior, *added], c))
        out = self._features(docs, words, posterior)
        out = out.withColumns({added[0]: F.col(words)} | {c: F.col(posterior)[k] for k, c in enumerate(added[1:4])})
        out = out.withColumn(added[4], rate(self.steps, [F.col(c) for c in added[1:4]]))
        turn = F.pmod(F.xxhash64(F.col(self.id_col), F.lit("copies")), F.lit(1_000_000)) / 1_000_000
        return out.withColumn(added[5], F.floor(F.col(added[4]) + turn).cast("bigint")).drop(words, posterior)


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, max_epochs: float = MAX_EPOCHS, strict: bool = False) -> DataFrame:
    """``docs`` plus n_mix_words (bigint), p_clean, p_low, p_toxic, rate (double) and copies (bigint):
    the rate rounded up or down by a hash of the id, so that its expectation is the rate.

    With ``strict``, shares that miss their goals by more than TOLERANCE are a ValueError; else a
    warning is logged. Added names that docs has already get a trailing underscore.
    """
    plan = Plan(docs, labels, id_col, text_col, WEIGHTS if weights is None else weights, max_epochs)
    if strict and not plan.met:
        raise ValueError(f"the target weights can't be reached: {plan.report}")
    return plan.apply(docs)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; same columns."""
    names = docs.columns
    copies = fresh([*names, *[x for c in ("n_mix_words", "p_clean", "p_low", "p_toxic", "rate") for x in [c]]], "copies")
    mixed = mix(docs, labels, id_col, text_col)
    return mixed.where(F.col(copies) >= 1).withColumn(fresh(mixed.columns, "copy"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in names])
