"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the
histogram of vote patterns estimates how each rule votes on good and on bad documents; the
posterior probability that a document is good decides, next to the hard base rule.

The histogram has at most 3**len(RULES) rows and is built over all documents by a
pre-aggregated count, so the driver holds a bounded table whatever the corpus size. The
texts are read twice and never shuffled.

Defined cases: null or empty text has no words and fails the base rule; other columns pass
through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import fresh
from .workers import lean

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Documents at or above this posterior are kept.
KEEP_AT = 0.5
EM_STEPS = 300
#: Prior for a rule's accuracy on good documents, and for that on bad ones: it knows some kinds only.
PRECISION, RECALL = 0.998, 0.25
#: Weight of each of these priors in documents, whatever the corpus size.
PRIOR_DOCS = 20
GOOD, BAD, ABSTAIN = 2, 0, 1
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS = b"0123456789"
#: Everything in ASCII but letters, white space and the marks of prose becomes "#".
ODD = bytes(ord("#") if 32 < c < 127 and not chr(c).isalpha() and chr(c) not in ".,;:!?'\"()-" else c for c in range(256))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice, exactly."""
    n = len(words)
    if n <= window:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = ids * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        rolled = np.zeros(n - window + 1, np.uint64)
        for k in range(window):
            rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : n - window + 1 + k]
    order = np.sort(rolled)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Some hash occurs twice: name the windows exactly, doubling the length named.
    index: dict[bytes, int] = {}
    name = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    length = 1
    while length < window:
        pairs = name[: len(name) - length] * (int(name.max()) + 1) + name[length:]
        name = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        length *= 2
    starts = np.flatnonzero(np.bincount(name)[name] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measures(raw: bytes) -> dict[str, float]:
    """What the rules look at, for one text as UTF-8 bytes."""
    words = raw.split()
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup = full = ended = 0
    for line in lines:
        end = line.rstrip(SPACE)
        if end.lstrip(SPACE):
            full += 1
            ended += end[-1:] in (b".", b"!", b"?", b":", b'"', b")")
            if line in seen:
                dup += 1
            seen.add(line)
    solid = raw.translate(None, SPACE)
    cont = len(solid) - len(solid.translate(None, bytes(range(0x80, 0xC0))))
    odd = raw.translate(ODD)
    count = lambda chars: len(solid) - len(solid.translate(None, chars))
    upper, lower = count(UPPER), count(LOWER)
    return {
        "n_words": len(words), "word_chars": len(solid) - cont, "n_symbols": count(SYMBOLS), "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words), "n_lines": full, "n_ended": ended, "n_upper": upper,
        "n_ascii_letters": upper + lower, "n_digits": count(DIGITS), "n_distinct": len(set(words)), "n_shouts": count(b"!"),
        "n_odd": sum(b"#" in w for w in odd.split()) if b"#" in odd else 0,
    }


def _band(value: float, bad_low: float, good_low: float, good_high: float, bad_high: float) -> int:
    if value < bad_low or value > bad_high:
        return BAD
    return GOOD if good_low <= value <= good_high else ABSTAIN


INF = float("inf")
#: name -> vote of a document's measures. Thresholds are parameters of the operator, not learned.
RULES = {
    "length": lambda m: _band(m["n_words"], 20, 50, INF, INF),
    "word_length": lambda m: _band(m["word_chars"] / max(1, m["n_words"]), 2.5, 3.5, 10, 14),
    "symbols": lambda m: _band(m["n_symbols"] / max(1, m["n_words"]), -1, 0, 0.02, 0.2),
    "odd_words": lambda m: _band(m["n_odd"] / max(1, m["n_words"]), -1, 0, 0.05, 0.2),
    "repetition": lambda m: min(
        _band(m["n_dup_lines"] / max(8, m["n_lines"]), -1, 0, 0.05, 0.3),
        _band(m["n_repeat_words"] / max(1, m["n_words"]), -1, 0, 0.05, 0.3),
    ),
    "variety": lambda m: _band(m["n_distinct"] / max(1, m["n_words"]) ** 0.8, 0.6, 1.0, INF, INF),
    "capitals": lambda m: _band(m["n_upper"] / max(1, m["n_ascii_letters"]), -1, 0, 0.15, 0.4),
    "exclaiming": lambda m: _band(m["n_shouts"] / max(1, m["n_words"]), -1, 0, 0.02, 0.1),
    "digits": lambda m: _band(m["n_digits"] / max(1, m["word_chars"]), -1, 0, 0.1, 0.25),
    "sentences": lambda m: _band(m["n_ended"] / m["n_lines"], 0.05, 0.5, INF, INF) if m["n_lines"] >= 3 else ABSTAIN,
}


def base_failed(m: dict[str, float]) -> bool:
    return m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]


def pattern(m: dict[str, float]) -> int:
    """The votes as one number in base 3."""
    code = 0
    for vote in RULES.values():
        code = code * 3 + vote(m)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """(patterns, rules) votes behind the numbers."""
    return np.stack([codes // 3 ** (len(RULES) - 1 - j) % 3 for j in range(len(RULES))], axis=1)


def fit(codes: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """Posterior probability of good for each vote pattern.

    Two latent classes, votes independent within a class, abstaining uninformative. Each rule
    has its accuracy on good and on bad documents, learned from how far other rules agree with
    it; priors weigh as much as PRIOR_DOCS documents. Every kind of junk has two rules or more,
    so a rule whose bad votes no other rule shares is one that misjudges good documents.
    """
    votes = votes_of(codes)
    good, bad = votes == GOOD, votes == BAD
    post = np.choose(np.minimum(bad.sum(axis=1), 2), [0.98, 0.5, 0.05])
    weight = counts.astype(float)
    for _ in range(steps):
        g, b = weight * post, weight * (1 - post)
        prior = (g.sum() + 1) / (weight.sum() + 2)
        right_good = (g @ good + PRECISION * PRIOR_DOCS) / (g @ (good | bad) + PRIOR_DOCS)
        right_bad = (b @ bad + RECALL * PRIOR_DOCS) / (b @ (good | bad) + PRIOR_DOCS)
        up = np.log(prior) + good @ np.log(right_good) + bad @ np.log1p(-right_good)
        down = np.log1p(-prior) + bad @ np.log(right_bad) + good @ np.log1p(-right_bad)
        before, post = post, 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
        if np.abs(post - before).max() < 1e-9:
            break
    return post


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint),
    base_failed, quality (double, the posterior) and kept.

    Added names that docs already has get a trailing underscore.
    """
    raw = F.col(text_col).cast("binary").alias("raw")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0):
                code = pattern(measures(text.as_py() or b""))
                found[code] = found.get(code, 0) + 1
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    rows = docs.select(raw).mapInArrow(lean(tally), "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    codes = np.array([r.pattern for r in rows], np.int64)
    post = fit(codes, np.array([r.n for r in rows])) if rows else np.zeros(0)
    table = dict(zip(codes.tolist(), post.tolist(), strict=True))

    names = docs.columns
    added: list[str] = []
    for c in (*BASE, "base_failed", "quality", "kept"):
        added.append(fresh([*names, *added], c))
    kinds = [T.LongType()] * len(BASE) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(added, kinds, strict=True)]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in added]
            for text in batch.column(len(names)):
                m = measures(text.as_py() or b"")
                failed, p = base_failed(m), table[pattern(m)]
                for col, value in zip(out, [*(int(m[k]) for k in BASE), failed, p, not failed and p >= keep_at], strict=True):
                    col.append(value)
            types = [pa.int64()] * len(BASE) + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], names=[*names, *added])

    return docs.withColumn(fresh(names, "raw"), raw).mapInArrow(lean(judge), schema)


def digest(docs: DataFrame) -> DataFrame:
    """The op6 result."""
    return apply_rules(docs.select("doc_id", "text")).drop("text")
