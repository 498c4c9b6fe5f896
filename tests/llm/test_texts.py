"""Operators on texts against brute force: quality rules, line dedup, repeated spans, licenses, language model."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import bloom, katz_lm, license_scan, line_dedup, quality_rules, repeated_spans, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def frame(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(parts)


def prose(seed, n=60):
    rng = random.Random(seed)
    lines = ["  The quick Brown fox jumps over it ", "the QUICK brown fox jumps over it\t", "short", "", " ", "éñ ünï cödé lïne öf 20 chars", "a line that only two documents hold"]
    out = [None, "", "\n\n", "x" * 3000, lines[6], "y\n" + lines[6]]
    for _ in range(n):
        out.append("\n".join(rng.choice([*lines[:6], " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(12)))]) for _ in range(rng.randrange(1, 9))))
    return out


# line dedup -----------------------------------------------------------------


def brute_lines(rows, min_chars=20, min_docs=3):
    keyed = {d: [(line, low(line.strip(" \t\n\v\f\r"))) for line in (t or "").split("\n")] for d, t in rows}
    docs_of = {}
    for d, lines in keyed.items():
        for _, k in lines:
            if len(k) >= min_chars:
                docs_of.setdefault(k, set()).add(d)
    gone = {k: max(v) for k, v in docs_of.items() if len(v) >= min_docs}
    out = {}
    for d, lines in keyed.items():
        keep = [x for x, k in lines if gone.get(k, d) == d]
        out[d] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def test_line_dedup(spark):
    texts = prose(1)
    got = line_dedup.digest(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == brute_lines(list(enumerate(texts)))


def test_line_dedup_columns_and_odd_rows(spark):
    line = "this line is held by many documents"
    schema = "doc_id bigint, n_lines string, text string, drop_keys int"
    rows = [(1, "a", line, 1), (1, "b", line, None), (2, "c", line, 3), (None, "d", line, 4), (3, None, line, 5), (4, "e", None, 6)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "n_lines", "text", "drop_keys", "n_lines_", "n_dropped"]
    assert {(r.doc_id, r.n_lines, r.text) for r in out.collect()} == {(1, "a", ""), (1, "b", ""), (2, "c", ""), (None, "d", line), (3, None, line), (4, "e", None)}
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0


def filtered(spark, blocks, ranges):
    rows = [r for n, keys in enumerate(blocks) for r in bloom.asks(n, keys, ranges)]
    asked = spark.createDataFrame([(b, s, bytearray(d)) for b, s, d in rows], bloom.ASK).repartition(4)
    out = bloom.repeated(asked, "test").collect()
    return {(r.block, int(p)): int(k) for r in out for k, p in zip(np.frombuffer(r.keys, "<u8"), np.frombuffer(r.places, "<i8"), strict=True)}


@pytest.mark.parametrize("ranges", [1, 7])
def test_filters_find_every_repeat_and_little_else(spark, ranges):
    hashed = lambda x: np.asarray(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    blocks = [hashed(np.arange(0, 4000)), hashed(np.arange(3500, 7000)), hashed([9000, 9001, 9000])]
    found = filtered(spark, blocks, ranges)
    assert all(int(blocks[b][p]) == k for (b, p), k in found.items())
    sure = {(0, k) for k in range(3500, 4000)} | {(1, k) for k in range(500)} | {(2, 0), (2, 2)}
    assert sure <= set(found) and len(found) <= len(sure) + 200


def test_filters_grow_with_the_keys(spark, monkeypatch):
    """Many times more keys than one range is planned for: ranges multiply and still prune."""
    monkeypatch.setattr(bloom, "RANGE_KEYS", 10_000)
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 600_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    again = rng.choice(keys, 500, replace=False)
    ranges = bloom.ranges_for(600_500, 4)
    assert ranges == 61
    found = filtered(spark, [*np.array_split(keys, 6), again], ranges)
    assert sum(b == 6 for b, _ in found) == 500 and len(found) < 1000 + 0.03 * len(keys)


# quality --------------------------------------------------------------------


def brute_quality(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    dup = sum(bool(WORD.search(line)) and line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_measures(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "a b c d e f g h", "a b c d e f g h " * 2, "é# ñ*\né# ñ*\n \n ", "x " * 100, "a\x1cb\x85c d"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    got = {r.doc_id: r for r in quality_rules.digest(frame(spark, texts)).collect()}
    for d, t in enumerate(texts):
        r, want = got[d], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_quality_verdicts_on_held_out_kinds(spark):
    rng = random.Random(5)
    words = lambda n: [f"{'bcdfgl'[rng.randrange(6)]}{'aeiou'[rng.randrange(5)]}w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n)]
    good = [". ".join(" ".join(words(9)).capitalize() for _ in range(8)) + "." for _ in range(300)]
    symbols = [" ".join(w + "&&&" for w in words(60)) for _ in range(20)]
    shouts = [" ".join(w.upper() + "!!" for w in words(60)) for _ in range(20)]
    got = {r.doc_id: r.kept for r in quality_rules.digest(frame(spark, good + symbols + shouts)).collect()}
    assert sum(got[d] for d in range(300)) >= 297 and not any(got[d] for d in range(300, 340))
    assert quality_rules.apply_rules(spark.createDataFrame([], "doc_id bigint, text string, kept int")).columns[-1] == "kept_"


def test_quality_keeps_a_source_that_one_rule_misjudges(spark):
    rng = random.Random(9)
    words = lambda n: [f"{'bcdfgl'[rng.randrange(6)]}{'aeiou'[rng.randrange(5)]}w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n)]
    good = [". ".join(" ".join(words(9)).capitalize() for _ in range(8)) + "." for _ in range(400)]
    verse = ["\n".join(" ".join(words(6)).capitalize() for _ in range(12)) for _ in range(200)]
    junk = [" ".join(w + "###" for w in words(60)) for _ in range(20)] + [" ".join(w.upper() + "!!" for w in words(60)) for _ in range(20)]
    got = {r.doc_id: r for r in quality_rules.digest(frame(spark, good + verse + junk)).collect()}
    assert all(got[d].kept for d in range(600)) and not any(got[d].kept for d in range(600, 640))


@pytest.mark.parametrize("size", [300, 3_000_000])
def test_quality_learns_accuracies_at_any_size(size):
    votes = lambda **bad: sum(bad.get(r, quality_rules.GOOD) * 3 ** (len(quality_rules.RULES) - 1 - k) for k, r in enumerate(quality_rules.RULES))
    bad = lambda *rules: votes(**dict.fromkeys(rules, quality_rules.BAD))
    kinds = [("symbols", "odd_words"), ("repetition", "variety"), ("capitals", "exclaiming")]
    for rule in list(quality_rules.RULES)[1:]:
        junk = [bad(*k) for k in kinds if rule not in k]
        post = quality_rules.fit(np.array([votes(), bad(rule), *junk]), np.array([size, size // 2, *[size // 20] * len(junk)]))
        assert (post[:2] > 0.5).all() and (post[2:] < 0.5).all(), rule


# repeated spans -------------------------------------------------------------


def brute_spans(raws, length):
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        cover = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        out.append((len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


def span_texts():
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefghij éß") for _ in range(n))
    passages = [make(n) for n in (400, 401, 399, 650, 1200)]
    texts = [None, "", "short", make(700), "z" * 1500, "ab" * 700, make(399)]
    copy = make(2000)
    texts += [copy, copy, copy[:900] + "X" + copy[901:], make(50) + passages[3] + make(50) + passages[3]]
    return texts + [make(rng.randrange(200)) + rng.choice(passages) + make(rng.randrange(200)) for _ in range(24)]


@pytest.mark.parametrize(("length", "hot"), [(400, repeated_spans.HOT), (400, 2), (50, repeated_spans.HOT), (50, 3)])
def test_repeated_spans(spark, length, hot):
    texts = span_texts()
    out = repeated_spans.remove_repeats(frame(spark, texts), length=length, hot=hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()}
    assert [got[d] for d in range(len(texts))] == brute_spans([(t or "").encode() for t in texts], length)


def test_long_texts_are_read_in_pieces(monkeypatch):
    texts = span_texts()
    whole = [x for t in texts if t for h in repeated_spans.choices(t.encode(), 400) for x in zip(*h, strict=True)]
    monkeypatch.setattr(repeated_spans, "PIECE", 256)
    cut = {(int(h), int(p), i) for t in texts if t for c in repeated_spans.choices(t.encode(), 400) for h, p, a, b in zip(*c, strict=True) for i in range(a, b + 1)}
    assert cut == {(int(h), int(p), i) for h, p, a, b in whole for i in range(a, b + 1)}


@pytest.mark.parametrize("v", [1, 2, 4, 8, 16, 64])
def test_difference_cover(v):
    chosen = suffixes.cover(v)
    assert {(a - b) % v for a in chosen.tolist() for b in chosen.tolist()} == set(range(v))


@pytest.mark.parametrize("length", [1, 3, 9, 17, 64, 100, 400])
def test_suffix_blocks_equal_brute_force(length):
    rng = random.Random(length)
    unit = bytes(rng.choice(b"ab\0") for _ in range(length + 9))
    shared = bytearray(unit * 2)
    parts = [b"a" * (2 * length), bytes(shared), bytes(rng.randrange(256) for _ in range(3 * length)), unit, unit[: length // 2] + b"!" + unit[length // 2 + 1 :]]
    # Many strings that tie at both ends and differ in the middle.
    ends = bytes(rng.choice(b"xy") for _ in range(length))
    for k in range(60):
        parts.append(ends[: length // 2] + bytes([k % 25]) + ends[length // 2 + 1 :])
    rng.shuffle(parts)
    parts = [p for p in parts if len(p) >= length]
    got = repeated_spans.block_repeats(parts, length)
    seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    assert [g.tolist() for g in got] == [[seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in parts]


def test_repeated_spans_columns(spark):
    out = repeated_spans.remove_repeats(spark.createDataFrame([(None, "a" * 900, "x"), (None, None, None)], "doc_id bigint, text string, kept string"))
    assert out.columns == ["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans", "spans", "kept_"]
    assert sorted((r.n_bytes, r.n_removed) for r in out.collect()) == [(0, 0), (900, 900)]
    assert repeated_spans.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# licenses -------------------------------------------------------------------


def brute_licenses(texts, templates, least):
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    sets = {n: {tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} for n, t in templates.items()}
    out = set()
    for d, t in enumerate(texts):
        w = words(t or "")
        have = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        out |= {(d, n) for n, s in sets.items() if len(s & have) >= least * len(s)}
    return out


def test_license_scan(spark):
    rng = random.Random(7)
    filler = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    texts = [None, "", "MIT", filler(400)]
    for t in license_scan.TEMPLATES.values():
        for k in (0, 1, 2, 7, 300):
            texts.append(f"{filler(k)}\n{t.upper() if k == 7 else t}\n{filler(k)}")
        texts.append(t + " " + t)
    got = license_scan.scan(frame(spark, texts)).collect()
    want = brute_licenses(texts, license_scan.TEMPLATES, 0.8)
    found = {(r.doc_id, r.license) for r in got}
    assert found <= want and len(found) >= 0.98 * len(want) and len(got) == len(found)
    plan = license_scan.scan(frame(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(frame(spark, texts), templates={}).count() == 0


def test_license_scan_misses_no_short_notice(spark):
    rng = random.Random(10)
    filler = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    templates = {**license_scan.TEMPLATES, "two": "Free to use by anyone here."}
    texts = [f"{filler(k)} {t} {filler(20)}" for t in (templates["MIT"], templates["two"]) for k in [0] * 200 + [1, 2, 9] * 100]
    found = {(r.doc_id, r.license) for r in license_scan.scan(frame(spark, texts), templates=templates).collect()}
    assert found == brute_licenses(texts, templates, 0.8) and len(found) == len(texts)


# language model -------------------------------------------------------------


class Katz:
    """A plain dictionary version of the model: probabilities of a word after up to two words."""

    def __init__(self, texts, order):
        self.grams = [Counter() for _ in range(order)]
        for t in texts:
            w = ["<s>", *t, "</s>"]
            self.grams[0].update((x,) for x in w[1:])
            for n in range(2, order + 1):
                self.grams[n - 1].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        count_of = lambda c: [sum(v == k for v in c.values()) for k in range(1, katz_lm.KATZ_K + 2)]
        totals = lambda c: [*count_of(c), len(c), sum(c.values())]
        self.model = katz_lm.Model(*map(totals, self.grams))
        self.after = {}
        for c in self.grams[1:]:
            for gram, n in c.items():
                self.after.setdefault(gram[:-1], {})[gram[-1]] = n

    def given(self, history, w):
        history = history[-len(self.grams) + 1 :] if len(self.grams) > 1 else ()
        if not history:
            return float(self.model.word(np.array([self.grams[0][w,]]))[0])
        seen = self.after.get(history)
        if not seen:
            return self.given(history[1:], w)
        uses = sum(seen.values())
        mine = {x: float(self.model.discounted(np.array([n]), len(history) + 1)[0]) for x, n in seen.items()}
        free, scale = 1 - sum(mine.values()) / uses, 1.0
        if free <= 1e-9:
            free = 1 / (uses + 1)
            scale = 1 - free
        if w in mine:
            return scale * mine[w] / uses
        return free / (1 - sum(self.given(history[1:], x) for x in mine)) * self.given(history[1:], w)


def lm_texts():
    """Words that mostly follow from the one before, so that a bigram model has something to learn."""
    rng = random.Random(8)
    texts = [None, "", "Unseen WORDS only", "a " * 30]
    for _ in range(80):
        w, out = rng.randrange(30), []
        for _ in range(rng.randrange(40)):
            out.append(f"w{w}")
            w = (w * 3 + rng.randrange(2)) % 30
        texts.append(" ".join(out))
    return texts


@pytest.mark.parametrize(("size", "order"), [(2_000_000, 3), (50, 3), (7, 3), (50, 2)])
def test_katz_scores(spark, monkeypatch, size, order):
    monkeypatch.setattr(katz_lm, "BLOCK_TOKENS", size)
    texts = lm_texts()
    split = [WORD.findall(low(t or "")) for t in texts]
    held = [zlib.crc32(str(d).encode()) % 5 == 1 for d in range(len(texts))]
    plain = Katz([w for w, h in zip(split, held, strict=True) if not h], order)
    known = plain.grams[0]
    n, v = sum(known.values()), len(known)
    got = {r.doc_id: r for r in katz_lm.score(frame(spark, texts), order=order).collect()}
    for d, w in enumerate(split):
        r, w = got[d], [*w, "</s>"]
        before = ["<s>", *w]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(known[x,] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((known[x,] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(plain.given(tuple(before[max(0, k - 1) : k + 1]), x)) for k, x in enumerate(w)))
    for h in [("<s>",), ("<s>", "w0"), ("w0",), ("w3", "w9"), ("a", "a"), ("w1", "nowhere"), ("nowhere",)]:
        assert sum(plain.given(h, x) for (x,) in known) + plain.given(h, "unknown") == pytest.approx(1)
    mine = [r for d, r in got.items() if held[d]]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_katz_orders(spark):
    with pytest.raises(ValueError, match="order"):
        katz_lm.score(frame(spark, ["a b"]), order=4)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_sorting_by_packed_places(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
    keys[: n // 2] = (keys[: n // 2] & np.uint64(3)) + (keys[n // 2 : n // 2 * 2] >> np.uint64(20) << np.uint64(20))
    keys = np.append(keys, keys[::3])
    assert (katz_lm._order(keys) == np.argsort(keys, kind="stable")).all()
    for values in (keys[::2].astype(np.int64) >> 40, keys.astype(np.int64) >> 1):
        for mine, theirs in zip(katz_lm._numbered(values), np.unique(values, return_inverse=True), strict=True):
            assert (mine == theirs).all()


def test_katz_on_odd_tables(spark):
    schema = "doc_id bigint, text string, score int"
    assert katz_lm.score(spark.createDataFrame([], schema)).count() == 0
    only_held = next(d for d in range(50) if zlib.crc32(str(d).encode()) % 5 == 1)
    assert katz_lm.score(spark.createDataFrame([(only_held, "a b", 1)], schema)).first().train_tokens == 0
    assert katz_lm.score(spark.createDataFrame([(None, "a b", 1), (None, "a b", 1)], schema)).count() == 2


def test_quality_verdict_is_no_veto():
    """Simulated votes of rules with known accuracies: single bad votes of weak rules don't convict, agreement does."""
    rng = np.random.default_rng(12)
    k, n = len(quality_rules.RULES), 40_000
    good = rng.random(n) < 0.8
    right_good, right_bad = rng.uniform(0.85, 0.98, k), rng.uniform(0.6, 0.9, k)
    right = rng.random((n, k)) < np.where(good[:, None], right_good, right_bad)
    votes = np.where(right == good[:, None], quality_rules.GOOD, quality_rules.BAD)
    votes = np.where(rng.random((n, k)) < 0.2, quality_rules.ABSTAIN, votes)
    codes, place, counts = np.unique(votes @ 3 ** np.arange(k - 1, -1, -1), return_inverse=True, return_counts=True)
    kept = quality_rules.fit(codes, counts)[place] >= 0.5
    bad_vote = (votes == quality_rules.BAD).any(axis=1)
    assert (kept == good).mean() > 0.98
    assert (kept & bad_vote).sum() > 0.3 * n  # a filter of all-must-pass would drop these
    assert (~kept & ((votes == quality_rules.BAD).sum(axis=1) < 2)).sum() < 0.01 * n
