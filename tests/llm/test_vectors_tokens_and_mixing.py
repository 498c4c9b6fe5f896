"""Embeddings, tokens, packing, mixing and the pipeline against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from canvass.llm import components, embedding_dedup, packing, source_mixing, token_files, tokens

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\tb", "a\n\nb", "a \n b", "don't can't 'tis we'll", "ab12 3.4,5 x²y", "é é ñ", "ΣΑΣ ΟΔΟΣ İstanbul", "<|endoftext|> x<|endoftext|>",
       "日本語 テキスト", "a b", "a\x1cb", "x​b", "a\r\nb", "word,word.word!!! &&& ###", "😀 😀a", "a'sb 's", "_x_ __", "naïve—dash", "a\nb\nc", "é éx", "ªº ⅷ ①", "1 2\n3 4", "The the THE"]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_cached_encoder_equals_the_library(path, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    encoder = tokens.Encoder(path)
    assert encoder.kind in ("spaced", "words")
    for _ in range(2):
        for t in ODD:
            assert encoder.encode(t).tolist() == encoder.whole(t).tolist(), t


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_encoder_equals_a_fresh_tokenizer(path):
    from tokenizers import Tokenizer

    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    odd = [*ODD, "a <|endoftext|> b", "A <|ENDOFTEXT|> b", "<|startoftext|>a b<|endoftext|>", "x<|endoftext|>y z\n<|endoftext|>", "<|endoftext |> a"]
    for t in odd:
        assert encoder.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_token_files_round_trip(spark, tmp_path):
    texts = [None, *ODD, "long " * 3000]
    rows = [(10 * k + 3, t) for k, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    index = token_files.write_tokens(df, str(tmp_path / "t"), BYTE)
    encoder, start = tokens.Encoder(BYTE), 0
    got = {r.doc_id: r for r in token_files.read_digest(spark, str(tmp_path / "t")).collect()}
    for doc, text in sorted(rows):
        ids = [*encoder.whole(text or "").tolist(), 2]
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert index["width"] == 2 and sum(p["ids"] for p in index["parts"]) == start and len(got) == len(rows)
    token_files.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), "file://" + str(tmp_path / "e"), BYTE)
    assert token_files.read_digest(spark, str(tmp_path / "e")).count() == 0


def test_pack_lengths_is_whole_and_tight():
    rng = np.random.default_rng(2)
    for capacity, n in ((100, 400), (64, 50), (10, 7), (4096, 3000)):
        lengths = np.minimum(rng.geometric(6 / capacity, n), capacity)
        counts = np.bincount(lengths, minlength=capacity + 1)
        bins = packing.pack_lengths(counts)
        used = np.zeros(capacity + 1, np.int64)
        for items, times in bins:
            assert sum(items) <= capacity and times >= 1
            used += times * np.bincount(items, minlength=capacity + 1)
        assert (used == counts).all()
        assert sum(t for _, t in bins) <= -(-int(lengths.sum()) // capacity) + 1 + capacity // 50


def test_two_fit_replaces_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy takes 6 and 3; 2 and 2 fill the gap of 4 exactly
    assert packing.pack_lengths(counts)[0][0] == [6, 2, 2]


def test_packing(spark):
    texts = [None, "", "same words here", *["same words here"] * 40, *ODD, "long text " * 900]
    rows = list(enumerate(texts))
    capacity = 64
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), WORDS, capacity=capacity).collect()
    encoder, bins = tokens.Encoder(WORDS), {}
    got = {(r.doc_id, r.piece): r for r in out}
    assert len(got) == len(out)
    for doc, text in rows:
        ids = np.array([*encoder.whole(text or "").tolist(), 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            cut, r = ids[start : start + capacity], got.pop((doc, piece))
            assert (r.start, r.length, r.ids_crc32) == (start, len(cut), zlib.crc32(cut.tobytes()))
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not got
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), WORDS).count() == 0


def brute_vectors(rows, cosine):
    good = {k: (label, np.array(v, float)) for k, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {k: set() for k, *_ in rows}
    for a, (la, x) in good.items():
        for b, (lb, y) in good.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[a].add(b)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            todo += [n for n in links[todo.pop()] if n not in seen and not seen.add(n)]
        out[k] = (len(links[k]), min(seen), k == min(seen))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_near_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(0, None, 1), (1, [], 1), (2, [0.0] * 6, 1), (3, [1.0, None] + [0.0] * 4, 1), (4, [float("nan")] + [1.0] * 5, 1), (5, [1.0] * 6, None), (6, [1.0] * 5, 1), (7, [float("inf")] * 6, 1)]
    for c in range(9):
        centre = rng.normal(size=6)
        for _ in range(14):
            rows.append((len(rows), (centre + rng.normal(size=6) * 0.12).astype(np.float32).tolist(), c % 3))
        rows += [(len(rows) + k, rows[-1][1], c % 3) for k in range(3)]
    rows = [(k, v, label) for k, (_, v, label) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    want = brute_vectors([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows], 0.98)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == want and max(n for n, *_ in got.values()) > 3
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (1, [0.0, 1.0], 2), (None, [1.0, 0.0], 1), (3, [1e200, 1e200], 3), (4, [1.0, 1.0], 3), (5, [1e-200, 1e-200], 3), (6, [-0.0, 2.0], 2), (7, [1.0], 3), (8, [0.5], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, kept string")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    # The row of label 2 that repeats id 1 links with 6 alone, the one of label 1 with 2 alone.
    assert got == [(False, 1, 1, 1, True), (False, 1, 1, 1, True), (False, 2, 1, 1, False), (False, 3, 2, 3, True), (False, 4, 2, 3, False), (False, 5, 2, 3, False), (False, 6, 1, 1, False), (False, 7, 1, 7, True), (False, 8, 1, 7, False), (True, 0, 0, None, True)]
    alone = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (1, [0.0, 1.0], 2)], "vec_id bigint, embedding array<double>, label int")
    assert sorted(r.n_links for r in embedding_dedup.near_duplicates(alone).collect()) == [0, 1, 1]


@pytest.mark.parametrize("in_task", [0, 50, 1000])
def test_components(spark, monkeypatch, in_task):
    monkeypatch.setattr(components, "TASK_LINKS", in_task)
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    root = list(range(300))
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: root[k] for e in edges if e[0] != e[1] for k in e}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def mixing_tables(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for k in range(900):
        kind = k % 10
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        words += ["idiot", "scum"] if kind == 0 else ["&&&", "|", "###"] if kind == 1 else []
        rng.shuffle(words)
        texts.append((k, " ".join(words)))
        if k % 3 == 0:
            labels.append((k, int(kind != 1), int(kind == 0)))
    return spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("weights", [None, {"clean": 0.9, "low": 0.06, "toxic": 0.04}])
def test_mixing_classifies_and_meets_targets(spark, weights):
    docs, labels = mixing_tables(spark)
    rows = source_mixing.mix(docs, labels, weights=weights, strict=True).collect()
    kind = {r.doc_id: "toxic" if r.p_toxic > 0.5 else "low" if r.p_low > 0.5 else "clean" for r in rows}
    want = {k: "toxic" if k % 10 == 0 else "low" if k % 10 == 1 else "clean" for k in range(900)}
    assert sum(kind[k] == want[k] for k in want) >= 0.98 * len(want)
    reached = {d: sum(r.rate * r.n_mix_words * r[f"p_{d}"] for r in rows) for d in source_mixing.DOMAINS}
    for d, share in (weights or source_mixing.WEIGHTS).items():
        assert reached[d] / sum(reached.values()) == pytest.approx(share, abs=0.002)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    assert sum(r.copies >= 1 for r in rows if want.get(r.doc_id) == "clean") >= 0.95 * 720
    plan = source_mixing.mix(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("sharp", [0.1, 0.6, 5.0])
def test_rates_are_those_of_least_squares(spark, sharp):
    """fit() against a long plain descent over documents. No nonnegative rates reach the targets of the last case; steps are bounded there."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([8 * sharp, sharp, sharp], 300)
    words = rng.integers(5, 500, 300).astype(float)
    frame = spark.createDataFrame([(float(w), *map(float, x)) for w, x in zip(words, p, strict=True)], "words double, p_clean double, p_low double, p_toxic double")
    share = np.array([0.96, 0.02, 0.02])
    goal = source_mixing.goals(p.T @ words, share, 1.05)
    pull = (p * words[:, None]).T @ p
    best = np.ones(300)
    metric = np.linalg.inv(pull)
    for _ in range(5_000):
        best = np.maximum(0, best - p @ metric @ (p.T @ (words * best) - goal))
    steps, report = source_mixing.fit(frame, dict(zip(source_mixing.DOMAINS, share.tolist(), strict=True)), 1.05)
    rate = np.ones(300)
    for step in steps:
        rate = np.maximum(0, rate - p @ step)
    gap = lambda r: p.T @ (words * r) - goal
    if sharp > 1:
        assert np.abs(gap(best)).max() > 0.02 * words.sum() and report["reached"]["clean"] < 0.94 and len(steps) <= source_mixing.STEPS
        return
    assert gap(rate) @ metric @ gap(rate) <= 1.02 * (gap(best) @ metric @ gap(best)) + 1e-4 * (goal @ metric @ goal)
    reached = p.T @ (words * rate)
    assert list(report["reached"].values()) == pytest.approx((reached / reached.sum()).tolist())


def test_targets_that_cannot_be_reached_are_an_error(spark):
    docs, labels = mixing_tables(spark)
    blurred = labels.withColumn("toxic", (F.xxhash64("doc_id") % 3 == 0).cast("int"))
    with pytest.raises(ValueError, match="can't be reached"):
        source_mixing.mix(docs, blurred, strict=True)


def test_mixing_holds_shares_where_clean_words_are_few(spark):
    rng = random.Random(11)
    texts, labels = [], []
    for k in range(900):
        kind = "low" if k % 10 < 3 else "toxic" if k % 10 < 5 else "clean"
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))] + {"low": ["&&&", "|"], "toxic": ["idiot", "scum"], "clean": []}[kind]
        texts.append((k, " ".join(words)))
        labels.append((k, int(kind != "low"), int(kind == "toxic")))
    docs, known = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = source_mixing.mix(docs, known).collect()
    reached = np.array([sum(r.rate * r.n_mix_words * r[f"p_{d}"] for r in rows) for d in source_mixing.DOMAINS])
    assert reached / reached.sum() == pytest.approx([0.96, 0.02, 0.02], abs=0.004)


def test_mixing_goals():
    share = np.array([0.96, 0.02, 0.02])
    for have in ([0.5, 0.3, 0.2], [0.77, 0.11, 0.12], [0.9, 0.05, 0.05], [0.1, 0.1, 0.8]):
        goal = source_mixing.goals(np.array(have), share, 1.05)
        assert goal / goal.sum() == pytest.approx(share) and (goal <= 1.05 * np.array(have) + 1e-12).all()
        assert goal.sum() == pytest.approx(min(1, 1.05 * have[0] / 0.96))
    scarce = source_mixing.goals(np.array([0.86, 0.0004, 0.1396]), share, 1.05)
    assert scarce == pytest.approx([0.86, 0.00042, 0.86 / 48])
    assert source_mixing.goals(np.array([1.0, 0.0, 0.0]), share, 1.05) == pytest.approx([1, 0, 0])
    assert source_mixing.goals(np.zeros(3), share, 1.05).tolist() == [0, 0, 0]


def test_mixing_without_labels_or_rows(spark):
    docs, labels = mixing_tables(spark)
    out = source_mixing.resample(docs, labels.limit(0))
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 902
    assert source_mixing.mix(docs.limit(0).withColumn("rate", F.lit(1)), labels).count() == 0
    odd = docs.limit(3).union(docs.limit(3)).unionByName(spark.createDataFrame([(None, "idiot scum"), (None, "x " * 200_000)], docs.schema))
    odd = odd.withColumn("mix_words", F.lit("a")).withColumn("mix_text", F.lit("b")).withColumn("copies", F.lit("c"))
    mixed = source_mixing.mix(odd, labels.union(labels).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)))
    assert mixed.columns[:5] == odd.columns and mixed.columns[-1] == "copies_" and mixed.count() == 8


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    text = lambda n: ". ".join(" ".join(f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}ord{rng.randrange(99)}x" for _ in range(8)) for _ in range(n)) + "."
    shared = "this very line stands in many documents"
    docs = [(k, text(5) + ("\n" + shared if k < 6 else ""), "en", "s", 1) for k in range(40)]
    docs += [(40, docs[3][1], "en", "s", 1), (41, "few words", "en", "s", 1), (42, None, None, None, None), (43, "bad&&& " * 50, "en", "s", 1)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    frame, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, sf)
        assert k == 4 or frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text if k < 4 else None for r in frame.collect()})
    assert set(kept[0]) == set(range(41))
    assert sum(shared in t for t in kept[1].values()) == 1
    assert set(kept[2]) == set(range(40)) == set(kept[3]) == set(kept[4])


def test_tokens_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a b", 1), (1, "x", 2), (1, "x", 3), (1, "other words", 4), (None, None, 5), (2, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece int").repartition(3)
    out = packing.pack(docs, WORDS).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((d is None, d or 0) for d, *_ in rows)
    assert len({r.sequence_id for r in out}) == 1 and sorted(r.offset + r.length for r in out)[-1] == sum(r.length for r in out)
    token_files.write_tokens(docs, str(tmp_path / "t"), BYTE)
    back = token_files.read_digest(spark, str(tmp_path / "t")).collect()
    encoder = tokens.Encoder(BYTE)
    crc = lambda t: zlib.crc32(np.append(encoder.whole(t or ""), 2).astype("<u4").tobytes())
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in back) == sorted((d or 0, crc(t)) for d, t, _ in rows)
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id is None for r in sorted(back, key=lambda r: r.start)] == [True, True, False, False, False, False]
