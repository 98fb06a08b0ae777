"""Token counts, sampled pieces and the whole pipeline against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from midyear.llm import pieces, queries, token_counts
from midyear.llm.common import keyed, read

from . import brute
from .test_operators import docs, empty, odd, repeated  # noqa: F401

COUNT = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
VOCABULARY = pieces.Vocabulary(open(pieces.MODEL, "rb").read())
TEXT = st.text(alphabet=st.sampled_from("ab'st  \n\t1.é漢　"), max_size=300)


def tokens(text):
    return len(COUNT.encoding.encode_ordinary(text))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 310), st.integers(-2, 310), TEXT), max_size=5))
def test_edits(text, edits):
    edits = [{"start": a, "end": b, "replacement": new[:20]} for a, b, new in edits]
    done = token_counts.apply(token_counts.build(text, COUNT), text, edits, COUNT)
    assert done.tree.tokens == tokens(done.text) and done.tree.chars == len(done.text)
    again = token_counts.apply(done.tree, done.text, [{"start": 3, "end": 5, "replacement": "x y"}], COUNT)
    assert again.tree.tokens == tokens(again.text)


def test_edits_touch_little():
    text = "".join(random.Random(1).choice(["word ", "other, ", "thing\n"]) for _ in range(20000))
    done = token_counts.apply(token_counts.build(text, COUNT), text, [{"start": 50000, "end": 50010, "replacement": "new"}], COUNT)
    assert done.tree.tokens == tokens(done.text) and done.encoded < 4 * token_counts.LEAF


def test_many_edits():
    """Thousands of edits of one text cost about as much as counting what they touch, and the tree stays in shape."""
    r = random.Random(6)
    text = "".join(r.choice(["word ", "other, ", "thing\n", "a-b ", "12 "]) for _ in range(60000))
    total = len(COUNT.split(text))
    for n in (1, 40, 1000, 8000):
        places = sorted(r.sample(range(len(text) - 20), n))
        edits = [{"start": a, "end": a + r.randrange(8), "replacement": r.choice(["", "new", "x y\n"])} for a in places]
        done = token_counts.apply(token_counts.build(text, COUNT), text, edits, COUNT)
        fresh = token_counts.build(done.text, COUNT)
        assert done.tree.tokens == fresh.tokens == tokens(done.text) and done.tree.chars == len(done.text)
        assert done.encoded <= min(total + 4 * n, 4 * token_counts.LEAF * n)
        assert done.tree.leaves()[0].max() < 8 * 3 * token_counts.LEAF
        sums = done.tree.sums
        assert (sums[1 : done.tree.width] == sums[2 : 2 * done.tree.width : 2] + sums[3 : 2 * done.tree.width : 2]).all()
        again = token_counts.apply(done.tree, done.text, edits[: n // 2 + 1], COUNT)
        assert again.tree.tokens == tokens(again.text) and again.tree.chars == len(again.text)


def test_counts_of_documents(docs, odd, repeated, empty):  # noqa: F811
    for df in (docs, odd, repeated):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        spans = token_counts.redactions(df).collect()
        edits = {}
        for e in {(e.doc_id, e.text_hash, e.start, e.end, e.replacement) for e in spans}:
            edits.setdefault(e[:2], []).append(e[2:])
        hashes = {(r.doc_id, r.text): r.text_hash for r in keyed(df).collect()}
        want = Counter()
        for i, t in rows:
            new, at, n = [], 0, 0
            for start, end, by in sorted(edits.get((i, hashes[i, t]), [])):
                if start >= at:
                    new += [t[at:start], by]
                    at, n = end, n + 1
            want[i, tokens(t), n, tokens("".join(new) + t[at:])] += 1
        found = token_counts.counts_after(df, token_counts.redactions(df))
        assert Counter((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in found.collect()) == want
    assert token_counts.counts_after(empty, token_counts.redactions(empty)).count() == 0


def segmentations(text):
    """All segmentations of a short text with their log weights."""
    data, known = b" " + text.encode(), {}
    for i, b in enumerate(VOCABULARY.bytes):
        if b and i >= VOCABULARY.first_byte + 256:
            known[b] = i
    whole = data.decode()

    def go(at):
        if at == len(whole):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, len(whole) + 1):
            piece = whole[at:end].encode()
            if piece in known:
                ids, w = (known[piece],), VOCABULARY.weights[known[piece]]
            elif end == at + 1:
                ids, w = tuple(VOCABULARY.first_byte + b for b in piece), VOCABULARY.weights[VOCABULARY.first_byte] * len(piece)
            else:
                continue
            out += [(ids + rest, w + r) for rest, r in go(end)]
        return out

    found = go(0)
    top = max(w for _, w in found)
    total = top + math.log(sum(math.exp(w - top) for _, w in found))
    return {ids: w - total for ids, w in found}


def sampled(text, seed, k):
    (search,) = pieces.sample_short([text.encode()], [seed], pieces.Lattice(VOCABULARY), k)
    return [(tuple(ids.tolist()), g, p) for ids, g, p in search.found], search.threshold


@pytest.mark.parametrize("text", ["the cat", "▁é漢 \n a", "abab", "x"])
def test_probabilities(text):
    want = segmentations(text)
    found, _ = sampled(text, 1, len(want) + 5)
    assert {ids: pytest.approx(p) for ids, _, p in found} == want
    values = [g for _, g, _ in found]
    assert values == sorted(values, reverse=True)


def test_sampling_without_replacement():
    """First draws follow the probabilities; pairs follow those of drawing twice without replacement; inclusion scores are unbiased."""
    want = segmentations("that")
    n, first, second, total = 12000, Counter(), Counter(), 0.0
    for seed in range(n):
        found, threshold = sampled("that", seed * 7919 + 1, 2)
        assert found[0][0] != found[1][0] and found[0][1] >= found[1][1] >= threshold
        first[found[0][0]] += 1
        second[found[1][0]] += 1
        total += sum(math.exp(p - pieces.log_inclusion(p, threshold)) for _, _, p in found)
    for ids, p in want.items():
        q = math.exp(p)
        assert abs(first[ids] / n - q) < 5 * math.sqrt(q / n) + 1e-3
        later = sum(math.exp(o) * q / (1 - math.exp(o)) for other, o in want.items() if other != ids)
        assert abs(second[ids] / n - later) < 5 * math.sqrt(later / n) + 1e-3
    assert total / n == pytest.approx(1.0, abs=0.05)


def test_long_texts_in_stretches(monkeypatch):
    """A text drawn stretch by stretch has the samples of the text drawn at once."""
    r = random.Random(4)
    texts = ["".join(r.choice(["word ", "other, ", "thing\n", "  é漢", "\n\n", "ab"]) for _ in range(n)) for n in (1, 30, 400, 2000)]
    texts += [" " * 900 + "x", "漢" * 700, "\n" * 500, "é" * 333 + " a"]
    for text in texts:
        data = text.encode()
        (whole,) = pieces.sample_short([data], [5], pieces.Lattice(VOCABULARY), 6)
        with monkeypatch.context() as m:
            m.setattr(pieces, "STRETCH_BYTES", 3000)
            (parts,) = pieces.sample_long(data, 5, pieces.Lattice(VOCABULARY), 6)
        assert len(parts.found) == len(whole.found)
        for (a, g, p), (b, h, q) in zip(parts.found, whole.found):
            assert np.array_equal(a, b) and g == pytest.approx(h) and p == pytest.approx(q)
            assert pieces.spells(a, data, VOCABULARY) and not pieces.spells(a, data + b"q", VOCABULARY)


@pytest.mark.parametrize("most", [0, 40, 1 << 20])
def test_lattice_kept_over_stretches(monkeypatch, most):
    """What a lattice holds from earlier texts, and when it is begun anew, changes no sample."""
    monkeypatch.setattr(pieces, "LATTICE_BYTES", most)
    monkeypatch.setattr(pieces, "BLOCK_CELLS", 3)
    lattice, r = pieces.Lattice(VOCABULARY), random.Random(8)
    for seed in range(12):
        texts = [" ".join(r.choices(["the", "cat", "é漢", "sat.", "", "\n", f"new{seed}"], k=n)).encode() for n in (0, 1, 9, 40)]
        seeds = [seed * 10 + i for i in range(len(texts))]
        for got, text, own in zip(pieces.sample_short(texts, seeds, lattice, 3), texts, seeds):
            (alone,) = pieces.sample_short([text], [own], pieces.Lattice(VOCABULARY), 3)
            assert [(a.tolist(), g, p) for a, g, p in got.found] == [(a.tolist(), g, p) for a, g, p in alone.found]
            assert got.threshold == alone.threshold


def test_memory_of_a_long_text(spark):
    """25 MB of text, once with blanks and once without, in a worker of 1 GB."""
    from pyspark.sql import DataFrame

    unit = "The quick brown fox, jumped over 13 lazy dogs.\n"
    df = spark.sql(f"SELECT 1L AS doc_id, repeat({unit!r}, 540000) AS text UNION ALL SELECT 2L, repeat('thequickbrown', 1900000)")
    assert isinstance(df, DataFrame) and df.selectExpr("min(octet_length(text)) AS n").first().n > 23_000_000

    def limited(batches):
        import resource

        soft, hard = resource.getrlimit(resource.RLIMIT_DATA)
        resource.setrlimit(resource.RLIMIT_DATA, (1 << 30, hard))
        try:
            yield from run(batches)
        finally:
            resource.setrlimit(resource.RLIMIT_DATA, (soft, hard))

    run = pieces._samples(pieces._model(df, pieces.MODEL), 2, 4)
    rows = keyed(df).withColumn("text", F.col("text").cast("binary")).mapInArrow(limited, pieces.SCHEMA)
    found = rows.select("doc_id", "sample", "round_trip").collect()
    assert sorted((r.doc_id, r.sample) for r in found) == [(1, 1), (1, 2), (2, 1), (2, 2)] and all(r.round_trip for r in found)


def test_pieces_of_documents(docs, odd, repeated, empty):  # noqa: F811
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for df in (docs, odd, repeated):
        found = pieces.sampled_pieces(df, 3).collect()
        texts = {(r.doc_id, r.text_hash): r.text for r in keyed(df).collect()}
        by: dict = {}
        for r in found:
            text = texts[r.doc_id, r.text_hash]
            ids = np.frombuffer(r.pieces, "<i4").tolist()
            assert r.round_trip and len(ids) == r.n_pieces
            if text and not text.startswith(" "):
                assert sp.decode(ids) == text
            by.setdefault((r.doc_id, r.text_hash), {})[r.sample] = bytes(r.pieces)
            assert r.log_probability <= 1e-9 and r.log_inclusion <= 0
        assert set(by) == set(texts)
        assert all(len(set(x.values())) == len(x) for x in by.values())
        again = pieces.sampled_pieces(df.repartition(5), 3)
        assert Counter((r.doc_id, r.sample, bytes(r.pieces), r.perturbed) for r in again.collect()) == Counter((r.doc_id, r.sample, bytes(r.pieces), r.perturbed) for r in found)
        back = pieces.decoded_pieces(again).select("doc_id", "text_hash", "text").distinct().collect()
        assert {(r.doc_id, r.text_hash): r.text for r in back} == texts
    assert pieces.sampled_pieces(empty).count() == 0


def test_pipeline(spark, tiny):
    """Each stage against plain Python on its own input."""
    rows = read(spark, tiny, "documents")
    columns = rows.columns
    kept = corpus_pipeline.quality_rules(spark, rows, tiny)
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    failed = {i for i, t in text.items() if brute.statistics(t)[-1]}
    left = {r.doc_id for r in kept.collect()}
    verdicts = {r.doc_id: r.kept for r in queries.quality(spark, tiny).collect()}
    assert left == {i for i, k in verdicts.items() if k} and not left & failed
    once = corpus_pipeline.exact_dedup(spark, kept, tiny)
    ids = {r.doc_id for r in once.collect()}
    assert ids == {i for i, _, _, k, _ in brute.exact([(i, text[i]) for i in left]) if k}
    near = corpus_pipeline.near_dedup(spark, once, tiny)
    ids = {c for _, _, c in brute.near([(i, text[i]) for i in ids])}
    assert {r.doc_id for r in near.collect()} == ids
    mix = corpus_pipeline.mix_sources(spark, near, tiny)
    times = Counter(r.doc_id for r in mix.collect())
    assert set(times) <= ids and max(times.values()) <= 3
    assert all(df.columns == columns for df in (kept, once, near, mix))
    last = corpus_pipeline.encode(spark, mix, tiny).where("sample = 1")
    assert Counter(r.doc_id for r in last.collect()) == times
    run = corpus_pipeline.run(spark, tiny)
    assert Counter(r.doc_id for r in run.where("sample = 1").collect()) == times
    assert run.where(~F.col("round_trip")).count() == 0


def test_pipeline_of_odd_rows(spark, repeated, empty, tiny):  # noqa: F811
    for df in (repeated, empty):
        columns = df.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, tiny)
            assert df.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, df, tiny).collect()
