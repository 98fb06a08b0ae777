"""The operators against plain Python, on the small tables and on odd rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from midyear.llm import queries
from midyear.llm.anchors import Repeats
from midyear.llm.common import read
from midyear.llm.exact_dedup import drop_copies, exact_groups
from midyear.llm.line_dedup import drop_repeated_lines
from midyear.llm.mixing import mix, mixed
from midyear.llm.quality import clear_labels, cutoffs, good_documents, most_losses, quality_verdicts
from midyear.llm.simhash import near_groups, one_per_group
from midyear.llm.substring_dedup import RULE as WORDS
from midyear.llm.substring_dedup import remove_repeated_words
from midyear.llm.suffix_dedup import RULE as BYTES
from midyear.llm.suffix_dedup import remove_repeated_bytes

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fingerprint string, anchor string, words string, kept string, n long, size long"


def odd_rows(seed=1):
    """Random texts from few words, with nulls, blanks, repeats, one very long text and clashing columns."""
    r = random.Random(seed)
    vocabulary = ["a", "b", "Ba", "cé", "漢字", "d#", "x|y", "e"]

    def text(n):
        return "".join(r.choice(vocabulary) + r.choice([" ", " ", "\n", "\t", "  "]) for _ in range(n))

    long = text(3000)
    passage = text(90)
    texts = [None, "", " ", "\n\n", "a", "A", long, long[:2000] + "q", *(text(r.randrange(1, 150)) for _ in range(25))]
    texts += [text(20) + passage + text(20) for _ in range(6)] + [t for t in texts[8:14]] + ["the end\n" + text(5) for _ in range(12)] + [" The END\r\n" + text(60) for _ in range(3)]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None]), None, "r", "f", None, "w", "k", 7, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_pairs():
    return [(r[0], r[1]) for r in odd_rows()]


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return read(spark, tiny, "documents")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(odd):
    """Every row twice, and three rows without an id."""
    return odd.unionByName(odd).unionByName(odd.where("doc_id in (6, 7, 9)").withColumn("doc_id", F.lit(None).cast("long")))


def tuples(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_exact(request, which):
    rows = request.getfixturevalue({"docs": "pairs", "odd": "odd_pairs"}[which])
    assert tuples(exact_groups(request.getfixturevalue(which)), *EXACT) == Counter(brute.exact(rows))


def test_exact_repeated_rows(repeated, empty):
    found = exact_groups(repeated).collect()
    assert len(found) == repeated.count()
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in found}
    assert all(r.keep_id is not None for r in found)
    left = drop_copies(repeated)
    assert left.columns == repeated.columns and left.count() == len(kept)
    assert exact_groups(empty).count() == 0 and drop_copies(empty).count() == 0


def test_quotient_filters():
    """Filters of any shape come back whole, merge to the filter of all rows, and take less room than bare fingerprints."""
    import numpy as np

    from midyear.llm import exact_dedup as X

    r = np.random.default_rng(4)
    whole = np.concatenate([r.integers(0, 1 << 64, 3000, np.uint64), np.full(700, 12345, np.uint64), np.arange(400, dtype=np.uint64) << np.uint64(50)])
    whole = np.concatenate([whole, whole[:900], whole[:300], np.array([0, 2**64 - 1], np.uint64)])
    for bits in (0, 3, 5):
        want = X.counted(whole)
        merge = {}
        for part in np.array_split(r.permutation(whole), 7):
            values, counts = X.counted(part)
            for block in np.unique(values >> np.uint64(64 - bits)) if bits else [0]:
                own = (values >> np.uint64(64 - bits)) == block if bits else slice(None)
                data = X.encoded(values[own], counts[own], bits)
                back = X.decoded(data, int(block), bits)
                assert np.array_equal(back[0], values[own]) and np.array_equal(back[1], counts[own])
                merge.setdefault(int(block), X.Merge()).add(back)
        found = [merge[b].result() for b in sorted(merge)]
        assert np.array_equal(np.concatenate([v for v, _ in found]), want[0])
        assert np.array_equal(np.concatenate([c for _, c in found]), want[1])
    values, counts = X.counted(np.concatenate([r.integers(0, 1 << 64, 1_900_000, np.uint64), r.integers(0, 1 << 64, 50_000, np.uint64).repeat(2)]))
    size = sum(len(X.encoded(values[i], counts[i], 3)) for b in range(8) for i in [(values >> np.uint64(61)) == b])
    assert size < 8 * len(values)


def test_many_filters(spark, monkeypatch):
    from midyear.llm import exact_dedup as X

    monkeypatch.setattr(X, "FILTER_ROWS", 100)
    df = spark.range(5000).selectExpr("xxhash64(id % 3100) AS fingerprint").repartition(4)
    found = {r.fingerprint: r.n for r in X.repeated_fingerprints(df, 5000).collect()}
    want = Counter(r.fingerprint for r in df.collect())
    assert found == {k: n for k, n in want.items() if n > 1}


BYTE = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("rule", [BYTES, Repeats(40, 12, False), Repeats(40, 12, False, block_segments=16, hot_segments=3)])
def test_repeated_bytes(docs, pairs, odd, odd_pairs, rule):
    assert tuples(remove_repeated_bytes(docs, rule), *BYTE) == brute.repeated_bytes(pairs, rule.length)
    assert tuples(remove_repeated_bytes(odd, rule), *BYTE) == brute.repeated_bytes(odd_pairs, rule.length)


WORD = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("rule", [WORDS, Repeats(9, 3, True), Repeats(9, 3, True, block_segments=16, hot_segments=3)])
def test_repeated_words(docs, pairs, odd, odd_pairs, rule):
    assert tuples(remove_repeated_words(docs, rule), *WORD) == brute.repeated_words(pairs, rule.length)
    assert tuples(remove_repeated_words(odd, rule), *WORD) == brute.repeated_words(odd_pairs, rule.length)


def test_repeats_in_repeated_rows(repeated, empty):
    rows = [(r.doc_id, r.text) for r in repeated.collect()]
    assert tuples(remove_repeated_bytes(repeated), *BYTE) == brute.repeated_bytes(rows, 200)
    assert tuples(remove_repeated_words(repeated), *WORD) == brute.repeated_words(rows, 35)
    assert remove_repeated_bytes(empty).count() == 0 and remove_repeated_words(empty).count() == 0


def test_repeats_in_chunks(spark, monkeypatch):
    """Texts longer than a chunk, and a period shorter than a window."""
    from midyear.llm import anchors

    r = random.Random(3)
    base = "".join(r.choice("abcd ") for _ in range(5000))
    rows = [(1, base), (2, "xyz" * 300), (3, base[1000:1900] + "".join(r.choice("efgh ") for _ in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(anchors, "CHUNK", 700)
    assert tuples(remove_repeated_bytes(df), *BYTE) == brute.repeated_bytes(rows, 200)
    assert tuples(remove_repeated_words(df, Repeats(12, 4, True)), *WORD) == brute.repeated_words(rows, 12)


def periodic_rows():
    """Texts with stretches of short and long periods, some shared, some with a flaw, at the ends and between other symbols."""
    r = random.Random(12)
    other = lambda n: "".join(r.choice("klmnop ") for _ in range(n))
    rows = ["-" * 3000, other(300) + "-" * 2500 + other(300), other(300) + "ab " * 900, "ab " * 300 + "x" + "ab " * 400, other(10) + "-" * 199 + other(10)]
    for period in (2, 35, 159, 160, 161, 162, 199, 200, 201, 361, 500):
        unit = other(period)
        rows += [other(100) + unit * (1400 // period + 1) + other(50), unit * 2 + other(250)]
    return [(i % 25, t) for i, t in enumerate([*rows, rows[1], rows[3]])]


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_repeats_of_a_period(spark, monkeypatch, chunk):
    from midyear.llm import anchors

    rows = periodic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(anchors, "CHUNK", chunk)
    for rule in (BYTES, Repeats(200, 40, False, block_segments=16, hot_segments=3), Repeats(40, 40, False)):
        assert tuples(remove_repeated_bytes(df, rule), *BYTE) == brute.repeated_bytes(rows, rule.length)
    for rule in (WORDS, Repeats(9, 3, True, block_segments=16, hot_segments=3)):
        assert tuples(remove_repeated_words(df, rule), *WORD) == brute.repeated_words(rows, rule.length)


def test_anchors_of_a_period():
    """What is listed of a stretch does not grow with the number of its periods, and covers the same symbols."""
    import numpy as np

    from midyear.llm.anchors import anchors_of, symbols_of

    head, tail = ("".join(random.Random(seed).choice("klmnop ") for _ in range(700)) for seed in (1, 2))
    for rule, gap in ((BYTES, ""), (WORDS, " ")):
        for unit in ("-", "ab ", "on a "):
            counts = []
            for times in (500, 20_000):
                text = (gap.join(head) + gap + (unit.strip() + " " if rule.words else unit) * times + gap.join(tail)).encode()
                symbols, raw = symbols_of(text, rule)
                at, end, anchor, segment = anchors_of(symbols, raw, rule)
                assert len(at) == len(end) == len(anchor) == len(segment) / 16
                counts.append(len(at))
                marks = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(marks, np.maximum(at - rule.reach, 0), 1)
                np.add.at(marks, end, -1)
                assert (np.cumsum(marks)[:-1] > 0).all() and end.max() == len(symbols)
            assert counts[0] == counts[1] < 1000


NEAR = ("doc_id", "fingerprint", "component_id")


def test_near(docs, pairs, odd, odd_pairs):
    assert tuples(near_groups(docs), *NEAR) == Counter(brute.near(pairs))
    assert tuples(near_groups(odd), *NEAR) == Counter(brute.near(odd_pairs))


def test_near_rows(repeated, empty, docs, pairs):
    found = near_groups(repeated)
    assert found.count() == repeated.count()
    left = one_per_group(repeated)
    assert left.columns == repeated.columns and left.count() == found.select("component_id").distinct().count()
    assert near_groups(empty).count() == 0 and one_per_group(empty).count() == 0
    assert {r.doc_id for r in one_per_group(docs).collect()} == {c for _, _, c in brute.near(pairs)}


def test_trees_find_all_links():
    import numpy as np

    from midyear.llm.simhash import DISTANCE, VIEWS, bits_apart, grow, link_within, view_masks

    r = np.random.default_rng(5)
    values = r.integers(0, 1 << 64, 1500, np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (1500, 4)).astype(np.uint64)
    values = np.unique(np.concatenate([values, values ^ flips[:, 0] ^ flips[:, 1], values[:200] ^ np.bitwise_xor.reduce(flips[:200], axis=1)]))
    want = {(a, b) for a in range(len(values)) for b in np.flatnonzero(bits_apart(values, values[a], np.uint64(2**64 - 1)) <= DISTANCE).tolist() if a < b}
    for leaf in (4, 64):
        got = None
        for mask in view_masks():
            forest = link_within(values, np.ones(len(values), bool), mask, DISTANCE, DISTANCE // len(VIEWS), leaf)
            pairs = forest.roots(np.arange(len(values)))
            got = [pairs] if got is None else got + [pairs]
        assert all(any(p[a] == p[b] for p in got) for a, b in want)
        # What is connected is connected by links.
        full = link_within(values, np.ones(len(values), bool), np.uint64(2**64 - 1), DISTANCE, DISTANCE, leaf).roots(np.arange(len(values)))
        assert all((full[p] == full).all() for p in got)
    tree = grow(values, view_masks()[0], 3)
    assert tree is not None and tree[2] is not None


def test_shards(spark, docs, pairs):
    from midyear.llm.simhash import components, fingerprints, links
    from midyear.llm.common import stored

    distinct = stored(fingerprints(docs).select("fingerprint").distinct(), "t")
    few, many = (components(links(distinct, shard=s)) for s in (1 << 15, 16))
    assert tuples(few, "node", "root") == tuples(many, "node", "root") != Counter()


QUALITY = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(spark, docs, pairs, odd, odd_pairs, tiny, empty):
    labels = read(spark, tiny, "labels")
    for df, rows in ((docs, pairs), (odd, odd_pairs)):
        assert tuples(quality_verdicts(df, labels), *QUALITY) == Counter((i, *brute.statistics(t)) for i, t in rows)
    assert quality_verdicts(empty, labels).count() == 0
    none = labels.limit(0)
    assert tuples(quality_verdicts(odd, none), "doc_id", "kept") == Counter((i, not brute.statistics(t)[-1]) for i, t in odd_pairs)
    good = good_documents(odd, none)
    assert good.columns == odd.columns and {r.doc_id for r in good.collect()} == {i for i, t in odd_pairs if not brute.statistics(t)[-1]}


def test_quality_is_native(spark, tiny):
    plan = queries.quality(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_binomial_bound(spark):
    import math

    for n in (0, 10, 900, 5000, 40000):
        for error in (0.05, 1e-4):
            got = spark.range(1).select(most_losses(F.lit(n), 0.005, F.lit(math.log(error)))).first()[0]
            assert got == brute.most_losses(n, 0.005, error), (n, error)


def test_cutoffs(spark):
    """A stratum with many labels gets the cutoff that separates; one with few gets none; contradicting labels do not count."""
    r = random.Random(7)
    rows, labels = [], []
    for i in range(9000):
        stratum = "big" if i < 8000 else "small"
        bad = i % 5 == 0
        symbols = r.randrange(40, 90) if bad else r.randrange(0, 3)
        rows.append((i, 0, i, stratum, 100, 500, symbols, 0, 0, 10))
        labels += [(i, 0 if bad else 1)] + ([(i, 1)] if bad and i % 10 == 0 else [])
    measured = spark.createDataFrame(rows, "doc_id long, text_hash long, norm_hash long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    found = {x.stratum: x for x in cutoffs(measured, clear_labels(spark.createDataFrame(labels, "doc_id long, quality int"))).collect()}
    assert set(found) == {"big"} and found["big"].symbols_per_word == 0.3 and found["big"].chars_per_word is None


def test_repeated_rows_certify_nothing_more(spark, monkeypatch):
    """300 good documents of which 4 lie over a cutoff certify it no more when each stands there twenty times, blanks and ids changed."""
    from midyear.llm import quality

    monkeypatch.setattr(quality, "RISK", 0.08)
    r = random.Random(2)

    def text(i, symbols):
        return " ".join(f"{r.choice('abcdefgh')}{i}x{j}" + "#" * (j < symbols) for j in range(60))

    rows = [(i, text(i, 50 if i < 104 else 0), "en") for i in range(400)]
    labels = [(i, 0 if i < 100 else 1) for i in range(400)]
    times = 20
    again = [(i + 1000 * t, x + "\n" * t, lang) for i, x, lang in rows for t in range(times)]
    labels_again = [(i + 1000 * t, q) for i, q in labels for t in range(times)]
    kept = {}
    for name, a, b in (("once", rows, labels), ("ids", again, labels_again), ("rows", rows * times, labels * times)):
        found = quality_verdicts(spark.createDataFrame(a, "doc_id long, text string, lang string"), spark.createDataFrame(b, "doc_id long, quality int"))
        kept[name] = {x.doc_id % 1000 for x in found.where("kept").collect()}
    assert kept["once"] == kept["ids"] == kept["rows"] == set(range(400))
    many = [(i, text(i, 50 if i < 104 else 0), "en") for i in range(8000)]
    found = quality_verdicts(spark.createDataFrame(many, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 0 if i < 100 else 1) for i in range(8000)], "doc_id long, quality int"))
    assert {x.doc_id for x in found.where("kept").collect()} == set(range(104, 8000))


def test_stages_move_no_text(spark, tiny):
    """Quality rules and mixing decide in the row: no shuffle carries a text."""
    documents = read(spark, tiny, "documents")
    for df in (good_documents(documents, read(spark, tiny, "labels")), mixed(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


LINE = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


@pytest.mark.parametrize("documents,key", [(10, 1), (2, 1), (3, 4)])
def test_lines(docs, pairs, odd, odd_pairs, documents, key):
    for df, rows in ((docs, pairs), (odd, odd_pairs)):
        assert tuples(drop_repeated_lines(df, min_documents=documents, min_key=key), *LINE) == brute.lines(rows, documents, key)


def test_lines_rows(repeated, empty, spark):
    rows = [(r.doc_id, r.text) for r in repeated.collect()]
    assert tuples(drop_repeated_lines(repeated), *LINE) == brute.lines(rows, 10)
    assert drop_repeated_lines(empty).count() == 0
    df = spark.createDataFrame([(i, f"same\nown {i}") for i in range(5)], "doc_id long, text string")
    kept = {r.doc_id: r.n_dropped for r in drop_repeated_lines(df, min_documents=2, keep_first=True).collect()}
    assert kept == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_full_filter(odd, odd_pairs, monkeypatch):
    """A filter far too small only suspects more."""
    from midyear.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HASHES", 1)
    monkeypatch.setattr(line_dedup, "BLOCK_BITS", 64)
    monkeypatch.setattr(line_dedup, "MOST_BITS", 64)
    assert tuples(drop_repeated_lines(odd), *LINE) == brute.lines(odd_pairs, 10)


def test_filters_by_range(odd, odd_pairs, monkeypatch):
    """Where the lines need more bits than a filter has, ranges of hashes are worked on in turn."""
    import numpy as np

    from midyear.llm import line_dedup

    hashes = np.random.default_rng(1).integers(0, 1 << 64, 10000, np.uint64)
    held = np.array([line_dedup.Range(i, 7).holds(hashes) for i in range(7)])
    assert (held.sum(axis=0) == 1).all() and (held.sum(axis=1) > 1000).all()
    monkeypatch.setattr(line_dedup, "BLOCK_BITS", 1 << 10)
    monkeypatch.setattr(line_dedup, "MOST_BITS", 1 << 12)
    assert tuples(drop_repeated_lines(odd, min_documents=3), *LINE) == brute.lines(odd_pairs, 3)


def test_mix(odd, odd_pairs, docs, empty):
    for df in (docs, odd):
        rows = mix(df).collect()
        source = {r.doc_id: (r.source, len(brute.words(r.text))) for r in df.collect()}
        sizes = Counter()
        for s, n in source.values():
            sizes[s] += n
        want = brute.targets(dict(sizes))
        for r in rows:
            s, n = source[r.doc_id]
            assert r.size == n and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
            rate = min(want[s] / sizes[s], 3.0) if sizes[s] else 0.0
            assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 3 and r.taken == r.copies * n
        assert tuples(mix(df), "doc_id", "taken") == tuples(mix(df.repartition(7)), "doc_id", "taken")
        out = mixed(df)
        assert out.columns == df.columns and tuples(out, "doc_id") == +Counter({(r.doc_id,): r.copies for r in rows})
    assert mix(empty).count() == 0 and mixed(empty).count() == 0


def test_mix_hits_targets(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 7 as int)) as text", "case when id % 10 < 6 then 's0' when id % 10 < 9 then 's1' end as source")
    by = mix(df).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(by) == 3 and all(abs(r.taken - r.target) < 0.03 * r.target for r in by)


def test_mix_repeated(repeated):
    assert mix(repeated).count() == repeated.count()


def test_warc(spark, tiny):
    import hashlib as h

    pages = read(spark, tiny, "pages").select("page_id", "url", "html", F.lit("x").alias("digest"), F.lit("y").alias("same"))
    long = "é" * 500
    extra = spark.createDataFrame([(1000, "u", long), (1001, "http://ü/ \n", long), (1002, None, long), (1003, "u", long[:-1]), (1004, "u", long[:-1]), (1005, "u", None), (1006, "u", ""), (None, "u", "z" * 2000), (None, "v", "z" * 2000), (1007, "v", "k" * 1000), (1007, "v", "k" * 1000)], "page_id long, url string, html string")
    from midyear.llm.common import new_folder
    from midyear.llm.warc import read_archives, write_archives

    rows = pages.unionByName(extra, allowMissingColumns=True)
    path = new_folder(spark, "warc-test")
    write_archives(rows.repartition(3), path)
    found = read_archives(spark, path)
    want, best = Counter(), {}
    data = [(r.page_id, (r.html or "").encode()) for r in rows.collect()]
    for i, p in data:
        if len(p) >= 1000 and i is not None:
            best[p] = max(i, best.get(p, i))
    for i, p in data:
        first = best.get(p)
        revisit = first is not None and first != i
        want[(i, len(p), h.sha1(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert tuples(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    payloads = {bytes(r.payload) for r in found.where("record_type = 'response'").collect()}
    assert payloads == {p for _, p in data}
    empty = new_folder(spark, "warc-empty")
    write_archives(rows.limit(0), empty)
    assert read_archives(spark, empty).count() == 0


def test_warc_bytes(spark, tiny):
    """Each file is one Zstandard stream whose first frame holds the dictionary, and records open one by one."""
    import struct

    import zstandard

    from midyear.llm.common import new_folder
    from midyear.llm.warc import frame_size, read_frames, write_archives

    path = new_folder(spark, "warc-bytes")
    write_archives(read(spark, tiny, "pages").coalesce(1), path)
    data = bytes(spark.read.format("binaryFile").load(path).first().content)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 1000
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    records = list(read_frames(data))
    assert len(records) == 50 and all(r.startswith(b"WARC/1.1\r\n") for r in records)
    at = 8 + size + 8
    assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[at : at + frame_size(data, at)]) == records[0]


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_texts_on_which_rolling_hashes_agree(spark):
    """Polynomial hashes modulo 2**64 cannot tell a Thue-Morse word from its complement; nothing of these repeats."""
    common = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{common} {word}") for i, word in enumerate((thue_morse(1024), thue_morse(1024, "b", "a")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(remove_repeated_words(df), *WORD) == brute.repeated_words(rows, 35)
    assert {r.n_removed for r in remove_repeated_words(df).collect()} == {0}
    rows = [(i, "x" * 60 + body + "y" * 60) for i, body in enumerate((thue_morse(2048), thue_morse(2048, "b", "a")))]
    rows += [(2, " ".join(f"{x}{x}" for x in thue_morse(600))), (3, " ".join(f"{x}{x}" for x in thue_morse(600, "b", "a")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in (BYTES, Repeats(200, 40, False, block_segments=2, hot_segments=1)):
        assert tuples(remove_repeated_bytes(df, rule), *BYTE) == brute.repeated_bytes(rows, 200)
    for rule in (WORDS, Repeats(35, 10, True, block_segments=2, hot_segments=1)):
        assert tuples(remove_repeated_words(df, rule), *WORD) == brute.repeated_words(rows, 35)
