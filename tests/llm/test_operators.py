"""Each operator on small tables: brute force, and the cases that its docstring defines."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskloom.llm import common, exact_dedup, fingerprints, langid, mixing, near_dedup, packing, quality, sampling, secrets, token_output, toxicity
from riskloom.llm.tokens import Encoder

DIR = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, node string, score string, copies string, digest string, size string, __rl_gone string"
LONG = "lorem ipsum dolor " * 20_000


def make(spark, rows):
    """rows of (doc_id, text, lang, source), with more columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, y, s, len(t or ""), "a", None, "b", "c", "d", "e", "f") for d, t, y, s in rows], KIND)


ODD = [(5, "a b", "en", "s1"), (3, "a \t\n b", None, "s1"), (3, "a b", "en", None), (3, "a b", "en", None), (None, None, None, None), (None, "", "en", "s2"), (7, "x", None, "s1"), (8, LONG, "en", "s1"), (9, " ", "en", "s2"), (10, "a  b", "en", "s2")]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


# exact dedup


def test_exact_dedup(spark, odd, none):
    got = exact_dedup.query(spark, odd).collect()
    assert len(got) == len(ODD)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    for text in {norm(t) for _, t, _, _ in ODD}:
        rows = by.pop(hashlib.sha256(text.encode()).hexdigest())
        ids = [d for d, t, _, _ in ODD if norm(t) == text]
        least = min((d for d in ids if d is not None), default=None)
        assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids))
        assert {r["keep_id"] for r in rows} == {least} and {r["group_size"] for r in rows} == {len(ids)}
        assert sum(r["kept"] for r in rows) == 1 and [r["doc_id"] for r in rows if r["kept"]] == [least]
    assert not by and exact_dedup.query(spark, none).count() == 0


def test_exact_dedup_keeps_columns(spark, odd):
    kept = exact_dedup.dedup_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "None", "7", "8", "9"])


@pytest.mark.parametrize("sessions", [(4, 8, 3), (3, 4, 4)])
def test_index_persists(spark, odd, tmp_path, sessions):
    """Whatever the shuffle partitions of the sessions that open it."""
    at = str(tmp_path / "index")
    texts = [(i, f"text {i % 2000}", None, None) for i in range(100, 2600)]
    more = make(spark, [(1, "a b", None, None), (20, "new", None, None), (21, "new", None, None), (None, "new", None, None)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, n in enumerate(sessions):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            index = exact_dedup.DigestIndex(spark, at)
            assert index.buckets == sessions[0]
            kept = [r["doc_id"] for r in index.add(odd).collect() if r["kept"]]
            assert len(kept) == (5 if k == 0 else 0)
            got = index.add(make(spark, texts)).collect()
            assert sum(r["kept"] for r in got) == (2000 if k == 0 else 0) and all(r["keep_id"] == (r["doc_id"] - 100) % 2000 + 100 or r["doc_id"] < 2100 for r in got)
            assert index.entries().count() == 2005
        got = sorted((str(r["doc_id"]), r["keep_id"], r["kept"], r["group_size"]) for r in index.add(more).collect())
        assert got == [("1", 3, False, 1), ("20", 20, True, 3), ("21", 20, False, 3), ("None", 20, False, 3)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, at, 77)
    assert not [t for t in spark.catalog.listTables() if "digest_index" in t.name]


def test_a_lost_batch_can_be_repeated(spark, odd, tmp_path):
    at = str(tmp_path / "index")
    rows = lambda: sorted(map(str, exact_dedup.DigestIndex(spark, at).add(odd, "monday").collect()))
    first = rows()
    # The run that got this result is lost after it wrote the index.
    assert rows() == first and exact_dedup.DigestIndex(spark, at).entries().count() == 5
    assert not any(r["kept"] for r in exact_dedup.DigestIndex(spark, at).add(odd, "tuesday").collect())


MAPPED = KIND + ", more map<string,array<int>>, deep struct<x: array<map<int,string>>>"


@pytest.mark.parametrize("stage", ["exact_dedup", "near_dedup", "mixing", "toxicity"])
def test_map_columns_pass(spark, stage):
    rows = [(d, t, y, s, 0, "a", None, "b", "c", "d", "e", "f", {"k": [1]}, ([{1: "x"}],)) for d, t, y, s in ODD]
    for docs in (spark.createDataFrame(rows, MAPPED), spark.createDataFrame([], MAPPED)):
        labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
        out = {"exact_dedup": exact_dedup.dedup_documents, "near_dedup": near_dedup.dedup_documents, "mixing": mixing.mix, "toxicity": lambda d: toxicity.clean_documents(d, labels)}[stage](docs)
        assert out.columns == docs.columns and all(r["more"] == {"k": [1]} and r["deep"]["x"] == [{1: "x"}] for r in out.collect())


def test_many_rows_alike(spark):
    """A third of the rows share text and doc_id (or have none): one of them stays, and all are counted."""
    rows = [(None if i % 3 else i, "one text of six words here" if i % 3 else f"w{i} other", None, f"s{i % 2}") for i in range(6000)]
    docs = make(spark, rows)
    got = exact_dedup.query(spark, docs).collect()
    assert sum(r["kept"] for r in got) == 2001 and max(r["group_size"] for r in got) == 4000
    got = near_dedup.query(docs).collect()
    assert sum(r["kept"] for r in got) == 2001 and max(r["class_size"] for r in got) == 4000
    got = mixing.query(docs).collect()
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert len(got) == 6000 and all(abs(sum(v) - t) <= 6 for (_, t), v in by.items())
    assert sum(len(t.split()) for (t,) in mixing.mix(docs).select("text").collect()) == sum(r["taken"] for r in got)
    assert len({r["mark"] for r in packing.pieces(docs).select("mark").collect()}) > 5900
    assert token_output.query(spark, docs).count() == 6000 and fingerprints.query(docs).count() == 6000


# mixing


def test_mixing(spark, odd, none):
    got = mixing.query(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, *_ in ODD)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and mixing.query(none).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.query(odd).collect()))
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == 0


def test_mixing_reaches_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60), "en", f"s{rng.choice('aaaaabbbc')}") for i in range(3000)]
    got = mixing.query(make(spark, rows)).collect()
    size = {}
    for r in got:
        size.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    total = sum(s for s, _ in size)
    assert abs(sum(t for _, t in size) - total) < 1e-6 * total
    for (s, t), taken in size.items():
        assert t <= 3 * s + 1e-9 and abs(sum(taken) - t) < 0.01 * t
    # By hand: a has weight 1, b 2, c 3; c is small, so it stops at three times its size and the rest goes 1 to 2.
    a, b, c = sorted(size, key=lambda x: -x[0])
    assert c[1] == 3 * c[0] and abs(b[1] - 2 * a[1]) < 1e-6
    words = sum(len(r["text"].split()) for r in mixing.mix(make(spark, rows)).collect())
    assert words == sum(r["taken"] for r in got)


def test_mixing_comes_near_targets_of_small_sources(spark, larger):
    """Fifty documents a source, some of them a tenth of it and more."""
    by = {}
    for r in mixing.query(larger[0]).collect():
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert len(by) == 20 and all(abs(sum(v) - t) <= 0.01 * t for (_, t), v in by.items())


def test_first_ids_are_those_of_the_order(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    want = [r["doc_id"] for r in rows.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(100).collect()]
    assert [r["doc_id"] for r in common.first_ids(rows, 100).collect()] == want
    assert rows.where(common.early("doc_id", 20_000, 100)).count() < 1000
    assert common.first_ids(rows.limit(7), 100).count() == 7 and common.first_ids(rows.limit(0), 100).count() == 0


@pytest.mark.parametrize("name", ["exact_dedup", "mixing"])
def test_sql(spark, given, name):
    df = exact_dedup.query(spark, given[0]) if name == "exact_dedup" else mixing.query(given[0])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    r = con.sql((exact_dedup if name == "exact_dedup" else mixing).ORACLE_SQL)
    at = [r.columns.index(n) for n in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


# tokens, packing


def test_encoder_equals_whole_texts():
    rng, e = random.Random(6), Encoder()
    signs = ["a", "A", "bé", "É", "́", " ", "\t", "\n", "\x1c", "\x85", "\xa0", "'s", "'T", ".", ",", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "ß", "İ", "Σς", "한", "ᄒ", "$#", "word", ""]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(1500)]
    assert [x.tolist() for x in e.ids(texts)] == [e.tok.encode(t, add_special_tokens=False).ids for t in texts]


def greedy_words(values):
    """(selector, values) of each word: the selector with the most values that fit."""
    out, i = [], 0
    while i < len(values):
        for s, (count, width) in enumerate(token_output.WIDTHS):
            if all(v < 1 << width for v in values[i : i + count]):
                out.append((s, values[i : i + count]))
                i += count
                break
    return out


def test_words_take_as_many_as_fit():
    rng = random.Random(23)
    for _ in range(300):
        values = [rng.randrange(1 << rng.choice([0, 1, 2, 3, 4, 6, 8, 12, 15, 20])) if rng.random() < 0.3 else rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(200))]
        words = token_output.pack_words(np.array(values, np.uint64))
        want = greedy_words(values)
        assert (words >> np.uint64(60)).tolist() == [s for s, _ in want]
        for w, (s, v) in zip(words.tolist(), want, strict=True):
            count, width = token_output.WIDTHS[s]
            assert [(w >> (width * k)) & ((1 << width) - 1) for k in range(count)][: len(v)] == v
        assert token_output.unpack_words(words)[: len(values)].tolist() == values


def test_frames_round_trip():
    rng = np.random.default_rng(7)
    for _ in range(60):
        docs = [rng.integers(0, rng.choice([2, 9, 300, 40_000, 1 << 28]), rng.integers(0, rng.choice([3, 90, 40_000]))).astype(np.uint32) for _ in range(rng.integers(1, 6))]
        frame = token_output.encode_frame(docs)
        assert [d.tolist() for d in token_output.decode_frame(frame)] == [d.tolist() for d in docs]
        flat = np.concatenate(docs)
        for k in range(-(-len(flat) // token_output.BLOCK)):
            assert (token_output.decode_block(frame, k) == flat[k * token_output.BLOCK :][: token_output.BLOCK]).all()


def test_plain_files(tmp_path):
    frames = [token_output.encode_frame([np.array([1, 2, 3], np.uint32)]), token_output.encode_frame([])]
    token_output.dump(frames, str(tmp_path / "f"))
    assert token_output.load(str(tmp_path / "f")) == frames


def expected_ids(rows, end):
    e = Encoder()
    return [(d, [*e.tok.encode(t or "", add_special_tokens=False).ids, end]) for d, t, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_output(spark, odd, none):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_output.query(spark, odd).collect())
    from pyspark.sql import functions as F

    order = [tuple(r) for r in odd.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text").collect()]
    want, start = [], 0
    for d, ids in expected_ids(order, 1):
        want.append((start, d, len(ids), crc(ids)))
        start += len(ids)
    assert got == want and token_output.query(spark, none).count() == 0


def test_packing(spark, odd, none):
    rows = ODD + [(100 + i, "w " * (i * 37 % 1900), "en", "s") for i in range(300)]
    df = packing.pack(make(spark, rows), part_pieces=40)
    got = df.collect()
    want = sorted((str(d), k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for d, ids in expected_ids(rows, 0) for k in range(0, len(ids), 2048))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used, bound = packing.certificate(df)
    assert used == len(by) and bound <= used <= 1.06 * bound + 1  # partitions of 40 pieces; production ones have 4000
    full = {r["sequence_id"]: 0 for r in got}
    for r in got:
        full[r["sequence_id"]] += r["length"]
    assert all(r["certified"] or full[r["sequence_id"]] < 2048 for r in got)
    assert packing.pack(none).count() == 0


def test_lower_bound_never_exceeds_the_best_packing():
    def best(sizes, capacity):
        def go(i, bins):
            if i == len(sizes):
                return len(bins)
            options = []
            for b in sorted({x for x in bins if x + sizes[i] <= capacity}):
                rest = list(bins)
                rest.remove(b)
                options.append(go(i + 1, [*rest, b + sizes[i]]))
            return min([*options, go(i + 1, [*bins, sizes[i]])])

        return go(0, [])

    rng = random.Random(8)
    for _ in range(60):
        sizes = [rng.randrange(1, 13) for _ in range(rng.randrange(1, 8))]
        bound = packing.lower_bound(np.bincount(sizes, minlength=13), 12)
        bins = packing.best_fit_decreasing(np.array(sizes), 12)
        assert bound <= best(sizes, 12) <= len(set(bins.tolist()))


# classifiers


def held(pred, docs, labels, name):
    truth = {r["doc_id"]: r[name] for r in labels.collect()}
    rows = [r for r in pred.collect() if r["doc_id"] in truth]
    return [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"]]


@pytest.fixture(scope="session")
def larger(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_quality(spark, larger, odd, none):
    pairs = held(quality.query(*larger), *larger, "quality")
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.93
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (8, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    for docs in (odd, none):
        for table in (labels, labels.limit(0)):
            got = quality.query(docs, table).collect()
            assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(9)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0.6)).astype(float)
    s = quality.train(x[:1500], y[:1500]).score(x[1500:])
    assert ((s > 0.5) == y[1500:]).mean() > 0.97


def scalar_score(model, row):
    """One document, one tree, one node after the other."""
    sum_ = model.base
    for at in model.roots.tolist():
        while model.child[at] != at:
            at = model.child[at] + int(row[model.feature[at]] > model.limit[at])
        sum_ += model.value[at]
    return 1 / (1 + np.exp(-sum_))


def test_flat_trees_equal_a_scalar_walk():
    rng = np.random.default_rng(24)
    x = np.round(rng.random((600, 6)) * 20)
    y = (x[:, 0] + x[:, 2] > rng.random(600) * 40).astype(float)
    m = quality.train(x, y)
    assert len(m.roots) == quality.TREES
    assert np.allclose(m.score(x), [scalar_score(m, r) for r in x], atol=1e-12)


def test_the_first_split_is_the_best_of_all():
    """Histograms against a search over every feature and limit, on values with ties."""
    rng = np.random.default_rng(25)
    for _ in range(5):
        x = rng.integers(0, 12, (300, 4)).astype(float)
        y = (x[:, 1] + rng.integers(0, 6, 300) > 8).astype(float)
        m = quality.train(x, y)
        share = (y.sum() + 1) / (len(y) + 2)
        g, h = share - y, np.full(len(y), share * (1 - share))

        def gain(j, limit, x=x, g=g, h=h):
            left = x[:, j] <= limit
            if min(left.sum(), (~left).sum()) < quality.LEAF:
                return -1.0
            return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)

        best = max(gain(j, v) for j in range(4) for v in np.unique(x[:, j]))
        root = m.roots[0]
        assert abs(gain(m.feature[root], m.limit[root]) - best) < 1e-9


def test_statistics_are_of_the_whole_text():
    text = "One two two.\nThree!\n" + "x " * 5000
    got = dict(zip(quality.NAMES, quality.statistics(text), strict=True))
    words = text.split()
    assert got["words"] == np.log1p(len(words)) and got["commonest_word"] == 5000 / len(words) and got["distinct_words"] == len(set(words)) / len(words)
    assert got["lines"] == np.log1p(3) and got["ended_lines"] == 2 / 3 and got["upper"] == 2 / len(text)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity(spark, odd, none, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "labels"))
    pairs = held(toxicity.query(docs, labels), docs, labels, "toxic")
    found, toxic, false = sum(a and b for a, b in pairs), sum(b for _, b in pairs), sum(a and not b for a, b in pairs)
    assert found >= 0.9 * toxic and false <= 0.01 * len(pairs), (found, toxic, false)
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (8, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    for docs in (odd, none):
        for table in (labels, labels.limit(0)):
            got = toxicity.query(docs, table).collect()
            assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
            kept = toxicity.clean_documents(docs, table)
            assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)


def test_training_texts_are_bounded(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a" * 5), (2, "".join(chr(97 + i % 26) for i in range(common.LONG + 1000))), (3, ""), (4, "ü" * (common.LONG * 10))]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", common.passages(F.col("text"))).collect()}
    assert got[1] == "a" * 5 and got[3] == "" and all(common.LONG <= len(got[k]) <= common.LONG + common.PASSAGES for k in (2, 4))
    assert got[2].startswith(rows[1][1][:100]) and got[2].endswith(rows[1][1][-100:])
    docs = spark.createDataFrame([(1, f"t{i % 3}") for i in range(3000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1)] * 50, "doc_id bigint, toxic int")
    assert [tuple(r) for r in common.labelled_sample(docs, labels, "toxic", 4, 9, {1: 10}).collect()] == [(1, "t0", 1)]


def test_toxicity_tolerates_gaps():
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("aeioutnrshl") for _ in range(rng.randrange(2, 8)))
    text = lambda bad: " ".join(rng.choice(bad) if bad and rng.random() < 0.1 else word() for _ in range(60)) + ". " + " ".join(word() for _ in range(20))
    bad = ["dimwit", "buffoon", "crackpot"]
    m = toxicity.train([(text(bad), 1) for _ in range(120)] + [(text(None), 0) for _ in range(240)])
    for masked in (["dim-wit", "buf*foon"], ["d.i.m.w.i.t", "b u f f o o n"], ["dimmwit", "buffooon"]):
        assert np.mean(m.score([text(masked) for _ in range(20)]) >= 0.3) > 0.8
    assert np.mean(m.score([text(None) for _ in range(100)]) >= 0.3) < 0.05


def test_subsequence_scores_equal_features():
    rng = np.random.default_rng(11)
    beta = rng.standard_normal(64**3).astype(np.float32)
    codes = rng.integers(0, 64, 40).astype(np.uint8)
    scores = toxicity.window_scores(np.concatenate([codes, np.zeros(20, np.uint8)]), beta)
    for i in (0, 7, 20):
        window = codes[i : i + toxicity.WINDOW + toxicity.SPAN - 1]
        assert abs(scores[i] - (toxicity.WEIGHTS * beta[toxicity.features([window])[0]]).sum()) < 1e-3


def brute_features(window):
    """Subsequences of three symbols within SPAN symbols, each worth DECAY for every symbol it skips."""
    w, out = [*window.tolist(), *[0] * 20], Counter()
    for i in range(toxicity.WINDOW):
        for b in range(2, toxicity.SPAN):
            for a in range(1, b):
                out[w[i], w[i + a], w[i + b]] += toxicity.DECAY ** (b - 2)
    return out


def test_kernel_equals_that_of_subsequences():
    rng = np.random.default_rng(29)
    windows = [rng.integers(0, 5, rng.integers(3, toxicity.WINDOW + toxicity.SPAN)).astype(np.uint8) for _ in range(90)]
    f = [brute_features(w) for w in windows]
    want = [[sum(v * b[k] for k, v in a.items()) for b in f] for a in f]
    x = toxicity.features(windows)
    assert np.allclose(toxicity.kernel(x, x), want, rtol=1e-4)


def test_language(spark, larger, odd, none):
    truth = {r["doc_id"]: r["lang"] for r in larger[0].collect()}
    got = [r for r in langid.query(larger[0]).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.97
    rows = {(r["doc_id"], r["lang_pred"]) for r in langid.query(odd).collect()}
    assert (9, "und") in rows and (None, "und") in rows and (7, "en") in rows
    assert langid.query(none).count() == 0
    assert {r["lang_pred"] for r in langid.query(make(spark, [(1, "abc", None, None), (2, "12", None, None)])).collect()} == {"und"}


def brute_symbols(text):
    one = lambda c: " " if c.isspace() or not c.isprintable() or c in ".,;:!?" else "0" if c.isdigit() else c.lower()[0]
    return "".join(map(one, text))


def brute_ngrams(text):
    t = brute_symbols(text)
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_language_kernel_and_regression():
    """Kernel values against sets of n-grams in several scripts, and the folded model against a ridge regression on the kernel itself."""
    rng = random.Random(26)
    letters = {"a": "abcde fgh.", "b": "фывап ролд,", "c": "漢字仮名交 り文!", "d": "😀😁𐐀𐐨 x1٣"}
    text = lambda y: "".join(rng.choice(letters[y]) for _ in range(rng.randrange(3, 60)))
    rows = [(t, y) for y in letters for t in (text(y) for _ in range(40)) if langid.has_letter(t)]
    for t, _ in rows:
        assert len(langid.ngrams(t)) == len(brute_ngrams(t))
    found = [langid.ngrams(t) for t, _ in rows]
    known = np.unique(np.concatenate(found))
    marks = np.zeros((len(known), len(rows)), np.float32)
    for j, f in enumerate(found):
        marks[np.searchsorted(known, f), j] = 1 / np.sqrt(len(f))
    new = [text(y) for y in letters for _ in range(5)]
    got = langid.kernel([langid.ngrams(t) for t in new], known, marks)
    sets = [brute_ngrams(t) for t, _ in rows]
    for i, t in enumerate(new):
        own = brute_ngrams(t)
        assert np.allclose(got[i], [len(own & s) / (len(own) * len(s)) ** 0.5 for s in sets], atol=1e-5)
    m = langid.train(rows)
    assert len(rows) <= langid.LANDMARKS and len(m.names) == 4
    # With all rows as landmarks, Nyström features are those of the kernel (with its ridge): regression in the dual.
    k = langid.kernel(found, known, marks)
    kx = langid.kernel([langid.ngrams(t) for t in new], known, marks)
    inner = np.linalg.inv(k + 1e-3 * np.eye(len(k)))
    n = len(rows)
    for j, y in enumerate(m.names):
        own = np.array([r[1] == y for r in rows])
        v = np.where(own, 0.5 / own.sum(), 0.5 / (~own).sum()) * n
        gram, cross = k @ inner @ k + 1, kx @ inner @ k + 1
        alpha = np.linalg.solve(gram + 1e-2 * n * np.diag(1 / v), np.where(own, 1.0, -1.0))
        assert np.allclose(m.values(new)[:, j], cross @ alpha, atol=2e-3)


def test_languages_are_not_capped(spark):
    rng = random.Random(27)
    rows = []
    for y in range(300):
        own = [chr(0x3400 + 40 * y + i) for i in range(40)]
        rows += [(len(rows) + i, "".join(rng.choice(own) for _ in range(40)), f"l{y:03d}", "s") for i in range(12)]
    got = [r for r in langid.query(make(spark, rows)).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in got]) > 0.97


# secrets


def brute_spans(t):
    kinds = ((r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), (r"[0-9a-f]+", lambda m: len(m[0]) >= 16))
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m))


def test_base_spans():
    rng = random.Random(12)
    parts = ["password", "PassWd", "ſecret", "secret", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "ABCD1234", "0123456789abcdef", "dead", "beef", "x", "é", "-", "/"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        assert secrets.base_spans(t) == brute_spans(t), t


def test_grammar_inference():
    rng = random.Random(13)
    key = lambda: "sk" + "".join(rng.choice("0123456789ABCDEF") for _ in range(24)) + "-x"
    plain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(6, 20))) for _ in range(300)] + [f"item-{i:012d}" for i in range(40)]
    formats = secrets.Formats({"assign": [key() for _ in range(80)]}, plain)
    assert sum(formats.likely(key()) for _ in range(50)) >= 45
    assert not any(formats.likely(w) for w in ["internationalization2", "item-000000000777", "some_long_name_2024_v1"])
    a = secrets.infer(["ab" * k for k in range(1, 9)] * 20)
    assert a.rate("ababab") > a.rate("aabbab") and len(a.nexts) < 17
    text = f"id {key()} and password = abcdefghijkl0"
    spans = secrets.scan(text, formats)
    assert [k for _, k, _ in spans] == [3, 0] and secrets.base_spans(text) == [s for s in spans if s[1] < 3]


def test_secrets(spark, odd, none):
    rows = [*ODD, (30, 'token = "0123456789abcdef0" AKIAABCDEFGHIJ12345', "en", "s")]
    got = secrets.query(make(spark, rows)).collect()
    assert len(got) == len(rows)
    r = next(r for r in got if r["doc_id"] == 30)
    want = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(rows[-1][1]))
    assert (r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) == (1, 1, 1, want) and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert secrets.query(none).count() == 0


@pytest.mark.parametrize("bare", [0.01, 0.33, 1.0])
def test_common_bare_credentials_are_found(spark, bare):
    rng = random.Random(19)
    sign = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "".join(rng.choice(sign) for _ in range(40))
    vowels, rest = "aeiou", "bcdfghlmnprst"
    word = lambda: "".join(rng.choice(rest) + rng.choice(vowels) for _ in range(rng.randrange(1, 6)))
    rows, keys, plain = [], {}, {}
    for i in range(1500):
        words = [word() for _ in range(60)]
        if rng.random() < 0.1:
            words += ["api_key", "=", key()]
        if rng.random() < 0.2:
            plain[i] = f"{word()}_{word()}_{word()}_{rng.randrange(2000, 2030)}"
            words.append(plain[i])
        if rng.random() < bare:
            keys[i] = key()
            words.insert(20, keys[i])
        rows.append((i, " ".join(words), "en", "s"))
    text = {i: t for i, t, *_ in rows}
    spans = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x.startswith("format")] for r in secrets.query(make(spark, rows)).collect()}
    found = {i: {text[i][int(s) : int(e)] for _, s, e in x} for i, x in spans.items()}
    # Labelled credentials are scored like all others, and nearly all pass.
    labelled = [float(x) for r in secrets.query(make(spark, rows)).where("n_assign = 1 AND spans NOT LIKE '%format%'").collect() for x in r["scores"].split(",")]
    assert not labelled or sum(x >= 0 for x in labelled) >= 0.9 * len(labelled)
    assert sum(keys[i] in found[i] for i in keys) >= 0.9 * len(keys)
    assert sum(plain[i] in found[i] for i in plain) <= 0.01 * len(plain)


def test_rare_credentials_and_short_ones_are_learned(spark):
    rng = random.Random(20)
    key = lambda: "".join(rng.choice("QXZJKVWY") for _ in range(6)) + "." + "".join(rng.choice("QXZJKVWY") for _ in range(6))
    text = lambda: " ".join("".join(rng.choice("aeioutnrshl") for _ in range(rng.randrange(2, 15))) for _ in range(20))
    rows = [(i, text(), "en", "s") for i in range(30_000)]
    for i in range(0, 30_000, 1500):
        rows[i] = (i, f"{rows[i][1]} secret={key()}", "en", "s")
    bare = {i: key() for i in range(7, 30_000, 1000)}
    for i, k in bare.items():
        rows[i] = (i, f"{rows[i][1]} {k} x", "en", "s")
    got = {r["doc_id"]: r["spans"] for r in secrets.query(make(spark, rows)).collect()}
    found = {i for i, k in bare.items() if f"format:{rows[i][1].index(k)}:" in got[i]}
    assert len(found) >= 0.9 * len(bare)
    assert sum("format" in s for i, s in got.items() if i not in bare) <= 30


# fingerprints, near duplicates


def generalised_jaccard(a, b):
    return np.minimum(a, b).sum() / np.maximum(a, b).sum()


@pytest.mark.parametrize("top", [1.0, 2.0])
def test_collision_rate_is_generalised_jaccard(top):
    s, rng, off = sampling.Sampler(600, 3, top), np.random.default_rng(14), []
    for size in (1, 7, 200, 200, 200, 40_000):
        for draw in (lambda n: rng.integers(0, 5, n) * 1.0, lambda n: rng.random(n) * 2):
            terms = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
            a = draw(size)
            b = np.where(rng.random(size) < 0.3, draw(size), a)
            if not (a.any() and b.any()):
                continue
            both = [(terms[w > 0], w[w > 0]) for w in (a, b)]
            starts = np.cumsum([0, *(len(t) for t, _ in both)])
            x, y = s.sample(np.concatenate([t for t, _ in both]), np.concatenate([w for _, w in both]), starts)
            truth = generalised_jaccard(a, b)
            off.append((x == y).mean() - truth)
            assert abs(off[-1]) < 4.5 * (truth * (1 - truth) / 600) ** 0.5 + 0.005
    assert abs(np.mean(off)) < 0.015


def every_e1(s, terms):
    """e1 of each term (rows) and sample."""
    which, k, e1 = s.first(terms, np.full(len(terms), np.inf))
    out = np.full((len(terms), s.samples), np.nan)
    out[which, k] = e1
    return out


def test_passed_over_terms_change_no_sample():
    s, rng = sampling.Sampler(64, 5), np.random.default_rng(18)
    for size, most in ((1, 1.0), (3, 0.01), (900, 1.0), (900, 0.2), (2000, 1.0)):
        terms = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        w, e1 = rng.random(size) * most, every_e1(s, terms)
        assert not np.isnan(e1).any()
        want = []
        for k in range(64):
            a, t = s.rated(terms, np.full(size, k), e1[:, k], w)
            i = a.argmin()
            want.append(sampling.mixed(sampling.mixed(terms[i : i + 1]) + t[i : i + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])
        # Other texts in the same call change nothing either.
        got = s.sample(np.concatenate([terms, terms[:1], terms]), np.concatenate([w, w[:1], w]), np.array([0, size, size, size + 1, 2 * size + 1]))
        assert (got[0] == want).all() and (got[3] == want).all() and (got[1] == sampling.NONE).all()


def test_draws_have_the_laws_of_the_method():
    s, rng = sampling.Sampler(10, 9), np.random.default_rng(21)
    terms = rng.integers(0, 1 << 64, 60_000, np.uint64)
    e1 = every_e1(s, terms)
    assert abs(e1.mean() - 1) < 0.01 and abs(e1.std() - 1) < 0.02
    # Samples of a term are independent of each other.
    assert np.abs(np.corrcoef(e1.T) - np.eye(10)).max() < 0.02
    assert abs((np.minimum(e1[:, 2], e1[:, 7]) > 0.5).mean() - np.exp(-1)) < 0.01
    # a is exponential, its rate the weight.
    for w in (1.0, 0.37, 0.02):
        a, t = s.rated(terms, np.full(len(terms), 4), e1[:, 4], np.full(len(terms), w))
        x = np.exp(a) * w
        assert abs(x.mean() - 1) < 0.02 and abs(x.std() - 1) < 0.03 and abs((x < np.log(2)).mean() - 0.5) < 0.01
        assert (t <= 0).all() and (w < 1 or (t == 0).all())


def test_bands_collide_as_samples_would():
    """Five samples of one pair agree together as often as five independent ones."""
    s, rng, met = sampling.Sampler(100, 4), np.random.default_rng(28), []
    for _ in range(400):
        terms = np.unique(rng.integers(0, 1 << 64, 120, np.uint64))
        a, b = terms[:100], terms[20:]
        x, y = s.sample(np.concatenate([a, b]), np.ones(200), np.array([0, 100, 200]))
        met.append((x == y).reshape(20, 5).all(1).mean())
    assert abs(np.mean(met) - (80 / 120) ** 5) < 0.015


def test_bags_are_the_runs_of_words():
    import pyarrow as pa

    rng = random.Random(22)
    texts = ["", " ", "a", " a  b\t", *(" ".join(rng.choice("abcé") for _ in range(rng.randrange(30))) for _ in range(200))]
    names = {}
    for width in (1, 2, 5):
        terms, counts, starts = sampling.bags(pa.array(texts), width)
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            n = min(width, len(w))
            want = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()
            mine = terms[starts[i] : starts[i + 1]]
            assert sorted(counts[starts[i] : starts[i + 1]].tolist()) == sorted(want.values()) and (np.diff(mine.astype(object)) > 0).all()
            if w:
                assert names.setdefault(frozenset(want), tuple(mine)) == tuple(mine)
    assert len(set(names.values())) == len(names)


def test_fingerprints(spark, odd, none):
    got = fingerprints.query(odd).collect()
    from pyspark.sql import functions as F

    order = [tuple(r) for r in odd.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text").collect()]
    want = []
    for i, (d, t, *_) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (3, 5, 10)}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.query(none).count() == 0
    one = fingerprints.query(make(spark, [(1, "a b c", None, None)])).first()
    assert one["near_next"] == 1.0


def test_likeness_of_long_texts(spark):
    rng = random.Random(17)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    base = words(30_000)
    texts = [" ".join(x) for x in (base, words(30_000), base[:20_000] + words(10_000), [*base[:300] * 40, *words(9000)])]
    got = {r["doc_id"]: r for r in fingerprints.query(make(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}

    def bag(t):
        w = t.split()
        return Counter(zip(w, w[1:]))  # noqa: B905

    def near(estimate, a, b):
        truth = (bag(a) & bag(b)).total() / (bag(a) | bag(b)).total()
        assert abs(estimate - truth) <= 4 * (truth * (1 - truth) / fingerprints.SAMPLES) ** 0.5 + 0.02, (estimate, truth)

    for i, t in enumerate(texts):
        following = texts[i - 1]
        near(got[i]["near_next"], t, following)
        near(got[i]["near_edited"], t, fingerprints.edited(t, following))


def brute_classes(rows):
    """Components of the links of weighted Jaccard similarity 0.8 and more, with exact document frequencies."""
    words = [(t or "").lower().split() for _, t, *_ in rows]
    bags = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    df = Counter(s for b in bags for s in b)
    idf = lambda d: 1 + np.log((1 + len(rows)) / (1 + d))
    rate = {s: min(255, max(1, round(255 * (idf(d) / idf(1)) ** 0.5))) / 255 for s, d in df.items()}
    weights = [{s: (1 + np.log(n)) * rate[s] for s, n in b.items()} for b in bags]
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(weights):
        for j in range(i):
            b = weights[j]
            both = sum(min(w, b[s]) for s, w in a.items() if s in b)
            if words[i] == words[j] or (both and both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates(spark, odd, none):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, common = list(ODD), [word() for _ in range(30)]
    for g in range(12):
        base = [word() for _ in range(rng.randrange(60, 160))] + (common if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 100, " ".join(copy), "en", "s"))
    got = near_dedup.query(make(spark, rows)).collect()
    truth = brute_classes(rows)
    mine = {}
    for r in got:
        mine.setdefault(r["class_id"] if r["class_id"] is not None else "null", []).append(str(r["doc_id"]))
    brute = {}
    for (d, *_), c in zip(rows, truth, strict=True):
        brute.setdefault(c, []).append(str(d))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, brute.values()))
    assert all(r["class_size"] == len(mine[r["class_id"] if r["class_id"] is not None else "null"]) for r in got)
    assert sum(r["kept"] for r in got) == len(brute)
    docs = make(spark, rows)
    kept = near_dedup.dedup_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute)
    assert near_dedup.query(none).count() == 0 and near_dedup.dedup_documents(none).count() == 0


def test_components(spark):
    rng = random.Random(16)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in near_dedup.components(df, common.Scratch(spark, "components")).collect()}
    root = {}

    def find(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {frozenset(n for n in nodes if find(n) == r) for r in map(find, nodes)} == {frozenset(n for n in got if got[n] == r) for r in got.values()}


# the pipeline


def test_pipeline_stages(spark, given, tmp_path):
    import corpus_pipeline as P

    docs, labels = given
    names, columns, kept = [n for n, _ in P.STAGES], docs.columns, docs
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in P.STAGES:
        out = stage(spark, kept, DIR)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before, rows = [tuple(r) for r in kept.collect()], [tuple(r) for r in after.collect()]
        if name != "packing":
            assert after.columns == columns and set(rows) <= set(before)
        if name == "toxicity":
            reject = {r["doc_id"] for r in toxicity.query(docs, labels).collect() if r["predicted"]}
            assert sorted(r[0] for r in rows) == sorted(r[0] for r in before if r[0] not in reject)
        elif name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1]) for r in rows]
            assert len(set(texts)) == len(texts) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1]) for r in before})
        elif name == "near_dedup":
            truth = brute_classes(before)
            assert sorted(r[0] for r in rows) == sorted(min(before[i][0] for i, c in enumerate(truth) if c == k) for k in set(truth))
        elif name == "mixing":
            taken = {r["doc_id"]: r["taken"] for r in mixing.query(kept).collect()}
            for r in before:
                assert sum(len(x[1].split()) for x in rows if x[0] == r[0]) == taken[r[0]]
        else:
            want = sorted((d, k // 2048, len(ids[k : k + 2048])) for d, ids in expected_ids(before, 0) for k in range(0, len(ids), 2048))
            assert sorted((r["doc_id"], r["piece"], r["length"]) for r in after.collect()) == want
        kept = after


def test_registered():
    from riskloom.llm.queries import oracle_sql, queries

    assert sorted(queries()) == sorted([*(n for n in queries() if re.match(r"op(10|[1-9])_", n)), "pipeline"]) and len(queries()) == 11
    assert set(oracle_sql()) <= set(queries())
