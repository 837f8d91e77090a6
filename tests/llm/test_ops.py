import hashlib
import io
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import DATA, differences
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbend.llm import ann, decontam, langid, linededup, mixing, neardup, quality, queries, shared, tokens, urls, warc, words

SF = str(DATA / "sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split_words(t):
    return WORD.findall(lower(t))


ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.\nsecond line", "en", "a", 10), (2, "The quick brown fox jumps over the lazy dog again and again.\nsecond line", "en", "a", 10), (3, None, "en", None, None), (4, "", None, "b", 0),
    (5, "!!! ...", "en", "b", 3), (6, "Ünïcödé wörds ärе hérè", "de", None, 5), (None, "a row without an id and some words in it", "en", "c", 2), (7, "word " * 30000, "en", "c", 150000), (1, "The quick brown fox jumps over the lazy dog again and again.\nsecond line", "en", "a", 10), (8, "x" * 5000, "fr", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(*r, "extra", 1, "z") for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", score string, class_id int, h string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], DATA / "sf0.001") == ""


def test_words_of_any_text():
    texts = ["Hello, World! été 12a", "", None, "x" * 50 + " y", "ÀB c-d_e", "a" * 10 + " " + "b" * 10]
    for size in (1 << 20, 7):
        words.SEGMENT, old = size, words.SEGMENT
        hashes, offsets = words.batch_words(pa.array(texts))
        words.SEGMENT = old
        assert np.diff(offsets).tolist() == [len(split_words(t)) for t in texts]
        if size == 7:
            assert hashes.tolist() == before.tolist()  # noqa: F821
        before = hashes


def test_places_and_limits_of_the_session(spark, tmp_path, monkeypatch):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k, None) for k in (rows, size)}
    try:
        spark.conf.set(rows, "100")
        spark.conf.set(size, "64m")
        with shared.batches(spark, 7, 1 << 20):
            assert (spark.conf.get(rows), spark.conf.get(size)) == ("7", str(1 << 20))
        assert (spark.conf.get(rows), spark.conf.get(size)) == ("100", "64m")
        shared.small_batches(spark, 512, 1 << 20)  # only lowers
        assert (spark.conf.get(rows), spark.conf.get(size)) == ("100", str(1 << 20))
        root = shared.shared_root
        monkeypatch.setattr(shared, "shared_root", lambda spark: f"file://{tmp_path}")
        monkeypatch.setattr(shared, "_owned", [])
        made, other = shared.materialise(spark.range(3), "a"), shared.materialise(spark.range(4), "b")
        shared.discard(made)
        assert [p.name[0] for p in tmp_path.iterdir() if any(p.rglob("*.parquet"))] == ["b"] and other.count() == 4
        with shared.temporary(spark):
            with shared.temporary(spark):
                inner, kept = shared.materialise(spark.range(5), "c"), shared.materialise(spark.range(6), "d", keep=True)
            assert sorted(p.name[0] for p in tmp_path.iterdir() if any(p.rglob("*.parquet"))) == ["b", "d"] and kept.count() == 6 and inner.schema == kept.schema
        assert [p.name[0] for p in tmp_path.iterdir() if any(p.rglob("*.parquet"))] == ["b"]
        shared.clear(spark)
        assert not list(tmp_path.rglob("*.parquet"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        root(Elsewhere())


def test_shingles_of_batches_with_few_words():
    for texts in (["a"], ["a b"], ["", "a b c", None], ["a b c d"], ["x", "y"], ["a b c d e f", "a"]):
        row, shingle, offsets, hashes = words.batch_shingles(pa.array(texts), 5)
        alone = [words.batch_shingles(pa.array([t, "some other words to come after it"]), 5) for t in texts]
        assert [shingle[row == i].tolist() for i in range(len(texts))] == [s[r == 0].tolist() for r, s, _, _ in alone]
        assert np.diff(offsets).tolist() == [len(split_words(t)) for t in texts] and hashes.size == offsets[-1]


# 1 --------------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = [
        ("http://a.com/x", "a.com", "/x", "com/", "allow"), ("https://EXAMPLE.com/en/1?q#f", "example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/", "allow"), ("x://n.net/es/a", "n.net", "/es/a", "net/es/", "block"), ("x://n.net/fr/", "n.net", "/fr/", "net/fr/", "block"), ("x://n.net/de/", "n.net", "/de/", None, None),
        ("x://notcom/", "notcom", "/", None, None), ("x://a.com?x", "a.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("x://", "", "", None, None),
    ]
    df = spark.createDataFrame([(i, c[0], None, "clash") for i, c in enumerate(cases)], "page_id bigint, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict) and r["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    unlabelled = urls.judge(df.where("page_id = 6")).collect()
    assert [r["verdict"] for r in unlabelled] == ["allow"]


def test_odd_urls(spark):
    long = "https://news.example.com/en/" + "a/%20?&=1" * 100_000
    rows = [(None, "http://a.com/"), (1, "http://x.org/b?c"), (1, "http://x.org/b?c"), (2, long), (3, "http://x.org/" + "é" * 50_000), (None, None), (1, "http://n.net/es/")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id bigint, url string, rule int, verdict string")
    got = urls.judge(df).collect()
    assert Counter(r["page_id"] for r in got) == Counter(i for i, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["page_id"], r["host"], r["rule"]].append((r["path"], r["verdict"], r["score"]))
    assert len(by[1, "x.org", None]) == 2 and len(set(by[1, "x.org", None])) == 1 and by[1, "n.net", "net/es/"][0][1] == "block"
    assert by[2, "news.example.com", "example.com/en/"][0][:2] == ("/en/a/%20", "block") and by[None, "a.com", "com/"][0][1] == "allow" and len(by[3, "x.org", None][0][0]) == 50_001
    assert all(0 <= x[2] <= 1 and x[1] in ("allow", "block") for v in by.values() for x in v)


def test_boosted_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    p = urls.BoostedTrees(trees=80).fit(x[:2000], y[:2000]).predict(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.9
    assert urls.BoostedTrees().fit(x[:50], np.ones(50)).predict(x[:3]).min() > 0.9


# 2 --------------------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    rows = queries.op2_language_id(spark, str(DATA / "sf0.01")).join(shared.table(spark, str(DATA / "sf0.01"), "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_recurrent_gradients_are_right():
    rng = np.random.default_rng(2)
    net = langid.Network.new(["a", "b", "c"], rng, h=3)
    x, real, y = rng.integers(0, 5, (6, 4)), np.ones((6, 4), np.float32), np.array([0, 1, 2, 1])
    real[4:, 1] = 0
    for w in net.parameters():
        w[...] = w.astype(np.float32)

    def loss():
        p = net.labels(x.astype(np.uint8), real)
        return -(np.log(p[:, y, np.arange(4)].astype(np.float64)) * real).sum() / real.sum()

    grads = net.gradients(x, real, y)
    for w, g in zip(net.parameters(), grads, strict=True):
        at = tuple(rng.integers(0, n) for n in w.shape) if w.ndim < 2 or w.shape[1] != 256 else (int(rng.integers(0, w.shape[0])), int(x[0, 0]))
        old, step = w[at], 1e-2
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert math.isclose((up - down) / (2 * step), float(g[at]), rel_tol=0.05, abs_tol=2e-3)


def test_language_of_odd_rows(spark, odd, none):
    net = langid.train(odd, steps=5)
    got = langid.predict(odd, net).collect()
    assert len(got) == len(ODD) and all((r["lang_pred"] == "und") == (t is None or not re.search(r"[^\W\d_]", t)) for r, (_, t, *_) in zip(got, ODD, strict=True))
    assert langid.train(none) is None and {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"} and langid.predict(none, None).count() == 0
    kept = langid.keep_known(odd, net, 0.0)
    assert kept.columns == odd.columns and kept.count() == sum(bool(t and re.search(r"[^\W\d_]", t)) for _, t, *_ in ODD)


def test_few_usable_rows_are_found(spark):
    """Most labelled rows have no letter; the others are learned from all the same, wherever in the text their letters are."""
    rows = [(i, "12 34 ...", "xx") for i in range(400)] + [(1000 + i, "0 " * 300 + text, lang) for i in range(10) for text, lang in (("the house and the tree " * 20, "en"), ("das haus und der baum " * 20, "de"))]
    net = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), hold_out=False, sample_docs=20, steps=60)
    assert net.langs == ["de", "en"]


def test_pooling_is_the_mean_over_all_bytes():
    rng = np.random.default_rng(3)
    net = langid.Network.new(["a", "b", "c"], rng, h=4)
    texts = ["", "x", "ünï " * 50, "word " * 3000, None, "y" * 64, "z" * 65]
    got = langid.pooled(net, pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        positions = []
        for a in range(0, raw.size, langid.WINDOW):  # one window at a time
            piece = raw[a:a + langid.WINDOW]
            p = net.labels(piece[:, None], np.ones((piece.size, 1), np.float32))
            positions += [p[k, :, 0] for k in range(piece.size)]
        want = np.mean(positions, axis=0) if positions else np.zeros(3)
        assert np.allclose(row, want, atol=1e-5)
    lang, score = langid.best(net, pa.array(texts), pa.array([bool(t) for t in texts]))
    assert [x == "und" for x in lang.to_pylist()] == [not t for t in texts] and all(math.isclose(s, got[i].max(), rel_tol=1e-6) for i, s in enumerate(score.to_pylist()) if texts[i])


# 3 --------------------------------------------------------------------------------------------------------------------


def brute_nearest(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            found = sorted((-float(ok[q] @ v / (np.linalg.norm(ok[q]) * np.linalg.norm(v))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out[q] = found[:k]
    return out


def test_neighbours_of_all_rows(spark):
    df = shared.table(spark, SF, "embeddings")
    want = brute_nearest([(r["vec_id"], list(r["embedding"])) for r in df.collect()], 50, 5)
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(math.isclose(s, -dict((i, d) for d, i in want[q]).get(v, -s), rel_tol=1e-12) for q in want for v, s in got[q])


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (50, [-1.0, 0.5]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (2, [1.0, 0.0])]
    rows += [(i, [1.0, 0.0]) for i in range(10, 30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    want = [(q, n, i) for q, found in brute_nearest(rows, 50, 5).items() for n, (_, i) in enumerate(found, 1)]
    assert sorted(got) == sorted(want)
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id = 0")).count() == 0


def test_scaled_copies_tie(spark):
    """A third of the rows, and more, point one way: exact ties go to the smallest ids, whichever nodes a beam holds."""
    rng = np.random.default_rng(31)
    rows = [(i, [float(1000 - i), 0.0, 0.0]) for i in range(400)] + [(400 + i, v) for i, v in enumerate(rng.normal(size=(600, 3)).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df, every=100).collect()}
    want = {(q, n): i for q, found in brute_nearest(rows, 100, 5).items() for n, (_, i) in enumerate(found, 1)}
    assert [got[0, n] for n in range(1, 6)] == [1, 2, 3, 4, 5] and [got[100, n] for n in range(1, 6)] == [0, 1, 2, 3, 4]
    assert np.mean([got[x] == want[x] for x in want]) > 0.95


def test_one_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 0.5]), (0, [0.0, 1.0])]
    got = [(r["query_id"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).orderBy("rank").collect()]
    assert got == [(0, 1, 1.0), (0, 2, round(1 / math.sqrt(1.25), 6))]


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_over_several_shards_and_layers(spark, clustered, monkeypatch):
    rng = np.random.default_rng(32)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 9000)] + 0.15 * rng.normal(size=(9000, 24)) if clustered else rng.normal(size=(9000, 24))).astype(np.float32)
    x[::3] = x[0] * rng.choice([1.0, 2.0, 4.0, 0.5], (3000, 1)).astype(np.float32)  # a third are scaled copies of one vector
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(9000), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    index = ann.build_index(df, shard_rows=1300)
    graphs = [ann.Graph.load(ann._load(r["uri"])) for r in index.collect()]
    assert len(graphs) >= 4 and min(len(g.layers) for g in graphs) >= 3 and sum(len(g.ids) for g in graphs) == 6001
    got = defaultdict(dict)
    for r in ann.search(index, df.where("vec_id % 50 = 0"), block_bytes=5000).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 9000, 50):
        s = np.round(y @ y[q], 12)
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(9000), -s))[:5].tolist()) & set(got[q]))
        assert len(got[q]) == 5
    assert hits / (180 * 5) >= 0.9


# 4 --------------------------------------------------------------------------------------------------------------------


def test_encoder_gives_the_tokenizers_ids():
    e = tokens.WordEncoder(queries.tokenizer_path())
    texts = ["", None, "a b  c\tİI ß", "x <|endoftext|>y <|startoftext|> z", "don't we'll 12 34x\u200bq \u0301 é", " lead", "a\x1cb\x1fc", "ΑΣ ΑΣΑ", "\x85a\xa0b", "Éàß'Ñs's naïve-ça×÷x ªº", "12345 !!?? …", "I' m I' m '\ns", "e\u0301 a\u0301b", "日本語 text", "word " * 2000]
    for remembered in (1 << 20, 3):
        e.remembered = remembered
        ids, offsets = e.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[offsets[i]:offsets[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_a_missing_id_is_no_number(spark, tmp_path):
    rows = [(None, "without"), (-1, "minus one"), (0, "zero"), (0, "zero again"), (5, None), (-(1 << 63), "least")]
    path = queries.tokenizer_path()
    manifest = tokens.write(spark.createDataFrame(rows, "doc_id bigint, text string"), path, f"file://{tmp_path}", files=1)
    assert [r["doc_id"] for r in tokens.read(manifest).orderBy("start").collect()] == [None, -(1 << 63), -1, 0, 0, 5]
    f, e = tokens.TokenFile(manifest.first()["uri"]), tokens.WordEncoder(path)
    want = lambda t: [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    for wanted in ([-1], [None], [0], [None, -1, 5], []):
        got = sorted((str(i), ids.tolist()) for i, ids in f.read(wanted))
        assert got == sorted((str(i), want(t)) for i, t in rows if i in wanted)
    f.close()


def test_the_encoders_memory_is_bounded_and_keeps_what_is_frequent():
    e = tokens.WordEncoder(queries.tokenizer_path(), remembered=300)
    common = [f"common{i}" for i in range(40)]
    for k in range(30):
        text = " ".join(common + [f"rare{k}x{i}" for i in range(50)] + ["z" * 900 + str(k)])
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
        assert e.number.size == e.one.size == e.seen.size <= 300 + 90 and e.bounds.size == e.seen.size + 1 and e.ids.size == e.bounds[-1]
        assert (np.diff(e.one.astype(object)) >= 0).all()
    one, _, own = tokens.chunk_keys(pa.array(common, pa.large_string()))
    assert own.all() and np.isin(one, e.one).all()


def test_chunk_keys_tell_chunks_apart():
    chunks = sorted({"a" * n for n in range(70)} | {f"{'x' * k}{i}" for k in range(0, 40, 3) for i in range(500)} | {"é", "e", "\u0301", "日本", "日", "ab\0", "ab"})
    one, two, own = tokens.chunk_keys(pa.array(chunks, pa.large_string()).slice(3))
    assert own.tolist() == [len(c.encode()) <= tokens.CHUNK_BYTES for c in chunks[3:]]
    assert np.unique(one[own]).size == np.unique(two[own]).size == own.sum()
    again = tokens.chunk_keys(pa.array(chunks[::-1], pa.large_string()))
    assert again[0][::-1][3:][own].tolist() == one[own].tolist() and again[1][::-1][3:][own].tolist() == two[own].tolist()


def test_token_files_round_trip(spark, tmp_path, odd, none):
    path = queries.tokenizer_path()
    e = tokens.WordEncoder(path)
    manifest = tokens.write(odd, path, f"file://{tmp_path}", files=3)
    got = tokens.read(manifest).orderBy("start").collect()
    want = sorted(((-1 if i is None else i), e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in ODD)
    assert [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got] == [i for i, _ in want]
    start = 0
    by_id = defaultdict(list)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        by_id[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"]))
    for i, ids in want:
        assert (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in by_id[None if i == -1 else i]
    for r in manifest.collect():
        f = tokens.TokenFile(r["uri"])
        f.frame, frames, real = (lambda k: frames.append(k) or real(k)), [], f.frame
        some = [int(x) for x in f.doc_id[:1]]
        for i, ids in f.read(some):
            assert ids[-1] == 2 and i in some
        assert len(set(frames)) <= len(set(f.frame_of[np.isin(f.doc_id, some)].tolist()))
        import zstandard

        whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(r["uri"][7:], "rb").read()), read_across_frames=True).read() for _ in [0])
        assert len(whole) == 4 * r["n_ids"]
        f.close()
    assert tokens.encode_documents(none, path).count() == 0
    bad = bytearray(open(manifest.first()["uri"][7:], "rb").read())
    bad[20] ^= 0xFF
    (tmp_path / "bad.zst").write_bytes(bad)
    with pytest.raises(Exception):
        list(tokens.TokenFile(f"file://{tmp_path}/bad.zst"))


# 5 --------------------------------------------------------------------------------------------------------------------


def shingles(t):
    w = split_words(t)
    return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows, similarity=0.8):
    bags = [shingles(t) for _, t in rows]
    df = Counter(s for b in bags for s in b)
    n = len(rows)
    weigh = lambda s: 1 + math.log((1 + n) / (1 + df[s])) / math.log(2 + n)
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    at = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            at[s].append(i)
    for i, j in {p for group in at.values() for p in itertools.combinations(group, 2)}:
        a, b = bags[i], bags[j]
        low = sum(min(a[s], b[s]) * weigh(s) for s in a if s in b)
        high = sum(max(a[s], b[s]) * weigh(s) for s in set(a) | set(b))
        if low / high >= similarity:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)].append(rows[i][0])
    return Counter((rows[i][0], min(least[find(i)], default=None)) for i in range(n))


def test_classes_are_those_of_brute_force(spark):
    df = shared.table(spark, str(DATA / "sf0.01"), "documents")
    got = Counter((r["doc_id"], r["class_id"]) for r in neardup.classes(df).collect())
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_similarity_takes_exact_document_frequencies(spark):
    """Every counter holds about 16 shingles here. Of each pair one text has a passage of half the rows besides: exact similarity 0.816, 0.79 by counters."""
    rng = np.random.default_rng(9)
    passage = " ".join(f"c{k}" for k in range(72))
    rows = [(i, " ".join(f"r{x}" for x in rng.integers(0, 1 << 40, 5200)) + f" {passage}" * (i % 2)) for i in range(800)]
    for g in range(1000, 1012, 2):
        own = " ".join(f"g{g}o{k}" for k in range(204))
        rows += [(g, own), (g + 1, f"{own} {passage}")]
    weigh = lambda df: 1 + math.log((1 + len(rows)) / (1 + df)) / math.log(2 + len(rows))
    assert 0.81 < 200 * weigh(2) / (200 * weigh(2) + 68 * weigh(406) + 4 * weigh(1)) < 0.82
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 if i >= 1000 else i for i, _ in rows}


def test_a_chain_of_copies_and_its_block_comparison(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = list(rng.choice(vocabulary, 220))
    rows = []
    for i in range(60):  # each text differs from the one before by a few words, so far ends are unlike
        text = list(text)
        for at in rng.integers(0, 220, 2):
            text[at] = str(rng.choice(vocabulary))
        rows.append((i, " ".join(text)))
    rows += [(100 + i, rows[i % 3][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(neardup, "BLOCK", 8)
    got = Counter((r["doc_id"], r["class_id"]) for r in neardup.classes(df).collect())
    assert got == brute_classes(rows)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = Counter((r["doc_id"], r["class_id"]) for r in neardup.classes(odd).collect())
    assert got == brute_classes([(i, t) for i, t, *_ in ODD])
    kept = neardup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, 6, None, 7, 8])
    assert neardup.classes(none).count() == 0 and neardup.drop_duplicates(none).count() == 0


def test_rows_of_one_id_are_dropped_by_their_own_text(spark):
    rng = np.random.default_rng(12)
    one, two, three, four = (" ".join(f"{p}{x}" for x in rng.integers(0, 1 << 30, 200)) for p in "abcd")
    rows = [(5, one), (9, one + " end"), (9, two), (9, three), (9, three.upper()), (None, four), (None, four), (None, one), (7, "!"), (7, "?"), (7, "?"), (None, "!"), (None, "!")]
    kept = neardup.drop_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["doc_id"], three if r["text"] == three.upper() else r["text"]) for r in kept) == Counter([(5, one), (9, two), (9, three), (None, four), (7, "!"), (7, "?"), (None, "!"), (None, "!")])


def test_near_copies_without_an_id_are_linked(spark):
    rng = np.random.default_rng(21)
    base, lone = (" ".join(f"{p}{x}" for x in rng.integers(0, 1 << 30, 200)) for p in "ab")
    rows = [(7, base), (None, base + " end"), (None, lone), (None, lone + " more"), (None, base + " end"), (-3, "one two three")]
    got = Counter((r["doc_id"], r["class_id"]) for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == Counter([(7, 7), (None, 7), (None, 7), (None, None), (None, None), (-3, -3)]) == brute_classes(rows)
    kept = neardup.drop_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(kept) == 3 and {(r["doc_id"], r["text"]) for r in kept} < set(rows) and {r["doc_id"] for r in kept} == {7, None, -3}


def test_one_id_on_many_texts(spark):
    """A third of the rows has one doc_id; each is compared by its own text."""
    rng = np.random.default_rng(22)
    texts = [" ".join(f"t{i}x{x}" for x in rng.integers(0, 1 << 30, 60)) for i in range(60)]
    rows = [(5, t) for t in texts] + [(100 + i, t + " end") for i, t in enumerate(texts[:30])]
    got = Counter((r["doc_id"], r["class_id"]) for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), matches=0).collect())
    assert got == brute_classes(rows) == Counter({(5, 5): 60, **{(100 + i, 5): 1 for i in range(30)}})


def test_a_bucket_of_many_unlike_members(spark):
    """All share one band and nothing else: the comparison in blocks carries samples only, and no pair goes on to the tables."""
    n = 5000
    rng = np.random.default_rng(23)
    bands = rng.integers(-(1 << 62), 1 << 62, (n, neardup.BANDS))
    bands[:, 3] = 99
    weight = np.exp(rng.normal(5, 1.5, n))
    nodes = [i.to_bytes(25, "big") for i in range(n)]
    sig = spark.createDataFrame(pa.table({"node": nodes, **{f"b{k}": bands[:, k] for k in range(neardup.BANDS)}}))
    packed = [np.uint64(i).tobytes() + np.float32(w).tobytes() for i, w in enumerate(weight)]
    tables = spark.createDataFrame(pa.table({"node": nodes, "packed": packed, "weight": weight}))
    asked = []
    real, neardup._verify = neardup._verify, lambda pairs, *a: (asked.append(pairs.count()), real(pairs, *a))[1]
    try:
        found, comp = neardup.links(sig, lambda nodes: tables)
    finally:
        neardup._verify = real
    assert found.count() == 0 and comp.count() == 0 and sum(asked) == 0


@pytest.mark.parametrize("level_bits", [13, 2])
def test_frequencies_are_those_of_brute_force(spark, monkeypatch, level_bits):
    """In one shuffle, and in four that resolve two bits each."""
    docs = shared.table(spark, SF, "documents")
    want = Counter(s for (t,) in docs.select("text").collect() for s in neardup._tables(pa.array([t]), False)[1].tolist())
    for name, value in (("LEVEL_BITS", level_bits), ("COMBINED", 3000), ("FREQUENT", 64)):
        monkeypatch.setattr(neardup, name, value)
    f = neardup.frequencies(docs)
    got = {}
    for r in f.table.collect():
        keys, df = neardup._unpack(bytes(r["shingles"]), r["many"]), np.frombuffer(bytes(r["df"]), "<u4")
        assert (keys >> np.uint64(48 - f.bits) == r["part"]).all()
        got |= dict(zip(keys.tolist(), df.tolist(), strict=True))
    assert f.n == docs.count() and got == {k: n for k, n in want.items() if n > 1}
    least = max(1, sum(want.values()) // 64)
    assert dict(zip(f.shingles.tolist(), f.df.tolist(), strict=True)) == {k: n for k, n in want.items() if n > least}


def test_packed_shingles_come_back():
    rng = np.random.default_rng(24)
    for s in (np.empty(0, np.uint64), np.array([5], np.uint64), np.array([0, 1 << 47], np.uint64), np.unique(rng.integers(0, 1 << 43, 70_000, dtype=np.uint64))):
        packed = neardup._pack(s)
        assert neardup._unpack(packed, s.size).tolist() == s.tolist() and len(packed) <= 8 * s.size
    assert len(packed) == 4 * s.size + 4


def test_samples_of_long_texts_are_not_biased():
    """Several shingles of a text share a draw here."""
    rng = np.random.default_rng(25)
    seen, true = [], []
    for _ in range(8):
        s = np.unique(rng.integers(0, 1 << 48, 60_000, dtype=np.uint64))
        w = rng.choice([1.0, 1.5, 2.0], s.size)
        some = rng.permutation(s.size)
        a, b = np.sort(some[:-8_000]), np.sort(some[8_000:])
        row = np.concatenate([np.zeros(a.size), np.ones(b.size)]).astype(np.int64)
        lanes = neardup.samples(row, np.concatenate([s[a], s[b]]), np.concatenate([w[a], w[b]]), 2).view(np.uint16)
        seen.append((lanes[0] == lanes[1]).mean())
        true.append(w[some[8_000:-8_000]].sum() / w.sum())
    assert abs(np.mean(seen) - np.mean(true)) < 0.06


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    s = np.unique(rng.integers(0, 1 << 48, 900, dtype=np.uint64))
    w = rng.choice([1.0, 1.5, 2.0], s.size)
    a, b = np.arange(0, s.size - 100), np.arange(100, s.size)
    row = np.concatenate([np.zeros(a.size), np.ones(b.size)]).astype(np.int64)
    lanes = neardup.samples(row, np.concatenate([s[a], s[b]]), np.concatenate([w[a], w[b]]), 2).view(np.uint16)
    both = np.intersect1d(a, b)
    true = w[both].sum() / w.sum()
    assert abs((lanes[0] == lanes[1]).mean() - true) < 0.2


# 6 --------------------------------------------------------------------------------------------------------------------


def test_archives_of_odd_pages(spark, tmp_path):
    big = "ü" * 400_000
    rows = [(5, "http://a/", "same"), (3, None, "same"), (9, "http://b/ c\r\n", "same"), (4, "u", None), (2, "u", ""), (None, "u", "same"), (7, "u", big), (8, "u", big), (1, "u", "a\r\n\r\nWARC/1.1\r\n"), (3, None, "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    got = Counter(tuple(r) for r in warc.archive(df, f"file://{tmp_path}").collect())
    group = defaultdict(list)
    for i, _, h in rows:
        if i is not None:
            group[h or ""].append(i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(group[h or ""])
        kind = ("response", None) if i == first else ("revisit", first)
        want[(i, len(raw), warc.base32(hashlib.sha1(raw).digest()), *kind)] += 1
    assert got == want
    table = warc.read(spark.createDataFrame([(f"file://{p}",) for p in sorted(tmp_path.glob("*.gz"))], "uri string"))
    chunks = [r for r in table.where("page_id = 7").orderBy("chunk_no").collect()]
    assert len(chunks) == -(-len(big.encode()) // warc.CHUNK_BYTES) and b"".join(bytes(c["data"]) for c in chunks) == big.encode() and [c["last"] for c in chunks] == [False] * (len(chunks) - 1) + [True]
    done = b""
    for c in chunks:
        done += bytes(c["data"])
        assert c["payload_bytes"] == len(done) and c["payload_digest"] == warc.base32(hashlib.sha1(done).digest())
    assert warc.archive(df.limit(0)).count() == 0
    kinds = {r["page_id"]: r["record_type"] for r in warc.archive(df.where("page_id in (2, 4, 7, 8)"), min_bytes=1).collect()}
    assert kinds == {2: "response", 4: "response", 7: "response", 8: "revisit"}


# 7 --------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (budget - sum(full.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in open_}
        full |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return full


@pytest.mark.parametrize("levels", [mixing.LEVEL_BITS, (2, 3, 59)])
def test_mix_meets_its_targets(spark, levels):
    df = shared.table(spark, SF, "documents").withColumn("source", F.when(F.col("doc_id") % 9 != 0, F.col("source")))
    rows = mixing.allocation(df, level_bits=levels).collect()
    size, taken = defaultdict(int), defaultdict(int)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = brute_targets(size)
    assert all(math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["source_size"] == size[r["source"]] for r in rows)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.allocation(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_thresholds_are_nested(spark):
    df = shared.table(spark, SF, "documents")
    small = {r["doc_id"]: r["taken"] for r in mixing.allocation(df, share=0.4).collect()}
    large = {r["doc_id"]: r["taken"] for r in mixing.allocation(df, share=0.9).collect()}
    assert all(small[i] <= large[i] for i in small)


def test_rows_of_one_hash_share_in_proportion(spark):
    """One text under one id, many times: one hash, which no threshold parts."""
    rows = [(1, "five words are in here", "a")] * 10 + [(i, "one two", "b") for i in range(2, 30)]
    got = mixing.allocation(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(1,), share=0.5, cap=2.0).where("source = 'a'").collect()
    want = 0.5 * (50 + 56) / 2
    assert {r["target"] for r in got} == {want} and {r["taken"] for r in got} == {int(round(want) * 5 // 50)}


def test_mix_of_odd_rows(spark, odd, none):
    rows = mixing.allocation(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(odd).columns == odd.columns and mixing.allocation(none).count() == 0 and mixing.mix(none).count() == 0
    assert {r["doc_id"] for r in mixing.mix(odd).collect()} >= {3, 4}


# 8 --------------------------------------------------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    sf = str(DATA / "sf0.01")
    rows = queries.op8_quality(spark, sf).join(shared.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").collect()
    held = [(r["score"], r["quality"], r["predicted"]) for r in rows if r["held_out"]]
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.85 and all((s >= 0.3) == bool(p) for s, _, p in held)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(6)
    m = quality.Machine(0.3, rng.normal(size=quality.BUCKETS + quality.DENSE), rng.normal(size=(quality.BUCKETS + quality.DENSE, quality.FACTORS)) * 0.1, np.zeros(quality.DENSE), np.ones(quality.DENSE))
    bucket, value, dense = np.array([3, 77, 4000]), np.array([0.5, 0.2, 0.9]), rng.normal(size=(1, quality.DENSE))
    x = np.zeros(quality.BUCKETS + quality.DENSE)
    x[bucket], x[quality.BUCKETS:] = value, dense[0]
    at = np.flatnonzero(x)
    z = m.bias + m.linear @ x + sum(m.factor[i] @ m.factor[j] * x[i] * x[j] for i, j in itertools.combinations(at, 2))
    assert math.isclose(m.score(np.zeros(3, np.int64), bucket, value, dense)[0], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_labels_of_a_repeated_id_take_one_row_each(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {i % 7}", 10) for i in range(300)] + [(i, "other words here " * i, 5) for i in range(2, 12)], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(1, 1)], "doc_id bigint, quality int")
    sizes, real = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, dense, y, **k: (sizes.append(len(rows)), real(rows, dense, y, **k))[1])
    quality.train(docs, labels, hold_out=False)
    assert sizes == [11]


def test_features_are_those_of_brute_force():
    texts = ["Some words here. Some MORE words!!\n12 34 <b>|x|</b>", "", None, "x" * 70, "été — naïve 日本 words words", "a, b.. c.\n\n\tword word word"]
    stated = [None, 5, 0, 70, 3, None]
    row, bucket, value, dense = quality.features(pa.array(texts), pa.array(stated, pa.float64()))
    for i, t in enumerate(texts):
        raw, ws = (t or "").encode(), split_words(t)
        times = Counter(int(words.batch_words(pa.array([w]))[0][0] >> np.uint64(50)) for w in ws)
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in times.values())) or 1
        assert {int(k): round(float(v), 9) for k, v in zip(bucket[row == i], value[row == i], strict=True)} == {k: round(math.log1p(n) / norm, 9) for k, n in times.items()}
        size, count, lines, chars = len(raw), len(ws), raw.count(b"\n") + 1, len(t or "")
        share = lambda test: sum(map(test, raw)) / max(size, 1)
        punct = lambda c: 32 < c < 127 and not chr(c).isalnum()
        said = chars if stated[i] is None else stated[i]
        want = [
            math.log1p(size), math.log1p(count), size / max(count, 1) / 10, math.log1p(lines), math.log1p(size / lines), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(punct),
            sum(a == b and punct(b) for a, b in itertools.pairwise(raw)) / max(size, 1), share(lambda c: c >= 128), share(lambda c: c in (32, 9)), len(times) / max(count, 1), max(times.values(), default=0) / max(count, 1),
            sum(a == b for a, b in itertools.pairwise(ws)) / max(count, 1), share(lambda c: c in (124, 60)), share(lambda c: c in (46, 44)), math.log1p(said), float(said != chars),
        ]
        assert np.allclose(dense[i], want), i


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, None, 0), (8, 0, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(odd, quality.train(odd, labels, hold_out=False)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    nothing = quality.train(none, labels)
    assert {round(r["score"], 6) for r in quality.score(odd.drop("n_chars"), nothing).collect()} == {0.5} and quality.score(none, nothing).count() == 0


# 9 --------------------------------------------------------------------------------------------------------------------


def test_lines_of_recurring_templates_go(spark):
    rows = [(i, f"User {i} logged in from 10.0.0.{i} today\nonly here {'abcdefgh'[i]} words of its own\nsame old line", "keep me", i) for i in range(8)]
    got = linededup.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string, note string, n_lines int")).collect()
    assert {r["text"] for r in got} == {f"only here {'abcdefgh'[i]} words of its own" for i in range(8)}
    assert all(r["n_lines"] == 3 and r["note"] == "keep me" for r in got)
    few = linededup.drop_recurring(spark.createDataFrame(rows[:3], "doc_id bigint, text string, note string, n_lines int")).collect()
    assert all(r["n_dropped"] == 0 for r in few)


def test_a_leaf_holds_several_templates(spark):
    """Planted templates share token count and leading tokens; each is told from unlike lines of the same leaf, which stay."""
    fields = lambda i: f"f{i}x{i * 7919 % 1000}"
    planted = {
        "even": [[f"User login event {fields(i)} accepted by the main gateway" for i in range(8)], [f"User login event {fields(i)} refused after three bad passwords" for i in range(8)]],
        "skewed": [
            [f"{i} {i} {i} disk is nearly full on the host named {fields(i)} right now" for i in range(12)], [f"{i} {i} {i} backup of one volume was done by us in {fields(i)} whole seconds" for i in range(6)],
            [f"{i} {i} {i} cannot reach our peer at its usual open port {fields(i)} again today" for i in range(5)],
        ],
        "many": [[f"At time {i} " + " ".join(f"{a}{k}" for k in "klmnop") + f" value {fields(i)}" for i in range(6)] for a in "abcdefg"],
    }
    for name, templates in planted.items():
        lone = [f"{templates[0][0].split()[0]} {templates[0][0].split()[1]} {templates[0][0].split()[2]} " + " ".join(f"z{i}y{k}" for k in range(len(templates[0][0].split()) - 3)) for i in range(4)]
        lines = [x for t in templates for x in t] + lone
        rows = [(None if i % 2 else i, x) for i, x in enumerate(lines)]
        got = linededup.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert sorted(r["text"] for r in got) == sorted([""] * (len(lines) - 4) + lone), name


def test_passages_and_rows_without_an_id(spark):
    passage = " ".join(f"word{'abcdefghij'[k % 10]}{k}" for k in range(60))
    short = " ".join(passage.split()[:50])
    rows = [(1, f"alone\n{passage}"), (2, passage), (3, short), (4, short), (5, passage + " more"), (6, "twice\ntwice"), (6, "twice"), *[(None, "the same old line")] * 5, *[(9, "one document's line")] * 6]
    got = Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in linededup.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == Counter([(1, "alone", 1), (2, "", 1), (3, short, 0), (4, short, 0), (5, passage + " more", 0), (6, "twice\ntwice", 0), (6, "twice", 0), *[(None, "", 1)] * 5, *[(9, "one document's line", 0)] * 6])


def test_a_long_text_with_many_dropped_lines(spark):
    lines = [f"line of {chr(97 + k % 26)}{k}" for k in range(3000)]
    rows = [(i, "\n".join(lines + [f"own{i} " + "abcdef"[i] * 3])) for i in range(5)]
    got = linededup.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["text"] for r in got) == sorted(f"own{i} " + "abcdef"[i] * 3 for i in range(5)) and {(r["n_lines"], r["n_dropped"]) for r in got} == {(3001, 3000)}


def test_lines_of_odd_rows(spark, odd, none):
    got = linededup.drop_recurring(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"] and sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t, *_ in ODD)
    assert linededup.drop_recurring(none).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 10 -------------------------------------------------------------------------------------------------------------------


def brute_hits(text, windows):
    w = split_words(text)
    hit, items = [False] * len(w), set()
    for p in range(len(w)):
        for n in {n for n, _ in windows}:
            found = windows.get((n, tuple(w[p:p + n])))
            if found and p + n <= len(w):
                items |= found
                hit[p:p + n] = [True] * n
    return len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)


def test_contamination_of_odd_rows(spark, odd, none):
    items = [(1, "quick brown FOX jumps over the lazy dog again and again"), (2, "second line"), (3, None), (4, ""), (5, "word " * 30), (6, "wörds"), (1, "nowhere to be found at all in any of these texts here"), (None, "without an id")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = split_words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[(n, tuple(w[p:p + n]))].add("null" if i is None else str(i))
    want = Counter((i, *brute_hits(t, windows)) for i, t, *_ in ODD)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = decontam.find_matches(odd, bench)
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == want
    assert Counter(tuple(r) for r in decontam.find_matches(odd, bench, block_bytes=20).select(*columns).collect()) == want  # block by block
    one = found.where("doc_id = 7").first()
    assert one["longest_match"] == 30 and all(m["item_id"] == "5" for m in one["matches"])
    clean = decontam.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter(k[0] for k in want.elements() if not k[-1])
    assert decontam.find_matches(none, bench).count() == 0 and decontam.find_matches(odd, bench.limit(0)).where("contaminated").count() == 0


def test_an_item_without_an_id_is_no_item_named_null(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "one two three"), ("null", "ten eleven"), ("a", "nine ten"), ("a", "one two"), ("a", "one two")], "item_id string, text string")
    r = decontam.find_matches(docs, bench).first()
    assert (r["n_items"], r["n_hit"], r["items_sha256"]) == (3, 6, hashlib.sha256(b"a,null,null").hexdigest())
    assert sorted(m["item_id"] for m in r["matches"]) == ["a", "a", "null", "null"]


def test_suffix_array_is_sorted():
    seq = np.random.default_rng(8).integers(1, 4, 500).astype(np.uint64)
    order = decontam.suffix_array(seq, 10)
    suffix = [tuple(seq[i:i + 10].tolist()) for i in order]
    assert suffix == sorted(suffix) and sorted(order.tolist()) == list(range(500))


@pytest.mark.parametrize("row", [(None, None, None, None, None), (1, "a", "en", "a", 1)])
def test_tables_of_one_row(spark, row):
    docs = spark.createDataFrame([row], DOCS)
    labels, bench = spark.createDataFrame([(row[0], 1)], "doc_id bigint, quality int"), spark.createDataFrame([(1, "a"), (2, None)], "item_id int, text string")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    net = langid.train(docs, hold_out=False, steps=2)
    made = [
        langid.predict(docs, net), neardup.classes(docs), neardup.drop_duplicates(docs), linededup.drop_recurring(docs), mixing.allocation(docs), mixing.mix(docs).distinct(), quality.score(docs, quality.train(docs, labels, hold_out=False)),
        decontam.find_matches(docs, bench), tokens.encode_documents(docs, queries.tokenizer_path()), warc.archive(pages), urls.judge(pages),
    ]
    assert [len(x.collect()) for x in made] == [1] * len(made)


# pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as P

    docs = shared.table(spark, SF, "documents")
    by_name = dict(P.STAGES)
    assert list(by_name) == ["language", "near_dedup", "decontaminate", "mix", "tokens"]
    known = shared.materialise(by_name["language"](spark, docs, SF), "t1")
    letters = lambda t: bool(t and re.search(r"[^\W\d_]", t))
    assert known.columns == docs.columns and sorted(r["doc_id"] for r in known.collect()) == sorted(r["doc_id"] for r in docs.collect() if letters(r["text"]))
    single = shared.materialise(by_name["near_dedup"](spark, known, SF), "t2")
    classes = brute_classes([(r["doc_id"], r["text"]) for r in known.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c in classes})
    clean = shared.materialise(by_name["decontaminate"](spark, single, SF), "t3")
    windows = defaultdict(set)
    for r in shared.table(spark, SF, "benchmark").collect():
        w = split_words(r["text"])
        for p in range(max(len(w) - 9, 1)):
            windows[(min(10, len(w)), tuple(w[p:p + 10]))].add(str(r["item_id"]))
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in single.collect() if not brute_hits(r["text"], windows)[-1])
    mixed = shared.materialise(by_name["mix"](spark, clean, SF), "t4")
    times = Counter(r["doc_id"] for r in mixed.collect())
    plan = {r["doc_id"]: r for r in mixing.allocation(clean).collect()}
    assert mixed.columns == docs.columns and all(abs(times[i] * r["size"] - r["taken"]) <= r["size"] / 2 for i, r in plan.items())
    out = by_name["tokens"](spark, mixed, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and Counter(r["doc_id"] for r in out.collect()) == times
    assert isinstance(docs.schema, T.StructType)


def test_pipeline_runs(spark):
    import corpus_pipeline as P

    assert P.run(spark, SF).count() > 0
