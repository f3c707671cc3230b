"""Operators against plain versions of themselves, libraries, exact round trips and held-out labels."""

import base64
import cProfile
import hashlib
import itertools
import pstats
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annulus.llm import bpe, components, decontaminate, langid, licenses, line_dedup, media, minhash, queries, storage, textblocks, toxicity, webp
from annulus.llm.queries import word_vocabulary

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choices(vocabulary, k=rng.randrange(3, 120)) for _ in range(8)]
    out = []
    for d in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((d * 3 + 1, rng.choice((" ", "\n", "\t ")).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_equal_brute_force(spark, seed):
    docs = near_copies(seed)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("seed, block", [(3, 1), (4, 6)])
def test_hot_groups_equal_brute_force(spark, monkeypatch, seed, block):
    """Blocks so small that buckets and groups take several: pivots, core and rest."""
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", block)
    monkeypatch.setattr(minhash, "SET_BLOCK", 150)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    store = storage.Store(spark, "hot")
    got = minhash.near_duplicates(df, store=store).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)
    assert spark.read.parquet(store.path("star-links")).count() > 0


def test_near_duplicates_of_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = minhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_of_a_long_chain(spark, monkeypatch, few):
    """Dealt out, and in one task."""
    monkeypatch.setattr(components, "FEW", few)
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.label for r in components.connected_components(edges, storage.Store(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def brute_lines(docs):
    def near(x, y):
        if x == y or max(len(x), len(y)) < 8 or abs(len(x) - len(y)) > 1:
            return x == y
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) == 1
        x, y = sorted((x, y), key=len)
        return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    seen, out = [], {}
    for d, t in sorted(docs):
        kept = []
        for line in t.split("\n"):
            w = words(line)
            if not w or not any(near(w, x) for x in seen):
                kept.append(line)
            if w:
                seen.append(w)
        out[d] = "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 14))) for _ in range(25)]
    docs = []
    for d in range(40):
        own = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(lines).split()
            kind = rng.randrange(5)
            if kind == 0:
                w[rng.randrange(len(w))] = "zz"
            elif kind == 1:
                w.insert(rng.randrange(len(w) + 1), "yy")
            elif kind == 2 and len(w) > 1:
                del w[rng.randrange(len(w))]
            own.append(" ".join(w))
        docs.append((d, "\n".join(own)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


@pytest.mark.parametrize("least", [2, 8])
def test_short_lines_are_compared_from_min_words_on(spark, least):
    docs = [(1, "alpha beta gamma"), (2, "alpha beta delta"), (3, "a b c d e f g h"), (4, "a b c d e f g i"), (5, "one two"), (6, "one")]
    got = {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=least).collect()}
    assert got == {1: 1, 2: int(least == 8), 3: 1, 4: 0, 5: 1, 6: int(least == 8)}


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_keys_tell_thue_morse_sequences_apart(spark):
    """Polynomials modulo a power of two agree on them, whatever the base."""
    lines = [" ".join(("foo", "bar")[b ^ flip] for b in thue_morse(512)) for flip in (0, 1)]
    words = ["".join("ab"[b ^ flip] for b in thue_morse(2048)) for flip in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(lines + words)), "doc_id long, text string")
    assert [r.n_kept for r in line_dedup.dedup_lines(docs).collect()] == [1, 1, 1, 1]


def test_field_keys_equal_plain_polynomials():
    rng = np.random.default_rng(2)
    p = line_dedup.PRIME
    a, b = (np.append(rng.integers(0, p, 500, dtype=np.uint64), [0, p - 1, p - 1]).astype(np.uint64) for _ in range(2))
    assert [int(x) for x in line_dedup.times(a, b)] == [int(x) * int(y) % p for x, y in zip(a, b)]
    words = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    begin = np.array([0, 3, 3, 11, 60])
    values = [sum(int(w) % p * pow(line_dedup._BASES[0], j, p) for j, w in enumerate(words[x:y])) % p for x, y in zip(begin, begin[1:])]
    assert (line_dedup._keys(words, begin) == line_dedup._key(np.array(values, np.uint64), np.diff(begin))).all()
    without = [np.delete(words[x:y], j) for x, y in zip(begin, begin[1:]) for j in range(y - x)]
    assert line_dedup.deletion_keys(words, begin).tolist() == [line_dedup.line_key(w) for w in without]


def test_words_of_long_texts_equal_those_of_short_ones():
    """Texts over one block, words over one block, and sums over several pieces."""
    rng = random.Random(8)
    pieces = ["x" * 300_000, "y" * 1_500_000, "Z" * 47, "z" * 48, "z" * 49] + ["".join(rng.choices("abcdé", k=rng.randrange(1, 60))) for _ in range(60_000)]
    rng.shuffle(pieces)
    long = "\n ".join(pieces)
    assert len(long.encode()) > 3 * textblocks.BLOCK_BYTES
    got = [h for _, h, _ in textblocks.word_blocks(pa.array([long]))][0]
    want = np.concatenate([h for _, h, _ in textblocks.word_blocks(pa.array(pieces))])
    assert (got == want).all() and len(set(map(int, got))) == len({p.lower() for p in pieces})


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(word_vocabulary()), bpe.WordBpe(open(word_vocabulary(), "rb").read())
    rng = random.Random(6)
    letters = "abcXYZ éÉñß'\"!.,12  \t\n\x1c\x85 ΑΣσİﬁ日本👍́<|>"
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 80))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|startoftext|> B<|ENDOFTEXT|>", "x" * 3000, "don't it'S", ""]
    for t in texts:
        want = library.encode(t, add_special_tokens=False)
        ids, decoded = own.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids, t
        assert decoded == library.decode(want.ids, skip_special_tokens=False)
    for n in (2, 50, bpe.SHORT + 40):
        parts = [own.inner[b] for b in rng.choices(range(97, 123), k=n)]
        assert own._scan(list(parts)) == own._heap(list(parts))


def image(rng, n, colours=1 << 32):
    return rng.integers(0, colours, n, dtype=np.uint64).astype(np.uint32)


def test_webp_round_trips():
    rng = np.random.default_rng(1)
    w, h = 45, 33
    pixels = image(rng, w * h)
    modes, factors = rng.integers(0, 14, 12 * 9), image(rng, 12 * 9)
    few = rng.choice(image(rng, 20), w * h)
    few[600:1000] = few[100:500]
    few[1100:1400] = few[1099]
    copies = [(600, 400, 500), (1100, 300, 1)]
    cases = [(pixels, webp.Options())]
    cases += [(pixels, webp.Options(modes=np.full(12 * 9, m), block=2)) for m in range(14)]
    cases += [(pixels, webp.Options(modes=modes, factors=factors, subtract_green=True, block=2, cache_bits=4))]
    cases += [(rng.choice(image(rng, k), w * h), webp.Options(palette=True)) for k in (1, 2, 3, 5, 16, 17, 200)]
    cases += [(few, webp.Options(cache_bits=6)), (few, webp.Options(copies=copies)), (few, webp.Options(copies=copies, cache_bits=3))]
    groups = rng.integers(0, 5, 12 * 9)
    groups[:5] = range(5)
    cases += [(p, webp.Options(groups=groups, copies=c, cache_bits=b)) for p, c, b in ((pixels, [], 0), (few, copies, 0), (few, copies, 5), (few, [], 2))]
    cases += [(pixels, webp.Options(groups=np.arange(2 * 2), group_bits=5, modes=modes, block=2, subtract_green=True))]
    for p, options in cases:
        data = webp.encode(w, h, p, options)
        got = webp.decode(data)
        assert got[:2] == (w, h) and (got[2] == p).all()
        with pytest.raises(webp.WebpError):
            webp.decode(data[: len(data) // 2])


#: Alpha planes that another encoder compressed as lossless image streams: of a 16 by 16 icon, and of one pixel (a whole file).
ICON_ALPHA = (
    "J6KokSTleucYX+ffKpmImP90cY3gJjDi4Yt3MsjBEVyDKzDosHgVjnhRNcEIDAJPkqBqsFUZHNa2bUYvTsZ2PLbtd/uvKa4hov9J0f2PkPe6REkkGzolkTTzFG0Ox9PlFiD0CxS+kOGDtxoynjaCfx0pfk52CPuInrOR75lz"
    "Rugygtv4zEiy90UwfSD9NheMITJWLaXWayO8XeOlWRXVnIGk2W6WdYoYMQ+KqixQNPowgt+6a1BSKbUtz+lUFAoBAAA="
)
ICON_ROWS = {
    0: [0, 0, 0, 0, 175, 237, 255, 255, 255, 247, 146, 11, 3, 0, 0, 0],
    4: [189, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255, 72, 255, 247, 130, 10],
    11: [8, 33, 60, 53, 255, 255, 255, 170, 169, 169, 169, 169, 169, 121, 65, 32],
    15: [0, 0, 0, 0, 8, 29, 53, 66, 71, 69, 56, 31, 8, 0, 0, 0],
}
ONE_PIXEL = "UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="


def test_webp_of_another_encoder():
    assert [x.tolist() if hasattr(x, "tolist") else x for x in webp.decode(base64.b64decode(ONE_PIXEL))] == [1, 1, [0]]
    alpha = ((webp.decode_stream(webp.BitReader(base64.b64decode(ICON_ALPHA)), 16, 16) >> 8) & 255).reshape(16, 16)
    for y, row in ICON_ROWS.items():
        assert alpha[y].tolist() == row


def test_media_of_short_texts_takes_few_calls():
    """The calls of a text of usual length, which are most of its time, and files as they were when these were over twice as many."""
    rng = random.Random(5)
    signs = "etaoin shrdlu.cmfwyp,vbgkjqxzETAOIN0123456789\n"
    usual = "".join(rng.choices(signs, weights=range(46, 0, -1), k=3000))
    skewed = "".join(rng.choices(signs[:26], weights=[2**k for k in range(26)], k=200_000))  # codes of up to 15 bits, several windows
    files = {}
    for name, text in (("usual", usual), ("skewed", skewed)):
        payload = media.padded(text.encode())
        files[name] = media.to_media(payload)
        assert b"".join(((p >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes() for p in media.from_media(files[name])) == payload
    assert {k: hashlib.sha256(f).hexdigest()[:16] for k, f in files.items()} == {"usual": "f4b7be3d5415d50b", "skewed": "4ebd23d3f28e5c3f"}
    for function, given, most in ((media.to_media, media.padded(usual.encode()), 800), (media.from_media, files["usual"], 1000)):
        profile = cProfile.Profile()
        profile.runcall(function, given)
        assert pstats.Stats(profile).total_calls < most


def test_media_query_round_trips_whole_texts(spark, tmp_path):
    """Repeated lines, few bytes, equal rows, several images and empty texts; against the contract's columns worked out plainly."""
    rng = random.Random(9)
    line = lambda: "".join(rng.choices("abcdefghij klmnopqé", k=rng.randrange(40, 200)))
    lines = [line() for _ in range(30)]
    texts = [None, "", "a", "x" * 5000, "ab" * 4000, "".join(rng.choices("01", k=700)), "\n".join(rng.choices(lines, k=200)), "\n".join(lines * 40), ("r" * 191 + "\n") * 50]
    texts += ["\n".join(line() for _ in range(31_000)), texts[6]]
    assert max(len((t or "").encode()) for t in texts) > media.ROW * webp.MOST_SIDE
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_webp_media(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])), k
    assert got[6].media_sha256 == got[10].media_sha256 and got[6].feature == got[10].feature
    assert got[6].media_bytes < len(texts[6]) / 4 and got[7].media_bytes < len(texts[7]) / 8  # back-references
    assert len(media.from_media(media.to_media(media.padded(texts[9].encode())))) == 2


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"), 1000)
    got = toxicity.grade_toxicity(docs.where("doc_id % 3 = 0"), labels, model).join(labels.select("doc_id", F.col("toxic").alias("is")), "doc_id")
    share = {r["is"]: r.x for r in got.groupBy("is").agg(F.avg(F.col("toxic").cast("int")).alias("x")).collect()}
    assert share[1] > 0.85 and share[0] < 0.03  # some 100 toxic documents to learn from and 50 to tell
    assert (np.diff(model.cuts) > 0).all()


def test_ordinal_likelihood_and_gradient_equal_plain_versions():
    """Against probabilities written out grade by grade, and differences of the likelihood."""
    rng = np.random.default_rng(3)
    n, m = 40, 6
    x = rng.random((n, m)) < 0.4
    rows, cols = np.nonzero(x)
    grade, weight = rng.integers(0, toxicity.GRADES, n), rng.random(n)
    w, raw = rng.normal(0, 1, m), rng.normal(0, 1, toxicity.GRADES - 1)

    def loss(w, raw):
        cuts = [raw[0]]
        for r in raw[1:]:
            cuts.append(cuts[-1] + np.log(1 + np.exp(r)))
        total = 0.0
        for i in range(n):
            score = sum(w[j] for j in range(m) if x[i, j])
            upto = lambda k: 0.0 if k < 0 else 1.0 if k == toxicity.GRADES - 1 else 1 / (1 + np.exp(score - cuts[k]))  # noqa: B023, E731
            total -= weight[i] * np.log(upto(grade[i]) - upto(grade[i] - 1))
        return total

    value, g_w, g_raw = toxicity.likelihood(w, raw, rows, cols, grade, weight)
    assert value == pytest.approx(loss(w, raw))
    for at in range(m):
        step = np.eye(m)[at] * 1e-6
        assert g_w[at] == pytest.approx((loss(w + step, raw) - loss(w - step, raw)) / 2e-6, abs=1e-5)
    for at in range(toxicity.GRADES - 1):
        step = np.eye(toxicity.GRADES - 1)[at] * 1e-6
        assert g_raw[at] == pytest.approx((loss(w, raw + step) - loss(w, raw - step)) / 2e-6, abs=1e-5)


def test_features_chosen_by_spark_give_the_same_model(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=30) + ["vile", "awful"][: rng.randrange(3)] * (i % 3 == 0))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    plain = toxicity.fit([toxicity.text_features(t) for _, t in rows], np.array([i % 3 == 0 for i, _ in rows]))
    assert len(plain.ids) and (model.ids == plain.ids).all() and np.allclose(model.weights, plain.weights) and np.allclose(model.cuts, plain.cuts)


def test_weights_are_shared_and_severity_is_the_mean_grade():
    model = toxicity.OrdinalModel(np.array([3]), np.array([2.0]), np.array([0.0, 1.0, 3.0]))
    p = model.grades(np.array([0.0, 2.0]))
    at = lambda cut, score: 1 / (1 + np.exp(-(cut - score)))
    for k, score in enumerate((0.0, 2.0)):
        below = [0, *(at(c, score) for c in (0.0, 1.0, 3.0)), 1]
        assert p[k] == pytest.approx(np.diff(below))
    assert (p @ np.arange(4))[1] > (p @ np.arange(4))[0]


def test_toxicity_takes_twice_as_many_others(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda ids, toxic, picked: taken.append(toxic))
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    for others in (50, 15):
        toxicity.train(docs, spark.range(10 + others).selectExpr("id AS doc_id", "int(id < 10) AS toxic"), rows=8)
    assert [(t.sum(), (~t).sum()) for t in taken] == [(8, 16), (8, 15)]


def test_leaks_equal_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    plain = lambda t: "".join(map(chr, decontaminate.normal(t)))
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = {d for d, t in texts.items() if any(plain(x) in t for _, x in items)}
    got = {r.doc_id for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).where("size(passages) > 0").collect()}
    assert want and want == got


def test_band_alignment_equals_full_table():
    rng = random.Random(8)
    for _ in range(40):
        p = rng.choices(range(3), k=rng.randrange(3, 12))
        width = rng.randrange(1, 6)
        region = rng.choices(range(3), k=len(p) + width - 1)
        best, _ = decontaminate.band_alignment(np.array([p], np.uint32), np.array([len(p)]), np.array([region], np.uint32))
        row = {k: 0 for k in range(width)}
        for i, c in enumerate(p):
            new = {}
            for k in range(width):
                new[k] = min(row[k] + (region[i + k] != c), row[k + 1] + 1 if k + 1 < width else 99, new[k - 1] + 1 if k else 99)
            row = new
        assert best[0] == min(row.values())


def test_edited_passages_are_found():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefghijk", k=rng.randrange(2, 8))) for _ in range(40))
    index = decontaminate.indexes([(5, text)])[0]
    for _ in range(20):
        edited = list(text)
        for _ in range(len(text) // 40):
            edited[rng.randrange(len(edited))] = "z"
        assert any(f[0] == 5 for f in index.find(decontaminate.normal("some words before " + "".join(edited) + " and after")))
    assert not index.find(decontaminate.normal(text[::-1]))


@pytest.mark.parametrize("size", [75, 100, 121, 200, 333])
def test_partial_passages_are_found_at_every_offset(size):
    rng = random.Random(size)
    words = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(n))[:size].strip()
    item, other = words("abcdefghijk", 90), words("lmnopqrst", 90)
    index = decontaminate.indexes([(5, item)])[0]
    for n in {min(n, len(item)) for n in (decontaminate.SHORT + decontaminate.STRIDE - 1, 90, 130)}:
        for lo in range(len(item) - n + 1):
            text = decontaminate.normal(f"{other} {item[lo : lo + n]} {other}")
            assert index.find(text), (lo, n)
    # a whole item gives its long windows alone
    assert {f[2] - f[1] for f in index.find(decontaminate.normal(f"{other} {item} {other}"))} == {min(len(item), decontaminate.WINDOW)}
    assert not index.find(decontaminate.normal(other + " " + item[::-1]))


def test_short_items_are_found_with_the_edits_of_their_length():
    rng = random.Random(1)
    for n in [*range(1, 60)] * 2:
        item = "".join(rng.choices("abcdefghij", k=n))
        edited = list(item)
        for _ in range(int(decontaminate.EDIT_RATE * n)):
            i = rng.randrange(len(edited))
            edited[i : i + 1] = rng.choice(([], ["u"], [edited[i], "v"]))
        find = lambda text: [f for x in decontaminate.indexes([(5, item)]) for f in x.find(decontaminate.normal(text))]  # noqa: B023, E731
        assert find(f"xxx yyy {''.join(edited)} zzz www"), item
        assert not find("xxx yyy zzz www")
        if n < decontaminate.Q:
            assert not find(f"xxx{item}zzz") and find(item)


def test_blocks_of_items_do_not_change_the_result(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(6).collect()]
    rows = [(5, texts[0]), (5, "clean text of nothing"), (None, texts[1]), (None, None), (7, texts[2] + " " + texts[0]), (8, "the answer 42 is"), (8, "142 is"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(texts), (77, "42"), (None, "is"), (78, None), (79, "...")], "item_id long, text string")
    found = [sorted(map(str, decontaminate.find_leaks(docs, items, block_chars=n).collect())) for n in (1 << 20, 300, 100)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    for n in (1 << 20, 300):
        left = decontaminate.drop_leaked(docs, items, block_chars=n).collect()
        assert sorted(map(str, left)) == sorted(map(str, [r for r in docs.collect() if r.text in ("clean text of nothing", None, "142 is", "")]))


def test_licenses():
    scanner = licenses.Scanner()
    mit = licenses.TEMPLATES["MIT"][1]
    changed = mit.replace("free of charge", "at no charge").replace("deal in", "deal with")
    for filler in ("", "the software of the license " * 50):
        found = scanner.scan(filler + changed + " end. " + filler)
        assert [f[0] for f in found] == ["MIT"] and 0.9 < found[0][1] < 1
        assert scanner.scan(filler + licenses.TEMPLATES["MIT"][2] + filler)[0][:2] == ("MIT", 1.0)
    assert scanner.scan("the license of the work is under this version") == [] and scanner.scan(None) == []
    assert licenses.patience("a b c d e".split(), "a x c d y e".split()) == [(0, 0), (2, 2), (3, 3), (4, 5)]
    assert licenses.increasing([(0, 3), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]


def plain_patience(a, b):
    """The numbers of matches that a patience alignment may have (by the choice among longest chains), from the definition."""
    if not a or not b:
        return {0}
    if a[0] == b[0]:
        return {1 + n for n in plain_patience(a[1:], b[1:])}
    if a[-1] == b[-1]:
        return {1 + n for n in plain_patience(a[:-1], b[:-1])}
    unique = sorted((a.index(w), b.index(w)) for w in b if a.count(w) == b.count(w) == 1)
    if not unique:
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return {row[-1]}
    chains = [c for n in range(len(unique), 0, -1) for c in itertools.combinations(unique, n) if all(p[1] < q[1] for p, q in zip(c, c[1:]))]
    results = set()
    for chain in (c for c in chains if len(c) == len(chains[0])):
        edges, sums = [(-1, -1), *chain, (len(a), len(b))], {len(chain)}
        for (x, y), (u, v) in zip(edges, edges[1:]):
            sums = {s + n for s in sums for n in plain_patience(a[x + 1 : u], b[y + 1 : v])}
        results |= sums
    return results


def test_patience_equals_a_plain_version():
    rng = random.Random(5)
    for _ in range(400):
        letters = "abcdefghijklmnop"[: rng.randrange(2, 16)]
        a, b = (rng.choices(letters, k=rng.randrange(1, 13)) for _ in range(2))
        found = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(i < u and j < v for (i, j), (u, v) in zip(found, found[1:]))
        assert len(found) in plain_patience(a, b), (a, b)


@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "GPL-3.0", "Zlib"])
def test_whole_license_texts_are_covered(name):
    text = licenses.TEMPLATES[name][-1]
    n = len(licenses.words_of(text))
    body = "code comes before " * 40 + text.replace("software", "program", 1) + " and code behind " * 40
    scanner = licenses.Scanner({name: [text]})
    found = scanner.scan(body)
    assert found[0][0] == name and 1 - 3 / n <= found[0][1] <= 1 and found[0][2] == 120
    words = body.split()
    assert not scanner.scan(" ".join(words[: 120 + n // 2]))  # half of it is not it


@pytest.mark.parametrize("name", ["MIT", "GPL-3.0"])
def test_licenses_in_adjacent_copies(name):
    """Where a notice stands several times no word of it is unique."""
    notice, other = licenses.TEMPLATES[name][1], "before and after stands the text of another author " * 6
    n, before = len(licenses.words_of(notice)), len(licenses.words_of(other))
    for copies in (1, 2, 5):
        for between in ("", "and again "):
            found = licenses.Scanner().scan(other + (notice + " " + between) * copies + other)
            assert [f for f in found if f[0] == name] == [(name, 1.0, before, before + n)]


@pytest.mark.parametrize("cells", [1, 20, 1 << 20])
def test_gaps_without_anchors_equal_full_table(monkeypatch, cells):
    monkeypatch.setattr(licenses, "TABLE_CELLS", cells)
    rng = random.Random(4)
    for _ in range(100):
        a, b = (rng.choices("abcde", k=rng.randrange(25)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        found = licenses._common(*licenses._numbered(a, b))
        assert len(found) == row[-1] and all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Clean documents stay, planted ones go; the later stages are held against plain versions on the rows before them."""
    rng = random.Random(12)
    syllables = "ka lo mi ne tu ra so vi pe du".split()
    sentence = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(n))
    docs = [(i, "\n".join(sentence(20) for _ in range(3)), "en", "s", 0) for i in range(120)]
    toxic = [(200 + i, sentence(20) + " idiot moron scum " + sentence(10), "en", "s", 0) for i in range(40)]
    item = sentence(30)
    leaked = [(300 + i, sentence(15) + " " + item + " " + sentence(15), "en", "s", 0) for i in range(3)]
    near = []
    for i in range(5):
        w = docs[i][1].replace("\n", " ").split()
        near += [(400 + i, " ".join(w), "en", "s", 0), (410 + i, " ".join([*w[:-3], "x", "y", "z"]), "en", "s", 0)]
    lines = [(500 + i, docs[10 + i][1].split("\n")[0] + "\n" + sentence(12), "en", "s", 0) for i in range(4)]
    every = docs + toxic + leaked + near + lines
    spark.createDataFrame(every, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d[0], 1, 0) for d in docs[:100]] + [(d[0], 0, 1) for d in toxic[:30]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {t[0] for t in toxic} and not ids & {x[0] for x in leaked}
    assert {d[0] for d in docs} <= ids and {x[0] for x in lines} <= ids
    # plain versions of the stages behind the model
    left = [(d, t) for d, t, *_ in every if d < 200 or d >= 300]
    plain = {d: t for d, t in brute_lines(left).items() if words(t)}
    kept = {d for d, (_, c) in brute_components(list(plain.items())).items() if d == c}
    kept = {d for d in kept if "".join(map(chr, decontaminate.normal(item))) not in "".join(map(chr, decontaminate.normal(plain[d])))}
    assert ids == kept
    own = bpe.WordBpe(open(word_vocabulary(), "rb").read())
    assert all(bytes(r.ids) == own.encode(plain[r.doc_id])[0] for r in got)
