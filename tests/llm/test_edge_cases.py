"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annulus.llm import bpe, decontaminate, langid, licenses, line_dedup, media, minhash, toxicity, warc
from annulus.llm.queries import op10_warc_audit, word_vocabulary
from annulus.llm.token_counts import TokenLedger, count_tokens, counted, counted_bpe, deletes, inserts, revisions

SCHEMA = "doc_id long, text string, lang string, source string, rep long, label string, sig string, winners string, u long, kept string"
LONG = "one two three four five six seven eight nine ten " * 3000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "  \n\t\n", "en", "b"),
    (5, LONG, "de", "b"),
    (6, LONG + "more", "de", "b"),
    (None, "alpha beta gamma delta epsilon zeta", "en", None),
    (7, "idiot", None, "a"),
    (8, "12345 !!!", "en", "a"),
]


def made(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", "y", "z", 1, "k") for r in rows], SCHEMA)


LABELS = [(1, 0, 0), (7, 0, 1), (7, 0, None), (None, 1, 1), (99, 1, 0)]


def runs(spark):
    labels = lambda: spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    items = lambda: spark.createDataFrame([(1, LONG[:300]), (2, None), (3, "x"), (None, LONG[:200])], "item_id long, text string")
    return {
        "lines": line_dedup.dedup_lines,
        "toxicity": lambda d: toxicity.grade_toxicity(d, labels()),
        "licenses": licenses.scan_licenses,
        "minhash": minhash.near_duplicates,
        "media": lambda d: media.decode_media(media.encode_media(d)),
        "langid": langid.identify_languages,
        "bpe": lambda d: bpe.encode_documents(d, word_vocabulary()),
        "leaks": lambda d: decontaminate.find_leaks(d, items()),
        "leaks in blocks": lambda d: decontaminate.find_leaks(d, items(), block_chars=100),
    }


NAMES = ["lines", "toxicity", "licenses", "minhash", "media", "langid", "bpe", "leaks", "leaks in blocks"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(spark, name):
    out = runs(spark)[name](made(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)
    twice = [r for r in out if r.doc_id == 1]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert runs(spark)[name](made(spark, [])).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_all_null(spark, name):
    assert runs(spark)[name](made(spark, [(None, None, None, None)] * 3)).count() == 3


def test_defined_results(spark):
    docs = made(spark, ROWS)
    near = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert (near[2].n_shingles, near[2].component_id, near[2].kept) == (0, 2, True)
    assert near[6].component_id == 5 and not near[6].kept and near[None].component_id is None and near[None].kept
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[2].text is None and lines[3].text == "" and lines[4].text == "  \n\t\n" and lines[None].n_kept == 1
    languages = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    assert languages[2].lang_pred == "und" and languages[8].lang_pred == "und" and languages[8].score == 0
    leaks = {r.doc_id: r.passages for r in decontaminate.find_leaks(docs, spark.createDataFrame([(4, LONG[:300])], "item_id long, text string")).collect()}
    assert leaks[5] and not leaks[1] and not leaks[2]
    codes = {r.doc_id: r for r in bpe.encode_documents(docs, word_vocabulary()).withColumn("list", bpe.ids_array()).collect()}
    assert codes[2].n_tokens == 0 and codes[2].decoded == "" and len(codes[1].list) == codes[1].n_tokens


def test_rows_of_one_doc_id_with_different_texts_are_one_node(spark):
    a, b = "a b c d e f g h", "q w e r t y u i o p"
    rows = [(5, a), (5, b), (3, b), (9, a), (5, ""), (11, "zz"), (None, a), (12, None), (20, b + " s d f"), (20, "other words that nobody has"), (0, "zz"), (0, "yy")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {5: 3, 3: 3, 9: 3, 11: 0, None: None, 12: 12, 20: 20, 0: 0}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert sorted(r.n_shingles for r in got if r.doc_id == 5) == [0, 4, 6]


def test_toxicity_without_labels_or_of_one_kind(spark):
    docs = made(spark, ROWS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(not r.toxic and r.grade == 0 for r in toxicity.grade_toxicity(docs, none).collect())
    assert toxicity.drop_toxic(docs, none).columns == docs.columns


def test_ledger_is_idempotent(spark, tmp_path):
    docs = made(spark, ROWS)
    counts = docs.select("source", "lang", F.explode(count_tokens(F.col("text"))).alias("t")).select("source", "lang", "t.*")
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    assert ledger.commit("a", inserts(counts)) and not ledger.commit("a", inserts(counts))
    once = sorted(map(str, ledger.totals().collect()))
    assert ledger.totals().agg(F.sum("n_docs")).first()[0] == 2 * len(ROWS)
    (tmp_path / "ledger" / "batches" / "cut").mkdir()  # a batch that was never finished
    assert sorted(map(str, ledger.totals().collect())) == once
    with pytest.raises(ValueError):
        ledger.commit("a", inserts(counts.limit(3)))
    again = TokenLedger(spark, f"file://{tmp_path}/ledger")
    again._fold = lambda: None  # a commit that ends before the totals are written anew
    again.commit("late", inserts(counts))
    assert ledger.totals().agg(F.sum("n_docs")).first()[0] == 4 * len(ROWS)
    ledger.commit("undo", deletes(counts))
    assert sorted(map(str, ledger.totals().collect())) == once and ledger._latest()[2] == {"a", "late", "undo"}
    assert len(ledger._names("folded")) <= 2
    ledger.commit("r", revisions(counts, counts.withColumn("n_tokens", F.col("n_tokens") * 2)))
    assert ledger.totals().where("tokenizer = 'words-1'").agg(F.sum("n_tokens")).first()[0] == 2 * sum(len((r[1] or "").split()) for r in ROWS)
    ledger.commit("d", deletes(counts.withColumn("n_tokens", F.col("n_tokens") * 2)))
    assert ledger.totals().count() == 0
    with pytest.raises(ValueError):
        ledger.commit("../x", inserts(counts))


def test_ledger_takes_bpe_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = made(spark, ROWS)
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    ledger.commit("a", inserts(counted(docs)))
    ledger.commit("b", inserts(counted_bpe(docs, word_vocabulary(), "word-bpe-49k")))
    library = Tokenizer.from_file(word_vocabulary())
    want = sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS)
    assert {r.tokenizer: r.n for r in ledger.totals().groupBy("tokenizer").agg(F.sum("n_tokens").alias("n")).collect()}["word-bpe-49k"] == want


def test_queries_equal_their_sql(spark):
    import duckdb

    from annulus.llm import queries

    con = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        got = queries.queries()[name](spark, "/root/testdata/sf0.001")
        assert sorted(got.columns) == sorted(names)
        assert sorted(str([r[c] for c in names]) for r in got.collect()) == sorted(str(list(r)) for r in found.fetchall()), name


def test_damage_in_stored_bytes_is_found(spark):
    """Pages without id, of one id and equal ones; a long page."""
    rows = [(i, f"http://x/{i}", "<p>é%d" % i) for i in range(300)] + [(7, "a", "b%d" % i) for i in range(200)] + [(None, "u", "v%d" % i) for i in range(300)] + [(None, "u", "v")] * 50 + [(12, "l", "long " * 300_000), (13, None, None)]
    stored = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()
    assert stored.count() == len(rows)
    read = warc.stored_records(stored)
    assert stored.where(F.col("digest") != F.sha2("record", 256)).count() == 0 and read.join(stored, ["archive", "place", "offset", "length", "digest"]).count() == len(rows)
    whole = stored.groupBy("archive").agg((F.max("place") + 1 == F.countDistinct("place")).alias("x"), (F.max(F.col("offset") + F.col("length")) == F.sum("length")).alias("y"), F.countDistinct("offset").alias("z"), F.count("*").alias("n"))
    assert whole.where("NOT x OR NOT y OR z <> n").count() == 0
    order = stored.where("archive = 0").orderBy("place").select("page_id", "digest").collect()
    assert [tuple(r) for r in order] == sorted(tuple(r) for r in order)
    assert warc.audit(read, read).count() == 0
    hit = stored.withColumn("record", F.when(F.col("page_id") == 250, F.overlay("record", F.lit(b"\x00"), F.lit(70), F.lit(1))).otherwise(F.col("record")))
    found = warc.audit(read, warc.stored_records(hit)).collect()
    assert len(found) == 1 and found[0].archive == 0 and found[0].fault == "corrupt"
    assert read.where("archive < 0").select("archive").distinct().count() > 200


def test_warc_audit_and_round_trip(spark, tmp_path):
    schema = "page_id long, url string, html string, place long, hash string"
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>é%d" % i, 1, "h") for i in range(5000)] + [(None, None, None, 0, None), (7, "http://x/7", "<p>é7", 1, "h")], schema)
    first = warc.records(pages)
    assert warc.audit(first, first).count() == 0
    bad = warc.records(pages.withColumn("html", F.when(F.col("page_id") == 4242, "rotten").otherwise(F.col("html"))))
    found = warc.audit(first, bad).collect()
    where = {(r.archive, r.place): r for r in found}
    assert all(r.fault == "corrupt" for r in found) and (1, 4242 - 4096) in where
    gone = warc.audit(first, first.where("NOT (archive = 0 AND place = 9)")).collect()
    assert [(r.archive, r.place, r.fault) for r in gone] == [(0, 9, "missing")]
    assert [(r.place, r.fault) for r in warc.audit(first.where("NOT (archive = 0 AND place = 9)"), first).collect()] == [(9, "extra")]
    empty = warc.records(spark.createDataFrame([], schema))
    assert warc.audit(empty, empty).count() == 0
    for r in warc.archives(first).collect():
        (tmp_path / f"{r.archive}.warc").write_bytes(bytes(r.content))
    back = warc.read_warc(spark, f"{tmp_path}/*.warc")
    both = back.join(first, (F.col("record_id") == F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))) & (back.place == first.place))
    assert both.where((back["offset"] == first["offset"]) & (back["length"] == first["length"])).count() == 5002
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_warc_audit_shuffles_no_bytes_of_records(spark, tmp_path):
    """Two megabytes of bodies that do not compress, some rows twice, and the whole result held against plain Python."""
    bodies = [random.Random(i).randbytes(10_000).hex() for i in range(100)]
    rows = [(i * 100, f"http://x/{i}", b) for i, b in enumerate(bodies)] + [(0, "http://x/0", bodies[0]), (100, "http://y", None), (6700, "http://x/67", bodies[67])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    context = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    got = op10_warc_audit(spark, str(tmp_path)).collect()
    assert shuffled() - before < 500_000
    expected, ends, places = [], Counter(), Counter()
    record = lambda i, url, b: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(b or '')}\r\n\r\n{b or ''}\r\n\r\n"
    sized = [(i, sha256((r := record(i, url, b)).encode()).hexdigest(), len(r)) for i, url, b in rows]
    for i, digest, n in sorted(sized):
        archive = i // warc.ARCHIVE_PAGES
        status = "corrupt" if sha256(f"rot:{i}".encode()).hexdigest()[:2] == "00" else "intact"
        expected.append((i, archive, places[archive], ends[archive], n, digest, status))
        places[archive] += 1
        ends[archive] += n
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert {r.status for r in got} == {"corrupt", "intact"}


CLASHES = "doc_id int, text string, n_lines long, n_kept int, winners string, ids string, doc_ids int, decoded string, n_tokens long, node long, label string, key string, passages string, toxic int, rep long"


@pytest.mark.parametrize("filled", [True, False])
def test_pipeline_takes_any_columns_and_rows(spark, tmp_path, filled):
    """Clashing names, nulls, empty, repeated and long rows, and no n_chars; and an empty table."""
    rest = (1, 2, "w", "i", 3, "d", 4, 5, "l", "k", "p", 6, 7)
    long = "".join(f"{i} sentence {i * 7} of a text {i % 7919} that goes {i} on\n" for i in range(28_000))
    assert len(long) > 1 << 20
    rows = [(*r[:2], *rest) for r in ROWS if r[0] not in (5, 6)] + [(30, long, *rest), (31, long, *rest), (None,) * 15] if filled else []
    path = f"{tmp_path}/tables"
    spark.createDataFrame(rows, CLASHES).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "a passage that no text holds at all, of any sort"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, path)
    assert len(set(c.lower() for c in out.columns)) == len(out.columns) and {"doc_id", "n_tokens", "ids", "decoded", "doc_ids", "doc_doc_ids"} <= set(out.columns)
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == (sorted(["1", "1", "2", "3", "4", "7", "8", "30", "None", "None"]) if filled else [])
    assert all(r.label == "l" and r.doc_n_tokens == 4 for r in got if r.doc_id)
