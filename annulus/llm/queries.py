"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm.bpe import encode_documents
from annulus.llm.conversations import damage, repair_conversations
from annulus.llm.decontaminate import find_leaks
from annulus.llm.langid import identify_languages
from annulus.llm.late_rows import DailyLayout, epoch_micros, with_resent
from annulus.llm.licenses import scan_licenses
from annulus.llm.line_dedup import dedup_lines
from annulus.llm.media import decode_media, encode_media
from annulus.llm.minhash import near_duplicates
from annulus.llm.packing import pack_documents
from annulus.llm.ranks import joined_sha256, same
from annulus.llm.storage import Store
from annulus.llm.token_counts import TOKENIZERS, TokenLedger, count_tokens, deletes, inserts, revisions
from annulus.llm.toxicity import grade_toxicity
from annulus.llm.warc import ARCHIVE_PAGES, audit, laid_out, measured, replica_records, responses, with_slots


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """Path of the word-end BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, one of them committed twice: all documents come in, toxic ones go, and the texts of low quality are counted anew without digits."""
    store = Store(spark, "ledger")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("gone"), (F.min("quality") == 0).alias("poor"))
    # texts are counted where they are read; only counts are joined with labels
    both = F.arrays_zip(count_tokens(F.col("text")).alias("was"), count_tokens(F.translate("text", "0123456789", "")).alias("now"))
    counts = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.explode(both).alias("t"))
    counts = store.keep(counts.select("doc_id", "source", "lang", "t.was.tokenizer", "t.was.n_tokens", F.col("t.now.n_tokens").alias("n_cleaned")), "counts")
    ledger = TokenLedger(spark, store.path("batches"))
    ledger.commit("load", inserts(counts))
    labelled = counts.join(labels, "doc_id")
    withdrawn = deletes(labelled.where("gone"))
    ledger.commit("withdraw", withdrawn)
    ledger.commit("withdraw", withdrawn)
    poor = labelled.where("poor AND NOT gone")
    ledger.commit("recount", revisions(poor, poor.withColumn("n_tokens", F.col("n_cleaned"))))
    return ledger.totals()


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(encode_media(table(spark, sf_dir, "documents"))).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), word_vocabulary()).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("passages.item_id")))
    return found.select("doc_id", (F.size("passages") > 0).alias("contaminated"), items.alias("item_ids"), "passages")


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the pages' stored archives, and whether the audit finds it damaged in a replica where some stored records have a byte overwritten."""
    pages = table(spark, sf_dir, "pages")
    store = Store(spark, "warc")
    stored = store.keep(with_slots(responses(pages)), "archives")
    rotten = F.substring(F.sha2(F.concat(F.lit("rot:"), F.col("page_id").cast("string")), 256), 1, 2) == "00"
    # the fifth byte from the end of a record is the last one of its body
    damaged = F.overlay("record", F.lit(b"\x00"), F.length("record") - 4, F.lit(1))
    replica = store.keep(stored.select("slot", F.when(rotten, damaged).otherwise(F.col("record")).alias("record")), "copies")
    first = store.keep(laid_out(measured(stored)), "records")
    second = store.keep(replica_records(first, replica), "replica")
    found = audit(first, second, store).select("archive", "place", "fault")
    return first.join(found, ["archive", "place"], "left").select(
        "page_id", "archive", "place", "offset", "length", F.col("digest").alias("record_sha256"), F.coalesce("fault", F.lit("intact")).alias("status")
    )


def op11_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the daily layout of sales, of rows before 2024-03-20 at first, after the later ones have been put in."""
    sales = table(spark, sf_dir, "sales")
    # a folder of its own, in which nothing but the layout's files stays
    layout = DailyLayout(sales, Store(spark, "sales-layout").root, "sale_id", "sold_at", "arrived_at", 1 + sales.count() // 1100)
    rows, early = with_resent(sales), F.coalesce(F.col("arrived_at") < F.lit("2024-03-20 00:00:00").cast("timestamp_ntz"), F.lit(False))
    layout.create(rows.where(early))
    started = Store(spark, "sales-start").keep(layout.files(), "files")
    layout.overwrite(rows.where(~early))

    stored = layout.read()
    cents = F.coalesce(F.floor(100 * F.col("total") + 0.5), F.lit(0))
    parts = (F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("sale_id"), epoch_micros("sold_at"), epoch_micros("arrived_at")))
    crc = F.crc32(F.concat_ws(":", *parts).cast("binary"))
    files = stored.groupBy("path", "day", "file_no").agg(F.count("*").alias("n_rows"), F.sum(cents).cast("long").alias("cents"), F.sum(crc).cast("long").alias("rows_crc"))
    digests = joined_sha256(stored, "path", "row_index", "sale_id", ",").withColumnRenamed("sha256", "ids_sha256")
    found = files.join(digests, "path").join(started.withColumn("untouched", F.lit(True)), "path", "left")
    names = ",".join(layout.stored_columns())
    return found.select(
        "day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(names).alias("columns"), "ids_sha256", F.col("untouched").isNull().alias("rewritten")
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, the cheapest repair and the digest of its repaired turns."""
    convs = table(spark, sf_dir, "conversations")
    audits, turns = repair_conversations(damage(convs))
    texts = turns.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = joined_sha256(texts, "conv_id", "place", "line", "\n")
    every = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = every.join(audits, same(every, audits, "conv_id"), "left").drop(audits["conv_id"])
    found = found.join(digests, same(found, digests, "conv_id"), "left").drop(digests["conv_id"])
    numbers = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each closed by id 1, in sequences of 2,048 tokens or a power of two."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), word_vocabulary(), 1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_toxicity": op3_toxicity,
        "op4_license_scan": op4_license_scan,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_webp_media": op6_webp_media,
        "op7_language_id": op7_language_id,
        "op8_bpe_roundtrip": op8_bpe_roundtrip,
        "op9_decontamination": op9_decontamination,
        "op10_warc_audit": op10_warc_audit,
        "op11_late_overwrite": op11_late_overwrite,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_packing": op13_packing,
    }


OP2_SQL = """
WITH judged AS (SELECT doc_id, max(toxic) = 1 AS gone, min(quality) = 0 AS poor FROM labels GROUP BY doc_id),
docs AS (
  SELECT source, lang, text, coalesce(gone, false) AS gone,
         CASE WHEN coalesce(poor, false) AND NOT coalesce(gone, false) THEN translate(text, '0123456789', '') ELSE text END AS counted
  FROM documents LEFT JOIN judged USING (doc_id)
), counts AS (
  SELECT source, lang, tokenizer, len(regexp_extract_all(counted, pattern)) AS n
  FROM docs, (VALUES {values}) AS t(tokenizer, pattern) WHERE NOT gone
)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_tokens
FROM counts GROUP BY source, lang, tokenizer HAVING count(*) <> 0 OR sum(coalesce(n, 0)) <> 0
""".replace("{values}", ", ".join(f"('{name}', '{pattern}')" for name, pattern in sorted(TOKENIZERS.items())))

OP10_SQL = f"""
WITH made AS (
  SELECT page_id, url, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS record
  FROM pages
), sized AS (
  SELECT page_id, url, coalesce(CAST(floor(page_id / {ARCHIVE_PAGES}.0) AS BIGINT), -1) AS archive,
         octet_length(record) AS length, sha256(record) AS record_sha256 FROM made
)
SELECT page_id, archive, row_number() OVER w - 1 AS place,
       CAST(sum(length) OVER (w ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset", length, record_sha256,
       CASE WHEN substr(sha256('rot:' || CAST(page_id AS VARCHAR)), 1, 2) = '00' THEN 'corrupt' ELSE 'intact' END AS status
FROM sized WINDOW w AS (PARTITION BY archive ORDER BY page_id, record_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_token_counts": OP2_SQL, "op10_warc_audit": OP10_SQL}
