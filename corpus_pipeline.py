"""The corpus pipeline: stages over the documents table, each written and read again as the next one's input.

toxicity drops toxic documents; line_dedup takes out repeated lines, and documents of
which nothing is left; near_dedup keeps one document of each group of near-duplicates;
decontamination drops documents that hold benchmark passages; bpe encodes the texts.

Every stage takes documents with doc_id and text, and any other columns whatever their names, which
all but the last return as they are. Null and empty texts are clean, hold no lines and no passages, and are
like no other, so they stay, with no tokens. Rows without doc_id stay as well, less toxic and
leaked ones. Equal rows fare alike, and rows of one doc_id are one document to line_dedup and near_dedup. Ties go
to the least doc_id. An empty table stays empty. A long text is one row throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm.bpe import encode_documents
from annulus.llm.decontaminate import drop_leaked
from annulus.llm.line_dedup import dedup_lines
from annulus.llm.minhash import near_duplicates
from annulus.llm.queries import table, word_vocabulary
from annulus.llm.storage import Store
from annulus.llm.toxicity import drop_toxic
from annulus.session import ship
from annulus.shared import closing_stores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return drop_toxic(docs, table(ship(spark), sf_dir, "labels"))


def _packed(docs: DataFrame) -> tuple[list[Column], tuple[str, ...]]:
    """doc_id, text and all other columns as one struct, so that no name of theirs meets one of an operator; its name, if there is one."""
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    own = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    return (own + [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("carried_columns")], ("carried_columns",)) if rest else (own, ())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one whose every line is a repeat goes. n_chars, where there is one, is brought up to date."""
    ship(spark)
    own, carry = _packed(docs)
    left = dedup_lines(docs.select(*own), carry=carry).where("n_kept > 0 OR n_lines = 0")

    def column(name: str) -> Column:
        if name.lower() in ("doc_id", "text"):
            return F.col(name).cast(docs.schema[name].dataType).alias(name)
        value = F.col(f"carried_columns.`{name}`")
        if name.lower() == "n_chars":
            value = F.when(F.col("n_kept") < F.col("n_lines"), F.length("text")).otherwise(value).cast(docs.schema[name].dataType)
        return value.alias(name)

    return left.select(*map(column, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near-duplicates."""
    dropped = near_duplicates(docs.select("doc_id", "text"), store=Store(ship(spark), "near")).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return drop_leaked(docs, table(ship(spark), sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to, with the other columns; one that is called like a new column gets the prefix doc_."""
    ship(spark)
    own, carry = _packed(docs)
    coded = encode_documents(docs.select(*own), word_vocabulary(), carry=carry)
    made, rest = ["doc_id", "n_tokens", "ids", "decoded"], [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    names = {c: c for c in rest if c.lower() not in made}
    for c in rest:
        if c not in names:
            name = f"doc_{c}"
            while name.lower() in {n.lower() for n in names.values()}:
                name = f"doc_{name}"
            names[c] = name
    return coded.select(*made, *[F.col(f"carried_columns.`{c}`").alias(names[c]) for c in rest])


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: No stage can be told in SQL as a whole; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each but the last written to the shared folder; what a stage is done with is removed."""
    store = Store(ship(spark), "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with closing_stores():
            docs = store.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if before:
            store.drop(before)
        before = f"{k}-{name}"
    return docs
