"""Token counts kept up to date from signed deltas.

A ledger is a folder of batches. A batch is the sum of signed deltas (documents and tokens
inserted, deleted or counted anew) by source, language and tokenizer version, written as
Parquet under the batch's name. Spark's committer leaves ``_SUCCESS`` when all of a batch is
there; a batch that has it is never written again, so a repeated commit changes nothing, and
one that was cut short is written over. A name that comes again with other rows is an error.

Totals are kept: a commit adds its batch to the latest totals and writes them anew with the names of
the batches in them, so neither a commit nor a reader goes through old batches. Totals are read
with whatever batches they do not name yet; a commit that ends between its two steps, or two at
once, therefore lose nothing and count nothing twice.

Deltas are summed by a partial aggregate before they are shuffled, so a source with a third of
the rows sends one row a task.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm.bpe import encode_documents
from annulus.llm.storage import exists, remove, shared_dir

#: Tokenizer versions: the runs of characters that each counts as tokens.
TOKENIZERS = {
    "words-1": "[^ \\t\\n\\x0B\\f\\r]+",
    "letters-1": "[A-Za-zÀ-ÖØ-öø-ÿ]+",
}
KEYS = ("source", "lang", "tokenizer")


def count_tokens(text: Column, tokenizers: dict[str, str] = TOKENIZERS) -> Column:
    """Array of (tokenizer, n_tokens); a null text has none."""
    counts = [
        F.struct(F.lit(name).alias("tokenizer"), F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long").alias("n_tokens"))
        for name, pattern in sorted(tokenizers.items())
    ]
    return F.array(*counts)


def counted(docs: DataFrame, text: str = "text", tokenizers: dict[str, str] = TOKENIZERS) -> DataFrame:
    """source, lang, tokenizer and n_tokens of each document, a row for each tokenizer."""
    return docs.select("source", "lang", F.explode(count_tokens(F.col(text), tokenizers)).alias("t")).select("source", "lang", "t.*")


def counted_bpe(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """source, lang, tokenizer (the given version) and n_tokens of each document by a BPE vocabulary file."""
    own = docs.select(F.lit(0).cast("long").alias("doc_id"), "text", F.struct("source", "lang").alias("of"))
    return encode_documents(own, vocabulary, carry=("of",)).select("of.source", "of.lang", F.lit(version).alias("tokenizer"), "n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas that replace the counts in before by those in after; the documents stay."""
    out = before.select(*KEYS, F.lit(0).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))
    return out.union(after.select(*KEYS, F.lit(0).cast("long").alias("docs"), F.col("n_tokens").alias("tokens")))


_SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


def _digest(sums: DataFrame) -> tuple:
    """Equal for equal rows, in any order."""
    rows = F.xxhash64(*KEYS, "docs", "tokens"), F.hash(*KEYS, "docs", "tokens")
    return tuple(sums.agg(F.count("*"), F.bit_xor(rows[0]), F.sum(rows[1].cast("long")), F.sum("docs"), F.sum("tokens")).first())


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenLedger:
    """Batches of deltas and kept totals under one folder.

    Null sources, languages and tokenizers are keys like others. A batch without rows is
    committed as empty. Totals that come to no documents and no tokens are left out.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/token-ledger"

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Commit a batch; False if it was there already with the same sums (then nothing is written).

        Raises if it was there with others.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch is named with letters, digits, dots, dashes and underscores")
        path = f"{self.root}/batches/{batch}"
        sums = _summed(deltas)
        if exists(self.spark, f"{path}/_SUCCESS"):
            if _digest(sums) != _digest(self.spark.read.schema(_SUMS).parquet(path)):
                raise ValueError(f"batch {batch} was committed with other rows")
            return False
        self._write(sums, path)
        self._fold()
        return True

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)

    def _names(self, folder: str) -> list[str]:
        """Names under a folder that were written to their end."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        return sorted(n for n in names if exists(self.spark, f"{self.root}/{folder}/{n}/_SUCCESS"))

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return self._names("batches")

    def _latest(self) -> tuple[int, str | None, set[str]]:
        """Number and path of the latest kept totals, and the batches in them. The names are written last, so totals with names are whole."""
        kept = self._names("folded")
        if not kept:
            return 0, None, set()
        rows = self.spark.read.schema("batch string").parquet(f"{self.root}/folded/{kept[-1]}").collect()  # a name a batch
        return int(kept[-1].split("-")[0]), f"{self.root}/totals/{kept[-1]}", {r.batch for r in rows}

    def _sums(self) -> tuple[int, str | None, list[str], DataFrame]:
        number, path, inside = self._latest()
        names = self.batches()
        paths = [f"{self.root}/batches/{n}" for n in names if n not in inside] + ([path] if path else [])
        deltas = self.spark.read.schema(_SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], _SUMS)
        return number, path, names, _summed(deltas)

    def _fold(self) -> None:
        """Write the totals with all batches that there are now."""
        number, _, names, sums = self._sums()
        name = f"{number + 1:012d}-{uuid.uuid4().hex}"
        self._write(sums, f"{self.root}/totals/{name}")
        self._write(self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1), f"{self.root}/folded/{name}")
        for old in self._names("folded"):
            if int(old.split("-")[0]) < number:  # readers may still hold the one before
                remove(self.spark, f"{self.root}/folded/{old}")
                remove(self.spark, f"{self.root}/totals/{old}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens over all committed batches."""
        sums = self._sums()[3].withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})
        return sums.where("n_docs <> 0 OR n_tokens <> 0")
