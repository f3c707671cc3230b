"""MinHash near-duplicates: universal hash minima, banding, verification, components.

Plan, for any input size:

1. One scan makes, for each document, the 128-bit key of its shingle set, the set's
   size and a signature: the low byte of the minimum of each of 240 multiply-add-shift
   hashes. Documents of equal sets form a class; only the class's least doc_id goes on.
2. The signature is cut into 48 bands of 5. At similarity 0.75 two texts miss all bands
   with probability below 3e-6. Buckets with several classes are dealt out in blocks of
   bounded size, and each task compares signatures and emits a spanning forest of the
   pairs whose estimate is within four standard deviations of the limit, so rows grow
   with the members, not with their pairs.
3. The forest's components bound where links can be. Their full shingle sets are dealt
   out in blocks of bounded bytes; each task confirms candidate pairs on the full sets
   and emits a spanning forest of the confirmed links.
4. Components of those links, by alternating large-star and small-star, label the
   classes, and each document takes the label of its class.

Hot groups: copies collapse in step 1 by a partial aggregate. In steps 2 and 3 a bucket
or group of more than one block is first compared with ``PIVOTS`` of its own members, which
takes work in proportion to its size; the largest component that this finds is its core.
Members of the core are connected already, so only the rest is dealt out in pairs of
blocks, against the rest and the core. No pair that could connect two components is left
out; the work is quadratic only in what no pivot is near to. The join that brings labels
back to documents is one that Spark splits when skewed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.components import connected_components
from annulus.llm.storage import Store, filtered_scans
from annulus.llm.textblocks import SHINGLE_WORDS, SIMILARITY_PERCENT, mix64, seeded, shingle_set, word_blocks

BANDS = 48
ROWS = 5
HASHES = BANDS * ROWS
#: Members of a bucket that one side of a task compares.
BUCKET_BLOCK = 512
#: Shingles that one side of a task holds, and shingles that a smaller set counts as (so 2,000 sets are a side at most).
SET_BLOCK = 400_000
LEAST_WEIGHT = 200
#: Members that all others of a bucket or group of several blocks are compared with first.
PIVOTS = 16
#: Nodes from here on are no documents but texts of documents that have several.
ALIASES = 1 << 62
_U = np.uint64
_MULTIPLIERS = seeded(21, HASHES) | _U(1)
_ADDENDS = seeded(22, HASHES)


def signature(shingles: np.ndarray) -> bytes:
    """Low bytes of the minima of HASHES universal hashes (a * x + b) >> 32 over 32-bit x."""
    x = shingles >> _U(32)
    least = None
    for lo in range(0, len(x), 128):
        part = ((x[lo : lo + 128, None] * _MULTIPLIERS + _ADDENDS) >> _U(32)).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return (least & _U(255)).astype(np.uint8).tobytes() if least is not None else bytes(HASHES)


def least_estimate(percent: int) -> float:
    """Share of equal signature bytes from which a pair is confirmed: four deviations below the limit."""
    p = percent / 100
    p = p + (1 - p) / 256
    return p - 4 * (p * (1 - p) / HASHES) ** 0.5


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[int, int], bytes] = {}
    for batch in batches:
        high, low, count, sigs = [], [], [], []
        for _, words, begin in word_blocks(batch.column("text")):
            for i in range(len(begin) - 1):
                shingles = shingle_set(words[begin[i] : begin[i + 1]], size)
                key = (int(shingles.sum(dtype=np.uint64)), int(mix64(shingles ^ _U(0x5DEECE66D)).sum(dtype=np.uint64)))
                if key not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[key] = signature(shingles)
                high.append(key[0])
                low.append(key[1])
                count.append(len(shingles))
                sigs.append(known[key])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("alias"),
                pa.array(np.array(high, dtype=np.uint64).view(np.int64)),
                pa.array(np.array(low, dtype=np.uint64).view(np.int64)),
                pa.array(count, type=pa.int64()),
                pa.array(sigs, type=pa.binary()),
            ],
            names=["doc_id", "alias", "high", "low", "n_shingles", "sig"],
        )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, and where the runs begin (with the end); the input is sorted by keys."""
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        n = table.num_rows
        if n == 0:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        begin = np.flatnonzero(new)
        if begin[-1]:
            yield table.slice(0, begin[-1]), begin
        carry = table.slice(begin[-1]).combine_chunks()
    if carry is not None and carry.num_rows:
        yield carry, np.array([0, carry.num_rows])


def _fixed_bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


class Forest:
    """Components of small integers; ``label`` has that of each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: int, y: int) -> bool:
        x, y = self.label[x], self.label[y]
        if x == y:
            return False
        self.label[self.label == y] = x
        return True


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edge_batch(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, type=pa.int64()), pa.array(v, type=pa.int64())], schema=_EDGES)


def _candidates(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs, in each block pair of a bucket, whose signatures agree enough."""
    for table, begin in runs(batches, ["bucket", "bi", "bj"]):
        sigs = _fixed_bytes(table.column("sig"), HASHES)
        reps, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
        sizes = np.diff(begin)
        first = begin[:-1][sizes == 2]
        first = first[(bi[first] == bj[first]) | (side[first] != side[first + 1])]
        near = first[(sigs[first] == sigs[first + 1]).mean(axis=1) >= least]
        u, v = list(reps[near]), list(reps[near + 1])
        for k in np.flatnonzero(sizes > 2):
            lo, hi = int(begin[k]), int(begin[k + 1])
            own, forest = sigs[lo:hi], Forest(hi - lo)
            across = bi[lo] != bj[lo]
            for i in range(hi - lo - 1):
                rest = np.flatnonzero(forest.label[i + 1 :] != forest.label[i]) + i + 1
                if across:
                    rest = rest[side[lo + rest] != side[lo + i]]
                for j in rest[(own[i] == own[rest]).mean(axis=1) >= least]:
                    if forest.join(i, int(j)):
                        u.append(reps[lo + i])
                        v.append(reps[lo + j])
        yield _edge_batch(u, v)


def _without_repeats(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch without rows whose set is dealt out just as in the row before (repeated rows of a document)."""
    if batch.num_rows < 2:
        return batch
    same = np.ones(batch.num_rows - 1, bool)
    for name in ("rep", "grp", "side", "lo", "hi"):
        column = batch.column(name).to_numpy()
        same &= column[1:] == column[:-1]
    return batch.filter(pa.array(np.concatenate(([True], ~same))))


def _shingle_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in map(_without_repeats, batches):
        sets: list[bytes] = []
        for _, words, begin in word_blocks(batch.column("text")):
            sets += [shingle_set(words[begin[i] : begin[i + 1]], size).tobytes() for i in range(len(begin) - 1)]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(sets, type=pa.binary())).rename_columns(
            ["shingles" if x == "text" else x for x in batch.schema.names]
        )


def _confirmed(batches: Iterator[pa.RecordBatch], least: float, percent: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links, in each block pair of a group, that hold on the full sets."""
    for table, begin in runs(batches, ["grp", "bi", "bj"]):
        sigs = _fixed_bytes(table.column("sig"), HASHES)
        reps, side, sets = table.column("rep").to_numpy(), table.column("side").to_numpy(), table.column("shingles").to_pylist()
        bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
        u, v = [], []
        for k in range(len(begin) - 1):
            lo, hi = int(begin[k]), int(begin[k + 1])
            if hi - lo < 2:
                continue
            full = [np.frombuffer(x, dtype=np.uint64) for x in sets[lo:hi]]
            size = np.array([len(x) for x in full])
            own, forest = sigs[lo:hi], Forest(hi - lo)
            across = bi[lo] != bj[lo]
            for i in range(hi - lo - 1):
                rest = np.flatnonzero(forest.label[i + 1 :] != forest.label[i]) + i + 1
                rest = rest[100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest])]
                if across:
                    rest = rest[side[lo + rest] != side[lo + i]]
                agree = (own[i] == own[rest]).mean(axis=1)
                for j in rest[np.argsort(-agree, kind="stable")[: (agree >= least).sum()]]:
                    if forest.label[i] == forest.label[j]:
                        continue
                    both = np.concatenate((full[i], full[j]))
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        forest.join(i, int(j))
                        u.append(reps[lo + i])
                        v.append(reps[lo + j])
        yield _edge_batch(u, v)


def _anew(column: str) -> Column:
    """The same values, but not known to be dealt by them: a join then shuffles both sides and can split a hot key."""
    return F.bitwise_not(F.bitwise_not(column)).alias(column)


def _star_plan(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Where rows (key, rep, weight) of keys of several blocks go to meet their key's pivots: key, rep, side, lo, hi."""
    hot = rows.groupBy(key).agg(F.ceil(F.sum("weight") / limit).cast("int").alias("blocks")).where("blocks > 1")
    inside = rows.join(hot.select(_anew(key), "blocks"), key)
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int") + 1
    members = inside.select(key, "rep", block.alias("side"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    pivots = inside.groupBy(key, F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(PIVOTS)).alias("slot")).agg(
        F.min(F.struct(F.xxhash64("rep", F.lit(3)).alias("h"), "rep")).alias("pivot"), F.max("blocks").alias("blocks")
    )
    return members.unionByName(
        pivots.select(key, "pivot.rep", F.lit(0).alias("side"), F.lit(1).alias("lo"), F.col("blocks").alias("hi"))
    )


def _rest_plan(rows: DataFrame, key: str, limit: int, labels: DataFrame) -> DataFrame:
    """Where rows (key, rep, weight) go so that each pair meets, but for pairs within the key's largest component of labels."""
    known = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    parts = known.groupBy(key, "label").agg(F.sum("weight").alias("part"))
    sizes = (
        parts.groupBy(key)
        .agg(F.max(F.when(F.col("label").isNotNull(), F.struct("part", "label"))).alias("largest"), F.sum("part").alias("total"))
        .select(
            _anew(key),
            F.col("largest.label").alias("core"),
            F.ceil((F.col("total") - F.coalesce("largest.part", F.lit(0))) / limit).cast("int").alias("rests"),
            F.ceil(F.coalesce("largest.part", F.lit(0)) / limit).cast("int").alias("cores"),
        )
        .where("rests > 0")
    )
    h = F.xxhash64("rep", F.lit(4))
    inside = known.join(sizes, key).withColumn("inner", F.coalesce(F.col("label") == F.col("core"), F.lit(False)))
    return inside.select(
        key,
        "rep",
        F.when(F.col("inner"), F.col("rests") + F.pmod(h, F.greatest("cores", F.lit(1)))).otherwise(F.pmod(h, "rests")).cast("int").alias("side"),
        F.lit(0).alias("lo"),
        (F.when(F.col("inner"), F.col("rests")).otherwise(F.col("rests") + F.col("cores")) - 1).alias("hi"),
    )


def _dealt(df: DataFrame) -> DataFrame:
    """Each row once for each block, lo to hi, that its own (side) meets: columns side, bi, bj."""
    return (
        df.withColumn("other", F.explode(F.sequence("lo", "hi")))
        .withColumn("bi", F.least("side", "other"))
        .withColumn("bj", F.greatest("side", "other"))
        .drop("other", "lo", "hi")
    )


def near_duplicates(
    docs: DataFrame, percent: int = SIMILARITY_PERCENT, size: int = SHINGLE_WORDS, store: Store | None = None
) -> DataFrame:
    """Near-duplicate components of documents.

    docs: doc_id long and text string; other columns are ignored, whatever their names.
    Returns, for each row, doc_id, n_shingles, component_id (least doc_id reachable over
    links of at least percent % similarity) and kept (doc_id = component_id).

    A null or empty text, or one of white space, has no shingles and links with nothing.
    Rows of one doc_id are one node, whatever their texts: they have one component_id, by
    the links of all of them, and each row its own n_shingles. Ids are under ``ALIASES``. A row
    without doc_id links with nothing: its component_id is null and it is kept. An empty table
    gives an empty result.
    """
    store = store or Store(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aliased = texts.withColumn("alias", F.xxhash64("text").bitwiseAND(ALIASES - 1).bitwiseOR(ALIASES))
    least = least_estimate(percent)
    signed = store.keep(
        aliased.mapInArrow(partial(_signatures, size=size), "doc_id long, alias long, high long, low long, n_shingles long, sig binary"),
        "signatures",
    )
    key = ["high", "low", "n_shingles"]
    # documents whose rows have different sets; each such row's node is its alias, tied to the document's own node
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("least"), F.max(F.struct(*key)).alias("most"))
    several = store.keep(several.where("least <> most").select("doc_id"), "several")
    mixed = not several.isEmpty()
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    if mixed:
        filled = filled.join(several.select(_anew("doc_id"), F.lit(True).alias("mixed")), "doc_id", "left")
        filled = filled.withColumn("node", F.when(F.col("mixed"), F.col("alias")).otherwise(F.col("doc_id")))
    else:
        filled = filled.withColumn("node", F.col("doc_id"))
    classes = store.keep(filled.groupBy(*key).agg(F.min("node").alias("rep"), F.first("sig").alias("sig")), "classes")
    nodes = classes.select("rep", "sig", "n_shingles")
    banded = nodes.select(
        "rep",
        F.explode(
            F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {ROWS} + 1, {ROWS})))")
        ).alias("bucket"),
    )
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = store.keep(banded.join(shared.select(_anew("bucket")), "bucket").withColumn("weight", F.lit(1)), "members")

    def agreeing(plan: DataFrame, name: str) -> DataFrame:
        pairs = (
            _dealt(plan.join(nodes.select("rep", "sig"), "rep"))
            .select("bucket", "bi", "bj", "side", "rep", "sig")
            .repartition("bucket", "bi", "bj")
            .sortWithinPartitions("bucket", "bi", "bj")
            .mapInArrow(partial(_candidates, least=least), "u long, v long")
        )
        return store.keep(pairs, name)

    stars = agreeing(_star_plan(members, "bucket", BUCKET_BLOCK), "star-pairs")
    rest = _rest_plan(members, "bucket", BUCKET_BLOCK, connected_components(stars, store, "stars"))
    pairs = stars.union(agreeing(rest, "pairs"))
    groups = connected_components(pairs, store, "loose")
    groups = store.keep(
        groups.join(nodes, groups.node == nodes.rep).select("rep", F.col("label").alias("grp"), "sig", F.greatest("n_shingles", F.lit(LEAST_WEIGHT)).alias("weight")), "groups"
    )

    def confirmed(plan: DataFrame, name: str) -> DataFrame:
        needed = store.keep(plan.join(groups.select("rep", "sig"), "rep"), f"{name}-plan").where("hi >= lo")
        own = texts.join(needed, texts.doc_id == needed.rep).select("grp", "rep", "sig", "side", "lo", "hi", "text")
        if mixed:
            by_alias = needed.where(F.col("rep") >= ALIASES)
            own = own.union(aliased.join(by_alias, F.col("alias") == F.col("rep")).select(*own.columns))
        sets = (
            own.mapInArrow(partial(_shingle_rows, size=size), "grp long, rep long, sig binary, side int, lo int, hi int, shingles binary")
        )
        found = (
            _dealt(sets)
            .select("grp", "bi", "bj", "side", "rep", "sig", "shingles")
            .repartition("grp", "bi", "bj")
            .sortWithinPartitions("grp", "bi", "bj")
            .mapInArrow(partial(_confirmed, least=least, percent=percent), "u long, v long")
        )
        with filtered_scans(docs.sparkSession):  # few texts are in a group, so the others stay where they are
            return store.keep(found, name)

    small = groups.drop("sig")
    stars = confirmed(_star_plan(small, "grp", SET_BLOCK), "star-links")
    rest = _rest_plan(small, "grp", SET_BLOCK, connected_components(stars, store, "cores"))
    links = stars.union(confirmed(rest, "links"))
    if mixed:
        links = links.union(filled.where("mixed").select("doc_id", *key).distinct().join(classes, key).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    labels = connected_components(links, store, "linked")
    named = classes.join(labels, classes.rep == labels.node, "left").select(*key, F.coalesce("label", "rep").alias("component"))
    out = signed.join(named, key, "left").select("doc_id", "n_shingles", "component")
    if mixed:  # rows of such documents, those without shingles too, have the document's component
        own = several.join(labels, several.doc_id == labels.node).select(_anew("doc_id"), F.col("label").alias("own"))
        out = out.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "component").alias("component"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
