"""Column expressions over alignment records; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annulus import schema as S

C = F.col


def has_flag(bit: int, flag: str | Column = "flag") -> Column:
    column = C(flag) if isinstance(flag, str) else flag
    return column.bitwiseAND(bit) != 0


def is_soft_clipped(cigar: str = "cigar") -> Column:
    return F.exists(cigar, lambda c: c["op"] == S.SOFT)


def is_hard_clipped(cigar: str = "cigar") -> Column:
    return F.exists(cigar, lambda c: c["op"] == S.HARD)


def cigar_sum(cigar: str | Column, *ops: int) -> Column:
    """Total length of the given operations."""
    column = C(cigar) if isinstance(cigar, str) else cigar
    kept = F.filter(column, lambda c: c["op"].isin(*ops))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda total, c: total + c["len"])


def rightmost(pos: str = "pos", cigar: str = "cigar") -> Column:
    """End of the alignment, by M, D and N alone."""
    return C(pos) + cigar_sum(cigar, S.MATCH, S.DELETION, S.SKIP)


def aligned_bases(cigar: str = "cigar") -> Column:
    return cigar_sum(cigar, S.MATCH)


def aligned_blocks(pos: str = "pos", cigar: str = "cigar") -> Column:
    """M, = and X operations as an array of (start on the chromosome, at in the read, len)."""
    block = lambda t, c: F.array(F.struct(t["start"].alias("start"), t["at"].alias("at"), c["len"].cast("long").alias("len")))
    moved = lambda at, c, *ops: at + F.when(c["op"].isin(*ops), c["len"]).otherwise(0)
    none = F.array().cast("array<struct<start:bigint,at:bigint,len:bigint>>")
    begin = F.struct(C(pos).cast("long").alias("start"), F.lit(0).cast("long").alias("at"), none.alias("blocks"))

    def step(t: Column, c: Column) -> Column:
        return F.struct(
            moved(t["start"], c, S.MATCH, S.DELETION, S.SKIP, S.EQUAL, S.DIFFERENT).alias("start"),
            moved(t["at"], c, S.MATCH, S.INSERTION, S.SOFT, S.EQUAL, S.DIFFERENT).alias("at"),
            F.concat(t["blocks"], F.when(c["op"].isin(S.MATCH, S.EQUAL, S.DIFFERENT), block(t, c)).otherwise(none)).alias("blocks"),
        )

    return F.aggregate(cigar, begin, step, lambda t: t["blocks"])


def runs_of_bases(seq: Column, qual: Column, at: Column, length: Column, quality: int = 0) -> Column:
    """Runs (first, last) of the bases of a block of a read that are A, C, G or T, of the given quality if it is over 0."""
    bases = F.upper(F.substring(seq, at.cast("int") + 1, length.cast("int")))
    clean = (F.length(bases) == length) & ~bases.rlike("[^ACGT]")
    counts = F.transform(F.split(bases, ""), lambda b: b.isin("A", "C", "G", "T"))
    if quality > 0:
        marks = F.slice(F.when(F.size(qual) == F.length(seq), qual), at.cast("int") + 1, length.cast("int"))
        high = F.transform(marks, lambda q: F.coalesce(q >= quality, F.lit(False)))
        clean = clean & (F.size(marks) == length) & F.forall(high, lambda h: h)
        counts = F.zip_with(counts, high, lambda b, h: b & h)
    places = F.filter(F.transform(counts, lambda c, i: F.when(c, i.cast("long"))), lambda i: i.isNotNull())
    first = lambda p: F.filter(p, lambda i, k: (k == 0) | (F.get(p, k - 1) < i - 1))
    last = lambda p: F.filter(p, lambda i, k: (k == F.size(p) - 1) | (F.get(p, k + 1) > i + 1))
    # places are wrapped so that the inner functions see a value, not an expression to work out for each base
    runs = F.flatten(F.transform(F.array(places), lambda p: F.zip_with(first(p), last(p), lambda a, b: F.struct(a.alias("first"), b.alias("last")))))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (length - 1).alias("last")))
    return F.when(length > 0, F.when(F.coalesce(clean, F.lit(False)), whole).otherwise(runs))


def query_length(cigar: str = "cigar", hard: bool = False) -> Column:
    """Bases of the read, with hard-clipped ones if asked for."""
    return cigar_sum(cigar, S.MATCH, S.INSERTION, S.SOFT, 7, 8, *([S.HARD] if hard else []))


def _op_code(op: Column) -> Column:
    return (F.call_function("instr", F.lit(S.CIGAR_OPS), op) - 1).cast("int")


def parse_cigar(text: Column) -> Column:
    """A CIGAR string as an array of (op, len)."""
    pattern = F.lit("([0-9]+)([MIDNSHP=X])")
    lengths, ops = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.zip_with(
        lengths, ops, lambda n, op: F.struct(_op_code(op).alias("op"), n.cast("int").alias("len"))
    )


def text_sum(text: Column, ops: str) -> Column:
    """Total length of the operations of a CIGAR string."""
    lengths = F.regexp_extract_all(text, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n.cast("long"))


def rightmost_of_text(leftmost: Column, text: Column) -> Column:
    """End of a supplementary alignment that begins at a 1-based place."""
    return leftmost - 1 + text_sum(text, "MDN")


def genome_span(text: Column, with_deletions: bool = False) -> Column:
    """Aligned length that widens a prior; deletions count only if asked for."""
    return text_sum(text, "MD" if with_deletions else "M")


def supplementary(sa: str = "sa") -> Column:
    """First entry of an SA tag as (chrom, pos, strand, cigar, mapq); null without a tag."""
    part = F.split(C(sa), ",")
    fields = F.struct(
        part[0].alias("chrom"), part[1].cast("long").alias("pos"), part[2].alias("strand"), part[3].alias("cigar"), F.regexp_extract(part[4], "^[0-9]+", 0).cast("int").alias("mapq")
    )
    return F.when(C(sa).isNotNull(), fields)


def alternatives(xa: str = "xa") -> Column:
    """Entries of an XA tag as an array of (chrom, pos, cigar, nm); the sign of the place is dropped."""
    entries = F.filter(F.split(C(xa), ";"), lambda e: e != "")
    return F.transform(entries, lambda e: _alternative(F.split(e, ",")))


def _alternative(part: Column) -> Column:
    return F.struct(part[0].alias("chrom"), F.substring(part[1], 2, 30).cast("long").alias("pos"), part[2].alias("cigar"), part[3].cast("int").alias("nm"))


def phred_to_prob(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / F.lit(10.0))


def prob_to_phred(p: Column) -> Column:
    """Phred of the error 1 - p, rounded half to even; a sure p gives 90."""
    sure = F.when(p == 1, F.lit(0.999999999)).otherwise(p)
    return F.bround(F.lit(-10.0) * F.log10(F.lit(1.0) - sure)).cast("int")


def weight(mapq: Column) -> Column:
    """Probability that an alignment is right."""
    return F.lit(1.0) - phred_to_prob(mapq)


def clip_lengths(cigar: str = "cigar") -> tuple[Column, Column]:
    """Soft-clipped bases at the left and right end; hard clips outside them are passed over."""
    ops = F.filter(C(cigar), lambda c: c["op"] != S.HARD)
    first, last = F.get(ops, F.lit(0)), F.get(ops, F.size(ops) - 1)
    left = F.when(first["op"] == S.SOFT, first["len"]).otherwise(0)
    right = F.when((last["op"] == S.SOFT) & (F.size(ops) > 1), last["len"]).otherwise(0)
    return F.coalesce(left, F.lit(0)), F.coalesce(right, F.lit(0))


def longest_clip(seq: str = "seq", qual: str = "qual", cigar: str = "cigar") -> Column:
    """The longer soft clip as (side, seq, qual); ties go left; null without a clip."""
    left, right = clip_lengths(cigar)
    by_left = F.struct(F.lit("L").alias("side"), F.substring(C(seq), F.lit(1), left).alias("seq"), F.slice(C(qual), F.lit(1), left).alias("qual"))
    by_right = F.struct(
        F.lit("R").alias("side"),
        F.substring(C(seq), F.length(seq) - right + 1, right).alias("seq"),
        F.slice(C(qual), F.greatest(F.size(qual) - right + 1, F.lit(1)), right).alias("qual"),
    )
    return F.when((left > 0) & (left >= right), by_left).when(right > 0, by_right)


def non_colinear(cigar: Column, pos: Column, start: Column, end: Column) -> Column:
    """Whether a clipped read points away from an interval; null for a read clipped at neither end."""
    first, last = F.element_at(cigar, 1)["op"], F.element_at(cigar, -1)["op"]
    left, right = (start > pos) | (pos < end), (end < pos) | (pos > start)
    return F.when((first == S.SOFT) & left, F.lit(True)).when(last == S.SOFT, right).when(first == S.SOFT, F.lit(False))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def base_share(seq: Column, base: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))) / F.length(seq)


def encode_bases(seq: Column) -> Column:
    """A, T, C, G as 1, 2, 3, 4 and anything else as 0."""
    return F.transform(F.split(seq, ""), lambda b: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in zip("ATCG", (1, 2, 3, 4)) for x in kv]), b), F.lit(0)))


def has_base(seq: Column) -> Column:
    return seq.rlike("[ATCG]")


def share_base(first: Column, second: Column) -> Column:
    return F.arrays_overlap(F.split(first, ""), F.split(second, ""))


def edit_budget(clip: Column, share: float) -> Column:
    return clip * F.lit(share)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def reciprocal(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Sum of the overlap's shares of both spans, each at least 0; an empty span has share 0."""
    shared = overlap(a0, a1, b0, b1)
    part = lambda lo, hi: F.coalesce(F.greatest(F.try_divide(shared.cast("double"), (hi - lo).cast("double")), F.lit(0.0)), F.lit(0.0))
    return part(a0, a1) + part(b0, b1)


def fraction(a0: Column, a1: Column, b0: Column, b1: Column, same_read: Column) -> Column:
    """Closeness of two spans and whether one read supports both."""
    apart = F.abs(a0 - b0) + F.abs(a1 - b1)
    return (F.lit(1.0) - F.try_divide(apart, a1 - a0)) + (F.lit(1.0) - F.try_divide(apart, b1 - b0)) + same_read.cast("int")


def supplementary_text(chrom: Column, pos: Column, strand: Column, cigar: Column, phred: Column, edits: Column) -> Column:
    """An SA tag's entry."""
    return F.concat(F.concat_ws(",", chrom, pos.cast("string"), strand, cigar, phred.cast("string"), edits.cast("string")), F.lit(";"))


def simulated_name(number: Column, chrom: Column, left: Column, right: Column, kind: Column, circle: Column) -> Column:
    """Read name of the simulator: number|chrom|left|right|kind|circle."""
    return F.concat_ws("|", number.cast("string"), chrom, left, right, kind.cast("string"), circle.cast("string"))


def parse_simulated_name(name: Column) -> Column:
    """Parts of a simulated read's name; left and right as arrays of (start, end), two where the read runs over the join."""
    part = F.split(F.split(name, " ")[0], "\\|")

    def ranges(text: Column) -> Column:
        each = lambda r: F.struct(F.split(r, ":")[0].cast("long").alias("start"), F.split(r, ":")[1].cast("long").alias("end"))
        return F.transform(F.split(text, "-"), each)

    return F.struct(
        part[0].cast("long").alias("number"), part[1].alias("chrom"), ranges(part[2]).alias("left"), ranges(part[3]).alias("right"),
        part[4].cast("int").alias("kind"), F.regexp_extract(part[5], "^[0-9]+", 0).cast("int").alias("circle"), F.regexp_extract(name, " ([12]):", 1).alias("mate"),
    )
