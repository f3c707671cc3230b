"""Candidate extraction over streams of reads and of mate pairs.

Predicates are stateless, so a batch plan works unchanged on pairs. Pairing keeps, for each read name, the
last first read until its mate comes, or until it is old enough to be forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from annulus.operators.pairs import both_mapped, outward
from annulus.schema import READ1, READ2

#: What a stream's reads are known by.
_FIELDS = ("ordinal", "flag", "chrom", "pos", "mapq")
_READ = "struct<ordinal:long,flag:int,chrom:string,pos:long,mapq:int>"
_STATE = "ordinal long, flag int, chrom string, pos long, mapq int"


def outward_pairs(pairs: DataFrame, mapq: int = 10) -> DataFrame:
    """Outward pairs of a (streaming) table of (r1, r2) structs."""
    return pairs.where(both_mapped() & outward(mapq))


def stream_pairs(reads: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """(qname, r1, r2) of a stream of reads: each second read with the last first read of its name that came before it.

    reads: qname, ordinal, flag, chrom, pos and mapq; within one batch ordinal is the order. With forget_ms a first
    read is forgotten when nothing of its name has come for so long (such a query runs batches without data, too, and ends only when
    it is stopped); without it the state holds every name that still waits.
    """

    def paired(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = dict(zip(_FIELDS, state.get)) if state.exists else None
        rows = pd.concat(list(parts)).sort_values("ordinal")
        found = []
        for row in rows[list(_FIELDS)].to_dict("records"):
            if row["flag"] & READ2 and last is not None:
                found.append((key[0], last, row))
            if row["flag"] & READ1:
                last = row
        if last is not None:
            state.update(tuple(last[f] if last[f] is None or isinstance(last[f], str) else int(last[f]) for f in _FIELDS))
            if forget_ms is not None:
                state.setTimeoutDuration(forget_ms)
        if found:
            yield pd.DataFrame(found, columns=["qname", "r1", "r2"])

    timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    keyed = reads.select("qname", *_FIELDS).groupBy("qname")
    return keyed.applyInPandasWithState(paired, f"qname string, r1 {_READ}, r2 {_READ}", _STATE, "append", timeout)
