"""Schemas of the record types, and fixed values of the SAM format."""

from __future__ import annotations

READS = (
    "ordinal long, qname string, flag int, ref_id int, chrom string, pos long, mapq int, cigar array<struct<op:int,len:int>>, "
    "next_ref_id int, next_chrom string, next_pos long, tlen long, seq string, qual array<int>, sa string, xa string, nm int, mq int, "
    "tags map<string,string>"
)
CONTIGS = "ref_id int, chrom string, length long"
INTERVALS = "chrom string, start long, end long"
FASTQ = "name string, seq string, qual string"
GENOME = "chrom string, seq string"

#: CIGAR operations by code, and flag bits.
CIGAR_OPS = "MIDNSHP=X"
MATCH, INSERTION, DELETION, SKIP, SOFT, HARD, _, EQUAL, DIFFERENT = range(9)
PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2 = 2, 4, 8, 16, 32, 64, 128
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048
