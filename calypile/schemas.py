"""The fixed schemas of the engine's tables, as DDL."""

from __future__ import annotations

READS = "sample string, read_idx bigint, name string, flag int, chr string, start bigint, `end` bigint, mapq int, cigar string, seq string, quals array<int>, mm string, ml array<int>"
REGIONS = "bed_id string, region_idx bigint, chr string, begin_pos bigint, end_pos bigint, strand string"
CALLS = "sample string, id string, read_name string, chr string, pos bigint, prob int, mod string"
PILEUP = "sample string, id string, chr string, pos bigint, mod string, methylated_bases bigint, total_bases bigint"
QC_READS = "sample string, name string, chr string, start bigint, `end` bigint, length bigint, strand string, mapq int, ave_baseq double, ave_alignq double"

