"""Column functions over reads: sequence, CIGAR, qualities and probabilities. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """The sequence as read from the other strand; letters other than A, C, G, T stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def mean_phred(quals: Column) -> Column:
    """Phred score of the mean error probability of an array of Phred scores; null for a null or empty array."""
    total = F.aggregate(quals, F.lit(0.0), lambda a, q: a + F.pow(F.lit(10.0), q / F.lit(-10.0)))
    return F.when(F.size(quals) > 0, F.lit(-10.0) * F.log10(total / F.size(quals)))


def mean_phred_agg(qual: Column) -> Column:
    """The same as an aggregate over rows; null scores do not count."""
    return F.lit(-10.0) * F.log10(F.avg(F.pow(F.lit(10.0), qual / F.lit(-10.0))))


def any_modified(prob: Column) -> Column:
    """Probability that at least one base is modified: 1 - product of (1 - p) over p >= 0.5, where p = 1 counts as 254/255. An
    aggregate; 0 without such a p."""
    p = F.when(prob == 1, F.lit(254 / 255)).otherwise(prob)
    return F.lit(1.0) - F.exp(F.coalesce(F.sum(F.when(prob.between(0.5, 1), F.ln(1 - p))), F.lit(0.0)))


def rounded_probability(prob: Column) -> Column:
    """A 0-255 probability as a share with two digits, half to even."""
    return F.bround(prob / F.lit(255.0), 2)


def mod_family(mod: Column) -> Column:
    """A for adenine codes, C for cytosine codes, else null; codes that contain the letter pool together."""
    return F.when(mod.contains("A"), "A").when(mod.contains("C"), "C")


def mod_label(mod: Column) -> Column:
    """The display name: A or CG."""
    return F.when(mod.contains("A"), "A").when(mod.contains("C"), "CG")


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n bigint, op string>>; null for a null CIGAR or *."""
    parsed = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.expr("1").cast("bigint").alias("_"), x.alias("t")))
    return F.when(
        cigar.isNotNull() & (cigar != "*"),
        F.transform(parsed, lambda x: F.struct(F.regexp_extract(x["t"], r"\d+", 0).cast("bigint").alias("n"), F.right(x["t"], F.lit(1)).alias("op"))),
    )


def _consumed(ops: Column, letters: str) -> Column:
    return F.aggregate(ops, F.lit(0).cast("bigint"), lambda a, x: a + F.when(F.lit(letters).contains(x["op"]), x["n"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    """Reference bases an alignment spans: M, D, N, = and X."""
    return _consumed(cigar_ops(cigar), "MDN=X")


def query_length(cigar: Column) -> Column:
    """Read bases of the record: M, I, S, = and X."""
    return _consumed(cigar_ops(cigar), "MIS=X")


def aligned_blocks(cigar: Column, start: Column) -> Column:
    """array<struct<qstart, rstart, len>> of the aligned stretches, positions 0-based; one pass over the operations."""
    step = lambda a, x: F.struct(
        (a["q"] + F.when(F.lit("MIS=X").contains(x["op"]), x["n"]).otherwise(0)).alias("q"),
        (a["r"] + F.when(F.lit("MDN=X").contains(x["op"]), x["n"]).otherwise(0)).alias("r"),
        F.when(F.lit("M=X").contains(x["op"]), F.array_append(a["b"], F.struct(a["q"].alias("qstart"), a["r"].alias("rstart"), x["n"].alias("len")))).otherwise(a["b"]).alias("b"),
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("q"), start.cast("bigint").alias("r"), F.array().cast("array<struct<qstart:bigint,rstart:bigint,len:bigint>>").alias("b"))
    return F.aggregate(cigar_ops(cigar), zero, step, lambda a: a["b"])


def aligned_quals(quals: Column, cigar: Column) -> Column:
    """Qualities without the soft-clipped ends."""
    bare = F.regexp_replace(cigar, r"\d+H", "")
    lead = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(bare, r"^(\d+)S", 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
    trail = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(bare, r"[MIDNP=X](\d+)S$", 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
    return F.slice(quals, lead + 1, F.greatest(F.size(quals) - lead - trail, F.lit(0)))
