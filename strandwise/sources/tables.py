"""Tables of guides, barcodes, model weights and alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header, None standing for null."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="None")


def read_library(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct barcodes (bc) of a named column of a tab-separated table."""
    table = spark.read.csv(path, sep="\t", header=True)
    if column not in table.columns:
        raise ValueError(f"no column {column} in {path}")
    return table.select(F.upper(column).alias("bc")).where("bc is not null").distinct()


def barcodes(spark: SparkSession, values: list[str]) -> DataFrame:
    """Distinct barcodes of a list."""
    return spark.createDataFrame([(v.upper(),) for v in values], "bc string").distinct()


def read_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """Weights of a model of a few dozen features from a table (feature, weight, ...)."""
    rows = spark.read.csv(path, header=True).select("feature", F.col("weight").cast("double")).collect()
    return {r.feature: r.weight for r in rows}


def reference_bases(seq: Column, cigar: Column, md: Column) -> Column:
    """The bases of the chromosome under an alignment, from its sequence, CIGAR and MD; null if any is.

    Soft-clipped and inserted bases have none; MD tells matches, substituted and deleted bases.
    """
    ops = F.transform(
        F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])")), lambda x: F.struct(F.left(x, F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op"))
    )
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))

    def along(state: Column, x: Column) -> Column:
        read = x["op"].isin("M", "=", "X", "I", "S")
        text = F.when(x["op"].isin("M", "=", "X"), F.concat(state["text"], F.substring(seq, state["at"], x["n"]))).otherwise(state["text"])
        return F.struct((state["at"] + F.when(read, x["n"]).otherwise(0)).alias("at"), text.alias("text"))

    laid = F.aggregate(ops, start, along)["text"]

    def turned(state: Column, x: Column) -> Column:
        n = F.when(x.rlike(r"\A\d"), x.try_cast("int"))
        deleted = x.startswith("^")
        step = F.when(n.isNotNull(), n).when(deleted, 0).otherwise(1)
        text = F.when(n.isNotNull(), F.substring(laid, state["at"], n)).when(deleted, F.substring(x, F.lit(2), F.length(x))).otherwise(x)
        return F.struct((state["at"] + step).alias("at"), F.concat(state["text"], text).alias("text"))

    return F.aggregate(F.regexp_extract_all(F.upper(md), F.lit(r"(\d+|\^[A-Z]+|[A-Z])")), start, turned)["text"]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(name, spacer, chr, start, end, strand, nm, mapped, target) of alignments in SAM text.

    Rows without a sequence are left out; a reverse alignment's sequence is turned back. target is what the chromosome
    has there, in the guide's direction, from CIGAR and MD; null without MD. end follows from CIGAR.
    """
    from ..functions.seq import oriented, rev_comp_iupac

    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c"), "value")
    flag = F.col("c")[1].cast("int")
    back, mapped = flag.bitwiseAND(16) != 0, flag.bitwiseAND(4) == 0
    seq, cigar, start = F.upper(F.col("c")[9]), F.col("c")[5], F.col("c")[3].cast("int") - 1
    md = F.nullif(F.regexp_extract("value", r"\tMD:Z:(\S+)", 1), F.lit(""))
    spans = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]")), lambda x: x.cast("int"))
    covered = F.aggregate(spans, F.lit(0), lambda a, b: a + b)
    strand = F.when(mapped, F.when(back, "R").otherwise("F"))
    out = lines.select(
        F.col("c")[0].alias("name"),
        F.when(back, rev_comp_iupac(seq)).otherwise(seq).alias("spacer"),
        F.when(mapped, F.col("c")[2]).alias("chr"),
        F.when(mapped, start).alias("start"),
        F.when(mapped, start + F.when(F.size(spans) > 0, covered).otherwise(F.length(seq))).alias("end"),
        strand.alias("strand"),
        F.coalesce(F.regexp_extract("value", r"\tNM:i:(\d+)", 1).try_cast("int"), F.lit(0)).alias("nm"),
        mapped.alias("mapped"),
        F.when(mapped, oriented(reference_bases(seq, cigar, md), strand)).alias("target"),
    )
    return out.where("spacer != '*'")


def write_sam(aligned: DataFrame, path: str) -> None:
    """Ungapped alignments (spacer, chr, start, end, strand, nm, target) as SAM text without header, the spacer being the name;
    rows without chr are unmapped."""
    from ..functions.seq import oriented

    seq, there = oriented("spacer", "strand"), oriented("target", "strand")
    places = F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("text"))

    def step(state: Column, i: Column) -> Column:
        x, y = F.substring(seq, i, F.lit(1)), F.substring(there, i, F.lit(1))
        other = F.struct(F.lit(0).alias("n"), F.concat(state["text"], state["n"].cast("string"), y).alias("text"))
        return F.when(x == y, F.struct((state["n"] + 1).alias("n"), state["text"].alias("text"))).otherwise(other)

    md = F.aggregate(places, start, step, lambda s: F.concat(s["text"], s["n"].cast("string")))
    mapped = F.col("chr").isNotNull()
    fields = [
        F.col("spacer"),
        F.when(~mapped, "4").when(F.col("strand") == "R", "16").otherwise("0"),
        F.when(mapped, F.col("chr").cast("string")).otherwise("*"),
        F.when(mapped, (F.col("start") + 1).cast("string")).otherwise("0"),
        F.lit("255"),
        F.when(mapped, F.concat(F.length("spacer").cast("string"), F.lit("M"))).otherwise("*"),
        F.lit("*"),
        F.lit("0"),
        F.lit("0"),
        F.when(mapped, seq).otherwise(F.col("spacer")),
        F.repeat(F.lit("I"), F.length("spacer")),
        F.when(mapped, F.concat(F.lit("NM:i:"), F.col("nm").cast("string"))),
        F.when(mapped, F.concat(F.lit("MD:Z:"), md)),
    ]
    aligned.select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(path)
