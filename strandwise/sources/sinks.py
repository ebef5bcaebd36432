"""Writers: tables, counts, FASTA, FASTQ and compressed read files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated text, null as None (K1, K8)."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=header, nullValue="None", emptyValue="")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON record a line (K2)."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_json_array(rows: DataFrame, path: str) -> None:
    """One JSON array for each partition's file, null fields included (K2); rows.coalesce(1) gives a single one."""

    def arrays(batches):
        import pandas as pd

        first = True
        for batch in batches:
            lines = batch["record"].tolist()
            if lines:
                yield pd.DataFrame({"value": [("[" if first else ",") + lines[0], *("," + x for x in lines[1:])]})
                first = False
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    records = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    records.mapInPandas(arrays, "value string").write.mode("overwrite").text(path)


def integral(rows: DataFrame) -> DataFrame:
    """Float columns of whole numbers only as bigint, null kept (F30): one aggregate of a row decides."""
    floats = [f.name for f in rows.schema if f.dataType.simpleString() in ("float", "double")]
    if not floats:
        return rows
    whole = rows.agg(*(F.coalesce(F.bool_and(F.col(c) == F.floor(F.col(c))), F.lit(True)).alias(c) for c in floats)).first()
    return rows.withColumns({c: F.col(c).cast("bigint") for c in floats if whole[c]})


def write_counts(counts: DataFrame, path: str) -> None:
    """Barcode and count of documented barcodes, without header (K3)."""
    write_tsv(counts.where("documented").select("barcode", "count"), path, header=False)


def fasta(name: Column | str, seq: Column | str) -> Column:
    """A FASTA record (K5)."""
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def fastq(name: Column | str, seq: Column | str) -> Column:
    """A FASTQ record of quality 40 throughout (K6)."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq)))


def write_fasta(rows: DataFrame, path: str, name: str = "spacer", seq: str = "spacer") -> None:
    rows.select(fasta(name, seq)).write.mode("overwrite").text(path)


def write_fastq(rows: DataFrame, path: str, name: str = "spacer", seq: str = "spacer") -> None:
    rows.select(fastq(name, seq)).write.mode("overwrite").text(path)


def write_reads(rows: DataFrame, path: str) -> None:
    """Aligned, sorted read columns as Parquet compressed by zstd (K4); order and alignment of the rows stay."""
    rows.write.mode("overwrite").parquet(path, compression="zstd")


def write_read_files(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """Each read column as text files of a folder ``path/<column>.reads``, one read a line (K4).

    Part files of all columns hold the same rows in the same order, since all come from one stored copy. compression: a
    codec that the cluster's Hadoop has; zstd often needs a native library.
    """
    held = cut(rows)
    for column in rows.columns:
        held.select(column).write.mode("overwrite").option("compression", compression).text(f"{path}/{column}.reads")
