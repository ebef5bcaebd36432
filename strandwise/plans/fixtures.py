"""Views that turn general tables into genomes, features, guides and reads, in Spark and in DuckDB SQL alike.

Letters of a document's text stand for bases; documents of at least 200 letters are chromosomes, those of even id are
circular. Line items become features, the 20-mer at place 100 of each chromosome a guide, events become reads.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.running import parts_of

#: Line items that a task groups.
LINES = 500_000
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
LEFT, RIGHT, RIGHT_N = "TTGACCTAGA", "GTTTTAGAGC", "GTTNTAGAGC"

CHROM = f"""SELECT doc_id AS chr, seq, CAST(length(seq) AS INT) AS len, doc_id % 2 = 0 AS circular
FROM (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', ''{{g}}), '{LETTERS}', '{BASES}') AS seq
  FROM documents) s WHERE length(seq) >= 200"""

FEATURE = """SELECT chr, concat('LT_', ok, '_', ln) AS locus_tag,
  CASE WHEN ok % 3 = 0 THEN '' ELSE concat('gene', ok % 100) END AS gene, fs AS feature_start,
  CAST(least(len, fs + 30 + CAST(floor(q) AS INT) * 10) AS INT) AS feature_end,
  CASE WHEN rf = 'R' THEN -1 ELSE 1 END AS strand
FROM (SELECT c.chr, c.len, ok, ln, q, rf, CAST((pk * 131 + sk * 17 + ln * 7) % c.len AS INT) AS fs
  FROM (SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk,
      min(l_quantity) AS q, min(l_returnflag) AS rf
    FROM lineitem GROUP BY l_orderkey, l_linenumber) l
  JOIN chrom c ON c.chr = l.ok % (SELECT count(*) FROM documents)) f"""

GUIDE = "SELECT DISTINCT substring(seq, 101, 20) AS spacer FROM chrom"

LIBRARY = """SELECT bc, CAST(row_number() OVER (ORDER BY bc) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT substring(seq, 101, 20) AS bc FROM chrom) b"""

READS = f"""SELECT event_id AS row_idx, concat('{LEFT}',
  CASE WHEN event_type = 'error' THEN concat(substring(bc, 1, 9), translate(substring(bc, 10, 1), 'ACGT', 'CGTA'), substring(bc, 11, 10))
    ELSE bc END,
  CASE WHEN event_id % 97 = 0 THEN '{RIGHT_N}' ELSE '{RIGHT}' END) AS r1
FROM (SELECT event_id, event_type, user_id % (SELECT count(*) FROM library) AS k FROM events) e JOIN library ON idx = k"""

VIEWS = {"chrom": CHROM, "feature": FEATURE, "guide": GUIDE, "library": LIBRARY, "reads": READS}


#: What CHROM's SQL does to a lower-cased text, for bytes in UTF-8.
TURNED = bytes.maketrans(LETTERS.encode(), BASES.encode())
OTHERS = bytes(sorted(set(range(256)) - set(LETTERS.encode())))


def _chromosomes(batches):
    for batch in batches:
        texts = (None if t is None else t.lower().encode().translate(TURNED, OTHERS) for t in batch["text"].to_pylist())
        kept = [(i, t) for i, t in enumerate(texts) if t is not None and len(t) >= 200]
        chr = batch["doc_id"].take(pa.array([i for i, _ in kept], pa.int64()))
        seq = pa.array([t for _, t in kept], pa.binary()).cast(pa.string())
        circular = pa.array([None if x is None else x % 2 == 0 for x in chr.to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([chr, seq, pa.array([len(t) for _, t in kept], pa.int32()), circular], ["chr", "seq", "len", "circular"])


def chromosomes(documents: DataFrame) -> DataFrame:
    """The rows of CHROM's SQL. Spark would work out the text once for the condition and again for each column, letter by letter."""
    return documents.select("doc_id", "text").mapInArrow(_chromosomes, "chr bigint, seq string, len int, circular boolean")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables that the fixtures read, and of the fixtures."""
    for name in ("documents", "lineitem", "events"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "lineitem":  # FEATURE groups by these: dealt out first, so that a task's groups don't grow with the table
            table = table.repartition(parts_of(table, LINES), "l_orderkey", "l_linenumber")
        table.createOrReplaceTempView(name)
    chromosomes(spark.table("documents")).createOrReplaceTempView("chrom")
    for name, sql in VIEWS.items():
        if name == "feature":
            # a subquery in a join's key may not have finished where its side is broadcast; line items are too many to be
            sql = sql.replace("(SELECT count(*) FROM documents)", str(spark.table("documents").count()))
            sql = sql.replace("SELECT c.chr,", "SELECT /*+ MERGE(c, l) */ c.chr,")
        if name != "chrom":
            spark.sql(sql).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture as a DataFrame."""
    register(spark, sf_dir)
    return spark.table(name)


def duckdb_ctes(*names: str) -> str:
    """WITH clause of the fixtures that the names need, in DuckDB's dialect."""
    needs = {"chrom": (), "feature": ("chrom",), "guide": ("chrom",), "library": ("chrom",), "reads": ("library",)}
    order: list[str] = []

    def add(name: str) -> None:
        for x in needs[name]:
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{g}', ", 'g'")})" for n in order)
