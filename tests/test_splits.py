"""The splittable reader against the serial one, and files put together lane by lane."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators import distill
from strandwise.sources import fastx, splits


def fastq(n, seed, ends="\n"):
    """Records whose quality lines often begin with the signs that headers begin with, and some without a base."""
    r, out = random.Random(seed), []
    for i in range(n):
        k = r.choice([0, 1, 7, 40, 200])
        seq = "".join(r.choice("ACGTN") for _ in range(k))
        qual = "".join(r.choice("@+I#") for _ in range(k))
        out.append(f"@r{i}@+{'x' * r.randrange(30)} rest{ends}{seq}{ends}+{r.choice(['', '@r'])}{ends}{qual}{ends}")
    return "".join(out)


def same(spark, path, split):
    serial = fastx.read_fastx(spark, path).select("file", "row_idx", "id", "seq", "qual")
    scanned = splits.scan_reads(spark, path, split=split)
    found = splits.number_reads(scanned)
    assert sorted(map(str, found.collect())) == sorted(map(str, serial.collect()))
    return scanned


@pytest.mark.parametrize("split", [1, 37, 500, 1 << 20])
def test_ranges_hold_each_record_once(tmp_path, split):
    """Every range of every file, without Spark: plain and block gzip, whatever the bounds."""
    texts = {"a.fastq": fastq(40, 1), "b.fastq": fastq(30, 2, "\r\n").rstrip("\r\n"), "c.reads": "ACGT\n\nTT\nG", "d.fa": ">x y\nAC\n\nGT\n>z\n>w\nTT", "e.fastq": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
        splits.write_bgzf(str(tmp_path / f"{name}.gz"), text.encode(), 97)
        splits.write_bgzf(str(tmp_path / f"one_{name}.gz"), text.encode())
        with gzip.open(tmp_path / f"plain_{name}.gz", "wt", newline="") as f:
            f.write(text)
    for path in sorted(tmp_path.iterdir()):
        uri, size = f"file:{path}", path.stat().st_size
        serial = list(fastx.records(fastx.kind_of(uri), fastx.lines(uri)))
        parts = splits.ranges([(uri, size)], None, split) if size else []
        assert len(parts) == (1 if path.name.startswith("plain_") and path.suffix == ".gz" else -(-size // split))
        assert [x for part in parts for x in splits.read_range(part)] == serial, path


def test_one_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(fastq(3000, 3))
    splits.write_bgzf(str(tmp_path / "b.fastq.gz"), fastq(3000, 4).encode(), 5000)
    scanned = same(spark, str(tmp_path / "*.fastq*"), 20_000)
    tasks = scanned.select("file", F.spark_partition_id().alias("p")).distinct().groupBy("file").count().collect()
    assert len(tasks) == 2 and all(row["count"] > 3 for row in tasks)
    assert splits.scan_reads(spark, str(tmp_path / "*.fastq*")).select("seq").count() == 6000


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.reads").write_text("")
    assert splits.scan_reads(spark, str(tmp_path / "a.reads")).count() == 0
    (tmp_path / "b.reads.gz").write_bytes(b"\x1f\x8b\x08\x04no gzip at all, but long enough")
    with pytest.raises(Exception, match="gzip|header|end-of-stream|Truncated|invalid"):
        splits.scan_reads(spark, str(tmp_path / "b.reads.gz")).count()
    (tmp_path / "c.bam").write_text("x")
    with pytest.raises(Exception, match="unknown kind"):
        splits.scan_reads(spark, str(tmp_path / "c.bam")).count()
    splits.write_bgzf(str(tmp_path / "d.reads.gz"), b"".join(b"ACGT%d\n" % i for i in range(500)), 100)
    data = (tmp_path / "d.reads.gz").read_bytes()
    at = splits.block_size(data) + 30  # within the second block
    (tmp_path / "d.reads.gz").write_bytes(data[:at] + b"???" + data[at + 3 :])
    with pytest.raises(Exception, match="damaged|decompressing"):
        splits.scan_reads(spark, str(tmp_path / "d.reads.gz"), split=200).count()


def test_lanes_pair_with_their_own_mates(spark, tmp_path):
    """Two lanes of two mates give their own pairs only, as far as both go, numbered on from lane to lane."""
    sides = {"R1": [["A1", "A2", "A3"], ["B1", "B2"]], "R2": [["a1", "a2"], ["b1", "b2", "b3"]]}
    for mate, files in sides.items():
        for lane, reads in enumerate(files):
            (tmp_path / f"L{lane}_{mate}.reads").write_text("\n".join(reads) + "\n")
    read = [splits.number_reads(splits.scan_reads(spark, str(tmp_path / f"*_{m}.reads"), split=3)) for m in sides]
    expected = [(0, "A1", "a1"), (1, "A2", "a2"), (2, "B1", "b1"), (3, "B2", "b2")]
    assert sorted(map(tuple, fastx.paired(*read).collect())) == expected
    assert sorted(map(tuple, distill.zip_reads([fastx.read_fastx(spark, str(tmp_path / f"*_{m}.reads")) for m in sides]).collect())) == expected
    with pytest.raises(ValueError, match="different numbers of files"):
        fastx.paired(read[0], read[1].where("file like '%L0%'"))
