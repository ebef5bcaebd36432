"""The filter before an alignment against plain loops: it loses no window, and lets few others through."""

import random

import pytest

from strandwise.operators import near


@pytest.fixture(scope="module")
def lines(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ACGT") for _ in range(n)), n, i % 2 == 0) for i, n in enumerate((70_000, 900, 24, 21))]
    return rows, spark.createDataFrame(rows, "chr int, seq string, len int, circular boolean").cache()


@pytest.mark.parametrize(("mismatches", "most"), [(0, 24), (1, 24), (2, 24), (1, 0)])
def test_windows_near_guides(spark, lines, monkeypatch, mismatches, most):
    rows, table = lines
    monkeypatch.setattr(near, "MOST", most)  # 0: one word, which is full
    r, reads, all_windows = random.Random(mismatches), set(), 0
    for _ in range(40):
        _, seq, n, _ = rows[r.randrange(2)]
        at = r.randrange(n - 20)
        text = list(seq[at : at + 20])
        for place in r.sample(range(20), mismatches):
            text[place] = r.choice("ACGT")
        reads.add("".join(text))
    expected = set()
    for c, seq, n, ring in rows:
        whole = seq + seq[:19] if ring else seq
        for i in range(len(whole) - 19):
            all_windows += 1
            w = whole[i : i + 20]
            if any(sum(a != b for a, b in zip(w, g, strict=True)) <= mismatches for g in reads):
                expected.add((c, i, w))
    found = near.near_windows(table, spark.createDataFrame([(g,) for g in reads], "read string"), [20], mismatches).collect()
    assert expected <= {(x.chr, x.start, x.window) for x in found}
    assert len(found) <= (len(expected) + 0.01 * all_windows if most else all_windows)
