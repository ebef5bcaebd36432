"""Mismatched variants of guides and their predicted efficacy."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S

#: Weights of the linear model by 0-based place, substitution and GC content.
WEIGHTS = {
    "intercept": -0.061524905,
    "0": 0.770420411,
    "1": 0.70691691,
    "2": 0.640814024,
    "3": 0.644132625,
    "4": 0.568233226,
    "5": 0.632160337,
    "6": 0.656576057,
    "7": 0.682734689,
    "8": 0.607012613,
    "9": 0.543817942,
    "10": 0.530568259,
    "11": 0.492513171,
    "12": 0.408539158,
    "13": 0.29727904,
    "14": 0.253439641,
    "15": 0.324400133,
    "16": 0.33289759,
    "17": 0.273870337,
    "18": 0.115394825,
    "19": 0.0,
    "AC": -0.00893982,
    "AG": 0.180780492,
    "AT": 0.045718532,
    "CA": -0.166731995,
    "CG": 0.000473642,
    "CT": 0.023749827,
    "GA": -0.100658292,
    "GC": -0.198931276,
    "GT": -0.144115981,
    "TA": -0.038939247,
    "TC": -0.025160812,
    "TG": 0.0,
    "GC_content": 0.729597133,
}
ORIGINAL, VARIANT = ("original", "perfect", "target"), ("variant", "mismatch", "spacer")


def variants(guides: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(original, variant, change_description, y_pred, place, base) of all single substitutions."""
    own = guides.select(F.upper("spacer").alias("original")).where(F.length("spacer") > 0)
    each = own.select("original", F.posexplode(F.split("original", "")).alias("place", "was"))
    each = each.where("was != ''").withColumn("base", F.explode(F.array(*map(F.lit, "ACGT")))).where("base != was")
    changed = F.overlay("original", "base", F.col("place") + 1)
    change = F.concat("was", (F.col("place") + 1).cast("string"), "base")
    out = each.select("original", changed.alias("variant"), change.alias("change_description"), "place", "base")
    return out.withColumn("y_pred", S.y_pred("original", "variant", S.weights_map(weights)))


def series(guides: DataFrame, low: float = 0.0, high: float = 1.0, step: float = 0.1, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(original, variant, change_description, y_pred, nth) of the variants nearest to evenly spaced scores, each taken
    once: for each score in ascending order the nearest that is left, ties by place and base (W3)."""
    scores, bases = S.desired_scores(low, high, step), np.frombuffer(b"ACGT", np.uint8)

    def of_length(texts: list[str], length: int) -> pa.RecordBatch:
        was = np.frombuffer("".join(texts).encode("ascii"), np.uint8).reshape(-1, length)
        n = len(was)
        place = np.array([weights[str(i)] for i in range(length)])
        change = np.zeros((256, 4))
        for x in set(was.reshape(-1).tolist()):
            change[x] = [weights[f"{chr(x)}{chr(b)}"] if x != b else 0.0 for b in bases]
        gc = ((was == ord("G")) | (was == ord("C"))).sum(1).astype(float) / float(length)
        # places, then bases, as one axis; the guide's own base is no variant
        y = (weights["intercept"] + place)[None, :, None] + change[was] + (weights["GC_content"] * gc)[:, None, None]
        y, left = y.reshape(n, -1), (was[:, :, None] != bases).reshape(n, -1)
        most, every, out = int(left.sum(1).min()), np.arange(n), []
        for score in scores[:most]:
            taken = np.where(left, np.abs(y - score), np.inf).argmin(1)
            left[every, taken] = False
            out.append(taken)
        rows, at = np.repeat(every, len(out)), np.array(out, int).reshape(len(out), n).T.reshape(-1)
        named = [(texts[r], i // 4, "ACGT"[i % 4]) for r, i in zip(rows.tolist(), at.tolist(), strict=True)]
        columns = [
            [t for t, _, _ in named],
            [t[:i] + b + t[i + 1 :] for t, i, b in named],
            [f"{t[i]}{i + 1}{b}" for t, i, b in named],
            y[rows, at],
            np.tile(np.arange(len(out), dtype=np.int32), n),
        ]
        types = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["original", "variant", "change_description", "y_pred", "nth"])

    def each(batches):
        for batch in batches:
            by_length = defaultdict(list)
            for text in batch["original"].to_pylist():
                by_length[len(text), sum(b in "ACGT" for b in text)].append(text)
            for (length, _), texts in by_length.items():
                for i in range(0, len(texts), 2_000):
                    yield of_length(texts[i : i + 2_000], length)

    own = guides.select(F.upper("spacer").alias("original")).where(F.length("spacer") > 0).distinct()
    return own.mapInArrow(each, "original string, variant string, change_description string, y_pred double, nth int")


def recalculate(pairs: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Rows of pairs with y_pred, or y_pred_new where y_pred is there already; sequences in upper case.

    Exactly one column must be named as an original and one as a variant.
    """
    found = [[c for c in pairs.columns if c in names] for names in (ORIGINAL, VARIANT)]
    if any(len(x) != 1 for x in found):
        raise ValueError(f"one of {ORIGINAL} and one of {VARIANT} is needed, found {found}")
    a, b = found[0][0], found[1][0]
    rows = pairs.withColumns({a: F.upper(a), b: F.upper(b)})
    return rows.withColumn("y_pred_new" if "y_pred" in pairs.columns else "y_pred", S.y_pred(a, b, S.weights_map(weights)))
