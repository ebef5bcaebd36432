"""A composable interface over alignments and features: annotated, unique and unambiguous targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .intervals import overlap_join


class GuideLibrary:
    """Targets of guides, joined to features of the types source and gene.

    sites: (spacer, chr, start, end, strand, before, after, nm); features: (chr, locus_tag, gene, feature_start,
    feature_end, strand, type). Of rows of one guide, the first by place is kept where one is asked for. Sites and features are
    read several times: write them first if they are dear.
    """

    ORDER = ("chr", "start", "end", "feature_start", "feature_end", "locus_tag")

    def __init__(self, sites: DataFrame, features: DataFrame, pam: str, direction: str = "downstream"):
        found = sites.withColumn("pam", S.extract_pam("before", "after", "strand", direction)).drop("before", "after")
        self.sites = found.withColumn("targeting", S.pam_matches(pam, "pam", "[ATCG]"))
        self.features = features.withColumnRenamed("strand", "feature_strand")
        self.targets = self._within(self.sites, self.features)

    @staticmethod
    def _within(sites: DataFrame, features: DataFrame) -> DataFrame:
        return overlap_join(sites, features, ("start", "end"), ("feature_start", "feature_end"))

    def _first(self, rows: DataFrame) -> DataFrame:
        """The first row of each guide, a minimum that is combined before the shuffle."""
        order = F.struct(*(x for c in self.ORDER for x in (F.col(c).isNull(), F.col(c))))  # nulls last
        first = rows.groupBy("spacer").agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
        return first.select("_row.*")

    def source_unique(self) -> DataFrame:
        """The first targeting site of each guide on a chromosome (AG6)."""
        return self._first(self.targets.where("type = 'source' and targeting"))

    def mapped(self) -> DataFrame:
        """Targeting sites within genes with offset and overlap."""
        return self._mapped(self.sites.where("targeting"))

    def _mapped(self, sites: DataFrame) -> DataFrame:
        direction = S.strand_letter("feature_strand")
        return self._within(sites, self.features.where("type != 'source'")).withColumns(
            {
                "offset": S.offset(direction, "start", "end", "feature_start", "feature_end"),
                "overlap": S.overlap("start", "end", "feature_start", "feature_end"),
            }
        )

    def unique(self) -> DataFrame:
        """Mapped sites of guides that have a source target, in genome order."""
        return self._unique().orderBy("chr", "start", "end")

    def _unique(self) -> DataFrame:
        """Sites meet the guides that have a source target before they meet genes, since those are many more rows."""
        sites = self.sites.where("targeting")
        sources = self._within(sites, self.features.where("type = 'source'")).select("spacer").distinct()
        return self._mapped(sites.join(sources, "spacer", "left_semi"))

    def unambiguous(self) -> DataFrame:
        """The first unique site of each guide."""
        return self._first(self._unique())

    def strictly_unique(self) -> DataFrame:
        """Mapped sites of guides that have a single targeting site at all (Q9)."""
        places = self.targets.where("type = 'source' and targeting").groupBy("spacer")
        single = places.agg(F.count_distinct("chr", "start", "strand").alias("n")).where("n = 1")
        return self.mapped().join(single.select("spacer"), "spacer", "left_semi")


def sense_lookup(table: DataFrame, query: str, sense: str = "sense", antisense: str = "antisense") -> DataFrame:
    """Rows that have a sequence on either strand."""
    return table.where((F.col(sense) == query) | (F.col(antisense) == query))
