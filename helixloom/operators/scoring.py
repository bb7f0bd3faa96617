"""Scored variants, trait scores and rare variants of many samples."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


class Scores(NamedTuple):
    """Lazy tables: every scored variant, every trait's score, the rarest variants."""

    full: DataFrame
    prs: DataFrame
    rare: DataFrame


def matched(gwas: DataFrame, calls: DataFrame) -> DataFrame:
    """Catalogue rows and a sample's calls of one rsid, the first of each (sample, rsid, trait).

    The first catalogue row of an (rsid, trait) and the first call of a (sample, rsid) are taken before the join: the
    same rows as a window over its result, which is many times as large. Spark broadcasts the catalogue if its size
    allows.
    """
    columns = [c for c in gwas.columns if c not in ("rsid", "trait")]
    first = gwas.filter("rsid is not null").groupBy("rsid", "trait").agg(F.min_by(F.struct(*columns), "row_id").alias("g"))
    catalogue = first.select("rsid", "trait", *[F.col(f"g.{c}").alias(c) for c in columns])
    order = F.struct(F.col("position").isNull(), "position", "chromosome", "genotype")
    own = calls.filter("rsid is not null").repartition("sample_id").groupBy("sample_id", "rsid").agg(F.min_by(F.struct("chromosome", "position", "genotype"), order).alias("c"))
    own = own.select("sample_id", "rsid", F.col("c.chromosome").alias("chromosome"), F.col("c.position").alias("position"), F.col("c.genotype").alias("personal_genotype"))
    return own.join(catalogue, "rsid")


def annotated(rows: DataFrame) -> DataFrame:
    """Adds risk_status, other_allele_frequency and risk_status_category."""
    return rows.withColumn("risk_status", expr.risk_status("personal_genotype")).withColumns({"other_allele_frequency": 1 - F.col("risk_allele_frequency"), "risk_status_category": expr.status_category()})


def full_scores(gwas: DataFrame, calls: DataFrame) -> DataFrame:
    """FULL: odds_ratio is signed by direction; rows without a final_risk are dropped."""
    rows = annotated(matched(gwas, calls)).withColumn("odds_ratio", expr.signed_effect())
    return rows.withColumn("final_risk", expr.final_risk()).filter(F.col("final_risk").isNotNull() & ~F.isnan("final_risk"))


def trait_scores(full: DataFrame) -> DataFrame:
    """PRS: one row for each sample and trait. Lists are sorted; "first" is by row_id, nulls skipped."""
    # rows go to their samples as they are: lists and sets of the map tasks' groups, which hold a row or two each where
    # the catalogue is shuffled by rsid, take several times the disk
    kept = ["sample_id", "trait", "row_id", "final_risk", "population_score", "is_or", "category", "pmid", "rsid", "chromosome"]
    return (
        full.filter("trait is not null")
        .select(*kept)
        .repartition("sample_id")
        .groupBy("sample_id", "trait")
        .agg(
            # views colour by the sign of it
            expr.exact_sum("final_risk").alias("final_risk"),
            # a set of two dozen at most: a distinct count would aggregate in four phases
            F.size(F.collect_set("chromosome")).cast("long").alias("n_chromosomes"),
            F.min_by("is_or", F.when(F.col("is_or").isNotNull(), F.col("row_id"))).alias("is_or"),
            expr.exact_sum("population_score").alias("population_score"),
            expr.distinct_csv("pmid").alias("pmid"),
            expr.distinct_csv("rsid").alias("rsid"),
            F.min_by("category", F.when(F.col("category").isNotNull(), F.col("row_id"))).alias("category"),
            F.count("*").alias("n_variants"),
        )
        .withColumn("percentile", expr.normal_cdf("final_risk") * 100)
    )


def rare_variants(gwas: DataFrame, calls: DataFrame, n: int = 5, hardy_weinberg: bool = False) -> DataFrame:
    """RARE: of each sample, blocks of the ``n`` rarest risk variants (1), protective ones (2) and genotypes (3).

    Variants in several blocks stand in each. Ties go to the lower row_id; nulls come last. No-calls are left out. The
    joined rows are made once: each is tagged with its blocks, and one window takes the first of every block, which Spark
    limits before the shuffle.
    """
    rows = annotated(matched(gwas, calls)).filter(~F.coalesce(F.contains("personal_genotype", F.lit("-")), F.lit(False)))
    rows = rows.withColumn("genotype_probability", expr.genotype_probability(hardy_weinberg=hardy_weinberg))

    def tag(block: int, key: str):
        return F.struct(F.lit(block).alias("block"), F.col(key).alias("key"))

    third = tag(3, "genotype_probability")
    tags = F.when(F.col("risk_status") > 0, F.array(tag(1, "risk_allele_frequency"), third)).when(F.col("risk_status") == 0, F.array(tag(2, "other_allele_frequency"), third)).otherwise(F.array(third))
    tagged = rows.withColumn("tag", F.explode(tags)).select("*", "tag.*")
    order = Window.partitionBy("sample_id", "block").orderBy(F.col("key").asc_nulls_last(), "row_id")
    ranked = tagged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("sample_id", "block", "rank", "rsid", "risk_allele", "risk_allele_frequency", "gene", "category", "personal_genotype", "other_allele_frequency", "genotype_probability")


def plain_trait_scores(full: DataFrame) -> DataFrame:
    """The plainer aggregate: per sample and odds-ratio trait the sum of ``log_risk``, the number of its variants, and what
    the first of them by row_id has. ``full`` has the signed effect; that of an odds ratio is the effect itself."""
    rows = full.filter("trait is not null").withColumn("risk", expr.log_risk()).filter(F.col("risk").isNotNull() & ~F.isnan("risk"))
    kept = ["rsid", "risk_allele", "pmid", "chromosome", "personal_genotype", "is_or"]
    first = F.min_by(F.struct(*kept), F.struct("row_id", "rsid")).alias("first")
    found = rows.groupBy("sample_id", "trait").agg(F.sum("risk").alias("final_risk"), F.count("*").alias("n_risk_snps"), first)
    found = found.select("sample_id", "trait", "final_risk", "n_risk_snps", "first.*")
    return found.filter("is_or").withColumn("percentile", expr.normal_cdf("final_risk") * 100)


def score(gwas: DataFrame, calls: DataFrame) -> Scores:
    full = full_scores(gwas, calls)
    return Scores(full, trait_scores(full), rare_variants(gwas, calls))


def stored(scores: Scores, folder: str) -> Scores:
    """The scores as Parquet tables of a folder, computed once for all views: FULL is written, PRS is made of what was
    written, and views read files in place of the joins."""
    spark = scores.full.sparkSession
    scores.full.write.mode("overwrite").parquet(f"{folder}/full")
    full = spark.read.parquet(f"{folder}/full")
    trait_scores(full).write.mode("overwrite").parquet(f"{folder}/prs")
    scores.rare.write.mode("overwrite").parquet(f"{folder}/rare")
    return Scores(full, spark.read.parquet(f"{folder}/prs"), spark.read.parquet(f"{folder}/rare"))
