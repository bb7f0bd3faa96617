"""Curation of a raw association table into the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..sources import reference_data


def category_table(spark: SparkSession, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """trait, category: the first category in order that lists a trait."""
    first: dict[str, str] = {}
    for category, traits in (categories or reference_data.TRAIT_CATEGORIES).items():
        for trait in traits:
            first.setdefault(trait, category)
    return spark.createDataFrame(list(first.items()), "trait string, category string")


def curate(raw: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Associations with an effect, one risk allele, a frequency and an interval in a known form, with flags, population
    score and category. A replication size fails only if it says NA. Traits with any odds ratio have a category
    ("Other" if none lists them); others have none."""
    ci = F.col("ci_text")
    rows = raw.filter(F.col("odds_or_beta").isNotNull()).withColumn("risk_allele", expr.allele_after_dash("strongest_allele")).filter("risk_allele != '?'")
    rows = rows.filter(F.col("frequency").isNotNull()).filter(ci.rlike(r"(?i)\[.*\]( unit increase| unit decrease)$") | ci.rlike(r"(?i)^\[.*\]$"))
    rows = rows.withColumns({"is_or": ~ci.rlike("(?i)unit"), "trait_direction": F.when(ci.rlike("(?i)unit increase"), "increase").when(ci.rlike("(?i)unit decrease"), "decrease")})
    rows = rows.filter(F.coalesce(F.col("replication_size") != "NA", F.lit(True)) & ~ci.rlike("(?i)NR") & F.col("snps").rlike("(?i)rs") & (F.col("odds_or_beta") < 100) & (F.length("risk_allele") == 1))
    rows = rows.select(
        *(["row_id"] if "row_id" in raw.columns else []),
        "trait",
        F.col("odds_or_beta").alias("odds_ratio"),
        "risk_allele",
        F.col("ci_text").alias("confidence_interval"),
        F.col("snps").alias("rsid"),
        "is_or",
        "pmid",
        F.expr("try_cast(frequency AS double)").alias("risk_allele_frequency"),
        "trait_direction",
        "gene",
    ).withColumn("population_score", expr.population_score())
    return with_categories(rows, categories if categories is not None else category_table(raw.sparkSession))


def with_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """The category table is the literal list, or the caller's; Spark broadcasts it by its size."""
    odds = rows.filter("is_or").select("trait").distinct()
    mapped = odds.join(categories, "trait", "left").withColumn("category", F.coalesce("category", F.lit("Other")))
    return rows.join(mapped, "trait", "left")


def category_counts(curated: DataFrame) -> DataFrame:
    """Odds-ratio rows by category, the commonest first, equals by name; as many rows as there are categories."""
    return curated.filter("is_or").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def allele_lookup(keys: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows of an allele dimension (refsnp_id, allele, chrom_start, chrom_strand) for a set of rsids: a connector's key
    set is pushed down as a semi join."""
    return dimension.join(keys.select(F.col("rsid").alias("refsnp_id")).distinct(), "refsnp_id", "left_semi")
