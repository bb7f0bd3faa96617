"""All queries of the engine over the projected tables, whole, by name. Numbers are rounded as in their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import curation, scoring
from ..sources import alleles, fixtures, readers, schemas
from . import views
from .oracle import ORACLE_SQL  # noqa: F401  the SQL of the same names

Query = Callable[[SparkSession, str], DataFrame]

SCORE, PERCENT = 6, 4
#: The key set of the lookup query.
LOOKED_UP = ["rs1000001", "rs1000007", "rs1000042", "rs1000100", "rs1000101", "rs1"]


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _full(spark, sf):
    return scoring.full_scores(fixtures.gwas(spark, sf), fixtures.calls(spark, sf))


def _prs(spark, sf):
    return scoring.trait_scores(_full(spark, sf))


def _rare(spark, sf):
    return scoring.rare_variants(fixtures.gwas(spark, sf), fixtures.calls(spark, sf))


def prs_trait(spark, sf):
    prs = rounded(_prs(spark, sf), final_risk=SCORE, population_score=SCORE, percentile=PERCENT)
    return prs.select("sample_id", "trait", "final_risk", "n_chromosomes", "is_or", "population_score", "pmid", "rsid", "category", "n_variants", "percentile")


def full_scored(spark, sf):
    columns = ["sample_id", "rsid", "trait", "row_id", "personal_genotype", "risk_allele", "odds_ratio", "risk_status", "risk_status_category", "other_allele_frequency", "population_score", "final_risk"]
    return rounded(_full(spark, sf).select(*columns), odds_ratio=SCORE, other_allele_frequency=SCORE, population_score=SCORE, final_risk=SCORE)


def scan_catalogue(spark, sf):
    return rounded(fixtures.gwas(spark, sf), odds_ratio=SCORE, population_score=SCORE)


def scan_calls(spark, sf):
    return fixtures.calls(spark, sf)


def risk_status_counts(spark, sf):
    return views.risk_status_counts(_full(spark, sf))


def trait_counts(spark, sf):
    return views.trait_counts(_full(spark, sf))


def category_radar(spark, sf):
    return rounded(views.category_radar(_prs(spark, sf)), mean_percentile=PERCENT)


def sunburst_rollup(spark, sf):
    return views.sunburst(_full(spark, sf))


def disease_overview(spark, sf):
    return rounded(views.disease_overview(_prs(spark, sf)), percentile_normalized=PERCENT)


def density_curve(spark, sf):
    return rounded(views.density_curve(_prs(spark, sf), 1, "Melanoma"), x=SCORE, y=SCORE, z=SCORE, percentile=PERCENT, mark_height=SCORE, axis_height=SCORE)


def trait_report(spark, sf):
    return rounded(views.trait_report(_prs(spark, sf)), percentile=PERCENT)


def trait_detail(spark, sf):
    return rounded(views.trait_detail(_full(spark, sf), "Melanoma"), odds_ratio=SCORE)


def sports_join(spark, sf):
    return views.sports_join(fixtures.calls(spark, sf), views.sports_table(spark))


def popular_snps(spark, sf):
    return views.popular_snps(fixtures.calls(spark, sf))


def cvd_split(spark, sf):
    return views.cvd_split(_full(spark, sf))


def hypertension_sum(spark, sf):
    return rounded(views.hypertension(_prs(spark, sf)), total=SCORE)


def lipid_sum(spark, sf):
    return rounded(views.lipids(_prs(spark, sf)), total=SCORE)


def other_markers(spark, sf):
    return rounded(views.other_markers(_full(spark, sf)), total=SCORE)


def rare_blocks(spark, sf):
    return rounded(_rare(spark, sf), genotype_probability=SCORE, other_allele_frequency=SCORE)


def rare_genotypes(spark, sf):
    return rounded(views.rare_genotypes(_rare(spark, sf)), percent=SCORE)


def rare_mutations(spark, sf):
    return views.rare_mutations(_rare(spark, sf))


def trait_choices(spark, sf):
    return views.trait_choices(_prs(spark, sf))


def trait_overview(spark, sf):
    return rounded(views.trait_overview(_prs(spark, sf)), final_risk=SCORE)


def curated_catalogue(spark, sf):
    return rounded(curation.curate(fixtures.raw_catalogue(spark, sf)), odds_ratio=SCORE, population_score=SCORE)


def category_counts(spark, sf):
    return curation.category_counts(curation.curate(fixtures.raw_catalogue(spark, sf)))


def status_share(spark, sf):
    return rounded(views.status_share(_full(spark, sf)), share=SCORE)


def percentile_histogram(spark, sf):
    return views.percentile_histogram(_prs(spark, sf))


def _allele_dimension(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    dimension = part.select(F.concat(F.lit("rs"), (1000000 + F.col("p_partkey")).cast("string")).alias("refsnp_id"), F.when(F.col("p_partkey") % 2 == 0, "A/G").otherwise("C/T").alias("allele"), (F.col("p_partkey") * 1000).cast("long").alias("chrom_start"), F.when(F.col("p_size") > 25, 1).otherwise(-1).alias("chrom_strand"))
    return dimension


def allele_lookup(spark, sf):
    return curation.allele_lookup(fixtures.gwas(spark, sf), _allele_dimension(spark, sf))


def allele_source(spark, sf):
    """A set of keys looked up through the connector, which opens their buckets alone."""
    folder = readers.scratch(spark, "alleles")
    alleles.write_store(_allele_dimension(spark, sf), folder)
    return alleles.read_store(spark, folder).filter(F.col("refsnp_id").isin(LOOKED_UP))


def has_trait(spark, sf):
    return views.has_trait(_prs(spark, sf), "Melanoma")


def superpopulation_regions(spark, sf):
    return views.superpopulations(spark)


def sport_scores(spark, sf):
    return views.sport_scores(spark)


def power_endurance(spark, sf):
    return views.power_endurance(spark)


def category_lookup(spark, sf):
    return curation.category_table(spark)


def plain_trait_scores(spark, sf):
    return rounded(scoring.plain_trait_scores(_full(spark, sf)), final_risk=SCORE, percentile=PERCENT)


def _calls_from_files(spark, sf):
    """The calls as tab-separated files, a folder a sample, without a header, read back."""
    folder = readers.scratch(spark, "calls")
    calls = fixtures.calls(spark, sf).select("sample_id", "rsid", "chromosome", "position", "genotype")
    calls.repartition("sample_id").write.partitionBy("sample_id").csv(folder, sep="\t")
    return readers.read_calls(spark, f"{folder}/*", sample_id=F.regexp_extract(F.input_file_name(), "sample_id=([^/]+)", 1))


def _catalogue_from_files(spark, sf):
    """The catalogue as CSV with its row names first, read back."""
    folder = readers.scratch(spark, "catalogue")
    columns = [c.strip().split(" ")[0] for c in schemas.GWAS.split(",")]
    readers.write_csv(fixtures.gwas(spark, sf).select(*columns), folder, "row_id")
    return readers.read_catalogue(spark, folder)


def files_calls(spark, sf):
    return _calls_from_files(spark, sf)


def files_catalogue(spark, sf):
    return rounded(_catalogue_from_files(spark, sf), odds_ratio=SCORE, population_score=SCORE)


def files_prs(spark, sf):
    """The trait scores, from files to the end."""
    prs = scoring.trait_scores(scoring.full_scores(_catalogue_from_files(spark, sf), _calls_from_files(spark, sf)))
    return rounded(prs.select("sample_id", "trait", "final_risk", "n_variants", "percentile"), final_risk=SCORE, percentile=PERCENT)


def files_raw_catalogue(spark, sf):
    """The raw association table as tab-separated files under its own column names, read back and curated."""
    folder = readers.scratch(spark, "raw")
    raw = fixtures.raw_catalogue(spark, sf).drop("row_id")
    raw.select(*[F.col(own).alias(name) for name, own in readers.RAW_NAMES.items()], F.lit("x").alias("PLATFORM")).write.csv(folder, sep="\t", header=True)
    return rounded(curation.curate(readers.read_raw_catalogue(spark, folder, readers.RAW_NAMES)), odds_ratio=SCORE, population_score=SCORE)


def files_sports(spark, sf):
    folder = readers.scratch(spark, "sports")
    views.sports_table(spark).coalesce(1).write.csv(folder, sep="\t", header=True)
    return views.sports_join(fixtures.calls(spark, sf), readers.read_sports(spark, folder))


def normal_grid(spark, sf):
    """The grid of the density view with the distribution function beside it."""
    grid = spark.range(1000).select((-4 + F.col("id") * 8 / 999).alias("x"))
    return grid.select(F.round("x", SCORE).alias("x"), F.round(expr.normal_pdf("x"), SCORE).alias("density"), F.round(expr.normal_cdf("x") * 100, PERCENT).alias("percentile"))


_ALL = (
    prs_trait, full_scored, scan_catalogue, scan_calls, risk_status_counts, trait_counts, category_radar, sunburst_rollup, disease_overview, density_curve, trait_report, trait_detail, sports_join, popular_snps,
    cvd_split, hypertension_sum, lipid_sum, other_markers, rare_blocks, rare_genotypes, rare_mutations, trait_choices, trait_overview, curated_catalogue, category_counts, status_share, percentile_histogram,
    allele_lookup, has_trait, superpopulation_regions, sport_scores, power_endurance, category_lookup, normal_grid,
    plain_trait_scores, files_calls, files_catalogue, files_prs, files_raw_catalogue, files_sports, allele_source,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
