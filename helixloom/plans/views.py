"""The derived views. Each takes the scored tables of many samples and returns a tidy table keyed by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..sources import reference_data as ref


class MissingInput(ValueError):
    """A view was asked for without its input."""


def require(df: DataFrame | None) -> DataFrame:
    if df is None:
        raise MissingInput("no genotype calls have been scored yet")
    return df


def trait_counts(full: DataFrame) -> DataFrame:
    return full.filter("trait is not null").groupBy("sample_id", "trait").agg(F.count("*").alias("n"))


def risk_status_counts(full: DataFrame) -> DataFrame:
    return full.groupBy("sample_id", "risk_status").agg(F.count("*").alias("n"))


def category_radar(prs: DataFrame) -> DataFrame:
    return prs.filter("is_or and category is not null").groupBy("sample_id", "category").agg(F.avg("percentile").alias("mean_percentile"))


def sunburst(full: DataFrame) -> DataFrame:
    """Leaves, status nodes and the root by one roll-up, with labels, parents and colours."""
    rows = full.filter("is_or").select("sample_id", "risk_status_category", F.coalesce("category", F.lit("Unknown")).alias("category"))
    # the sample is in every grouping set, so each sample has a root of its own
    groups = rows.groupingSets([["sample_id", "risk_status_category", "category"], ["sample_id", "risk_status_category"], ["sample_id"]], "sample_id", "risk_status_category", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    node = F.when(F.col("risk_status_category") == "bad", "Predisposition").otherwise("Protective")
    sign = F.when(F.col("risk_status_category") == "bad", "(-) ").otherwise("(+) ")
    label = F.when(F.col("level") == 0, F.concat(sign, "category")).when(F.col("level") == 1, node).otherwise("SNPs")
    parent = F.when(F.col("level") == 0, node).when(F.col("level") == 1, "SNPs").otherwise("")
    colour = F.when(F.col("level") == 0, expr.mapped("category", ref.CATEGORY_COLOURS, ref.DEFAULT_COLOUR)).otherwise(expr.mapped("label", ref.NODE_COLOURS, ref.DEFAULT_COLOUR))
    return groups.withColumns({"label": label, "parent": parent}).select("sample_id", "label", "parent", "n", colour.alias("colour"))


def _blocked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in ref.BLOCKED_TRAITS], "trait string")


def disease_overview(prs: DataFrame) -> DataFrame:
    rows = prs.filter("is_or").join(_blocked(prs.sparkSession), "trait", "left_anti")
    centred = F.col("percentile") - 50
    return rows.select("sample_id", "trait", "category", centred.alias("percentile_normalized"), F.when(centred > 0, "red").otherwise("green").alias("colour"))


def trait_overview(prs: DataFrame) -> DataFrame:
    return prs.filter("not is_or").select("sample_id", "trait", "final_risk", F.when(F.col("final_risk") > 0, "blue").otherwise("orange").alias("colour"))


def density_curve(prs: DataFrame, sample_id, trait: str, points: int = 1000) -> DataFrame:
    """The standard normal density from -4 to 4, with the side of the sample's score (the point itself is on both) and
    the heights for its mark and the axis, parts of the highest point of the grid. Empty if the sample has no such
    odds-ratio trait."""
    grid = prs.sparkSession.range(points).select((-4 + F.col("id") * 8 / (points - 1)).alias("x")).withColumn("y", expr.normal_pdf("x"))
    score = prs.filter((F.col("sample_id") == sample_id) & (F.col("trait") == trait) & F.col("is_or")).select(F.col("final_risk").alias("z"), "percentile").groupBy().agg(F.min(F.struct("z", "percentile")).alias("s")).filter("s is not null").select("s.*")
    # one row at most beside the grid, and one with its top
    rows = grid.join(F.broadcast(score), F.lit(True)).join(F.broadcast(grid.agg(F.max("y").alias("top"))), F.lit(True))
    top = F.col("top")
    sided = rows.withColumn("side", F.explode(F.when(F.col("x") < F.col("z"), F.array(F.lit("below"))).when(F.col("x") > F.col("z"), F.array(F.lit("above"))).otherwise(F.array(F.lit("below"), F.lit("above")))))
    return sided.select("x", "y", "side", "z", "percentile", (top * 0.9).alias("mark_height"), (top * 1.1).alias("axis_height"))


def trait_report(prs: DataFrame) -> DataFrame:
    """Percentile and true numbers of publications and variants behind each trait."""
    return prs.select("sample_id", "trait", "percentile", F.size(F.split("pmid", ",")).cast("long").alias("n_pmids"), F.size(F.split("rsid", ",")).cast("long").alias("n_snps"))


def trait_detail(full: DataFrame, trait: str) -> DataFrame:
    n = expr.occurrences("personal_genotype", "risk_allele")
    order = Window.partitionBy("sample_id").orderBy(F.desc_nulls_last("odds_ratio"), "row_id")
    rows = full.filter(F.col("trait") == trait)
    colour = F.when(n == 2, "red").when(n == 1, "yellow").otherwise("none")
    return rows.select("sample_id", "rsid", "gene", "personal_genotype", "risk_allele", "odds_ratio", "risk_allele_frequency", "confidence_interval", "pmid", "risk_status_category", colour.alias("colour"), F.row_number().over(order).cast("long").alias("position_in_list"))


def sports_table(spark: SparkSession) -> DataFrame:
    from ..sources import schemas

    rows = [tuple(None if i == 2 else v for i, v in enumerate(r)) for r in ref.SPORTS_SNPS]
    return spark.createDataFrame(rows, schemas.SPORTS)


def sports_join(calls: DataFrame | None, sports: DataFrame) -> DataFrame:
    calls = require(calls)
    return calls.join(sports, calls.rsid == sports.SNP).select("sample_id", "rsid", sports.gene.alias("gene"), "genotype", "power_allele", "endurance_allele", F.col("Comment").alias("comment"))


def popular_snps(calls: DataFrame | None) -> DataFrame:
    """Well-known variants that a sample has calls for. Vendor ids are replaced in every text column."""
    calls = require(calls)
    renamed = calls.replace(ref.VENDOR_RSIDS)
    table = calls.sparkSession.createDataFrame(ref.POPULAR_SNPS, "rsid string, description string, effect_allele string")
    n = expr.occurrences("genotype", "effect_allele")
    colour = F.when(n == 2, "green").when(n == 1, "yellow").when(n == 0, "red").otherwise("none")
    return renamed.join(table, "rsid").select("sample_id", "rsid", "description", "effect_allele", "genotype", n.cast("long").alias("occurrences"), colour.alias("colour"))


def cvd_split(full: DataFrame | None) -> DataFrame:
    rows = require(full).filter(~F.col("is_or") & F.col("trait").isin(ref.BLOOD_PRESSURE_TRAITS + ref.LIPID_TRAITS))
    label = F.when(F.col("risk_status_category") == "good", "Protective").otherwise("Predisposition")
    return rows.groupBy("sample_id", label.alias("status")).agg(F.count("*").alias("n"))


def hypertension(prs: DataFrame | None) -> DataFrame:
    return require(prs).filter(~F.col("is_or") & F.col("trait").isin(ref.BLOOD_PRESSURE_TRAITS)).groupBy("sample_id", "trait").agg(F.sum("final_risk").alias("total"))


def lipids(prs: DataFrame | None, parity: bool = True) -> DataFrame:
    """``parity`` keeps the label table as it is; else the fenofibrate triglyceride response keeps its own name."""
    labels = dict(ref.LIPID_LABELS)
    if not parity:
        labels = {k: (k if k.startswith("Response") else v) for k, v in labels.items()}
    rows = require(prs).filter(~F.col("is_or") & F.col("trait").isin(ref.LIPID_TRAITS))
    return rows.groupBy("sample_id", expr.mapped("trait", labels).alias("trait")).agg(F.sum("final_risk").alias("total"))


def other_markers(full: DataFrame | None) -> DataFrame:
    rows = require(full).filter(~F.col("is_or") & F.col("trait").isin(ref.OTHER_MARKER_TRAITS) & (F.col("trait") != "Platelet count"))
    return rows.groupBy("sample_id", "trait").agg(F.sum("final_risk").alias("total"))


def rare_genotypes(rare: DataFrame, parity: bool = False) -> DataFrame:
    """One row a variant of RARE, the first by block and rank, in the order of its probability: by number, or with
    ``parity`` by the written percentage."""
    first = Window.partitionBy("sample_id", "rsid").orderBy("block", "rank")
    one = rare.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    percent = F.col("genotype_probability") * 100
    key = F.format_string("%.5f%%", percent) if parity else percent
    order = Window.partitionBy("sample_id").orderBy(key.asc_nulls_last(), "block", "rank")
    return one.select("sample_id", "rsid", "gene", "category", "personal_genotype", percent.alias("percent"), F.row_number().over(order).cast("long").alias("position_in_list"))


def rare_mutations(rare: DataFrame) -> DataFrame:
    return rare.select("sample_id", "block", "rank", "rsid", "risk_allele", "risk_allele_frequency", "gene", "category", "personal_genotype")


def trait_choices(prs: DataFrame) -> DataFrame:
    rows = prs.filter("is_or").join(_blocked(prs.sparkSession), "trait", "left_anti")
    order = Window.partitionBy("sample_id").orderBy(F.round("percentile", 4), "trait")
    return rows.select("sample_id", "trait", F.row_number().over(order).cast("long").alias("place"))


def status_share(full: DataFrame) -> DataFrame:
    counted = full.groupBy("sample_id", "risk_status_category").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample_id")))


def percentile_histogram(prs: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of percentiles, to four places, by equal bins; 100 is in the last."""
    place = F.least(F.floor(F.round("percentile", 4) * bins / 100), F.lit(bins - 1)).cast("int")
    return prs.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def superpopulations(spark: SparkSession) -> DataFrame:
    rows = [(name, k, lat, lon) for name, corners in ref.SUPERPOPULATIONS.items() for k, (lat, lon) in enumerate(corners)]
    return spark.createDataFrame(rows, "superpopulation string, corner int, lat double, lon double")


def sport_scores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ref.SPORT_SCORES, "sport string, genetic_score int")


def power_endurance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ref.POWER_ENDURANCE, "axis string, value int")


def has_trait(prs: DataFrame, trait: str) -> DataFrame:
    """Per sample, whether it has a score for a trait, and the first variant of it."""
    return prs.groupBy("sample_id").agg(F.max(F.col("trait") == trait).alias("found"), F.max(F.when(F.col("trait") == trait, F.split("rsid", ",")[0])).alias("first_rsid"))
