"""The catalogue and calls as projections of the driver's tables ``part`` and ``lineitem``, whole.

Four catalogue rows share an rsid at any scale, so the catalogue has no key that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

ROWS_PER_RSID = 4
# The first rsids; later ones are made from their number.
NAMED_RSIDS = ["rs1815739", "rs4646994", "rs699", "rs1800012", "i3003626", "rs12913832", "rs1042522", "rs53576"]
# Trait, whether its effects are odds ratios, category.
TRAITS = [
    ("Melanoma", True, "Cancer"),
    ("Type 2 diabetes", True, "Metabolic Disorders"),
    ("Coronary artery disease", True, "CVD and Chronic Conditions"),
    ("Schizophrenia", True, "Neurological Disorders"),
    ("Asthma", True, "Autoimmune and Inflammatory Diseases"),
    ("Tuberculosis", True, "Infectious Diseases"),
    ("Osteoarthritis", True, "Developmental and Structural Conditions"),
    ("Gallstone disease", True, "Other Conditions"),
    ("Straight vs curly hair", True, "Other"),
    ("Allergic sensitization", True, None),
    ("Systolic blood pressure", False, None),
    ("Pulse pressure", False, None),
    ("LDL cholesterol", False, None),
    ("LDL cholesterol levels", False, None),
    ("Triglycerides", False, None),
    ("Response to fenofibrate (triglyceride levels)", False, None),
    ("HDL cholesterol", False, None),
    ("Bilirubin levels", False, None),
    ("Platelet count", False, None),
    ("Hematocrit", False, None),
]


def _pick(values: list, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _rsid(k):
    return F.when(k < len(NAMED_RSIDS), _pick(NAMED_RSIDS, F.least(k, F.lit(len(NAMED_RSIDS) - 1)))).otherwise(expr.rsid_of(1000000 + k))


def gwas(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_name")
    k = F.floor(F.col("p_partkey") / ROWS_PER_RSID)
    i = (F.col("p_partkey") + F.col("p_size")) % len(TRAITS)
    rows = part.select(
        F.col("p_partkey").cast("long").alias("row_id"),
        _rsid(k).alias("rsid"),
        _pick([t for t, _, _ in TRAITS], i).alias("trait"),
        _pick([o for _, o, _ in TRAITS], i).alias("is_or"),
        _pick([c for _, _, c in TRAITS], i).alias("category"),
        F.col("p_name").alias("gene"),
        (10000000 + F.col("p_partkey") % 300).cast("string").alias("pmid"),
        F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1)).alias("risk_allele"),
        (((F.col("p_partkey") * 37) % 99 + 1) / 100).alias("risk_allele_frequency"),
        "p_size",
        (F.col("p_partkey") % 2 == 0).alias("even"),
    )
    rows = rows.withColumns(
        {
            "odds_ratio": F.when(F.col("is_or"), 0.8 + F.col("p_size") / 100).otherwise(F.col("p_size") / 100),
            "trait_direction": F.when(~F.col("is_or"), F.when(F.col("even"), "increase").otherwise("decrease")),
        }
    )
    return rows.withColumns(
        {
            "population_score": expr.population_score(),
            "confidence_interval": F.when(F.col("is_or"), "[1.1-1.3]").otherwise(F.concat(F.lit("[0.1-0.2] unit "), "trait_direction")),
        }
    ).drop("p_size", "even")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    k = F.floor(F.col("l_partkey") / ROWS_PER_RSID)
    risk, other = (F.substring(F.lit(s), (k % 4 + 1).cast("int"), F.lit(1)) for s in ("ACGT", "CGTA"))
    first = F.when(F.col("l_quantity").cast("int") % 3 == 0, risk).otherwise(other)
    second = F.when(F.col("l_returnflag") == "A", risk).otherwise(other)
    rows = items.select(F.col("l_suppkey").cast("long").alias("sample_id"), k.alias("k"), F.when(F.col("l_linenumber") == 7, "--").otherwise(F.concat(first, second)).alias("genotype"))
    # dealt by sample alone, which serves what is grouped by sample and variant or trait later
    one = rows.repartition("sample_id").groupBy("sample_id", "k").agg(F.max("genotype").alias("genotype"))
    return one.select("sample_id", _rsid(F.col("k")).alias("rsid"), (F.col("k") % 22 + 1).cast("string").alias("chromosome"), (F.col("k") * 1000).alias("position"), "genotype")


#: Edge values of a raw association table, chosen by p_partkey % 10: allele, interval text, frequency, replication size.
RAW_EDGES = [
    ("rs1-A", "[1.1-1.3]", "0.3", "100"),
    ("rs1-?", "[1.1-1.3]", "0.3", "100"),
    ("rs1", "[1.1-1.3]", "0.3", "100"),
    ("rs1-AT", "[1.1-1.3]", "0.3", "100"),
    ("rs1-G", "[0.1-0.2] unit increase", "0.25", "100"),
    ("rs1-C", "[0.1-0.2] UNIT DECREASE", "0.4", "100"),
    ("rs1-T", "[NR]", "0.4", "100"),
    ("rs1-T", "1.1-1.3", "0.4", "100"),
    ("rs1-T", "[1.1-1.3]", "NR", "100"),
    ("rs1-G", "[1.2-1.4]", "0.5", "NA"),
]


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_name")
    e = F.col("p_partkey") % 10
    i = (F.floor(F.col("p_partkey") / 10) + F.col("p_size")) % len(TRAITS)
    return part.select(
        F.col("p_partkey").cast("long").alias("row_id"),
        F.when(F.col("p_partkey") % 13 != 0, F.col("p_size") * 2.5).alias("odds_or_beta"),
        *[_pick([r[n] for r in RAW_EDGES], e).alias(c) for n, c in enumerate(("strongest_allele", "ci_text", "frequency", "replication_size"))],
        F.when(F.col("p_partkey") % 17 == 0, F.concat(F.lit("chr1:"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("rs"), F.col("p_partkey").cast("string"))).alias("snps"),
        _pick([t for t, _, _ in TRAITS], i).alias("trait"),
        (10000000 + F.col("p_partkey") % 300).cast("string").alias("pmid"),
        F.col("p_name").alias("gene"),
    )
