"""Files in and out, and where they are."""

from __future__ import annotations

import atexit
import os
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


@dataclass(frozen=True)
class Paths:
    """Where inputs are; environment variables override defaults."""

    root: str = "."

    @property
    def project(self) -> str:
        return os.environ.get("GENOMICS_PROJECT_ROOT", self.root)

    @property
    def genomes(self) -> str:
        return os.environ.get("GENOMICS_GENOMES_DIR", f"{self.project}/genomes")

    @property
    def catalogue(self) -> str:
        return os.environ.get("GENOMICS_GWAS_DATA", f"{self.project}/gwas.csv")

    def missing(self, spark: SparkSession) -> list[str]:
        return [p for p in (self.project, self.genomes, self.catalogue) if not exists(spark, p)]


def _place(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, whichever Hadoop knows: local, shared or an object store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _place(spark, path)
    return files.exists(at)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name under the session's ``spark.checkpoint.dir``, removed when the interpreter ends; a local session
    without that setting gets one on this machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    path = f"{(shared or '/tmp/checkpoints').rstrip('/')}/helixloom/{label}-{uuid.uuid4().hex}"
    at, files = _place(spark, path)
    path = re.sub("^file:/+", "file:///", files.makeQualified(at).toString())  # what isn't Spark needs the scheme

    def remove() -> None:
        try:
            at, files = _place(spark, path)
            files.delete(at, True)
        except Exception:  # the session may be gone
            pass

    atexit.register(remove)
    return path


# Column names of the raw association table, and what they are here.
RAW_NAMES = {
    "OR.or.BETA": "odds_or_beta",
    "STRONGEST.SNP.RISK.ALLELE": "strongest_allele",
    "RISK.ALLELE.FREQUENCY": "frequency",
    "X95..CI..TEXT.": "ci_text",
    "REPLICATION.SAMPLE.SIZE": "replication_size",
    "SNPS": "snps",
    "DISEASE.TRAIT": "trait",
    "PUBMEDID": "pmid",
    "MAPPED_GENE": "gene",
}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The curated catalogue (CSV with a header and a row-name column first). NaN becomes null."""
    read = spark.read.csv(path, header=True, schema=schemas.GWAS, enforceSchema=True)
    return read.replace(float("nan"), None)


def read_raw_catalogue(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A raw association table (TSV with a header). ``columns`` maps its names to those of RAW_CATALOGUE; all others are
    pruned."""
    read = spark.read.csv(path, sep="\t", header=True)
    wanted = [c.strip().split(" ")[0] for c in schemas.RAW_CATALOGUE.split(",")]
    back = {v: k for k, v in columns.items()}
    kept = read.select(*[F.col(f"`{back[c]}`").alias(c) for c in wanted])
    return kept.withColumn("odds_or_beta", F.expr("try_cast(odds_or_beta AS double)"))


def read_calls(spark: SparkSession, path, first_row_is_header: bool = False, sample_id=None) -> DataFrame:
    """Genotype calls: TSV of four columns, ``#`` comments. A header row that isn't commented is dropped. With
    ``first_row_is_header`` each file's first data row is taken as the header, as a reader that infers headers would.
    ``sample_id``: a value or column, or None for the file's name without its ending."""
    read = spark.read.csv(path, sep="\t", comment="#", header=first_row_is_header, schema=schemas.CALLS, enforceSchema=True)
    rows = read.filter(~F.coalesce(F.lower("rsid") == "rsid", F.lit(False)))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1) if sample_id is None else F.lit(sample_id)
    return rows.select(name.alias("sample_id"), "*")


def read_two_allele_calls(spark: SparkSession, path, sample_id=None) -> DataFrame:
    """Extension: vendor files of five columns (two alleles) or with commas, as CALLS."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    parts = F.split(F.regexp_replace("value", '"', ""), "[,\t]")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1) if sample_id is None else F.lit(sample_id)
    genotype = F.concat(F.try_element_at(parts, F.lit(4)), F.coalesce(F.try_element_at(parts, F.lit(5)), F.lit("")))
    rows = lines.select(name.alias("sample_id"), parts[0].alias("rsid"), F.try_element_at(parts, F.lit(2)).alias("chromosome"), F.try_element_at(parts, F.lit(3)).try_cast("bigint").alias("position"), genotype.alias("genotype"))
    return rows.filter(F.col("position").isNotNull())


def read_sports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.SPORTS)


def list_genomes(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name to path of the sample files of a folder, on any file system, sorted, a blank entry first; empty if there's no
    folder."""
    at, files = _place(spark, folder)
    if not files.exists(at) or not files.getFileStatus(at).isDirectory():
        return {}
    found = [s.getPath() for s in files.listStatus(at) if s.isFile()]
    return {"": ""} | {p.getName().removesuffix(".txt"): str(p.toString()) for p in sorted(found, key=lambda p: p.getName()) if p.getName().endswith(".txt")}


def read_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path and base64 content of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.base64("content").alias("content"))


def write_csv(df: DataFrame, path: str, row_names: str | None = None) -> None:
    """CSV with a header; ``row_names`` names the column that stands first, unnamed in the file's convention."""
    columns = ([row_names] if row_names else []) + [c for c in df.columns if c != row_names]
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def preview(df: DataFrame, n: int = 6) -> tuple[int, list[str], DataFrame]:
    return df.count(), df.columns, df.limit(n)
