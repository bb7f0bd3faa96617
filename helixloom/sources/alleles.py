"""A connector for allele lookups: rows of (refsnp_id, allele, chrom_start, chrom_strand) by a set of keys.

The store is a folder of buckets, ``bucket=N/*.csv``, where N is the CRC-32 of the key modulo their number. A filter on
``refsnp_id`` (equals, or in a list) is pushed into the source, which then opens the buckets of these keys alone, a task
a bucket; without one it reads all. Spark passes filters to Python sources if ``spark.sql.python.filterPushdown.enabled``
is set. For key sets too large for a filter, join: see ``curation.allele_lookup``.
"""

from __future__ import annotations

import csv
import io
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "refsnp_id string, allele string, chrom_start bigint, chrom_strand int"
BUCKETS = 64


def bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


class Bucket(InputPartition):
    def __init__(self, number: int, keys: frozenset[str] | None):
        self.number, self.keys = number, keys


class AlleleReader(DataSourceReader):
    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("refsnp_id",):
                found = {k for k in (f.value if isinstance(f, In) else (f.value,)) if k is not None}
                self.keys = found if self.keys is None else self.keys & found
            else:
                yield f

    def partitions(self) -> list[Bucket]:
        if self.keys is None:
            return [Bucket(k, None) for k in range(self.buckets)]
        by: dict[int, set[str]] = {}
        for key in self.keys:
            by.setdefault(bucket_of(key, self.buckets), set()).add(key)
        return [Bucket(k, frozenset(keys)) for k, keys in sorted(by.items())] or [Bucket(0, frozenset())]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        from pyarrow import fs

        if partition.keys is not None and not partition.keys:
            return
        store, path = fs.FileSystem.from_uri(self.folder) if ":" in self.folder else (fs.LocalFileSystem(), self.folder)
        listing = fs.FileSelector(f"{path}/bucket={partition.number}", allow_not_found=True)
        for info in store.get_file_info(listing):
            if info.type != fs.FileType.File or not info.base_name.endswith(".csv"):
                continue
            with store.open_input_stream(info.path) as raw:
                for key, allele, start, strand in csv.reader(io.TextIOWrapper(raw, "utf-8", newline="")):
                    if partition.keys is None or key in partition.keys:
                        yield key, allele or None, int(start) if start else None, int(strand) if strand else None


class AlleleSource(DataSource):
    """Options: ``path``, the store's folder with its scheme, and ``buckets``."""

    @classmethod
    def name(cls) -> str:
        return "alleles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AlleleReader:
        return AlleleReader(self.options["path"], int(self.options.get("buckets", BUCKETS)))


def write_store(dimension: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Deals an allele dimension into the store's buckets. Rows without a key are left out: no lookup finds them."""
    rows = dimension.filter("refsnp_id is not null").select("refsnp_id", "allele", "chrom_start", "chrom_strand")
    dealt = rows.withColumn("bucket", (F.crc32("refsnp_id") % buckets).cast("int"))
    dealt.repartition("bucket").write.partitionBy("bucket").csv(folder)


def read_store(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AlleleSource)
    return spark.read.format("alleles").option("buckets", buckets).load(folder)
