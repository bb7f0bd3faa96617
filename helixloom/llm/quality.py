"""Quality rules: fixed rules, then robust multivariate outliers.

Counts of each document become a vector of transformed statistics. For each language and source, mean and covariance
are those of the minimum-covariance-determinant kind: concentration steps over all documents from two starts, each of
which keeps the share ``SUPPORT`` nearest to its last estimate; of the two estimates the one of least determinant stays.
Counts, sums and products are aggregated in the map tasks by bins of distance, so a source with a third of all rows costs
a row a bin and task, and no document is joined to its group's limit. The bin in which the share is reached counts in
part. A group's estimate is drawn towards that of its language as ``PRIOR`` documents would, so that small groups have
one. A document whose squared Mahalanobis distance exceeds ``CUTOFF`` is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textstats

SUPPORT = 0.75
STEPS = 3
PRIOR = 200.0
#: The chi-square quantile of five dimensions at 0.99999.
CUTOFF = 30.86
#: Least standard deviation of each statistic, so that one that hardly varies (no symbols, no repeats) rejects none for a
#: trifle; what varies more has its own. A document of nearly only repeated lines or windows is still rejected for that.
FLOORS = (0.12, 0.30, 0.16, 0.12, 0.10)
#: Bins of squared distance: so many to a doubling, from the first to the last power of two.
BINS, FIRST_BIN, LAST_BIN = 8, -20, 40
VECTOR = ("v_length", "v_symbols", "v_lines", "v_repeats", "v_upper")
D = len(VECTOR)
MIN_WORDS = 50

_FIELDS = ", ".join(f"{f} long" for f in textstats.FIELDS)


def _with_counts(docs: DataFrame, passing: list[str], text_column: str) -> DataFrame:
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passing)
    source = docs.select(*passing, shared.text_or_empty(text_column).alias("text__"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = textstats.counts(batch.column(len(passing)))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(passing)], *(pa.array(found[f]) for f in textstats.FIELDS)], [*passing, *textstats.FIELDS])

    return shared.arrow_map(source, make, f"{kinds}, {_FIELDS}")


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """doc_id, lang, source, the counts of textstats, base_failed and the vector. A null text counts as empty, a null
    language or source as one of its own."""
    counted = _with_counts(docs.select("doc_id", "lang", "source", text_column), ["doc_id", "lang", "source"], text_column)
    return transformed(counted.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in ("lang", "source")}))


def transformed(counted: DataFrame) -> DataFrame:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "v_length": F.log(chars / words),
            "v_symbols": F.log1p(100 * F.col("n_symbols") / chars),
            "v_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "v_repeats": F.sqrt(F.col("n_repeat_words") / words),
            "v_upper": F.sqrt(F.col("n_upper") / chars),
        }
    )


def _distance(center="center", whiten="whiten"):
    """Squared Mahalanobis distance: the length of the whitened difference."""
    center, whiten = (F.col(x) if isinstance(x, str) else x for x in (center, whiten))
    total = F.lit(0.0)
    for i in range(D):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + whiten[i * D + j] * (F.col(VECTOR[j]) - center[j])
        total = total + row * row
    return total


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_MODEL = "lang string, source string, centers array<array<double>>, whitens array<array<double>>, dets array<double>"


def _whitening(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(np.linalg.cholesky(cov))


def _least_spread(cov: np.ndarray) -> np.ndarray:
    """``cov`` with what its variances lack to the least ones."""
    return (cov + cov.T) / 2 + np.diag(np.maximum(np.square(FLOORS) - np.diag(cov), 1e-9))


def _supporting(bins: pd.DataFrame) -> np.ndarray:
    """n, sums and products of the share SUPPORT of a group's documents that is nearest; its last bin counts in part."""
    moments = bins.sort_values("bin")[["n", *_SUMS]].to_numpy(float)
    before = np.cumsum(moments[:, 0]) - moments[:, 0]
    part = np.clip((SUPPORT * moments[:, 0].sum() - before) / moments[:, 0], 0, 1)
    return part @ moments


_SUMS = [f"t{i}" for i in range(D)] + [f"p{i}{j}" for i, j in _PAIRS]


def _starts(medians: pd.DataFrame) -> pd.DataFrame:
    """From a group's quartiles: its medians with the least spreads, and with those of its quartiles."""
    rows = []
    for q in np.stack([np.array(medians[v].tolist(), float) for v in VECTOR], 2):  # group, quartile, statistic
        spread = np.maximum((q[2] - q[0]) / 1.349, FLOORS)
        rows.append(([q[1].tolist()] * 2, [np.diag(1 / np.array(x)).ravel().tolist() for x in (FLOORS, spread)], [0.0, 0.0]))
    return pd.DataFrame({"lang": medians["lang"], "source": medians["source"], **{c: [r[k] for r in rows] for k, c in enumerate(("centers", "whitens", "dets"))}})


def _estimate(binned: pd.DataFrame) -> pd.DataFrame:
    """Of one language: a row for each source, by start."""
    found: dict[str, list[tuple]] = {}
    for _, of_start in binned.groupby("start"):
        groups = [(source, _supporting(bins)) for source, bins in of_start.groupby("source")]
        total = sum(m for _, m in groups)
        mean, second = total[1 : D + 1] / total[0], _square(total[D + 1 :]) / total[0]
        for source, m in groups:
            weight = m[0] + PRIOR
            center = (m[1 : D + 1] + PRIOR * mean) / weight
            moments = (_square(m[D + 1 :]) + PRIOR * second) / weight
            # the share SUPPORT nearest understates the spread; this factor is that of a normal sample of five statistics
            cov = _least_spread(CONSISTENCY * (moments - np.outer(center, center)))
            found.setdefault(source, []).append((center.tolist(), _whitening(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
    names = sorted(found)
    return pd.DataFrame({"lang": binned["lang"].iloc[0], "source": names, **{c: [[r[k] for r in found[s]] for s in names] for k, c in enumerate(("centers", "whitens", "dets"))}})


def _square(products: np.ndarray) -> np.ndarray:
    out = np.zeros((D, D))
    for (i, j), x in zip(_PAIRS, products, strict=True):
        out[i, j] = out[j, i] = x
    return out


#: Fixed value: SUPPORT / P(chi-square of 7 dimensions <= its quantile of 5 dimensions at SUPPORT), SUPPORT 0.75.
CONSISTENCY = 1.61


def fit(measured: DataFrame) -> DataFrame:
    """A model row for each language and source, of documents that pass the fixed rules."""
    tables = shared.Tables(measured.sparkSession)
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", *VECTOR)
    quartiles = rows.groupBy("lang", "source").agg(*[F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(v) for v in VECTOR])
    model = tables.write("quality-0", quartiles.groupBy("lang").applyInPandas(_starts, _MODEL))
    for step in range(STEPS):
        placed = rows.join(model, ["lang", "source"])
        d2 = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), _distance(F.col("centers")[k], F.col("whitens")[k]).alias("d2")) for k in (0, 1)]))
        placed = placed.select("lang", "source", *VECTOR, d2.alias("at"))
        place = F.floor(F.log2(F.greatest(F.least("at.d2", F.lit(2.0**LAST_BIN)), F.lit(2.0**FIRST_BIN))) * BINS).cast("int")
        sums = [F.sum(v).alias(f"t{i}") for i, v in enumerate(VECTOR)] + [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}{j}") for i, j in _PAIRS]
        binned = placed.groupBy("lang", "source", F.col("at.start").alias("start"), place.alias("bin")).agg(F.count("*").alias("n"), *sums)
        model = tables.write(f"quality-{step + 1}", binned.groupBy("lang").applyInPandas(_estimate, _MODEL))
        tables.drop(f"quality-{step}")
    best = F.when(F.col("dets")[0] <= F.col("dets")[1], 0).otherwise(1)
    return model.select("lang", "source", F.col("centers")[best].alias("center"), F.col("whitens")[best].alias("whiten"))


def judge(measured: DataFrame, model: DataFrame) -> DataFrame:
    """Adds distance and kept. A group without a model (none of its documents passes the fixed rules) keeps none."""
    placed = measured.join(model, ["lang", "source"], "left").withColumn("distance", _distance())
    return placed.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False))).drop("center", "whiten")


def verdicts(docs: DataFrame) -> DataFrame:
    """A row for each document: its counts, base_failed, distance and kept. Empty tables give no rows, repeated rows are
    judged alike, each a document of its own; a distance of just the cutoff is kept."""
    measured = shared.written(measure(docs), "quality-stats")
    return judge(measured, fit(measured))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever these are named. The texts aren't shuffled: the model
    is joined to them. Repeated rows stay repeated; an empty table gives none."""
    model = fit(shared.written(measure(docs), "quality-stats"))
    renamed = docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    names = dict(zip(docs.columns, renamed.columns, strict=True))
    counted = _with_counts(renamed, renamed.columns, names["text"])
    keyed = counted.withColumns({k: F.coalesce(F.col(names[k]), F.lit("")) for k in ("lang", "source")})
    good = judge(transformed(keyed), model).filter("kept").select(*renamed.columns)
    return good.toDF(*docs.columns)
