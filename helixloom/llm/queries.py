"""The thin queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
COUNT_BPE = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shingle_join(spark, sf_dir):
    from . import shingle_join

    return shingle_join.join_components(table(spark, sf_dir, "documents"))


def op2_personal_data(spark, sf_dir):
    from . import pii

    return pii.detect(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers as tokenizers

    from . import bytebpe

    return bytebpe.digests(table(spark, sf_dir, "documents"), tokenizers.path(BYTE_BPE), tokenizers.PATTERN)


def op4_quality_rules(spark, sf_dir):
    from . import quality

    found = quality.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_token_files(spark, sf_dir):
    import public_tokenizers as tokenizers

    from . import shared, tokenfiles

    folder = shared.fresh_path(spark, "tokens")
    listing = tokenfiles.write(table(spark, sf_dir, "documents"), tokenizers.path(WORD_BPE), folder)
    return tokenfiles.read(spark, folder, listing)


def op6_toxicity(spark, sf_dir):
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark, sf_dir):
    from . import substrings

    return substrings.digests(table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    from . import htmltext

    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op9_token_counts(spark, sf_dir):
    import public_tokenizers as tokenizers

    from . import tokencounts

    counted = tokencounts.count_sections(table(spark, sf_dir, "documents"), tokenizers.path(COUNT_BPE), tokenizers.PATTERN)
    return counted.withColumn("section_tokens", F.array_join(F.col("section_tokens").cast("array<string>"), ","))


def op10_decontamination(spark, sf_dir):
    from . import decontam

    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_shingle_join, op2_personal_data, op3_byte_bpe, op4_quality_rules, op5_token_files, op6_toxicity, op7_substring_dedup, op8_html_text, op9_token_counts, op10_decontamination)}
#: The others can't be expressed: components, trees, tokenizers, robust estimates, files, noisy-or, DOM trees, edit search.
ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      windows AS (SELECT r, doc_id, k, array_to_string(w[k : k + 49], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
      least AS (SELECT g, min(doc_id) AS m FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
      gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(k, k + 50)) AS p FROM windows JOIN least USING (g) WHERE doc_id > m)),
      word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
      kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
      SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
}
