"""DuckDB SQL of every query, over the same projection of ``part`` and ``lineitem``."""

from __future__ import annotations

from ..sources import fixtures
from ..sources import reference_data as ref


def _text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + v.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + f") AS v({names}))"


def _in(values) -> str:
    return "(" + ", ".join(map(_text, values)) + ")"


def _cdf(x: str) -> str:
    """Abramowitz and Stegun 7.1.26, its five constants written out here, apart from those of the columns."""
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    poly = f"(0.254829592 * {t} - 0.284496736 * {t}**2 + 1.421413741 * {t}**3 - 1.453152027 * {t}**4 + 1.061405429 * {t}**5)"
    return f"(CASE WHEN {x} >= 0 THEN 0.5 * (2 - {poly} * exp(-({x}) * ({x}) / 2)) ELSE 0.5 * {poly} * exp(-({x}) * ({x}) / 2) END)"


def _pdf(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"


def _rsid(k: str) -> str:
    named = " ".join(f"WHEN {k} = {i} THEN '{r}'" for i, r in enumerate(fixtures.NAMED_RSIDS))
    return f"CASE {named} ELSE 'rs' || (1000000 + {k}) END"


N = fixtures.ROWS_PER_RSID
_TRAITS = _values([(i, *t) for i, t in enumerate(fixtures.TRAITS)], "i, trait, is_or, category")
_COUNT = "((length({0}) - length(replace({0}, {1}, ''))) // length({1}))"

_POPULATION = """CASE WHEN is_or THEN risk_allele_frequency * 2 * (CASE WHEN odds_ratio > 0 THEN ln(odds_ratio) END)
    WHEN trait_direction = 'decrease' THEN -risk_allele_frequency * 2 * odds_ratio
    WHEN trait_direction = 'increase' THEN risk_allele_frequency * 2 * odds_ratio END"""

GWAS = f"""gwas0 AS (
  SELECT p_partkey::BIGINT AS row_id, {_rsid(f"(p_partkey // {N})")} AS rsid, trait, is_or, category, p_name AS gene,
    (10000000 + p_partkey % 300)::VARCHAR AS pmid, substr('ACGT', (p_partkey // {N} % 4 + 1)::INT, 1) AS risk_allele,
    ((p_partkey * 37) % 99 + 1)::DOUBLE / 100 AS risk_allele_frequency,
    CASE WHEN is_or THEN 0.8::DOUBLE + p_size::DOUBLE / 100 ELSE p_size::DOUBLE / 100 END AS odds_ratio,
    CASE WHEN NOT is_or THEN CASE WHEN p_partkey % 2 = 0 THEN 'increase' ELSE 'decrease' END END AS trait_direction
  FROM part JOIN {_TRAITS} t ON t.i = (p_partkey + p_size) % 20),
gwas AS (SELECT *, {_POPULATION} AS population_score,
    CASE WHEN is_or THEN '[1.1-1.3]' ELSE '[0.1-0.2] unit ' || trait_direction END AS confidence_interval FROM gwas0)"""

CALLS = f"""calls0 AS (
  SELECT l_suppkey::BIGINT AS sample_id, l_partkey // {N} AS k, CASE WHEN l_linenumber = 7 THEN '--' ELSE
    (CASE WHEN trunc(l_quantity)::BIGINT % 3 = 0 THEN substr('ACGT', (l_partkey // {N} % 4 + 1)::INT, 1) ELSE substr('CGTA', (l_partkey // {N} % 4 + 1)::INT, 1) END) ||
    (CASE WHEN l_returnflag = 'A' THEN substr('ACGT', (l_partkey // {N} % 4 + 1)::INT, 1) ELSE substr('CGTA', (l_partkey // {N} % 4 + 1)::INT, 1) END) END AS g
  FROM lineitem),
calls AS (SELECT sample_id, {_rsid("k")} AS rsid, (k % 22 + 1)::VARCHAR AS chromosome, (k * 1000)::BIGINT AS position, max(g) AS genotype
  FROM calls0 GROUP BY sample_id, k)"""

FULL = f"""{GWAS}, {CALLS},
matched AS (SELECT * FROM (SELECT c.sample_id, c.chromosome, c.position, c.genotype AS personal_genotype, g.*,
    row_number() OVER (PARTITION BY c.sample_id, g.rsid, g.trait ORDER BY g.row_id) AS nth FROM gwas g JOIN calls c USING (rsid)) WHERE nth = 1),
annotated AS (SELECT *, 1 - risk_allele_frequency AS other_allele_frequency, CASE WHEN risk_status <= 1 THEN 'good' ELSE 'bad' END AS risk_status_category
  FROM (SELECT *, CASE WHEN n = 2 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END::INT AS risk_status
    FROM (SELECT *, {_COUNT.format("personal_genotype", "risk_allele")} AS n FROM matched))),
fullt AS (SELECT * FROM (SELECT * EXCLUDE (odds_ratio), signed AS odds_ratio,
    (CASE WHEN is_or THEN CASE WHEN signed > 0 THEN ln(signed) ELSE 0 END ELSE signed END) * risk_status - population_score AS final_risk
  FROM (SELECT *, CASE WHEN NOT is_or AND trait_direction = 'decrease' THEN -odds_ratio ELSE odds_ratio END AS signed FROM annotated)) WHERE final_risk IS NOT NULL)"""

PRS = f"""{FULL},
prs0 AS (SELECT sample_id, trait, sum(final_risk) AS final_risk, count(DISTINCT chromosome) AS n_chromosomes, arg_min(is_or, row_id) AS is_or,
    sum(population_score) AS population_score, string_agg(DISTINCT pmid, ',' ORDER BY pmid) AS pmid, string_agg(DISTINCT rsid, ',' ORDER BY rsid) AS rsid,
    arg_min(category, row_id) FILTER (category IS NOT NULL) AS category, count(*) AS n_variants FROM fullt GROUP BY sample_id, trait),
prs AS (SELECT *, {_cdf("final_risk")} * 100 AS percentile FROM prs0)"""


def _block(number: int, condition: str, key: str) -> str:
    return f"""SELECT sample_id, {number} AS block, rank::INT AS rank, rsid, risk_allele, risk_allele_frequency, gene, category, personal_genotype, other_allele_frequency, genotype_probability
      FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {key} ASC NULLS LAST, row_id) AS rank FROM called WHERE {condition}) WHERE rank <= 5"""


RARE = f"""{FULL},
called AS (SELECT *, CASE risk_status WHEN 1 THEN risk_allele_frequency * (1 - risk_allele_frequency) WHEN 0 THEN (1 - risk_allele_frequency) * (1 - risk_allele_frequency)
    WHEN 2 THEN risk_allele_frequency * risk_allele_frequency END AS genotype_probability FROM annotated WHERE NOT contains(personal_genotype, '-')),
rare AS ({_block(1, "risk_status > 0", "risk_allele_frequency")} UNION ALL {_block(2, "risk_status = 0", "other_allele_frequency")} UNION ALL {_block(3, "TRUE", "genotype_probability")})"""

_EDGES = _values([(i, *e) for i, e in enumerate(fixtures.RAW_EDGES)], "e, strongest_allele, ci_text, frequency, replication_size")


def _category_rows() -> list[tuple[str, str]]:
    first: dict[str, str] = {}
    for category, traits in ref.TRAIT_CATEGORIES.items():
        for trait in traits:
            first.setdefault(trait, category)
    return list(first.items())


CURATED = f"""raw AS (SELECT p_partkey::BIGINT AS row_id, CASE WHEN p_partkey % 13 <> 0 THEN p_size * 2.5::DOUBLE END AS odds_ratio,
    strongest_allele, ci_text, frequency, replication_size, CASE WHEN p_partkey % 17 = 0 THEN 'chr1:' || p_partkey ELSE 'rs' || p_partkey END AS snps,
    t.trait, (10000000 + p_partkey % 300)::VARCHAR AS pmid, p_name AS gene
  FROM part JOIN {_EDGES} x ON x.e = p_partkey % 10 JOIN {_TRAITS} t ON t.i = (p_partkey // 10 + p_size) % 20),
kept AS (SELECT row_id, trait, odds_ratio, nullif(regexp_extract(strongest_allele, '-(.*)', 1), '') AS risk_allele, ci_text AS confidence_interval, snps AS rsid,
    NOT regexp_matches(ci_text, '(?i)unit') AS is_or, pmid, TRY_CAST(frequency AS DOUBLE) AS risk_allele_frequency,
    CASE WHEN regexp_matches(ci_text, '(?i)unit increase') THEN 'increase' WHEN regexp_matches(ci_text, '(?i)unit decrease') THEN 'decrease' END AS trait_direction, gene
  FROM raw WHERE odds_ratio IS NOT NULL AND odds_ratio < 100 AND frequency IS NOT NULL AND replication_size <> 'NA' AND regexp_matches(snps, '(?i)rs')
    AND NOT regexp_matches(ci_text, '(?i)NR') AND (regexp_matches(ci_text, '(?i)\\[.*\\]( unit increase| unit decrease)$') OR regexp_matches(ci_text, '(?i)^\\[.*\\]$'))),
curated AS (SELECT k.*, {_POPULATION} AS population_score, m.category FROM kept k
  LEFT JOIN (SELECT DISTINCT k2.trait, coalesce(c.category, 'Other') AS category FROM kept k2 LEFT JOIN {_values(_category_rows(), "trait, category")} c USING (trait)
    WHERE k2.is_or AND length(k2.risk_allele) = 1 AND k2.risk_allele <> '?') m ON m.trait = k.trait WHERE length(k.risk_allele) = 1 AND k.risk_allele <> '?')"""

_LABEL = "CASE trait " + " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in ref.LIPID_LABELS.items()) + " ELSE trait END"
_COLOUR = "CASE category " + " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in ref.CATEGORY_COLOURS.items()) + f" ELSE '{ref.DEFAULT_COLOUR}' END"
_NODE = "CASE WHEN risk_status_category = 'bad' THEN 'Predisposition' ELSE 'Protective' END"
_NODE_COLOUR = "CASE WHEN risk_status_category = 'bad' THEN '{Predisposition}' ELSE '{Protective}' END".format(**ref.NODE_COLOURS)
_POPULAR = _values(ref.POPULAR_SNPS, "rsid, description, effect_allele")
_SPORTS = _values([tuple(r) for r in ref.SPORTS_SNPS], ", ".join("chr_comment" if c == "Comment" else c for c in ref.SPORTS_COLUMNS))
_DETAIL_N = _COUNT.format("personal_genotype", "risk_allele")
_POPULAR_N = _COUNT.format("genotype", "effect_allele")

ORACLE_SQL: dict[str, str] = {
    "prs_trait": f"WITH {PRS} SELECT sample_id, trait, round(final_risk, 6) AS final_risk, n_chromosomes, is_or, round(population_score, 6) AS population_score, pmid, rsid, category, n_variants, round(percentile, 4) AS percentile FROM prs",
    "full_scored": f"WITH {FULL} SELECT sample_id, rsid, trait, row_id, personal_genotype, risk_allele, round(odds_ratio, 6) AS odds_ratio, risk_status, risk_status_category, round(other_allele_frequency, 6) AS other_allele_frequency, round(population_score, 6) AS population_score, round(final_risk, 6) AS final_risk FROM fullt",
    "scan_catalogue": f"WITH {GWAS} SELECT * REPLACE (round(odds_ratio, 6) AS odds_ratio, round(population_score, 6) AS population_score) FROM gwas",
    "scan_calls": f"WITH {CALLS} SELECT * FROM calls",
    "risk_status_counts": f"WITH {FULL} SELECT sample_id, risk_status, count(*) AS n FROM fullt GROUP BY 1, 2",
    "trait_counts": f"WITH {FULL} SELECT sample_id, trait, count(*) AS n FROM fullt GROUP BY 1, 2",
    "category_radar": f"WITH {PRS} SELECT sample_id, category, round(avg(percentile), 4) AS mean_percentile FROM prs WHERE is_or AND category IS NOT NULL GROUP BY 1, 2",
    "sunburst_rollup": f"""WITH {FULL}, rows AS (SELECT sample_id, risk_status_category, coalesce(category, 'Unknown') AS category FROM fullt WHERE is_or)
      SELECT sample_id, (CASE WHEN risk_status_category = 'bad' THEN '(-) ' ELSE '(+) ' END) || category AS label, {_NODE} AS parent, count(*) AS n, {_COLOUR} AS colour FROM rows GROUP BY sample_id, risk_status_category, category
      UNION ALL SELECT sample_id, {_NODE}, 'SNPs', count(*), {_NODE_COLOUR} FROM rows GROUP BY sample_id, risk_status_category
      UNION ALL SELECT sample_id, 'SNPs', '', count(*), '{ref.NODE_COLOURS["SNPs"]}' FROM rows GROUP BY sample_id""",
    "disease_overview": f"WITH {PRS} SELECT sample_id, trait, category, round(percentile - 50, 4) AS percentile_normalized, CASE WHEN percentile - 50 > 0 THEN 'red' ELSE 'green' END AS colour FROM prs WHERE is_or AND trait NOT IN {_in(ref.BLOCKED_TRAITS)}",
    "density_curve": f"""WITH {PRS}, grid AS (SELECT -4 + i * 8::DOUBLE / 999 AS x FROM range(1000) r(i)), s AS (SELECT final_risk AS z, percentile FROM prs WHERE sample_id = 1 AND trait = 'Melanoma' AND is_or)
      SELECT round(x, 6) AS x, round({_pdf("x")}, 6) AS y, side, round(z, 6) AS z, round(percentile, 4) AS percentile, round((SELECT max({_pdf("x")}) FROM grid) * 0.9, 6) AS mark_height, round((SELECT max({_pdf("x")}) FROM grid) * 1.1, 6) AS axis_height
      FROM grid, s, (VALUES ('below'), ('above')) b(side) WHERE (side = 'below' AND x <= z) OR (side = 'above' AND x >= z)""",
    "trait_report": f"WITH {PRS} SELECT sample_id, trait, round(percentile, 4) AS percentile, len(string_split(pmid, ',')) AS n_pmids, len(string_split(rsid, ',')) AS n_snps FROM prs",
    "trait_detail": f"""WITH {FULL} SELECT sample_id, rsid, gene, personal_genotype, risk_allele, round(odds_ratio, 6) AS odds_ratio, risk_allele_frequency, confidence_interval, pmid, risk_status_category,
      CASE {_DETAIL_N} WHEN 2 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'none' END AS colour, row_number() OVER (PARTITION BY sample_id ORDER BY fullt.odds_ratio DESC NULLS LAST, row_id) AS position_in_list FROM fullt WHERE trait = 'Melanoma'""",
    "sports_join": f"WITH {CALLS} SELECT c.sample_id, c.rsid, s.gene, c.genotype, s.power_allele, s.endurance_allele, s.chr_comment AS comment FROM calls c JOIN {_SPORTS} s ON c.rsid = s.SNP",
    "popular_snps": f"""WITH {CALLS}, renamed AS (SELECT sample_id, CASE WHEN rsid = 'i3003626' THEN 'rs333' ELSE rsid END AS rsid, genotype FROM calls)
      SELECT sample_id, rsid, description, effect_allele, genotype, {_POPULAR_N} AS occurrences, CASE {_POPULAR_N} WHEN 2 THEN 'green' WHEN 1 THEN 'yellow' WHEN 0 THEN 'red' ELSE 'none' END AS colour FROM renamed JOIN {_POPULAR} p USING (rsid)""",
    "cvd_split": f"WITH {FULL} SELECT sample_id, CASE WHEN risk_status_category = 'good' THEN 'Protective' ELSE 'Predisposition' END AS status, count(*) AS n FROM fullt WHERE NOT is_or AND trait IN {_in(ref.BLOOD_PRESSURE_TRAITS + ref.LIPID_TRAITS)} GROUP BY 1, 2",
    "hypertension_sum": f"WITH {PRS} SELECT sample_id, trait, round(sum(final_risk), 6) AS total FROM prs WHERE NOT is_or AND trait IN {_in(ref.BLOOD_PRESSURE_TRAITS)} GROUP BY 1, 2",
    "lipid_sum": f"WITH {PRS} SELECT sample_id, {_LABEL} AS trait, round(sum(final_risk), 6) AS total FROM prs WHERE NOT is_or AND trait IN {_in(ref.LIPID_TRAITS)} GROUP BY 1, 2",
    "other_markers": f"WITH {FULL} SELECT sample_id, trait, round(sum(final_risk), 6) AS total FROM fullt WHERE NOT is_or AND trait IN {_in(ref.OTHER_MARKER_TRAITS)} AND trait <> 'Platelet count' GROUP BY 1, 2",
    "rare_blocks": f"WITH {RARE} SELECT * REPLACE (round(genotype_probability, 6) AS genotype_probability, round(other_allele_frequency, 6) AS other_allele_frequency) FROM rare",
    "rare_genotypes": f"""WITH {RARE}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, rsid ORDER BY block, rank) AS nth FROM rare) WHERE nth = 1)
      SELECT sample_id, rsid, gene, category, personal_genotype, round(genotype_probability * 100, 6) AS percent, row_number() OVER (PARTITION BY sample_id ORDER BY genotype_probability * 100 ASC NULLS LAST, block, rank) AS position_in_list FROM one""",
    "rare_mutations": f"WITH {RARE} SELECT sample_id, block, rank, rsid, risk_allele, risk_allele_frequency, gene, category, personal_genotype FROM rare",
    "trait_choices": f"WITH {PRS} SELECT sample_id, trait, row_number() OVER (PARTITION BY sample_id ORDER BY round(percentile, 4), trait) AS place FROM prs WHERE is_or AND trait NOT IN {_in(ref.BLOCKED_TRAITS)}",
    "trait_overview": f"WITH {PRS} SELECT sample_id, trait, round(final_risk, 6) AS final_risk, CASE WHEN final_risk > 0 THEN 'blue' ELSE 'orange' END AS colour FROM prs WHERE NOT is_or",
    "curated_catalogue": f"WITH {CURATED} SELECT * REPLACE (round(odds_ratio, 6) AS odds_ratio, round(population_score, 6) AS population_score) FROM curated",
    "category_counts": f"WITH {CURATED} SELECT category, count(*) AS n FROM curated WHERE is_or GROUP BY 1 ORDER BY n DESC, category",
    "status_share": f"WITH {FULL} SELECT sample_id, risk_status_category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sample_id), 6) AS share FROM fullt GROUP BY sample_id, risk_status_category",
    "percentile_histogram": f"WITH {PRS} SELECT least(floor(round(percentile, 4) * 20 / 100), 19)::INT AS bin, count(*) AS n FROM prs GROUP BY 1",
    "allele_lookup": f"""WITH {GWAS} SELECT 'rs' || (1000000 + p_partkey) AS refsnp_id, CASE WHEN p_partkey % 2 = 0 THEN 'A/G' ELSE 'C/T' END AS allele, (p_partkey * 1000)::BIGINT AS chrom_start, CASE WHEN p_size > 25 THEN 1 ELSE -1 END AS chrom_strand
      FROM part WHERE 'rs' || (1000000 + p_partkey) IN (SELECT rsid FROM gwas)""",
    "allele_source": """SELECT 'rs' || (1000000 + p_partkey) AS refsnp_id, CASE WHEN p_partkey % 2 = 0 THEN 'A/G' ELSE 'C/T' END AS allele, (p_partkey * 1000)::BIGINT AS chrom_start, CASE WHEN p_size > 25 THEN 1 ELSE -1 END AS chrom_strand
      FROM part WHERE 1000000 + p_partkey IN (1000001, 1000007, 1000042, 1000100, 1000101, 1)""",
    "has_trait": f"WITH {PRS} SELECT sample_id, bool_or(trait = 'Melanoma') AS found, max(CASE WHEN trait = 'Melanoma' THEN string_split(rsid, ',')[1] END) AS first_rsid FROM prs GROUP BY 1",
    "superpopulation_regions": "SELECT superpopulation, corner, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM " + _values([(n, k, a, b) for n, c in ref.SUPERPOPULATIONS.items() for k, (a, b) in enumerate(c)], "superpopulation, corner, lat, lon"),
    "sport_scores": "SELECT * FROM " + _values(ref.SPORT_SCORES, "sport, genetic_score"),
    "power_endurance": "SELECT * FROM " + _values(ref.POWER_ENDURANCE, "axis, value"),
    "category_lookup": "SELECT * FROM " + _values(_category_rows(), "trait, category"),
    "plain_trait_scores": f"""WITH {FULL}, r AS (SELECT *, (CASE WHEN odds_ratio > 0 THEN ln(odds_ratio) END) * risk_status - population_score AS risk FROM fullt),
      p AS (SELECT sample_id, trait, sum(risk) AS final_risk, count(*) AS n_risk_snps, min_by(rsid, row_id) AS rsid, min_by(risk_allele, row_id) AS risk_allele, min_by(pmid, row_id) AS pmid, min_by(chromosome, row_id) AS chromosome,
        min_by(personal_genotype, row_id) AS personal_genotype, min_by(is_or, row_id) AS is_or FROM r WHERE risk IS NOT NULL GROUP BY sample_id, trait)
      SELECT * REPLACE (round(final_risk, 6) AS final_risk), round({_cdf("final_risk")} * 100, 4) AS percentile FROM p WHERE is_or""",
    "files_calls": f"WITH {CALLS} SELECT sample_id::VARCHAR AS sample_id, rsid, chromosome, position, genotype FROM calls",
    "files_catalogue": f"WITH {GWAS} SELECT row_id, trait, round(odds_ratio, 6) AS odds_ratio, risk_allele, confidence_interval, rsid, is_or, pmid, risk_allele_frequency, trait_direction, gene, round(population_score, 6) AS population_score, category FROM gwas",
    "files_raw_catalogue": f"WITH {CURATED} SELECT * EXCLUDE (row_id) REPLACE (round(odds_ratio, 6) AS odds_ratio, round(population_score, 6) AS population_score) FROM curated",
    "files_sports": f"WITH {CALLS} SELECT c.sample_id, c.rsid, s.gene, c.genotype, s.power_allele, s.endurance_allele, s.chr_comment AS comment FROM calls c JOIN {_SPORTS} s ON c.rsid = s.SNP",
    "files_prs": f"WITH {PRS} SELECT sample_id::VARCHAR AS sample_id, trait, round(final_risk, 6) AS final_risk, n_variants, round(percentile, 4) AS percentile FROM prs",
    "normal_grid": f"SELECT round(x, 6) AS x, round({_pdf('x')}, 6) AS density, round({_cdf('x')} * 100, 4) AS percentile FROM (SELECT -4 + i * 8::DOUBLE / 999 AS x FROM range(1000) r(i))",
}
