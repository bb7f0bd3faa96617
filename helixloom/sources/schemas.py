"""Schemas of the inputs."""

RAW_CATALOGUE = "odds_or_beta double, strongest_allele string, frequency string, ci_text string, replication_size string, snps string, trait string, pmid string, gene string"
GWAS = "row_id bigint, trait string, odds_ratio double, risk_allele string, confidence_interval string, rsid string, is_or boolean, pmid string, risk_allele_frequency double, trait_direction string, gene string, population_score double, category string"
CALLS = "rsid string, chromosome string, position bigint, genotype string"
SPORTS = "SNP string, chr_name string, Beta double, effect_allele string, non_effect_allele string, ensembl_alleles string, Comment string, power_allele string, endurance_allele string, gene string"
