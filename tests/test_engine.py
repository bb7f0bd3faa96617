"""Hand-computed rows for the operators, and their invariants."""

import math

import pytest
from pyspark.sql import functions as F

from helixloom.functions import expr
from helixloom.operators import curation, scoring
from helixloom.plans import views
from helixloom.sources import fixtures, readers, reference_data, schemas

GWAS_COLUMNS = schemas.GWAS
SF = "/root/testdata/sf0.001"


def gwas_rows(spark, rows):
    """(row_id, trait, rsid, is_or, effect, allele, p, direction, population, category, pmid)"""
    full = [(i, t, e, a, "[1-2]", r, o, pm, p, d, "G", pop, c) for i, t, r, o, e, a, p, d, pop, c, pm in rows]
    return spark.createDataFrame(full, GWAS_COLUMNS)


def call_rows(spark, rows):
    return spark.createDataFrame([(s, r, "1", k, g) for k, (s, r, g) in enumerate(rows)], "sample_id long, rsid string, chromosome string, position long, genotype string")


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_risk_status(spark):
    df = spark.createDataFrame([("AA", "A"), ("AG", "A"), ("GG", "A"), ("A", "A"), ("AAA", "A"), ("--", "A"), ("II", "I"), (None, "A")], "genotype string, risk_allele string")
    assert [r[0] for r in values(df.select(expr.risk_status().alias("s")), "s")] == [2, 1, 0, 1, 1, 0, 2, None]


def test_probability_and_scores(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "risk_status int").withColumn("risk_allele_frequency", F.lit(0.2))
    assert [round(r[0], 9) for r in values(df.select(expr.genotype_probability().alias("p")), "p")] == [0.64, 0.16, 0.04]
    assert round(values(df.select(expr.genotype_probability(hardy_weinberg=True).alias("p")), "p")[1][0], 9) == 0.32
    rows = spark.createDataFrame([(True, 0.0, None, 2, 0.1), (True, None, None, 2, 0.1), (False, -0.5, "decrease", 2, -0.2), (True, math.e, None, 1, 0.0)], "is_or boolean, odds_ratio double, trait_direction string, risk_status int, population_score double")
    assert [round(r[0], 9) for r in values(rows.select(expr.final_risk().alias("f")), "f")] == [-0.1, -0.1, -0.8, 1.0]
    rows = spark.createDataFrame([(True, 2.0, None), (False, 0.5, "increase"), (False, 0.5, "decrease"), (False, 0.5, None)], "is_or boolean, odds_ratio double, trait_direction string").withColumn("risk_allele_frequency", F.lit(0.3))
    got = [r[0] for r in values(rows.select(expr.population_score().alias("f")), "f")]
    assert [None if g is None else round(g, 9) for g in got] == [round(0.6 * math.log(2), 9), 0.3, -0.3, None]


def test_normal_cdf(spark):
    rows = values(spark.range(-60, 61).select((F.col("id") / 10).alias("x")).select("x", expr.normal_cdf("x").alias("p"), expr.normal_pdf("x").alias("d")), "x", "p", "d")
    assert all(abs(p - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1.5e-7 for x, p, _ in rows)
    assert all(b[1] >= a[1] for a, b in zip(rows, rows[1:]))


def test_first_of_each_trait(spark):
    gwas = gwas_rows(spark, [(7, "T", "rs1", True, 2.0, "A", 0.1, None, 0.0, "C", "1"), (3, "T", "rs1", True, 3.0, "A", 0.1, None, 0.0, None, "2"), (5, "U", "rs1", False, 0.5, "A", 0.1, "decrease", 0.0, None, "3")])
    calls = call_rows(spark, [(1, "rs1", "AA"), (1, "rs1", "GG"), (2, "rs1", None), (1, "rs9", "AA")])
    full = scoring.full_scores(gwas, calls)
    assert sorted(values(full, "sample_id", "trait", "row_id", "odds_ratio", "personal_genotype")) == [(1, "T", 3, 3.0, "AA"), (1, "U", 5, -0.5, "AA")]


def test_a_sum_near_zero_has_one_colour_in_any_order_of_the_rows(spark):
    risks = [0.2, 1.26, -0.46, 1.3, 1.5, -3.8]
    for turn in range(len(risks)):
        own = risks[turn:] + risks[:turn]
        rows = [(1, "T", x, x, "1", False, "p", f"rs{x}", "C", k) for k, x in enumerate(own)]
        full = spark.createDataFrame(rows, "sample_id long, trait string, final_risk double, population_score double, chromosome string, is_or boolean, pmid string, rsid string, category string, row_id long").coalesce(1)
        prs = scoring.trait_scores(full)
        assert values(prs, "final_risk", "population_score") == [(math.fsum(risks), math.fsum(risks))]
        assert values(views.trait_overview(prs), "colour") == [("blue",)]


def test_exact_sum_of_odd_numbers(spark):
    rows = [("a", 1e300), ("a", 1.0), ("b", None), ("c", None), ("c", -0.1), ("d", float("nan")), ("d", 1.0), ("e", float("-inf")), ("f", 2.0**20), ("f", -(2.0**20) + 0.5)]
    found = spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(expr.exact_sum("x").alias("s"))
    got = dict(values(found, "k", "s"))
    assert math.isnan(got.pop("d")) and got == {"a": 1e300, "b": None, "c": -0.1, "e": float("-inf"), "f": 0.5}


def test_trait_lists_are_made_after_the_rows_are_dealt(spark):
    """No list or set of a map task's part of a trait is shuffled."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        plan = scoring.trait_scores(scoring.full_scores(fixtures.gwas(spark, SF), fixtures.calls(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = plan.splitlines()
    sets = [k for k, line in enumerate(lines) if "Aggregate" in line and "collect_set" in line]
    dealt = next(k for k, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert len(sets) == 2 and max(sets) < dealt


def test_trait_score_lists(spark):
    gwas = gwas_rows(spark, [(1, "T", "rs2", True, 2.0, "A", 0.1, None, 0.0, None, "9"), (2, "T", "rs1", True, 2.0, "A", 0.1, None, 0.0, "C", "9"), (3, "T", "rs3", True, 2.0, "A", 0.1, None, 0.0, "D", "10")])
    prs = scoring.trait_scores(scoring.full_scores(gwas, call_rows(spark, [(1, "rs1", "AA"), (1, "rs2", "AG"), (1, "rs3", "GG")]))).first()
    assert (prs.pmid, prs.rsid, prs.category, prs.n_variants) == ("10,9", "rs1,rs2,rs3", "C", 3)
    assert prs.final_risk == pytest.approx(3 * math.log(2))


def test_rare_ties_and_nulls(spark):
    gwas = gwas_rows(spark, [(k, "T", f"rs{k}", True, 2.0, "A", None if k == 0 else 0.1, None, 0.0, None, "1") for k in range(8)])
    calls = call_rows(spark, [(1, f"rs{k}", "AA" if k < 7 else "--") for k in range(8)])
    rare = scoring.rare_variants(gwas, calls)
    assert sorted(values(rare.filter("block = 1"), "rank", "rsid")) == [(k, f"rs{k}") for k in range(1, 6)]
    assert rare.filter("block = 2").count() == 0
    gwas = gwas_rows(spark, [(k, "T", f"rs{k}", True, 2.0, "A", p, None, 0.0, None, "1") for k, p in ((1, 0.1), (2, 0.3), (3, None))])
    rare = scoring.rare_variants(gwas, call_rows(spark, [(1, f"rs{k}", "AA") for k in (1, 2, 3)]))
    assert [r.rsid for r in rare.filter("block = 3").orderBy("rank").collect()] == ["rs1", "rs2", "rs3"]


def test_written_order_of_percentages(spark):
    rare = spark.createDataFrame([(1, 3, 1, "a", 0.02), (1, 3, 2, "b", 0.1), (1, 2, 1, "b", 0.1)], "sample_id long, block int, rank int, rsid string, genotype_probability double")
    rare = rare.selectExpr("*", "'g' gene", "'c' category", "'AA' personal_genotype")
    number = {r.rsid: r.position_in_list for r in views.rare_genotypes(rare).collect()}
    written = {r.rsid: r.position_in_list for r in views.rare_genotypes(rare, parity=True).collect()}
    assert number == {"a": 1, "b": 2} and written == {"b": 1, "a": 2}


def test_sunburst_of_one_status(spark):
    full = spark.createDataFrame([(1, True, "good", "Cancer"), (1, True, "good", None), (1, False, "bad", "Cancer")], "sample_id long, is_or boolean, risk_status_category string, category string")
    got = {(r.label, r.parent, r.n) for r in views.sunburst(full).collect()}
    assert got == {("(+) Cancer", "Protective", 1), ("(+) Unknown", "Protective", 1), ("Protective", "SNPs", 2), ("SNPs", "", 2)}


def test_vendor_ids(spark):
    got = views.popular_snps(call_rows(spark, [(1, "i3003626", "--"), (1, "rs53576", "AG")])).collect()
    assert {(r.rsid, r.occurrences, r.colour) for r in got} == {("rs333", 2, "green"), ("rs53576", 1, "yellow")}


def test_lipid_labels(spark):
    prs = spark.createDataFrame([(1, "Response to fenofibrate (triglyceride levels)", False, 1.0), (1, "Triglyceride levels", False, 2.0)], "sample_id long, trait string, is_or boolean, final_risk double")
    assert {r.trait for r in views.lipids(prs).collect()} == {"Response to fenofibrate (LDL cholesterol levels)", "Triglycerides"}
    assert {r.trait for r in views.lipids(prs, parity=False).collect()} == {"Response to fenofibrate (triglyceride levels)", "Triglycerides"}


RAW = "row_id long, " + schemas.RAW_CATALOGUE


def test_curation(spark):
    def raw(k, allele="rs1-A", ci="[1-2]", freq="0.3", size="x", snps="rs1", trait="Uterine fibroids", effect=2.0):
        return (k, effect, allele, freq, ci, size, snps, trait, "1", "G")

    rows = [raw(1), raw(2, "rs1-?"), raw(3, "rs1"), raw(4, "rs1-AT"), raw(5, "chr1:5-6-A"), raw(6, ci="[1-2] unit increase", trait="beta only"), raw(7, ci="[1-2] UNIT DECREASE"), raw(8, ci="[NR]"), raw(9, ci="1-2"), raw(10, ci="[1-2] mg increase"), raw(11, freq="NR"), raw(12, size="NA"), raw(13, size=None), raw(14, snps="chr1"), raw(15, effect=100.0), raw(16, effect=None), raw(17, trait="new trait")]
    got = {r.row_id: r for r in curation.curate(spark.createDataFrame(rows, RAW)).collect()}
    assert set(got) == {1, 6, 7, 11, 13, 17}
    assert (got[1].category, got[17].category, got[6].category) == ("Cancer", "Other", None)
    assert (got[6].trait_direction, got[7].trait_direction, got[1].trait_direction) == ("increase", "decrease", None)
    assert got[11].risk_allele_frequency is None and got[11].population_score is None


def test_category_table():
    assert sum(map(len, reference_data.TRAIT_CATEGORIES.values())) == 190
    assert len({t for ts in reference_data.TRAIT_CATEGORIES.values() for t in ts}) == 186
    assert (len(reference_data.BLOCKED_TRAITS), len(reference_data.OTHER_MARKER_TRAITS), len(reference_data.LIPID_LABELS)) == (26, 30, 10)


def test_files(spark, tmp_path):
    genomes = tmp_path / "genomes"
    genomes.mkdir()
    (genomes / "ann.txt").write_text("# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t10\tAA\nrs2\tX\t\tAG\n")
    (genomes / "bob.txt").write_text("rsid\tchromosome\tposition\tgenotype\nrs1\tMT\t5\t--\n")
    got = sorted(values(readers.read_calls(spark, str(genomes)), "sample_id", "rsid", "chromosome", "position", "genotype"), key=repr)
    assert got == [("ann", "rs1", "1", 10, "AA"), ("ann", "rs2", "X", None, "AG"), ("bob", "rs1", "MT", 5, "--")]
    assert readers.read_calls(spark, str(genomes / "ann.txt"), first_row_is_header=True).count() == 1
    found = readers.list_genomes(spark, str(genomes))
    assert list(found) == ["", "ann", "bob"] and readers.read_calls(spark, found["ann"]).count() == 2 and readers.list_genomes(spark, str(tmp_path / "no")) == {}
    (tmp_path / "vendor.csv").write_text('#x\n"rsid","chromosome","position","allele1","allele2"\nrs5,2,7,A,G\n')
    assert values(readers.read_two_allele_calls(spark, str(tmp_path / "vendor.csv")), "sample_id", "rsid", "position", "genotype") == [("vendor", "rs5", 7, "AG")]
    catalogue = fixtures.gwas(spark, SF).select(*[c.strip().split(" ")[0] for c in schemas.GWAS.split(",")])
    readers.write_csv(catalogue, str(tmp_path / "cat"), "row_id")
    back = readers.read_catalogue(spark, str(tmp_path / "cat"))
    assert back.count() == catalogue.count() and sorted(values(back, "row_id", "is_or", "trait")) == sorted(values(catalogue, "row_id", "is_or", "trait"))
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    assert readers.read_images(spark, str(tmp_path)).first().content == "iVBORw=="
    assert readers.preview(catalogue)[0] == catalogue.count()


def test_paths(spark, monkeypatch, tmp_path):
    monkeypatch.setenv("GENOMICS_PROJECT_ROOT", str(tmp_path))
    assert readers.Paths().genomes == str(tmp_path / "genomes")
    monkeypatch.setenv("GENOMICS_GENOMES_DIR", "/elsewhere")
    assert readers.Paths().genomes == "/elsewhere" and "/elsewhere" in readers.Paths().missing(spark) and str(tmp_path) not in readers.Paths().missing(spark)


def test_invariants(spark):
    full, prs, rare = scoring.score(fixtures.gwas(spark, SF), fixtures.calls(spark, SF))
    assert full.groupBy("sample_id", "rsid", "trait").count().filter("count > 1").isEmpty()
    assert prs.filter("percentile < 0 or percentile > 100").isEmpty()
    assert rare.groupBy("sample_id", "block").count().filter("count > 5").isEmpty()
    assert {r[0] for r in full.select("risk_status").distinct().collect()} <= {0, 1, 2}
    for view in (views.require, views.cvd_split, views.hypertension, views.lipids, views.other_markers, views.popular_snps, lambda df: views.sports_join(df, views.sports_table(spark))):
        with pytest.raises(views.MissingInput):
            view(None)


def test_null_genotypes_have_no_probability(spark):
    gwas = gwas_rows(spark, [(k, "T", f"rs{k}", True, 2.0, "A", 0.01 if k == 0 else 0.3, None, 0.0, None, "1") for k in range(3)])
    rare = scoring.rare_variants(gwas, call_rows(spark, [(1, "rs0", None), (1, "rs1", "AA"), (1, "rs2", "GG")]))
    got = {(r.block, r.rank): (r.rsid, r.genotype_probability) for r in rare.collect()}
    assert got == {(1, 1): ("rs1", pytest.approx(0.09)), (2, 1): ("rs2", pytest.approx(0.49)), (3, 1): ("rs1", pytest.approx(0.09)), (3, 2): ("rs2", pytest.approx(0.49)), (3, 3): ("rs0", None)}


def test_rare_variants_join_once(spark):
    plan = scoring.rare_variants(fixtures.gwas(spark, SF), fixtures.calls(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") + plan.count("l_suppkey") >= 1 and plan.count("Join") == 1 and plan.count("Window ") == 1


def test_heights_are_of_the_grid(spark):
    """The highest of 1,000 points from -4 to 4 isn't at 0: stored values, 0.398939 of it worked out apart."""
    prs = spark.createDataFrame([(1, "T", True, 0.5, 69.0)], "sample_id long, trait string, is_or boolean, final_risk double, percentile double")
    row = views.density_curve(prs, 1, "T").first()
    assert (round(row.mark_height, 6), round(row.axis_height, 6)) == (0.359045, 0.438833)
    assert views.density_curve(prs, 2, "T").isEmpty()


def test_plain_scores(spark):
    gwas = gwas_rows(spark, [(2, "T", "rs2", True, 3.0, "A", 0.1, None, 0.1, "C", "9"), (1, "T", "rs1", True, 2.0, "A", 0.1, None, 0.0, "C", "8"), (3, "U", "rs1", False, 0.5, "A", 0.1, "increase", 0.0, None, "7")])
    full = scoring.full_scores(gwas, call_rows(spark, [(1, "rs1", "AG"), (1, "rs2", "AA")]))
    (row,) = scoring.plain_trait_scores(full).collect()
    assert (row.trait, row.rsid, row.pmid, row.n_risk_snps, row.personal_genotype) == ("T", "rs1", "8", 2, "AG")
    assert row.final_risk == pytest.approx(math.log(2) + 2 * math.log(3) - 0.1)


def test_lookup_opens_the_buckets_of_its_keys_alone(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    from helixloom.sources import alleles

    rows = [(f"rs{k}", "A/G" if k else None, k * 10, 1) for k in range(300)] + [(None, "A", 1, 1)]
    alleles.write_store(spark.createDataFrame(rows, alleles.SCHEMA), str(tmp_path / "store"), 16)
    store = alleles.read_store(spark, str(tmp_path / "store"), 16)
    assert sorted(map(tuple, store.collect()), key=repr) == sorted(rows[:-1], key=repr)
    got = store.filter(F.col("refsnp_id").isin("rs0", "rs5", "rs9", "none")).filter("chrom_start < 60")
    assert sorted(map(tuple, got.collect())) == [("rs0", None, 0, 1), ("rs5", "A/G", 50, 1)]
    assert got.rdd.getNumPartitions() <= 4
    reader = alleles.AlleleReader(str(tmp_path), 16)
    other = GreaterThan(("chrom_start",), 5)
    assert list(reader.pushFilters([In(("refsnp_id",), ("a", "b", None)), other, EqualTo(("refsnp_id",), "b")])) == [other]
    assert [(p.number, p.keys) for p in reader.partitions()] == [(alleles.bucket_of("b", 16), frozenset("b"))]


def test_stored_scores(spark, tmp_path):
    scores = scoring.score(fixtures.gwas(spark, SF), fixtures.calls(spark, SF))
    kept = scoring.stored(scores, str(tmp_path))
    for a, b in zip(scores, kept):
        assert a.count() == b.count() and sorted(a.columns) == sorted(b.columns)
    assert views.category_radar(kept.prs).count() == views.category_radar(scores.prs).count()


def test_category_counts_are_ordered(spark):
    rows = curation.category_counts(spark.createDataFrame([("a", True)] * 2 + [("b", True)] * 3 + [("0", True)] * 2 + [("z", False)], "category string, is_or boolean"))
    assert values(rows, "category", "n") == [("b", 3), ("0", 2), ("a", 2)]


def test_stream(spark, tmp_path):
    from helixloom.streaming import ingest

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "ann.txt").write_text("rs1\t1\t10\tAA\n")
    (inbox / "bob.txt").write_text("rs1\t1\t10\tAG\n")
    gwas = gwas_rows(spark, [(1, "T", "rs1", True, 2.0, "A", 0.1, None, 0.0, "C", "9")])
    query = ingest.score_stream(ingest.call_stream(spark, str(inbox)), gwas, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r.sample_id: r.final_risk for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"ann": pytest.approx(2 * math.log(2)), "bob": pytest.approx(math.log(2))}
