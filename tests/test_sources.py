"""Parsers, matrices, sinks and the incremental load on small files."""

import gzip
import json
import zipfile

import pytest
from lattica.functions import rules
from lattica.functions import text as tx
from lattica.operators import build, graph
from lattica.schemas import TRIPLE
from lattica.sources import files, parsers, sinks
from lattica.streaming import micro
from pyspark.sql import functions as F

CASES = {
    "reactome_pathway_relations": ("A\tB\n\tC\nshort\n", [("pathway::B", "pathway_child_of", "pathway::A", 0.6, 0.65)]),
    "reactome_pathways": ("R-1\tCell cycle\tHomo sapiens\nR-2\tx\tMus musculus\n", [("pathway::R-1", "pathway_name", "term::Cell_cycle", 0.4, 0.6)]),
    "reactome_uniprot_pathway": ("P1\tR-1\tu\tName\tIEA\tHomo sapiens\nP2\tR-2\tu\t\tIEA\tHomo sapiens\nP3\tR-3\tu\tN\tIEA\tMus musculus\n",
                                 [("protein::P1", "participates_in_pathway", "pathway::R-1", 0.74, 0.82), ("pathway::R-1", "pathway_name", "term::Name", 0.45, 0.7), ("protein::P2", "participates_in_pathway", "pathway::R-2", 0.74, 0.82)]),
    "string_ppi": ("protein1 protein2 combined_score\n9606.A 9606.B 699\n9606.A 9606.C 700\n9606.A 9606.D 1001\n9606.A 9606.E x\n",
                   [("protein::9606.A", "protein_interacts_with", "protein::9606.C", 0.7, 0.7), ("protein::9606.A", "protein_interacts_with", "protein::9606.D", 1.0, 1.0)]),
    "string_protein_info": ("#string_protein_id\tpreferred_name\n9606.A\tabc1\n", [("gene::ABC1", "has_string_protein_id", "protein::9606.A", 0.96, 0.92)]),
    "string_protein_aliases": ("#p\talias\tsource\n9606.A\tabc1\tEnsembl_HGNC\n9606.A\t123\tx\n9606.A\tabcdefghijklmnopqrs\tx\n9606.A\tq1\tUniProt\n9606.A\tq2\tother\n",
                               [("gene::ABC1", "has_string_protein_id", "protein::9606.A", 0.88, 0.9), ("gene::Q1", "has_string_protein_id", "protein::9606.A", 0.88, 0.86), ("gene::Q2", "has_string_protein_id", "protein::9606.A", 0.88, 0.82)]),
    "pathway_commons_sif": ("# note\na\tControls\tb\na\t\tc\n", [("gene::A", "controls", "gene::B", 0.7, 0.7), ("gene::A", "gene_related_to", "gene::C", 0.7, 0.7)]),
    "npinter": ("interactor1\trel\tinteractor2\nMALAT1\tBinds\tEZH2\n", [("rna_or_protein::MALAT1", "binds", "rna_or_protein::EZH2", 0.65, 0.68)]),
    "kegg_gene_pathway": ("hsa:1956\tpath:hsa04010\n", [("gene::1956", "participates_in_pathway", "pathway::kegg_hsa04010", 0.72, 0.75)]),
    "wikipathways_query": (json.dumps({"result": [{"id": "WP1", "name": "x"}, {"name": "none"}]}), [("gene::UNKNOWN", "participates_in_pathway", "pathway::wp_WP1", 0.66, 0.7)]),
    "encode_eclip": ("about the file\nTarget of assay\tBiosample summary\tAccession\nabc\tK562 cells\tE1\nabd\t\tE2\n\tHepG2\tE3\n",
                     [("gene::ABC", "supported_by_eclip", "cell_context::K562_cells", 0.74, 0.78), ("gene::ABD", "supported_by_eclip", "cell_context::E2", 0.74, 0.78)]),
    "biogrid_tab3": ("Official Symbol Interactor A\tOfficial Symbol Interactor B\tOrganism ID Interactor A\tOrganism ID Interactor B\tExperimental System\na\tb\t9606\t9606\tY2H\na\tc\t10090\t9606\tY2H\na\td\t\t\tY2H\n",
                     [("gene::A", "biogrid_interacts_with", "gene::B", 0.76, 0.74), ("gene::A", "biogrid_interacts_with", "gene::D", 0.76, 0.74)]),
    "ncbi_gene_info": ("#tax_id\tGeneID\tSymbol\n9606\t1\ta1bg\n10090\t2\tx\n", [("gene::A1BG", "has_ncbi_gene_id", "ncbi_gene::1", 1.0, 0.95)]),
    "omnipath": ("source\ttarget\tis_stimulation\tis_inhibition\tconsensus_direction\na\tb\t1\t0\t1\na\tc\t0\ttrue\t0\na\td\t1\t1\t0\n",
                 [("gene::A", "activates", "gene::B", 0.86, 0.87), ("gene::A", "inhibits", "gene::C", 0.78, 0.78), ("gene::A", "associated_with", "gene::D", 0.78, 0.78)]),
    "ensembl_gtf": ('#!x\n1\th\tgene\t1\t2\t.\t+\t.\tgene_id "ENSG1"; gene_name "abc";\n1\th\ttranscript\t1\t2\t.\t+\t.\tgene_id "ENSG1"; gene_name "abc";\n', [("gene::ABC", "has_ensembl_gene_id", "ensembl_gene::ENSG1", 1.0, 0.95)]),
    "signor": ("a\tprotein\tx\tx\tb\tgene\tx\tx\tup-regulates\tx\tx\t9606\tx\tx\tx\tx\tx\t123\na\tgene\tx\tx\tb\tgene\tx\tx\tdown-regulates\nshort\n",
               [("protein::a", "activates", "gene::B", 0.88, 0.9), ("gene::A", "inhibits", "gene::B", 0.88, 0.8)]),
}


def test_every_parser_has_a_case():
    assert CASES.keys() == parsers.REGISTRY.keys()


@pytest.mark.parametrize("name", sorted(CASES))
def test_parser(spark, tmp_path, name):
    text, want = CASES[name]
    path = tmp_path / f"{name}.txt.gz"
    path.write_bytes(gzip.compress(text.encode()))
    got = parsers.REGISTRY[name](spark, str(path))
    assert got.columns == [x.split()[0] for x in TRIPLE.split(", ")]
    assert sorted(tuple(r) for r in got.select("head", "relation", "tail", "weight", "confidence").collect()) == sorted(want)
    assert all("structured" in json.loads(r[0]) for r in got.select("evidence").collect())


def test_manifest(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("readme.md", "x")
        z.writestr("links.txt", "A\tB\nA\tB\n")
    entries = [{"name": "reactome_pathway_relations", "status": "ok", "path": str(tmp_path / "s.zip"), "source": "S"}, {"name": "other", "status": "ok", "path": "x"}, {"name": "npinter", "status": "failed", "path": "x"}]
    assert files.manifest_triples(spark, entries).select("head", "source").collect() == [("pathway::B", "S")]
    assert sinks.upsert_manifest([{"name": "a", "v": 1}, {"name": "b"}], [{"name": "a", "v": 2}, {"name": "c", "status": "failed"}]) == [{"name": "a", "v": 2}, {"name": "b"}]


def test_matrices(spark, tmp_path):
    (tmp_path / "m.csv").write_text("gene,c.1,c2\nA,1.5,x\nB,,-2\n")
    assert sorted(map(repr, map(tuple, files.matrix(spark, str(tmp_path / "m.csv")).collect()))) == sorted(map(repr, [("A", "c.1", 1.5), ("A", "c2", None), ("B", "c.1", None), ("B", "c2", -2.0)]))
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 3.0\n2 2 4.0\n")
    assert sorted(map(tuple, files.matrix_market(spark, str(tmp_path / "m.mtx")).collect())) == [("gene_0", "cell_0", 3.0), ("gene_0", "cell_1", 0.0), ("gene_1", "cell_0", 0.0), ("gene_1", "cell_1", 4.0)]
    (tmp_path / "p.csv").write_text("cell_id,perturbation\nc1,KO_A\nc1,KO_B\n")
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    assert sorted(map(tuple, files.perturbations(spark, str(tmp_path / "p.csv"), cells).collect())) == [("c1", "KO_B"), ("c2", "unknown")]


def triples(spark, rows):
    return spark.createDataFrame([(h, r, t, "s", "v1", "{}", w, c, 0.0) for h, r, t, w, c in rows], TRIPLE)


def test_triples_csv(spark, tmp_path):
    sinks.write_triples(triples(spark, [("gene::A", "up-regulates", 'gene::"B"', 1.7, 0.5)]), str(tmp_path / "t"))
    row = files.triples_csv(spark, str(tmp_path / "t")).first()
    assert (row["tail"], row["raw_relation"], row["weight"], row["head_type"]) == ('gene::"B"', "up-regulates", 1.0, "gene")


def test_stream_adds_each_key_once(spark, tmp_path):
    for i, rows in enumerate(([("gene::A", "activates", "gene::B", 1.0, 0.5)] * 2, [("gene::A", "activates", "gene::B", 0.5, 0.5), ("gene::A", "inhibits", "gene::C", 1.0, 0.5)])):
        triples(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    micro.run_stream(spark, str(tmp_path / "in"), TRIPLE, str(tmp_path / "out"))
    got = micro.read_edges(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("head", "relation", "tail", "rel_type").collect())) == [("gene::A", "activates", "gene::B", "ACTIVATES"), ("gene::A", "inhibits", "gene::C", "INHIBITS")]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rules(spark):
    for given, want in (("  egfr ", "gene::EGFR"), ("ENSP01", "protein::ENSP01"), ("R-HSA-1", "pathway::R-HSA-1"), ("cell_context::K562 x", "Cell::K562_x"), ("term::Cell cycle", "pathway::Cell_cycle"), ("", ""), (None, "")):
        assert value(spark, rules.canonical_entity(F.lit(given).cast("string"))) == want
    for given, want in (("up-regulates", "regulates"), ("inactivate", "activates"), ("downregulates", "inhibits"), ("affects_x", "affects_x"), ("", "associated_with"), ("has_cnv", "has_cnv")):
        assert value(spark, rules.canonical_relation(F.lit(given))) == want
    assert value(spark, rules.perturbation_sign(F.lit("OE_PRKDC"))) == -1.0 and value(spark, rules.perturbation_sign(F.lit("CRISPRI_A"))) == 1.0
    assert value(spark, rules.storage_type(F.lit("2 hop!"))) == "REL_2_HOP"
    assert value(spark, rules.or_else(F.lit(0.0), 0.5)) == 0.5
    assert tuple(value(spark, tx.parse_question(F.lit("In A549, knockout of EGFR?")))) == ("A549", "KO_EGFR")
    assert value(spark, tx.strip_wiki(F.lit("== T == [[x]] {{y}}<b>z</b>"))) == "T  x z"


def test_walks_may_cycle(spark):
    e = spark.createDataFrame([("gene::A", "gene::B", 0.1, 1.0, 1.0), ("gene::A", "gene::C", 2.0, 1.0, -1.0), ("gene::C", "gene::B", 2.0, 1.0, 1.0), ("gene::B", "gene::A", 1.0, 1.0, 1.0)], "head string, tail string, weight double, confidence double, effect_sign double")
    got = {r["node"]: (r["hops"], r["raw_signal"], r["direction_sign"]) for r in graph.ranked_candidates(e, spark.createDataFrame([("gene::A",)], "origin string")).collect()}
    assert got == {"gene::B": (2, 4.0, -1.0), "gene::C": (1, 2.0, -1.0)}


def test_components_and_text_graph(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(0, 40) if i != 20], "head string, tail string")
    got = {r["name"]: r["component"] for r in graph.components(e).collect()}
    assert got == {f"n{i}": min(f"n{j}" for j in (range(21) if i <= 20 else range(21, 41))) for i in range(41)}
    docs = spark.createDataFrame([(1, "a b a c"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in build.text_graph(docs).orderBy("position").select("head", "tail").collect()] == [("a", "b"), ("b", "c")]


def test_tar_lines(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, text in (("x/wanted.txt", "a\r\nb\n"), ("other.txt", "no"), ("y/wanted.txt", "c")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    assert [r["value"] for r in files.tar_lines(spark, str(tmp_path / "a.tar.gz"), "wanted.txt").collect()] == ["a", "b", "c"]


def test_a_broken_source_is_left_out(spark, tmp_path):
    (tmp_path / "good.txt").write_text("A\tB\n")
    (tmp_path / "bad.txt.gz").write_bytes(b"\x1f\x8bnot gzip at all")
    entries = [{"name": n, "parser": "reactome_pathway_relations", "path": str(tmp_path / p), "status": "ok"} for n, p in (("bad", "bad.txt.gz"), ("good", "good.txt"))]
    assert files.manifest_triples(spark, entries).count() == 1
    with pytest.raises(Exception):  # noqa: B017  whatever the reader raises
        list(files.source_triples(spark, entries, strict=True))


def test_small_ends(spark, tmp_path):
    from lattica.operators import evaluate

    table = spark.createDataFrame([("TP53", 1.5, 'a "b", c')], "protein string, log2_fc double, source string")
    sinks.write_calibration(table, str(tmp_path / "c"))
    assert files.calibration(spark, str(tmp_path / "c")).collect() == table.collect()
    specs = spark.createDataFrame([("a", "methylation", "m.csv"), ("b", "rna", "r.csv")], "name string, modality string, matrix_path string")
    assert [r["postprocess"] for r in sinks.omics_entries(specs, "t.csv").orderBy("name").collect()] == ["gene_means", "none"]
    assert value(spark, rules.percent(F.lit(0.12345))) == "12.35%" and value(spark, rules.suffix(F.lit("a::b::c"))) == "c"
    checks = spark.createDataFrame([("x", 0), ("y", 2)], "check string, problems int")
    assert [evaluate.exit_code(c) for c in (checks, checks.filter("problems = 0"), checks.limit(0))] == [1, 0, 2]
    e = triples(spark, [("gene::A", "activates", "gene::B", 1.0, 0.5)])
    flags = graph.with_evidence_flags(e.withColumn("evidence", F.lit('{"structured": 1}'))).first()
    assert flags["has_evidence"] and flags["is_structured"]
    nodes = graph.node_table(e)
    assert graph.visualise(e, nodes).count() == 1 and graph.visualise(e, nodes.limit(0)).count() == 1


def test_signor_makes_fields_once(spark, tmp_path):
    """A line is split and its names are normalised once, however often filters and columns read them; quotes are dropped."""
    row = lambda a, x, b, y, effect, organism="9606", pmid="1": "\t".join([a, x, "", "", b, y, "", "", effect, "", "", organism, *[""] * 5, pmid])
    rows = [row('" egfr  x"', '"Micro RNA"', '"', "protein", '"up-regulates"'), row("a b", "protein", 'c"', "", "down-regulates", "", ""), row("a", "", "b", "", "x", "10090"), row(" ", "", "b", "", "x"), "a\tb"]
    (tmp_path / "signor.tsv").write_text("\n".join(rows))
    made = parsers.signor(spark, str(tmp_path / "signor.tsv")).select("head", "relation", "tail", "weight", "confidence")
    assert {tuple(r) for r in made.collect()} == {("mirna::EGFR_X", "activates", 'protein::"', 0.88, 0.9), ("protein::a_b", "inhibits", 'gene::C"', 0.88, 0.8)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_replace(") <= 12  # more of both before
