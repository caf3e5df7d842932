import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandframe.engine import Engine, gene_features
from strandframe.errors import CorruptData, EncodingError, InvalidCoordinates, NotFound
from strandframe.operators import kmers, relations
from strandframe.sources import formats, store

GFF = """##gff-version 3
chr5\tx\tgene\t1001\t1800\t.\t+\t.\tID=gene:G1;gene_name=TERT
chr5\tx\tmRNA\t1001\t1800\t.\t+\t.\tID=transcript:T1;Parent=gene:G1
chr5\tx\texon\t1001\t1100\t.\t+\t.\tParent=transcript:T1
chr5\tx\tmRNA\t1\t9\t.\t+\t.\tID=T2;Parent=gene:none
chr5\tx\texon\t1\t9\t.\t+\t.\tParent=T2
chr5\tx\tgene\t1001\t1900\t.\t+\t.\tID=gene:G1;gene_name=TERT
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}")


@pytest.fixture(scope="module")
def loaded(engine, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(150_000))
    (folder / "a.fa").write_text("\n".join([">chr5 A>G note > x", *(seq[i : i + 60] for i in range(0, len(seq), 60)), ">MT", "acgtNRYu", ""]))
    (folder / "a.gff3").write_text(GFF)
    (folder / "a.vcf").write_text("#CHROM\nchr5\t10\trs1\tC\tG,T,CT\t1\tPASS\t.\nchr5\t20\t.\tC\tG,T\t1\tPASS\t.\n")
    package = formats.Package(9606, "asm1", {"scientific_name": "Homo sapiens"}, {"status": "draft", "release_year": 2013})
    report = engine.load(package.add_fasta(str(folder / "a.fa")).add_gff3(str(folder / "a.gff3")).add_vcf(str(folder / "a.vcf")))
    return seq, report


def test_load(engine, loaded):
    seq, report = loaded
    assert report == {"chromosomes": 2, "bases": len(seq) + 8, "features": 4, "variants": 5}
    assert engine.catalog.one("organisms", tax_id=9606).scientific_name == "Homo sapiens" and engine.catalog.one("reference_genomes", assembly_name="asm1").release_year == 2013
    # the last line of a key counts; orphans are not written
    assert engine.gene_by_symbol(9606, "asm1", "TERT").end_bp == 1900
    assert [r.transcript_id for r in engine.catalog.table("transcripts").collect()] == ["T1"] and engine.catalog.table("exons").count() == 1
    # every alternate is kept
    assert {r.variant_id for r in engine.catalog.table("variant_records").collect()} == {"rs1", "rs1:T", "rs1:CT", "chr5:19:C>G", "chr5:19:C>T"}
    assert engine.sequence_ref(9606, "asm1", "chr5").path.endswith("seq_id=chr5")


def test_store(engine, loaded):
    seq, _ = loaded
    c = engine.store.chunk
    for a, b in ((0, 20), (c - 3, c + 5), (c, 2 * c), (149_990, 150_000), (7, 7), (150_000, 150_000), (0, 150_000)):
        assert engine.fetch_sequence(9606, "asm1", "chr5", a, b) == seq[a:b]
    assert engine.fetch_full_sequence(9606, "asm1", "MT") == "ACGTNRYU"
    for a, b in ((100, 50), (0, 999_999), (-1, 5)):
        with pytest.raises(InvalidCoordinates):
            engine.fetch_sequence(9606, "asm1", "chr5", a, b)
    with pytest.raises(NotFound):
        engine.store.length(9606, "asm1", "chr6")
    with pytest.raises(EncodingError, match="at 4"):
        engine.store_sequence(9606, "asm1", "bad", "ACGT123")
    for name in ("../evil", "sub/chr1", ""):
        with pytest.raises(ValueError):
            engine.store_sequence(9606, "asm1", name, "ACGT")
    engine.store_sequence(1, "other", "x", "")
    assert engine.store.length(1, "other", "x") == 0 and engine.fetch_full_sequence(1, "other", "x") == ""
    engine.store_sequence(1, "other", "x", "acgu")
    assert engine.fetch_full_sequence(1, "other", "x") == "ACGU" and engine.store.length(9606, "asm1", "chr5") == len(seq)


def test_slices_in_one_join(engine, loaded, spark):
    seq, _ = loaded
    c = engine.store.chunk
    regions = [("a", "chr5", 0, 10), ("b", "chr5", c - 2, 2 * c + 1), ("c", "chr5", 5, 4), ("d", "chr5", 0, 150_001), ("e", "none", 0, 1), ("f", "chr5", 150_000, 150_000), ("g", "chr5", -2, 4), ("a", "chr5", 0, 10)]
    table = spark.createDataFrame([(n, 9606, "asm1", s, a, b) for n, s, a, b in regions], "name string, tax_id int, assembly_name string, seq_id string, start long, end long")
    got = {}
    for r in engine.store.slices(table).collect():
        got.setdefault(r.name, []).append((r.seq, r.valid))
    assert got == {"a": [(seq[:10], True)] * 2, "b": [(seq[c - 2 : 2 * c + 1], True)], "c": [(None, False)], "d": [(None, False)], "e": [(None, False)], "f": [("", True)], "g": [(None, False)]}


def test_verify(engine, loaded, spark):
    assert engine.verify_sequence(9606, "asm1", "chr5") and engine.verify_sequence(9606, "asm1", "MT")
    with pytest.raises(NotFound):
        engine.verify_sequence(9606, "asm1", "chr9")
    engine.store_sequence(9606, "asm2", "y", "ACGT")
    engine.catalog.put("sequences", spark.createDataFrame([(9606, "asm2", "y", 4, hashlib.sha256(b"ACGA").hexdigest())], "tax_id int, assembly_name string, seq_id string, length_bp long, sha256 string"))
    with pytest.raises(CorruptData):
        engine.verify_sequence(9606, "asm2", "y")


def test_loci(engine, loaded):
    seq, _ = loaded
    locus = engine.locus(9606, "asm1", "TERT", 100, 50)
    assert (locus.window_start, locus.window_end, locus.sequence) == (900, 1950, seq[900:1950]) and len(locus) == 1050 and not locus.is_empty
    assert locus.target.priority == 1 and locus.provenance_sha256 == hashlib.sha256(seq.encode()).hexdigest()
    row = engine.loci(9606, "asm1", 100, 50).filter("symbol = 'TERT'").first()
    assert row.sequence == locus.sequence and row.valid
    with pytest.raises(NotFound):
        engine.locus(9606, "asm1", "NONE")
    engine.register_target(tax_id=10090, symbol="SIRT6", priority=9, category="x")
    assert engine.target("SIRT6").tax_id == 9606 and engine.target("SIRT6", 10090).priority == 9 and engine.target("NONE") is None


def test_scans_of_an_assembly(engine, loaded):
    seq, _ = loaded
    pattern = seq[70_000:70_012]
    assert ("chr5", 70_000) in [tuple(r) for r in engine.locate_exact(9606, "asm1", pattern).collect()]
    assert engine.count_exact(9606, "asm1", pattern).first().n == sum(seq.startswith(pattern, i) for i in range(len(seq)))
    assert engine.similarity(9606, "asm1", "MT", "ACGT", 4) > 0
    hits = engine.offtargets(9606, "asm1", seq[500:512], 2).collect()
    assert [r.score for r in hits] == sorted((r.score for r in hits), reverse=True)
    report = engine.offtarget_report(9606, "asm1", seq[500:512], 2)
    assert report.total_bp == len(seq) + 8 and report.hits == len(hits)
    audit = {r.guide: r for r in engine.audit_guides(9606, "asm1", [seq[500:512], "ACGTACGTACGTACGTACGT"], 2).collect()}
    assert audit[seq[500:512]].hits == len(hits) and abs(audit[seq[500:512]].burden - report.burden) < 1e-9
    assert audit["ACGTACGTACGTACGTACGT"].offtarget_score == 1.0
    n = engine.index_cpg_islands(9606, "asm1", "chr5", gc=0.5, ratio=0.95)
    features = engine.catalog.table("epigenetic_features").collect()
    assert n == len(features) > 0 and features[0].feature_id.startswith("CGI:asm1:chr5:") and all(f.mark_label == f"CpG_Island_OE_{f.signal_value:.2f}" for f in features)
    assert [r.max_end for r in engine.gene_interval_index(9606, "asm1", "chr5").collect()] == [1900]
    assert [r.id for r in engine.transcript_interval_index("asm1", "chr5").collect()] == ["T1"]
    assert engine.genes_in_region(9606, "asm1", "chr5", 0, 2000).count() == 1 and engine.variants_by_region(9606, "asm1", "chr5", 9, 19).count() == 3


def test_feature_rule(engine, spark):
    genes = "gene_id string, assembly_name string, symbol string, name string, biotype string, tax_id int, feature_type string, source string"
    engine.catalog.put("genes", spark.createDataFrame([("X1", "asm9", "S", "N", "lncRNA", 7, "gene", "a")], genes))
    engine.catalog.put_features(spark.createDataFrame([("X1", "asm9", "S2", None, None, 7, "CDS", "b"), ("X2", "asm9", "T", None, None, 7, "gene", "b")], genes))
    rows = {r.gene_id: r for r in engine.catalog.find("genes", assembly_name="asm9").collect()}
    assert (rows["X1"].biotype, rows["X1"].symbol, rows["X1"].name, rows["X1"].feature_type) == ("lncRNA", "S2", "S2", "CDS")
    assert (rows["X2"].biotype, rows["X2"].name) == ("protein_coding", "T")
    assert gene_features(engine.catalog.table("genes")).columns[:2] == ["gene_id", "symbol"]


def test_omics(engine, spark):
    track = "tax_id int, assembly_name string, sample_id string, gene_symbol string, rna_tpm double, atac_accessibility double"
    engine.catalog.put("multiomics_tracks", spark.createDataFrame([(9606, "asm1", "s", "G", 2.0, 3.0)], track))
    assert engine.multiomics(9606, "asm1", "s", "G", score=F.col("rna_tpm") * F.col("atac_accessibility")).score == 6.0
    with pytest.raises(NotFound):
        engine.multiomics(9606, "asm1", "s", "H")
    engine.catalog.put("spatial_cells", spark.createDataFrame([("d", "c1", 10.0, 10.0), ("d", "c2", 90.0, 90.0)], "dataset_id string, cell_id string, x_um double, y_um double"))
    engine.catalog.put("spatial_transcripts", spark.createDataFrame([("d", "t", "G", 11.0, 9.5)], "dataset_id string, spot_id string, gene_symbol string, x_um double, y_um double"))
    assert {tuple(r) for r in engine.assign_spots("d", 5.0).collect()} == {("c1", 1), ("c2", 0)}
    engine.catalog.put("single_cell_atlas", spark.createDataFrame([("d", "k", "T", "1.5,x,2")], "dataset_id string, cell_id string, cell_type string, expression_csv string"))
    assert engine.single_cells("d").first().expression == [1.5, 2.0]
    engine.catalog.put("pharma_compounds", spark.createDataFrame([("p", "n", "G", 1.0, 4.0, 2.0, 6.0, 0.5)], ", ".join(engine.catalog.schema("pharma_compounds").split(", "))))
    rows = engine.regimen("p", 8.0, 6, 2, 6).orderBy("hour").collect()
    assert (rows[0].concentration, rows[0].within_window) == (4.0, False) and rows[6].concentration == pytest.approx(6.0) and rows[3].within_window


def test_index_files(spark, tmp_path):
    df = spark.createDataFrame([("c", "ACGTACGT")], "id string, seq string")
    path = f"file://{tmp_path}/index"
    store.save_index(kmers.postings(df, "id", 4), path, 4)
    index, k = store.load_index(spark, path)
    assert k == 4 and [tuple(r) for r in kmers.lookup(index, "acgu").collect()] == [("c", 0), ("c", 4)]
    assert kmers.jaccard_whole(index, "ACGTACGT", 4).first().jaccard == 1.0 and kmers.jaccard_whole(index, "A", 4).first().jaccard == 0.0
    with pytest.raises(NotFound):
        store.load_index(spark, f"{path}-none")
    (tmp_path / "index" / "meta" / next(p.name for p in (tmp_path / "index" / "meta").iterdir() if p.name.startswith("part"))).write_text("{}")
    for crc in (tmp_path / "index" / "meta").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(CorruptData):
        store.load_index(spark, path)
    cache = store.KeyValues()
    cache.set("a", b"x")
    assert cache.get("a") == b"x" and cache.remove("a") == b"x" and cache.get("a") is None


def test_suffixes(spark):
    rng = random.Random(9)
    texts = ["", "A", "GATGCGATCGATCGATCGATCGGGCATCGATCGATC", "".join(rng.choice("ACGTN") for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    want = {}
    for i, t in enumerate(texts):
        t = t.replace("N", "A") + "$"
        order = sorted(range(len(t)), key=lambda k: t[k:])
        want[i] = (order, "".join(t[k - 1] for k in order), t)
    assert {r.id: r.bwt for r in kmers.bwt(df, "id").collect()} == {i: w[1] for i, w in want.items()}
    for pattern in ("GATCG", "A", "CC", "TTTTTTTTT"):
        got = {r.id: (r.low, r.high) for r in kmers.suffix_interval(df, "id", pattern).collect()}
        for i, (order, _, t) in want.items():
            at = [r for r, k in enumerate(order) if t.startswith(pattern, k)]
            assert got.get(i) == ((at[0], at[-1] + 1) if at else None)
    assert kmers.suffix_interval(df, "id", "").count() == 0 and kmers.suffix_interval(df, "id", "N").count() == 0


def test_equal_rates(spark):
    row = spark.createDataFrame([(1, 2.0, 4.0, 0.5, 1.0), (2, 2.0, 4.0, 0.5 + 1e-7, 1.0)], "compound_id int, clearance double, volume double, absorption double, ec50 double")
    a, b = ([r.concentration for r in relations.dosing(row.filter(F.col("compound_id") == k), 10.0, 6, 2, 12).orderBy("hour").collect()] for k in (1, 2))
    assert a == pytest.approx(b, rel=1e-5)
