import pytest

from strandframe.sources import catalog, formats
from strandframe.streaming import ingest

GFF = """##gff-version 3
chr5\tx\tgene\t1001\t1800\t.\t+\t.\tID=gene:G1;gene_name=TERT
chr5\tx\tmRNA\t1001\t1800\t.\t+\t.\tID=transcript:T1;Parent=gene:G1
chr5\tx\texon\t1001\t1100\t.\t+\t.\tParent=transcript:T1
chr5\tx\texon\t1200\t1800\t.\t+\t.\tParent=transcript:T1
chr5\tx\tpseudogene\t3000\t3100\t.\t-\t.\tID=gene:G2;Name=P
chr5\tx\tgene\t5000\t4000\t.\t+\t.\tID=bad
chr5\tx\tmRNA\t1\t9\t.\t+\t.\tID=T2;Parent=gene:none
"""


@pytest.fixture
def package(tmp_path):
    (tmp_path / "a.fa").write_text(">chr5 some text\nACGT\nacgtn\n>MT\nAC\n")
    (tmp_path / "a.gff3").write_text(GFF)
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\nchr17\t7676154\trs1\tC\tG\t1\tPASS\t.\nchr17\t10\t.\tC\tCT,A\t1\tPASS\t.\n")
    p = formats.Package(9606, "asm1")
    return p.add_fasta(str(tmp_path / "a.fa")).add_gff3(str(tmp_path / "a.gff3")).add_vcf(str(tmp_path / "a.vcf"))


def test_formats(spark, package):
    fasta = {r.seq_id: r for r in formats.read_fasta(spark, package.fasta).collect()}
    assert fasta["chr5"].seq == "ACGTACGTN" and fasta["chr5"].length_bp == 9 and fasta["MT"].is_mitochondrial
    features = formats.read_gff(spark, package.gff)
    assert tuple(formats.gff_report(features).first()) == (2, 1, 2, 2, 5)
    genes = {r.symbol: r for r in formats.gff_genes(features).collect()}
    assert (genes["TERT"].start, genes["TERT"].end, genes["TERT"].gene_id) == (1000, 1800, "G1") and genes["P"].biotype == "pseudogene"
    assert sorted(r.exon_number for r in formats.gff_exons(features).collect()) == [1, 2]
    assert {r.transcript_id: r.exon_count for r in formats.gff_transcripts(features).collect()} == {"T1": 2, "T2": 1}
    variants = {r.variant_id: r for r in formats.read_vcf(spark, package.vcf).collect()}
    assert variants["rs1"].position == 7676153 and variants["rs1"].variant_type == "SNP" and variants["chr17:9:C>CT"].variant_type == "Insertion" and "chr17:9:C>A" in variants


def test_catalog(spark, package, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    assert c.table("longevity_targets").count() == 10
    assert [r.symbol for r in c.find("longevity_targets", "priority", "symbol", tax_id=9606).limit(2).collect()] == ["SIRT6", "TERC"]
    assert c.load(package) == {"chromosomes": 2, "bases": 11, "features": 5, "variants": 3}
    assert c.load(package)["variants"] == 3 and c.table("variant_records").count() == 3
    again = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    assert again.gene_feature(9606, "asm1", "TERT").first().gene_id == "G1"
    assert [r.name for r in again.find("chromosomes", "name", assembly_name="asm1").collect()] == ["MT", "chr5"]
    with pytest.raises(catalog.NotFound):
        again.one("organisms", tax_id=1)
    again.put("assemblies", spark.createDataFrame([(9606, "asm1", "web")], "tax_id int, assembly_name string, source string"))
    again.put("assemblies", spark.createDataFrame([(9606, "asm1", "note")], "tax_id int, assembly_name string, notes string"))
    assert tuple(again.one("assemblies", tax_id=9606))[2:] == ("web", None, "note")
    for bad in ("../evil", "sub/chr1", ""):
        with pytest.raises(ValueError):
            catalog.safe(bad)


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "y")], "k int, v string, w string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(catalog.upsert(old, new, ["k"])) == [(1, "a", "x"), (2, None, "z"), (3, "c", "y")]
    assert rows(catalog.upsert(old, new, ["k"], fill=True)) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "y")]
    assert rows(catalog.upsert(old, new, ["k"], ["w"])) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "y")]
    assert rows(catalog.insert_missing(old, new, ["k"])) == [(1, "a", "x"), (2, "b", None), (3, "c", "y")]
    once = catalog.upsert(old, new, ["k"])
    assert rows(catalog.upsert(once, new, ["k"])) == rows(once)


def test_stream(spark, package, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.vcf").write_text((tmp_path / "a.vcf").read_text())
    c = catalog.Catalog(spark, f"file://{tmp_path}/cat2")
    ingest.into_catalog(ingest.vcf_stream(spark, str(folder)), c, 9606, "asm1", str(tmp_path / "cp")).awaitTermination()
    assert c.table("variant_records").count() == 3


def test_checksums_of_whole_sequences(spark, tmp_path):
    import re
    import zlib

    from strandframe.plans import registry

    texts = ["ACGT", "", "xACGTNx tgc", "GATTACA" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: zlib.crc32(re.sub(registry.LETTERS, "", t).upper().encode()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.crc for r in registry.seq_crc32(spark, str(tmp_path)).collect()} == want
