from pyspark.sql import functions as F

from strandframe.functions import sequences as S


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_attributes(spark):
    get = lambda text: one(spark, S.attributes(F.col("t")), t=text)
    assert get('ID=gene:1;Name="A b";name=last') == {"id": "gene:1", "name": "last"}
    assert get('gene_id "G1"; note "x=y"') == {"gene_id": "G1", 'note "x': "y"}
    assert get("") == {} and get("novalue;;") == {}


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="acgtN") == "NACGT"
    assert one(spark, S.gc_percent(F.col("s")), s="ACGG") == 75.0
    assert one(spark, S.gc_percent(F.col("s")), s="") is None
    assert one(spark, S.slice_of(F.col("s"), 4, 6), s="ACGTUNRY") == "UN"
    assert one(spark, S.is_valid(F.col("s")), s="ACGTUNRYSWKMBDHVacgt") and not one(spark, S.is_valid(F.col("s")), s="ACGT123")
    assert one(spark, S.windows(F.col("s"), 4), s="ACG") == [] and one(spark, S.windows(F.col("s"), 4), s="ACGTA") == ["ACGT", "CGTA"]
    assert one(spark, F.crc32(F.col("s")), s="123456789") == 3421780262


def test_names_and_variants(spark):
    for name, want in {"chr1": (True, False, False), "chrX": (False, True, False), "MT": (False, False, True), "y": (False, True, False), "chr4294967296": (False, False, False)}.items():
        assert tuple(one(spark, f(F.col("n")), n=name) for f in (S.is_autosome, S.is_sex_chromosome, S.is_mitochondrial)) == want
    kinds = {("C", "G"): "SNP", ("C", "CG"): "Insertion", ("CG", "C"): "Deletion", ("CG", "TA"): "MNP"}
    for (a, b), want in kinds.items():
        assert one(spark, S.variant_class(F.col("a"), F.col("b")), a=a, b=b) == want
    assert one(spark, S.variant_id(F.lit("."), F.lit("chr1"), F.lit(9), F.lit("A"), F.lit("T"))) == "chr1:9:A>T"


def test_vectors(spark):
    assert one(spark, S.decode_vector(F.col("t")), t="1.5, x,2") == [1.5, 2.0]
    assert one(spark, S.encode_vector(F.array(F.lit(1.0), F.lit(-0.25)))) == "1.000000,-0.250000"
