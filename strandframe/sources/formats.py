"""FASTA, GFF3/GTF and VCF files as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions import sequences as S

#: Feature types by table, and the transcript types' names.
GENES = ("gene", "pseudogene")
TRANSCRIPTS = ("mrna", "transcript", "lnc_rna", "mirna", "ncrna")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(seq_id, header, seq, length_bp, sha256, is_mitochondrial, source_uri, line): a row a record, in upper case.

    A record begins with ``>`` at the start of a line; such a mark within a header is part of it. What comes before the
    first record is left out. A record is one string, so it is limited to 2 GB. line: the order of the records.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths).select("value", F.input_file_name().alias("source_uri"), F.monotonically_increasing_id().alias("line"))
    first = F.row_number().over(Window.partitionBy("source_uri").orderBy("line")) == 1  # only the records' first bytes are compared
    head = raw.select("source_uri", "line").withColumn("first", first).filter("first").select("line", F.lit(True).alias("first"))
    raw = raw.join(F.broadcast(head), "line", "left")  # one row a file
    mark = F.col("value").startswith(">")
    raw = raw.filter(F.col("first").isNull() | mark).withColumn("value", F.when(F.col("first") & mark, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))).filter(F.trim("value") != "")
    end = F.locate("\n", F.col("value"))
    header = F.trim(F.regexp_replace(F.when(end > 0, F.substring(F.col("value"), F.lit(1), end - 1)).otherwise(F.col("value")), "\r", ""))
    body = F.upper(F.regexp_replace(F.when(end > 0, F.substring(F.col("value"), end, F.length("value"))).otherwise(F.lit("")), r"\s+", ""))
    rows = raw.select(header.alias("header"), body.alias("seq"), "source_uri", "line").withColumn("seq_id", F.split("header", r"\s+")[0])
    return rows.select("seq_id", "header", "seq", F.length("seq").cast("long").alias("length_bp"), F.sha2(F.col("seq").cast("binary"), 256).alias("sha256"), S.is_mitochondrial(F.col("seq_id")).alias("is_mitochondrial"), "source_uri", "line")


def invalid_sequences(records: DataFrame) -> DataFrame:
    """Records with a symbol outside the alphabet, and where the first one is."""
    bad = F.regexp_instr("seq", F.lit(f"[^{S.ALPHABET}]"))
    return records.filter(~S.is_valid(F.col("seq"))).select("seq_id", (bad - 1).cast("long").alias("position"))


def read_gff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Typed features with 0-based half-open coordinates, attributes as a map, and ``skipped`` for unusable lines."""
    raw = spark.read.text(paths).withColumn("line", F.monotonically_increasing_id())
    raw = raw.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    start, end = F.get(f, F.lit(3)).try_cast("long"), F.get(f, F.lit(4)).try_cast("long")
    rows = raw.select("line", F.get(f, F.lit(0)).alias("seqid"), F.get(f, F.lit(1)).alias("source"), F.lower(F.get(f, F.lit(2))).alias("type"), (start - 1).alias("start"), end.alias("end"), F.when(F.get(f, F.lit(6)) == "-", "-").otherwise("+").alias("strand"), S.attributes(F.coalesce(F.get(f, F.lit(8)), F.lit(""))).alias("attr"), (F.size(f) < 9).alias("short"))
    return rows.withColumn("skipped", F.col("short") | F.coalesce(F.col("start") > F.col("end"), F.lit(True))).drop("short")


def _first(*keys: str):
    return F.coalesce(*(F.col("attr")[k] for k in keys))


def _place(prefix: str = ""):
    return F.concat(F.lit(prefix), F.col("seqid"), F.lit("_"), F.col("start").cast("string"), F.lit("_"), F.col("end").cast("string"))


def gff_genes(features: DataFrame) -> DataFrame:
    rows = features.filter(~F.col("skipped") & F.col("type").isin(*GENES))
    gene_id = S.strip_prefix(F.coalesce(_first("id", "gene_id"), _place()), "gene:")
    return rows.select(gene_id.alias("gene_id"), F.coalesce(_first("gene_name", "name", "gene", "symbol"), gene_id).alias("symbol"), F.coalesce(_first("biotype", "gene_biotype", "gene_type"), F.when(F.col("type") == "pseudogene", "pseudogene").otherwise("protein_coding")).alias("biotype"), F.col("attr")["description"].alias("description"), F.col("seqid").alias("chr"), "start", "end", "strand", F.col("type").alias("feature_type"), "source", "line")


def gff_exons(features: DataFrame) -> DataFrame:
    """Exons; those without a number are counted in file order within their transcript."""
    rows = features.filter(~F.col("skipped") & (F.col("type") == "exon"))
    exon_id = S.strip_prefix(F.coalesce(_first("id", "exon_id"), _place("exon_")), "exon:")
    parent = S.strip_prefix(F.coalesce(_first("parent", "transcript_id"), F.lit("")), "transcript:")
    given = F.coalesce(F.col("attr")["exon_number"].try_cast("long"), F.col("attr")["rank"].try_cast("long"))
    rows = rows.select("line", exon_id.alias("exon_id"), parent.alias("transcript_id"), F.col("seqid").alias("chr"), "start", "end", "strand", given.alias("given"))
    count = F.row_number().over(Window.partitionBy("transcript_id", F.col("given").isNull()).orderBy("line"))
    return rows.select("exon_id", "transcript_id", "chr", "start", "end", "strand", F.coalesce("given", count).cast("int").alias("exon_number"), "line")


def gff_transcripts(features: DataFrame) -> DataFrame:
    """Transcripts with their exon counts, 1 where no exon names them."""
    rows = features.filter(~F.col("skipped") & F.col("type").isin(*TRANSCRIPTS))
    transcript_id = S.strip_prefix(F.coalesce(_first("id", "transcript_id"), _place()), "transcript:")
    parent = S.strip_prefix(F.coalesce(_first("parent", "gene_id"), F.lit("")), "gene:")
    kind = F.when(F.col("type") == "mrna", "mRNA").when(F.col("type") == "transcript", "transcript").otherwise("ncRNA")
    rows = rows.select(transcript_id.alias("transcript_id"), parent.alias("gene_id"), kind.alias("biotype"), F.col("seqid").alias("chr"), "start", "end", "strand", "line")
    counts = gff_exons(features).groupBy("transcript_id").agg(F.count("*").alias("n"))
    return rows.join(counts, "transcript_id", "left").withColumn("exon_count", F.coalesce("n", F.lit(1)).cast("int")).drop("n")


def gff_tables(features: DataFrame, known_genes: DataFrame | None = None, known_transcripts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genes, the transcripts whose gene is there, and the exons whose transcript is: in the file, or among those known
    (gene_id), (transcript_id)."""
    genes = gff_genes(features)
    ids = genes.select("gene_id")
    transcripts = gff_transcripts(features).join(ids if known_genes is None else ids.unionByName(known_genes), "gene_id", "left_semi")
    ids = transcripts.select("transcript_id")
    return genes, transcripts, gff_exons(features).join(ids if known_transcripts is None else ids.unionByName(known_transcripts), "transcript_id", "left_semi")


def gff_report(features: DataFrame, known_genes: DataFrame | None = None, known_transcripts: DataFrame | None = None) -> DataFrame:
    """One row: genes, transcripts, exons, skipped (unusable lines and orphans), total."""
    used = ~F.col("skipped")
    kinds = {"g": GENES, "t": TRANSCRIPTS, "e": ("exon",)}
    read = features.agg(*(F.count_if(used & F.col("type").isin(*v)).alias(k) for k, v in kinds.items()), F.count_if(F.col("skipped")).alias("bad"))
    kept = [df.agg(F.count("*").alias(n)) for df, n in zip(gff_tables(features, known_genes, known_transcripts), ("genes", "transcripts", "exons"), strict=True)]
    row = read
    for one in kept:  # one row each
        row = row.crossJoin(one)
    out = row.select("genes", "transcripts", "exons", (F.col("bad") + F.col("t") - F.col("transcripts") + F.col("e") - F.col("exons")).alias("skipped"))
    return out.withColumn("total", F.col("genes") + F.col("transcripts") + F.col("exons"))


def vcf_rows(lines: DataFrame) -> DataFrame:
    """Variants of lines (value), and of their ``line`` if there is one. Of several alternates the first keeps the id that
    is given, and the others have it with a colon and their letters: no two share a key."""
    order = ["line"] if "line" in lines.columns else []
    f = F.split("value", "\t")
    data = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    rows = data.select(F.get(f, F.lit(0)).alias("chr"), (F.get(f, F.lit(1)).cast("long") - 1).alias("position"), F.get(f, F.lit(2)).alias("given"), F.get(f, F.lit(3)).alias("reference"), F.posexplode(F.split(F.get(f, F.lit(4)), ",")).alias("n", "alternate"), *order)
    named = F.coalesce("given", F.lit(".")).isin(".", "")
    given = F.when(named | (F.col("n") == 0), F.col("given")).otherwise(F.concat("given", F.lit(":"), "alternate"))
    return rows.select(S.variant_id(given, F.col("chr"), F.col("position"), F.col("reference"), F.col("alternate")).alias("variant_id"), "chr", "position", "reference", "alternate", S.variant_class(F.col("reference"), F.col("alternate")).alias("variant_type"), *order)


def read_vcf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(variant_id, chr, position, reference, alternate, variant_type, line): a row an ALT, positions 0-based."""
    return vcf_rows(spark.read.text(paths).withColumn("line", F.monotonically_increasing_id()))


@dataclass
class Package:
    """Paths of one assembly's files; organism and genome: columns of their tables, where they are to be registered."""

    tax_id: int
    assembly: str
    organism: dict[str, str] = field(default_factory=dict)
    genome: dict = field(default_factory=dict)
    fasta: list[str] = field(default_factory=list)
    gff: list[str] = field(default_factory=list)
    vcf: list[str] = field(default_factory=list)

    def add_fasta(self, path: str) -> Package:
        self.fasta.append(path)
        return self

    def add_gff3(self, path: str) -> Package:
        self.gff.append(path)
        return self

    def add_vcf(self, path: str) -> Package:
        self.vcf.append(path)
        return self
