"""The engine: one folder with a catalog and a sequence store, its imports, lookups and scans.

Lookups of one row raise NotFound; lists are DataFrames in a stated order. Coordinates are 0-based and half-open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandframe.errors import CorruptData, InvalidCoordinates, NotFound
from strandframe.functions import sequences as S
from strandframe.operators import intervals, kmers, relations
from strandframe.sources import formats
from strandframe.sources.catalog import Catalog
from strandframe.sources.store import SequenceStore

HUMAN = 9606


@dataclass(frozen=True)
class Locus:
    """A gene with the symbols of its window; ``len`` is their number."""

    gene: Row
    target: Row | None
    sequence: str
    window_start: int
    window_end: int
    provenance_sha256: str
    tax_id: int
    assembly: str

    def __len__(self) -> int:
        return len(self.sequence)

    @property
    def is_empty(self) -> bool:
        return not self.sequence


def gene_features(genes: DataFrame) -> DataFrame:
    """Rows of the genes table as features: their place, symbol, type and source."""
    return genes.select("gene_id", "symbol", "tax_id", "assembly_name", F.col("chr").alias("chrom"), F.col("start").alias("start_bp"), F.col("end").alias("end_bp"), "strand", F.coalesce("feature_type", F.lit("gene")).alias("feature_type"), F.coalesce("source", F.lit("")).alias("source"))


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.catalog = Catalog(spark, root)
        self.store = SequenceStore(spark, root)

    # -- registration and imports

    def _put(self, name: str, **values) -> None:
        row = {k: values.get(k) for k in self.catalog.columns(name)}
        unknown = set(values) - set(row)
        if unknown:
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        self.catalog.put(name, self.spark.createDataFrame([tuple(row.values())], self.catalog.schema(name)))

    def register_organism(self, **values) -> None:
        self._put("organisms", **values)

    def register_reference_genome(self, **values) -> None:
        self._put("reference_genomes", **values)

    def register_assembly(self, **values) -> None:
        self._put("assemblies", **values)

    def register_target(self, **values) -> None:
        self._put("longevity_targets", **values)

    def ingest_fasta(self, path: str | list[str], tax_id: int, assembly: str, source_uri: str | None = None) -> DataFrame:
        """Sequences to the store, their digests to the catalog; the rows of ``sequences`` that were written."""
        return self.catalog.ingest_fasta(self.store, path, tax_id, assembly, source_uri)

    def ingest_gff3(self, path: str | list[str], tax_id: int, assembly: str) -> Row:
        """genes, transcripts, exons, skipped, total."""
        return self.catalog.ingest_gff(path, tax_id, assembly)

    def ingest_vcf(self, path: str | list[str], tax_id: int, assembly: str) -> int:
        return self.catalog.ingest_vcf(path, tax_id, assembly)

    def load(self, package: formats.Package) -> dict[str, int]:
        return self.catalog.load(package, self.store)

    def store_sequence(self, tax_id: int, assembly: str, seq_id: str, seq: str) -> None:
        """To the store only: scans of an assembly, which go by the catalog, don't see it."""
        self.store.store_sequence(tax_id, assembly, seq_id, seq)

    # -- sequences

    def fetch_sequence(self, tax_id: int, assembly: str, seq_id: str, start: int, end: int) -> str:
        return self.store.fetch(tax_id, assembly, seq_id, start, end)

    def fetch_full_sequence(self, tax_id: int, assembly: str, seq_id: str) -> str:
        return self.store.fetch_full(tax_id, assembly, seq_id)

    def sequence_ref(self, tax_id: int, assembly: str, seq_id: str) -> Row:
        return self.catalog.one("sequences", tax_id=tax_id, assembly_name=assembly, seq_id=seq_id)

    def verify_sequence(self, tax_id: int, assembly: str, seq_id: str) -> bool:
        """True, or an error: no such sequence, or other symbols than its digest tells."""
        self.sequence_ref(tax_id, assembly, seq_id)
        row = self.catalog.find("sequences", tax_id=tax_id, assembly_name=assembly, seq_id=seq_id)
        if not self.store.verified(row).first().intact:
            raise CorruptData(f"{tax_id}:{assembly}:{seq_id} does not match its digest")
        return True

    def assembly_sequences(self, tax_id: int, assembly: str, seq_id: str | None = None) -> DataFrame:
        """(seq_id, seq) of the catalog's chromosomes of an assembly, or of one sequence."""
        held = self.store.table().filter((F.col("tax_id") == tax_id) & (F.col("assembly_name") == assembly))
        if seq_id is not None:
            self.store.length(tax_id, assembly, seq_id)
            held = held.filter(F.col("seq_id") == seq_id)
        else:
            names = self.catalog.table("chromosomes").filter(F.col("assembly_name") == assembly).select(F.col("name").alias("seq_id"))
            held = held.join(names, "seq_id", "left_semi")
        return kmers.fetch_full(held.select("seq_id", "chunk_id", "chunk_start", "seq"), "seq_id", self.store.chunk)

    # -- indexes and scans over the store

    def kmer_index(self, tax_id: int, assembly: str, k: int, seq_id: str | None = None) -> DataFrame:
        """(seq_id, pos, kmer)."""
        return kmers.postings(self.assembly_sequences(tax_id, assembly, seq_id), "seq_id", k)

    def similarity(self, tax_id: int, assembly: str, seq_id: str, query: str, k: int) -> float:
        index = self.kmer_index(tax_id, assembly, k, seq_id)
        row = kmers.jaccard(index, "seq_id", query, k).first()
        return row.jaccard if row else 0.0

    def count_exact(self, tax_id: int, assembly: str, pattern: str) -> DataFrame:
        """(seq_id, n) of overlapping occurrences."""
        return kmers.count_exact(self.assembly_sequences(tax_id, assembly), "seq_id", pattern)

    def locate_exact(self, tax_id: int, assembly: str, pattern: str) -> DataFrame:
        return kmers.locate_exact(self.assembly_sequences(tax_id, assembly), "seq_id", pattern).orderBy("seq_id", "pos")

    def locate_approximate(self, tax_id: int, assembly: str, pattern: str, mismatches: int) -> DataFrame:
        return kmers.locate_approximate(self.assembly_sequences(tax_id, assembly), "seq_id", pattern, mismatches).orderBy("mismatches", "seq_id", "pos")

    def offtargets(self, tax_id: int, assembly: str, guide: str, mismatches: int, seq_id: str | None = None, weights: DataFrame | None = None) -> DataFrame:
        """Sites beside a PAM, the highest score first."""
        sites = kmers.pam_sites(self.assembly_sequences(tax_id, assembly, seq_id), "seq_id", guide, mismatches, weights=weights)
        return sites.orderBy(F.desc("score"), "seq_id", "strand", "pos")

    def offtarget_report(self, tax_id: int, assembly: str, guide: str, mismatches: int) -> Row:
        lengths = self.catalog.table("chromosomes").filter(F.col("assembly_name") == assembly).select("length")
        return kmers.offtarget_report(self.offtargets(tax_id, assembly, guide, mismatches), lengths).first()

    def audit_guides(self, tax_id: int, assembly: str, guides: list[str], mismatches: int) -> DataFrame:
        """(guide, exact, hits, burden, specificity, offtarget_score) of each guide; the score is 100 - specificity within 1 and 50."""
        return kmers.audit_guides(self.assembly_sequences(tax_id, assembly), "seq_id", guides, mismatches)

    def index_cpg_islands(self, tax_id: int, assembly: str, seq_id: str, **limits) -> int:
        """Islands of a sequence as rows of ``epigenetic_features``; their number."""
        islands = kmers.cpg_features(self.assembly_sequences(tax_id, assembly, seq_id), "seq_id", assembly, **limits).withColumn("tax_id", F.lit(tax_id)).cache()
        n = islands.count()
        self.catalog.put("epigenetic_features", islands)
        islands.unpersist()
        return n

    # -- genes, proteins, variants

    def gene_by_symbol(self, tax_id: int, assembly: str, symbol: str) -> Row:
        row = gene_features(self.catalog.gene_feature(tax_id, assembly, symbol)).first()
        if row is None:
            raise NotFound(f"no gene {symbol} in {assembly} of {tax_id}")
        return row

    def genes_in_region(self, tax_id: int, assembly: str, seq_id: str, start: int, end: int) -> DataFrame:
        return gene_features(intervals.in_region(self._scoped("genes", tax_id, assembly, seq_id), start, end, checked=True))

    def _scoped(self, name: str, tax_id: int | None, assembly: str | None, seq_id: str | None) -> DataFrame:
        df = self.catalog.table(name)
        for column, value in (("tax_id", tax_id), ("assembly_name", assembly), ("chr", seq_id)):
            if value is not None:
                df = df.filter(F.col(column) == value)
        return df

    def genes_by_region(self, seq_id: str, start: int, end: int, tax_id: int | None = None, assembly: str | None = None) -> DataFrame:
        return intervals.in_region(self._scoped("genes", tax_id, assembly, seq_id), start, end)

    def variants_by_region(self, tax_id: int, assembly: str, seq_id: str, start: int, end: int) -> DataFrame:
        return intervals.points_in(self._scoped("variant_records", tax_id, assembly, seq_id), start, end)

    def epigenetic_features(self, tax_id: int, assembly: str, seq_id: str, start: int, end: int) -> DataFrame:
        return intervals.in_region(self._scoped("epigenetic_features", tax_id, assembly, seq_id), start, end)

    def gene_interval_index(self, tax_id: int, assembly: str, seq_id: str) -> DataFrame:
        """(chr, start, end, id, max_end) in order."""
        rows = self._scoped("genes", tax_id, assembly, seq_id).select("chr", "start", "end", F.col("gene_id").alias("id"))
        return intervals.running_max_end(rows, ["chr"], ["start", "end", "id"])

    def transcript_interval_index(self, assembly: str, seq_id: str) -> DataFrame:
        rows = self.catalog.table("transcripts").filter((F.col("assembly_name") == assembly) & (F.col("chr") == seq_id)).select("chr", "start", "end", F.col("transcript_id").alias("id"))
        return intervals.running_max_end(rows, ["chr"], ["start", "end", "id"])

    # -- targets and loci

    def target(self, symbol: str, tax_id: int | None = None) -> Row | None:
        """The target of an organism; without one, the human target if there is one, else that of the smallest tax_id."""
        rows = self.catalog.table("longevity_targets").filter(F.col("symbol") == symbol)
        if tax_id is not None:
            rows = rows.filter(F.col("tax_id") == tax_id)
        return rows.orderBy(F.when(F.col("tax_id") == HUMAN, 0).otherwise(1), "tax_id").first()

    def targets(self, tax_id: int) -> DataFrame:
        return self.catalog.find("longevity_targets", "priority", "symbol", tax_id=tax_id)

    def locus(self, tax_id: int, assembly: str, symbol: str, upstream: int = 0, downstream: int = 0) -> Locus:
        """A gene's window with its symbols; the rules are those of ``relations.locus_windows``."""
        gene = self.gene_by_symbol(tax_id, assembly, symbol)
        ref = self.catalog.find("sequences", tax_id=tax_id, assembly_name=assembly, seq_id=gene.chrom).first()
        n = ref.length_bp if ref else self.store.length(tax_id, assembly, gene.chrom)
        if n >= gene.end_bp:
            lo, hi = max(gene.start_bp - upstream, 0), min(gene.end_bp + downstream, n)
            window = (lo, hi)
        elif 0 < n <= gene.start_bp:
            lo, hi = 0, n
            window = (gene.start_bp, gene.start_bp + n)
        else:
            raise InvalidCoordinates(f"{symbol}: [{gene.start_bp}, {gene.end_bp}) of {n}")
        if lo >= hi:
            raise InvalidCoordinates(f"{symbol}: [{lo}, {hi})")
        return Locus(gene, self.target(symbol, tax_id) or self.target(symbol), self.store.fetch(tax_id, assembly, gene.chrom, lo, hi), *window, ref.sha256 if ref else "", tax_id, assembly)

    def loci(self, tax_id: int, assembly: str, upstream: int = 0, downstream: int = 0) -> DataFrame:
        """All genes of an assembly with their windows and symbols, in joins; genes without a window have valid = false."""
        genes = self._scoped("genes", tax_id, assembly, None).select("symbol", "tax_id", "assembly_name", "chr", "start", "end")
        return relations.locus_sequences(genes, self.catalog.table("sequences"), self.catalog.table("longevity_targets"), self.store, upstream, downstream)

    # -- regulation, omics

    def regulatory_order(self, tax_id: int) -> DataFrame:
        """(node, depth) of the organism's network."""
        edges = self.catalog.table("regulatory_edges").filter(F.col("tax_id") == tax_id)
        return relations.topological_depth(edges.select(F.col("tf_symbol").alias("source"), F.col("target_symbol").alias("target")))

    def multiomics(self, tax_id: int, assembly: str, sample_id: str, gene_symbol: str, **scores: Column) -> Row:
        """The track of a gene in a sample, with expressions over its columns that the caller names."""
        row = self.catalog.find("multiomics_tracks", tax_id=tax_id, assembly_name=assembly, sample_id=sample_id, gene_symbol=gene_symbol).withColumns(scores).first()
        if row is None:
            raise NotFound(f"no track of {gene_symbol} in {sample_id}")
        return row

    def assign_spots(self, dataset_id: str, radius: float) -> DataFrame:
        """(cell_id, total_transcripts) of all cells of a dataset."""
        spots = self.catalog.find("spatial_transcripts", dataset_id=dataset_id).select("spot_id", F.col("x_um").alias("x"), F.col("y_um").alias("y"))
        cells = self.catalog.find("spatial_cells", dataset_id=dataset_id).select("cell_id", F.col("x_um").alias("x"), F.col("y_um").alias("y"))
        return relations.cell_totals(spots, cells, radius)

    def single_cells(self, dataset_id: str) -> DataFrame:
        """Records of a dataset with their expression vectors read from text."""
        rows = self.catalog.find("single_cell_atlas", "cell_id", dataset_id=dataset_id)
        return rows.withColumn("expression", S.decode_vector(F.col("expression_csv")))

    def regimen(self, compound_id: str, dose: float, interval: int, doses: int, hours: int) -> DataFrame:
        compound = self.catalog.find("pharma_compounds", compound_id=compound_id)
        if compound.isEmpty():
            raise NotFound(f"no compound {compound_id}")
        return relations.regimen(compound, dose, interval, doses, hours)
