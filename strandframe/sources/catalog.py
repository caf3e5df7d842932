"""A catalog of typed Parquet tables with keyed upserts. Each write goes to a new version; readers see whole versions."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandframe.errors import EncodingError, NotFound
from strandframe.session import cut, drop_cut
from strandframe.sources import formats
from strandframe.sources.store import UNSAFE, SequenceStore

#: Columns of each table, its key first after the bar's left side.
TABLES = {
    "organisms": "tax_id int | scientific_name string, common_name string, domain string, kingdom string, phylum string, class string, ord string, family string, genus string, species string",
    "reference_genomes": "assembly_name string | tax_id int, status string, release_year int",
    "chromosomes": "name string, assembly_name string | length bigint, is_mitochondrial boolean",
    "assemblies": "tax_id int, assembly_name string | source string, created_at string, notes string",
    "sequences": "tax_id int, assembly_name string, seq_id string | length_bp bigint, path string, sha256 string, source_uri string",
    "genes": "gene_id string, assembly_name string | symbol string, name string, biotype string, chr string, start bigint, end bigint, strand string, tax_id int, feature_type string, source string",
    "transcripts": "transcript_id string, assembly_name string | gene_id string, biotype string, chr string, start bigint, end bigint, strand string, exon_count int",
    "exons": "exon_id string, transcript_id string, assembly_name string | chr string, start bigint, end bigint, strand string, exon_number int",
    "protein_entries": "uniprot_accession string | entry_name string, gene_symbol string, tax_id int, status string, sequence string, length int",
    "protein_domains": "domain_id string, uniprot_accession string | name string, db string, start_aa int, end_aa int",
    "variant_records": "variant_id string, assembly_name string | chr string, position bigint, reference string, alternate string, variant_type string, tax_id int",
    "clinical_variants": "variant_id string, condition string | clinical_significance string, review_status string, gene_symbol string",
    "epigenetic_features": "feature_id string, assembly_name string | tax_id int, chr string, start bigint, end bigint, track_type string, mark_label string, signal_value double",
    "protein_structures": "structure_id string | gene_symbol string, tax_id int, resolution_angstrom double, residue_count int, pocket_volume_a3 double",
    "dataset_manifests": "manifest_id string | tax_id int, assembly_name string, provider string, source_sha256 string, ingested_at string",
    "regulatory_edges": "edge_id string | tax_id int, tf_symbol string, target_symbol string, interaction string, weight double, evidence_source string",
    "multiomics_tracks": "tax_id int, assembly_name string, sample_id string, gene_symbol string | rna_tpm double, atac_accessibility double, promoter_methylation_beta double, h3k27ac_chip double, h3k27ac_input double, enhancer_distance_bp bigint",
    "spatial_cells": "dataset_id string, cell_id string | x_um double, y_um double",
    "spatial_transcripts": "dataset_id string, spot_id string | gene_symbol string, x_um double, y_um double",
    "single_cell_atlas": "dataset_id string, cell_id string | cell_type string, expression_csv string",
    "pharma_compounds": "compound_id string | compound_name string, target_gene string, ec50_um double, td50_um double, hill_coefficient double, half_life_hours double, bioavailability double",
    "synthetic_gametes": "gamete_id string | tax_id int, gamete_type string, follicle_stage string, diameter_um double, mitochondrial_count bigint, imprint_fidelity double, aneuploidy_risk double, overall_score double",
    "longevity_targets": "tax_id int, symbol string | priority int, category string, default_assembly string, notes string",
}
#: Columns that an update leaves as they are, and tables where it sets a few only or fills nulls only.
KEPT = {"genes": ("feature_type", "source"), "epigenetic_features": ("tax_id",), "protein_structures": ("tax_id",)}
SET_ONLY = {"dataset_manifests": ("source_sha256", "ingested_at"), "regulatory_edges": ("interaction", "weight", "evidence_source")}
FILL = ("assemblies",)
#: Fixed value: targets of a new catalog (organism 9606).
SEED = {1: ("SIRT6", "TERC", "TERT", "TP53"), 2: ("ATM", "CDKN2A", "FOXO3", "KLOTHO", "LMNA", "PARP1")}


def safe(name: str) -> str:
    """A path component, or an error."""
    if re.search(UNSAFE, name):
        raise ValueError(f"unsafe name: {name!r}")
    return name


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None, fill: bool = False, order: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` put in by key.

    columns: those that an update sets (all by default); fill: a null of ``new`` keeps the old value. Of several new
    rows with one key the last in ``order`` counts; without an order, the greatest row (a stated one, the same at every run).
    """
    rest = [c for c in existing.columns if c not in keys]
    columns = rest if columns is None else columns
    new = last_of(new, keys, order)
    a = existing.select(*keys, *(F.col(c).alias(f"__old_{c}") for c in rest), F.lit(True).alias("__a"))
    b = new.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in rest), F.lit(True).alias("__b"))
    both = a.join(b, keys, "full_outer")

    def value(c: str):
        old, fresh = F.col(f"__old_{c}"), F.col(f"__new_{c}")
        changed = F.coalesce(fresh, old) if fill else fresh
        return F.when(F.col("__b").isNull(), old).when(F.col("__a").isNull(), fresh).otherwise(changed if c in columns else old).alias(c)

    return both.select(*((F.col(c) if c in keys else value(c)) for c in existing.columns))


def last_of(new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key, by a partial aggregation."""
    rest = [c for c in new.columns if c not in keys and c != order]
    if not rest:
        return new.select(*keys).distinct()
    whole = F.struct(*([order] if order else []), *rest)
    return new.groupBy(*keys).agg(F.max(whole).alias("__row")).select(*keys, *(F.col("__row").getField(c).alias(c) for c in rest))


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet are added; nothing is overwritten."""
    return existing.unionByName(last_of(new, keys, None).join(existing.select(*keys), keys, "left_anti").select(existing.columns))


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions: dict[str, int] = {}
        self.state, names = 0, self._states()
        if names:
            self.state = max(names)
            self.versions = json.loads("".join(r[0] for r in spark.read.text(f"{self.root}/{self._state_name(self.state)}").collect()))
        else:
            seed = [(9606, s, p, "longevity", None, None) for p, names in SEED.items() for s in names]
            self.put("longevity_targets", spark.createDataFrame(seed, self.schema("longevity_targets")), missing_only=True)

    @staticmethod
    def schema(name: str) -> str:
        return TABLES[name].replace(" | ", ", ").replace("class string", "`class` string")

    @staticmethod
    def _state_name(number: int) -> str:
        return f"state-{number:09d}.json"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _states(self) -> list[int]:
        path, fs = self._files()
        if not fs.exists(path(self.root)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.root))]
        return [int(m[1]) for n in names if (m := re.fullmatch(r"state-(\d{9})\.json", n))]

    def _commit(self) -> None:
        """The current versions as a new file that takes its name when it is whole; the last few stay."""
        path, fs = self._files()
        part, whole = path(f"{self.root}/_state-{self.state + 1}"), path(f"{self.root}/{self._state_name(self.state + 1)}")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(self.versions).encode()))
        stream.close()
        if not fs.rename(part, whole):
            raise OSError(f"another writer made {whole}")
        self.state += 1
        for old in self._states():
            if old <= self.state - 3:
                fs.delete(path(f"{self.root}/{self._state_name(old)}"), False)

    def columns(self, name: str) -> list[str]:
        return [x.split()[0].strip("`") for x in self.schema(name).split(", ")]

    @staticmethod
    def keys(name: str) -> list[str]:
        return [x.split()[0] for x in TABLES[name].split(" | ")[0].split(", ")]

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise NotFound(name)
        if name not in self.versions:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.root}/{name}/v{self.versions[name]}")

    def put(self, name: str, rows: DataFrame, missing_only: bool = False, columns: list[str] | None = None) -> None:
        """Upsert by the table's own rules, to a new version that becomes current when it is whole.

        Of rows with one key the last counts: that of the largest ``line``, if there is such a column. columns: those
        that an update sets, where it is not by the table's rule.
        """
        old, keys = self.table(name), self.keys(name)
        order = "line" if "line" in rows.columns else None
        for c, kind in old.dtypes:
            rows = rows.withColumn(c, F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind))
        rows = rows.select(*old.columns, *([order] if order else []))
        rest = [c for c in old.columns if c not in keys and c not in KEPT.get(name, ())]
        out = insert_missing(old, rows, keys) if missing_only else upsert(old, rows, keys, columns or list(SET_ONLY.get(name, rest)), name in FILL, order)
        version = self.versions.get(name, 0) + 1
        out.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")
        self.versions[name] = version
        self._commit()

    def put_features(self, rows: DataFrame) -> None:
        """Gene features: new ones are protein_coding and named by their symbol; an update leaves the biotype as it is."""
        rows = rows.withColumn("biotype", F.lit("protein_coding")).withColumn("name", F.col("symbol"))
        self.put("genes", rows, columns=[c for c in self.columns("genes") if c not in (*self.keys("genes"), "biotype")])

    def find(self, name: str, *order: str, limit: int | None = None, **equal) -> DataFrame:
        """Rows with the given values, in a stated order; ties are broken by the key."""
        df = self.table(name)
        for c, v in equal.items():
            df = df.filter(F.col(c) == v)
        df = df.orderBy(*order, *self.keys(name))
        return df.limit(limit) if limit else df

    def one(self, name: str, **equal):
        row = self.find(name, limit=1, **equal).first()
        if row is None:
            raise NotFound(f"{name} {equal}")
        return row

    def gene_feature(self, tax_id: int, assembly: str, name: str) -> DataFrame:
        """By symbol or id; features of type gene first."""
        rows = self.table("genes").filter((F.col("tax_id") == tax_id) & (F.col("assembly_name") == assembly) & ((F.col("symbol") == name) | (F.col("gene_id") == name)))
        return rows.orderBy(F.when(F.col("feature_type") == "gene", 0).otherwise(1), "gene_id").limit(1)

    def ingest_fasta(self, store: SequenceStore, path: str | list[str], tax_id: int, assembly: str, source_uri: str | None = None) -> DataFrame:
        """Symbols to the store, then rows of assemblies, sequences and chromosomes; the sequences' rows."""
        scope = {"tax_id": F.lit(tax_id), "assembly_name": F.lit(safe(assembly))}
        records = formats.read_fasta(self.spark, path).withColumns(scope)
        if source_uri:
            records = records.withColumn("source_uri", F.lit(source_uri))
        bad = formats.invalid_sequences(records).first()
        if bad:
            raise EncodingError(f"{bad.seq_id}: a symbol outside the alphabet at {bad.position}")
        store.store(records)
        where = F.concat_ws("/", F.lit(f"{store.root}/tax_id={tax_id}/assembly_name={assembly}"), F.concat(F.lit("seq_id="), F.col("seq_id")))
        self.put("assemblies", self.spark.createDataFrame([(tax_id, assembly)], "tax_id int, assembly_name string"))
        self.put("sequences", records.withColumn("path", where))
        self.put("chromosomes", records.select(F.col("seq_id").alias("name"), "assembly_name", F.col("length_bp").alias("length"), "is_mitochondrial"))
        written = records.select("seq_id").distinct()
        return self.table("sequences").filter((F.col("tax_id") == tax_id) & (F.col("assembly_name") == assembly)).join(written, "seq_id", "left_semi")

    def ingest_gff(self, path: str | list[str], tax_id: int, assembly: str) -> Row:
        """Genes, then transcripts of known genes, then exons of known transcripts; others are skipped, as the report counts."""
        scope = {"tax_id": F.lit(tax_id), "assembly_name": F.lit(safe(assembly))}
        features = cut(formats.read_gff(self.spark, path))  # parsed once
        here = F.col("assembly_name") == assembly
        known = (self.table("genes").filter(here).select("gene_id"), self.table("transcripts").filter(here).select("transcript_id"))
        genes, transcripts, exons = formats.gff_tables(features, *known)
        report = formats.gff_report(features, *known).first()
        self.put("genes", genes.withColumns(scope).withColumn("name", F.col("symbol")))
        self.put("transcripts", transcripts.withColumns(scope))
        self.put("exons", exons.withColumns(scope))
        drop_cut(features)
        return report

    def ingest_vcf(self, path: str | list[str], tax_id: int, assembly: str) -> int:
        variants = formats.read_vcf(self.spark, path).withColumns({"tax_id": F.lit(tax_id), "assembly_name": F.lit(safe(assembly))})
        self.put("variant_records", variants)
        return variants.count()

    def load(self, package: formats.Package, store: SequenceStore | None = None) -> dict[str, int]:
        """A package in order: organism, genome, FASTA, GFF, VCF; counts of what was read. Every step can be repeated."""
        store = store or SequenceStore(self.spark, self.root)
        asm, tax = safe(package.assembly), package.tax_id
        report = {"chromosomes": 0, "bases": 0, "features": 0, "variants": 0}
        if package.organism:
            self.put("organisms", self.spark.createDataFrame([(tax, *package.organism.values())], ", ".join(["tax_id int", *(f"`{c}` string" for c in package.organism)])))
        if package.genome:
            self.put("reference_genomes", self.spark.createDataFrame([(asm, tax, package.genome.get("status"), package.genome.get("release_year"))], "assembly_name string, tax_id int, status string, release_year int"))
        if package.fasta:
            r = self.ingest_fasta(store, package.fasta, tax, asm).agg(F.count("*"), F.coalesce(F.sum("length_bp"), F.lit(0))).first()
            report["chromosomes"], report["bases"] = r[0], r[1]
        if package.gff:
            report["features"] = self.ingest_gff(package.gff, tax, asm).total
        if package.vcf:
            report["variants"] = self.ingest_vcf(package.vcf, tax, asm)
        return report
