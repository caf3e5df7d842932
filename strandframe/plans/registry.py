"""Queries over the driver's tables, one for each operator, and the SQL that says the same.

Roles: documents are sequences (letters of the nucleotide alphabet only), lineitem and orders intervals, part records
with ids and symbols, embeddings points, customer slices upsert batches, nation and region a graph.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.engine import Engine
from strandframe.functions import sequences as S
from strandframe.operators import intervals, kmers, relations
from strandframe.session import cut, shared_folder
from strandframe.sources import catalog, formats
from strandframe.sources.store import SequenceStore

QUERIES: dict = {}
ORACLES: dict = {}

GUIDE = "ACGATTTCG"
PATTERN = "ATTGCA"
PROBE = "THEREANDTHATTHISWASTHEREDANDTHEN"
LETTERS = "[^ACGTUNRYSWKMBDHVacgtunryswkmbdhv]"
#: Bytes of the documents' files for one task.
TASK = 8 << 20
SEQ = f"upper(regexp_replace(text, '{LETTERS}', '', 'g'))"
#: Fixed value: complements.
REVCOMP = "reverse(translate({0}, 'ACGTUNRYSWKMBDHV', 'TGCAANYRSWMKVHDB'))"
DNA = f"replace({SEQ}, 'U', 'T')"
FM = f"regexp_replace({DNA}, '[^ACGT]', 'A', 'g')"


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a text in UTF-8: one step a byte, through the table that the polynomial makes."""
    rule = lambda n: (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
    entries = range(256)
    for _ in range(8):
        entries = [rule(n) for n in entries]
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, (CAST({list(entries)} AS BIGINT[]))[xor(c & 255, b) + 1])))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, seq): spread over tasks before anything is exploded, so many that none has much."""
    rows = t(spark, d, "documents")
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(8, spark.sparkContext.defaultParallelism, size // TASK)
    rows = rows.select("doc_id", "text").repartition(n, "doc_id")
    return rows.mapInArrow(_lettered, T.StructType([rows.schema["doc_id"], T.StructField("seq", T.StringType())]))


def _lettered(batches):
    """Texts without what is not in the alphabet, in upper case."""
    import pyarrow as pa

    own = S.ALPHABET + S.ALPHABET.lower()
    upper, rest = bytes(range(256)).upper(), bytes(i for i in range(128) if chr(i) not in own)
    for batch in batches:
        texts = (x.as_py() for x in batch.column(1))
        seq = pa.array([None if x is None else x.encode("ascii", "ignore").translate(upper, rest).decode() for x in texts], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), seq], ["doc_id", "seq"])


def days(c: str) -> F.Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01")).cast("long")


def shipping(spark: SparkSession, d: str) -> DataFrame:
    start = days("l_shipdate")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


SHIP = "(SELECT l_orderkey, l_linenumber, l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"


def fresh(spark: SparkSession, kind: str) -> str:
    """A folder of its own that driver and executors share."""
    return f"{shared_folder(spark)}/strandframe/{kind}-{uuid.uuid4().hex}"


def cat(spark: SparkSession, d: str) -> catalog.Catalog:
    """A catalog whose genes are parts, and whose organisms are suppliers."""
    out = catalog.Catalog(spark, fresh(spark, "catalog"))
    start = F.col("p_size") * 100
    out.put("genes", t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("gene_id"), F.lit("a").alias("assembly_name"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("chr"), start.alias("start"), (start + 150).alias("end"), F.lit(9606).alias("tax_id"), F.when(F.col("p_partkey") % 3 == 0, "gene").otherwise("CDS").alias("feature_type")))
    out.put("organisms", t(spark, d, "supplier").select(F.col("s_suppkey").alias("tax_id"), F.col("s_name").alias("scientific_name")))
    return out


@query("SELECT CAST(s_suppkey AS INT) AS tax_id, s_name AS scientific_name FROM supplier WHERE s_suppkey = 7")
def point_lookup(spark, d):
    return cat(spark, d).find("organisms", tax_id=7).select("tax_id", "scientific_name")


@query("SELECT CAST(p_partkey AS VARCHAR) AS gene_id, p_name AS symbol FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 11) OR CAST(p_partkey AS VARCHAR) = (SELECT p_name FROM part WHERE p_partkey = 11) ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END, CAST(p_partkey AS VARCHAR) LIMIT 1")
def lookup_symbol_or_id_first(spark, d):
    name = t(spark, d, "part").filter("p_partkey = 11").first().p_name
    return cat(spark, d).gene_feature(9606, "a", name).select("gene_id", "symbol")


@query("SELECT CAST(p_partkey AS VARCHAR) AS gene_id, CAST(p_size * 100 AS BIGINT) AS \"start\" FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def list_scoped_sorted(spark, d):
    brand = t(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return cat(spark, d).find("genes", "start", assembly_name="a", chr=brand).select("gene_id", "start")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT min(ts) FROM events) AND ts < (SELECT min(ts) FROM events) + INTERVAL 1 DAY")
def point_in_range(spark, d):
    events = t(spark, d, "events")
    lo = events.agg(F.min("ts")).first()[0]  # one value: it reaches the scan as a literal
    return intervals.points_in(events, F.lit(lo).cast("timestamp_ntz"), F.lit(lo).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"), "ts").select("event_id", "user_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS gene_id FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size * 100 < 2000 AND p_size * 100 + 150 > 1000")
def genes_in_region(spark, d):
    engine = Engine(spark, cat(spark, d).root)
    brand = t(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return engine.genes_in_region(9606, "a", brand, 1000, 2000).select("gene_id")


def stored(spark: SparkSession, d: str) -> SequenceStore:
    """All documents, laid end to end in sixteen sequences of a store: (9606, a, c0) to (9606, a, c15)."""
    store = SequenceStore(spark, fresh(spark, "store"), 5000)
    store.store_pieces(docs(spark, d).filter("seq IS NOT NULL").select(F.lit(9606).alias("tax_id"), F.lit("a").alias("assembly_name"), F.concat(F.lit("c"), (F.col("doc_id") % 16).cast("string")).alias("seq_id"), F.col("doc_id").alias("part"), "seq"))
    return store


_STORED = f"(SELECT 'c' || (doc_id % 16) AS seq_id, string_agg(s, '' ORDER BY doc_id) AS s FROM (SELECT doc_id, {SEQ} AS s FROM documents) GROUP BY ALL)"


@query(f"SELECT seq_id, i * 6000 AS \"start\", i * 6000 + 6000 AS \"end\", i * 6000 + 6000 <= length(s) AS valid, CASE WHEN i * 6000 + 6000 <= length(s) THEN sha256(substring(s, CAST(i * 6000 + 1 AS BIGINT), 6000)) END AS sha FROM (SELECT seq_id, s, unnest(range(0, length(s) // 6000 + 1)) AS i FROM {_STORED})")
def store_fetch(spark, d):
    """Every sequence in slices; the last one reaches beyond its end."""
    store = stored(spark, d)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length_bp"), F.lit(6000).cast("long")))
    regions = store.lengths().select("tax_id", "assembly_name", "seq_id", starts.alias("start")).withColumn("end", F.col("start") + 6000)
    return store.slices(regions).select("seq_id", "start", "end", "valid", F.sha2("seq", 256).alias("sha"))


@query(f"SELECT seq_id, CAST(length(s) AS BIGINT) AS length_bp, seq_id <> 'c3' AS intact FROM {_STORED}")
def store_verify(spark, d):
    """Digests of what was stored, one of them wrong."""
    store = stored(spark, d)
    told = store.digests().withColumn("sha256", F.when(F.col("seq_id") == "c3", F.lit("0")).otherwise(F.col("sha256")))
    return store.verified(told).join(store.lengths().select("seq_id", "length_bp"), "seq_id").select("seq_id", "length_bp", "intact")


@query(f"""
WITH g AS (SELECT p_partkey, p_name, 'c' || (p_partkey % 16) AS seq_id, p_size * 200 AS gs, p_size * 200 + 300 AS ge FROM part),
w AS (SELECT p_partkey, s, CASE WHEN length(s) >= ge THEN greatest(gs - 50, 0) WHEN length(s) > 0 AND gs >= length(s) THEN 0 END AS lo, CASE WHEN length(s) >= ge THEN least(ge + 30, length(s)) WHEN length(s) > 0 AND gs >= length(s) THEN length(s) END AS hi FROM g JOIN {_STORED} USING (seq_id))
SELECT CAST(p_partkey AS VARCHAR) AS symbol, coalesce(hi > lo, false) AS valid, CASE WHEN hi > lo THEN sha256(substring(s, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT))) END AS sha FROM w""")
def locus_sequence(spark, d):
    store = stored(spark, d)
    start = (F.col("p_size") * 200).cast("long")
    genes = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.lit(9606).alias("tax_id"), F.lit("a").alias("assembly_name"), F.concat(F.lit("c"), (F.col("p_partkey") % 16).cast("string")).alias("chr"), start.alias("start"), (start + 300).alias("end"))
    sequences = store.lengths().withColumn("sha256", F.lit(""))
    targets = spark.createDataFrame([], "tax_id int, symbol string, priority int")
    out = relations.locus_sequences(genes, sequences, targets, store, 50, 30)
    return out.select("symbol", "valid", F.sha2("sequence", 256).alias("sha"))


def written(rows: DataFrame, kind: str) -> str:
    """A column of lines as text files."""
    path = fresh(rows.sparkSession, kind)
    rows.write.text(path)
    return path


@query(f"SELECT 'd' || doc_id AS seq_id, 'd' || doc_id || ' of > ' || source AS header, CAST(length({SEQ}) AS BIGINT) AS length_bp, sha256({SEQ}) AS sha256 FROM documents")
def import_fasta(spark, d):
    source = t(spark, d, "documents").select("doc_id", "source")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    text = F.concat(F.lit(">"), name, F.lit(" of > "), "source", F.lit("\n"), F.lower(F.regexp_replace("seq", "(.{60})", "$1\n")))
    path = written(docs(spark, d).join(source, "doc_id").select(text.alias("value")), "fasta")
    return formats.read_fasta(spark, path).select("seq_id", "header", "length_bp", "sha256")


@query("""
WITH v AS (SELECT p_partkey, 'chr' || p_size AS chr, p_partkey * 3 AS position, substring(p_brand, 1, 1) AS reference, CASE WHEN p_partkey % 4 = 0 THEN ['T', 'GG'] ELSE ['T'] END AS alts, CASE WHEN p_partkey % 2 = 0 THEN 'rs' || p_partkey ELSE '.' END AS given FROM part),
e AS (SELECT *, unnest(alts) AS alternate, generate_subscripts(alts, 1) AS k FROM v)
SELECT CASE WHEN given = '.' THEN chr || ':' || position || ':' || reference || '>' || alternate WHEN k = 1 THEN given ELSE given || ':' || alternate END AS variant_id, chr, position, reference, alternate, CASE WHEN length(alternate) = 1 THEN 'SNP' ELSE 'Insertion' END AS variant_type FROM e""")
def import_vcf(spark, d):
    key = F.col("p_partkey")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("p_size").cast("string")), (key * 3 + 1).cast("string"), F.when(key % 2 == 0, F.concat(F.lit("rs"), key.cast("string"))).otherwise("."), F.substring("p_brand", 1, 1), F.when(key % 4 == 0, "T,GG").otherwise("T"), F.lit("9"), F.lit("PASS"), F.lit("."))
    path = written(t(spark, d, "part").select(line.alias("value")), "vcf")
    out = catalog.Catalog(spark, fresh(spark, "catalog"))
    out.ingest_vcf(path, 9606, "a")
    return out.table("variant_records").select("variant_id", "chr", "position", "reference", "alternate", "variant_type")


def annotation(spark: SparkSession, d: str) -> DataFrame:
    """GFF lines: customers are genes, orders their transcripts (of every fifth customer no gene), order lines exons."""
    line = lambda kind, *attributes: F.concat(F.lit(f"chr1\tx\t{kind}\t11\t20\t.\t+\t.\t"), *attributes).alias("value")
    text = lambda c: F.col(c).cast("string")
    genes = t(spark, d, "customer").filter("c_custkey % 5 > 0").select(line("gene", F.lit("ID=gene:"), text("c_custkey"), F.lit(";Name="), "c_name"))
    orders = t(spark, d, "orders").select(line("mRNA", F.lit("ID=transcript:"), text("o_orderkey"), F.lit(";Parent=gene:"), text("o_custkey")))
    exons = t(spark, d, "lineitem").select(line("exon", F.lit("ID=exon:"), text("l_orderkey"), F.lit("."), text("l_linenumber"), F.lit(";Parent=transcript:"), text("l_orderkey"), F.lit(";exon_number="), text("l_linenumber")))
    return genes.unionByName(orders).unionByName(exons)


def features_of(spark: SparkSession, d: str) -> DataFrame:
    """The lines, read back and parsed once."""
    return cut(formats.read_gff(spark, written(annotation(spark, d), "gff")))


_KEPT = "(SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 5 > 0)"


@query(f"""
WITH n AS (SELECT (SELECT count(*) FROM customer WHERE c_custkey % 5 > 0) AS genes, (SELECT count(*) FROM {_KEPT}) AS transcripts, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM {_KEPT})) AS exons, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l)
SELECT genes, transcripts, exons, o - transcripts + l - exons AS skipped, genes + transcripts + exons AS total FROM n""")
def import_gff(spark, d):
    return formats.gff_report(features_of(spark, d))


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, s AS \"start\", e AS \"end\" FROM {SHIP} WHERE s < 10100 AND e > 10000")
def region_overlap(spark, d):
    return intervals.in_region(shipping(spark, d), 10000, 10100, checked=True).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "start", "end")


@query(f"""
WITH a AS {SHIP}, o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS os, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 60 AS oe FROM orders)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, s AS "start", e AS "end", os AS o_start FROM a JOIN o ON l_orderkey = o_orderkey AND s < oe AND e > os AND s < e""")
def interval_join(spark, d):
    start = days("o_orderdate")
    windows = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), start.alias("o_start"), (start + 60).alias("o_end"))
    out = intervals.interval_join(shipping(spark, d), windows, ["l_orderkey"], 32, right_on=("o_start", "o_end"))
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "start", "end", "o_start")


@query(f"""
WITH a AS {SHIP} SELECT x.l_suppkey, count(*) AS pairs, CAST(sum(least(x.e, y.e) - greatest(x.s, y.s)) AS BIGINT) AS days
FROM a x JOIN a y ON x.l_suppkey = y.l_suppkey AND x.s < y.e AND x.e > y.s AND (x.l_orderkey, x.l_linenumber) < (y.l_orderkey, y.l_linenumber) GROUP BY x.l_suppkey""")
def interval_self_join(spark, d):
    a = shipping(spark, d)
    b = a.select("l_suppkey", F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    out = intervals.interval_join(a, b, ["l_suppkey"], 32, right_on=("s2", "e2")).filter(F.struct("l_orderkey", "l_linenumber") < F.struct("ok", "ln"))
    return out.groupBy("l_suppkey").agg(F.count("*").alias("pairs"), F.sum(F.least("end", "e2") - F.greatest("start", "s2")).alias("days"))


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS max_end FROM {SHIP}")
def prefix_max_end(spark, d):
    return intervals.running_max_end(shipping(spark, d), ["l_suppkey"], ["start", "end", "l_orderkey", "l_linenumber"], width=256).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "max_end")


@query("SELECT doc_id, regexp_full_match(upper(text), '[ACGTUNRYSWKMBDHV]*') AS valid FROM documents")
def seq_validate(spark, d):
    return t(spark, d, "documents").select("doc_id", S.is_valid(F.col("text")).alias("valid"))


@query(f"SELECT doc_id, substring({SEQ}, 191, 120) AS seq FROM documents WHERE length({SEQ}) > 0")
def seq_slice(spark, d):
    rows = docs(spark, d).filter(F.length("seq") > 0)
    chunks = kmers.chunk(rows, "doc_id", size=200)
    return kmers.fetch(chunks, "doc_id", 190, 310, 200)


@query(f"SELECT doc_id, sha256({SEQ}) AS sha FROM documents")
def seq_full_concat(spark, d):
    return kmers.fetch_full(kmers.chunk(docs(spark, d), "doc_id", size=500), "doc_id", 500).select("doc_id", F.sha2("seq", 256).alias("sha"))


@query(f"SELECT doc_id, CAST(length({SEQ}) AS BIGINT) AS length_bp, sha256({SEQ}) AS sha256 FROM documents")
def seq_sha256(spark, d):
    return docs(spark, d).select("doc_id", F.length("seq").cast("long").alias("length_bp"), F.sha2("seq", 256).alias("sha256"))


@query(f"SELECT doc_id, {crc32_sql(SEQ)} AS crc FROM documents")
def seq_crc32(spark, d):
    return docs(spark, d).select("doc_id", F.crc32(F.col("seq").cast("binary")).alias("crc"))


@query(f"SELECT doc_id, {REVCOMP.format(SEQ)} AS rc FROM documents")
def revcomp(spark, d):
    return docs(spark, d).select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(f"SELECT doc_id, CASE WHEN length({SEQ}) > 0 THEN round(100.0 * length(regexp_replace({SEQ}, '[^GC]', '', 'g')) / length({SEQ}), 6) END AS gc FROM documents")
def gc_content(spark, d):
    return docs(spark, d).select("doc_id", F.round(S.gc_percent(F.col("seq")), 6).alias("gc"))


KMERS = f"(SELECT doc_id, unnest(range(0, greatest(length(s) - {{0}} + 1, 0))) AS pos, s FROM (SELECT doc_id, {DNA} AS s FROM documents))"


@query(f"SELECT kmer, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, substring(s, pos + 1, 6) AS kmer FROM {KMERS.format(6)}) GROUP BY kmer")
def kmer_postings(spark, d):
    return kmers.kmer_counts(docs(spark, d), "doc_id", 6)


PROBE_KMERS = f"(SELECT i, substring('{PROBE}', i + 1, 6) AS kmer FROM (SELECT unnest(range(0, {len(PROBE) - 5})) AS i))"


@query(f"""
WITH k AS (SELECT DISTINCT doc_id, substring(s, pos + 1, 6) AS kmer FROM {KMERS.format(6)}), q AS (SELECT DISTINCT kmer FROM {PROBE_KMERS})
SELECT doc_id, round(count(q.kmer) / (count(*) + (SELECT count(*) FROM q) - count(q.kmer)), 9) AS jaccard FROM k LEFT JOIN q ON k.kmer = q.kmer GROUP BY doc_id""")
def kmer_jaccard(spark, d):
    return kmers.jaccard_of(docs(spark, d), "doc_id", PROBE, 6).select("doc_id", F.round("jaccard", 9).alias("jaccard"))


@query(f"SELECT doc_id, count(*) AS shared FROM (SELECT DISTINCT doc_id, substring(s, pos + 1, 6) AS kmer FROM {KMERS.format(6)}) k JOIN {PROBE_KMERS} q ON k.kmer = q.kmer GROUP BY doc_id")
def kmer_shared(spark, d):
    return kmers.shared_positions(kmers.postings(docs(spark, d), "doc_id", 6, among=PROBE), "doc_id", PROBE, 6)


@query(f"SELECT doc_id, pos // 100 * 100 AS \"window\", count(*) AS hits FROM (SELECT doc_id, pos, substring(s, pos + 1, 6) AS kmer FROM {KMERS.format(6)}) k JOIN {PROBE_KMERS} q ON k.kmer = q.kmer GROUP BY ALL HAVING count(*) >= 2")
def kmer_window_density(spark, d):
    return kmers.window_density(kmers.postings(docs(spark, d), "doc_id", 6, among=PROBE), "doc_id", PROBE, 6, least=2)


FMS = f"(SELECT doc_id, unnest(range(0, greatest(length(s) - {{0}} + 1, 0))) AS pos, s FROM (SELECT doc_id, {FM} AS s FROM documents))"


@query(f"SELECT doc_id, pos FROM {FMS.format(len(PATTERN))} WHERE substring(s, pos + 1, {len(PATTERN)}) = '{PATTERN}'")
def exact_locate(spark, d):
    return kmers.locate_exact(docs(spark, d), "doc_id", PATTERN)


LONG = "ATTGCAAATTAC"
_HAMMING = " + ".join(f"CAST(substring(k, {i + 1}, 1) <> '{c}' AS BIGINT)" for i, c in enumerate(LONG))


@query(f"SELECT doc_id, pos, mismatches FROM (SELECT doc_id, pos, {_HAMMING} AS mismatches FROM (SELECT doc_id, pos, substring(s, pos + 1, {len(LONG)}) AS k FROM {FMS.format(len(LONG))})) WHERE mismatches <= 2")
def approx_locate(spark, d):
    return kmers.locate_approximate(docs(spark, d), "doc_id", LONG, 2)


_G = len(GUIDE)
_GUIDE_HAMMING = " + ".join(f"CAST(substring(k, {i + 1}, 1) <> '{c}' AS BIGINT)" for i, c in enumerate(GUIDE))
_PAM = f"""(SELECT doc_id, strand, CASE WHEN strand = '+' THEN pos + {_G} ELSE n - pos - {_G} END AS pos, substring(k, 1, {_G}) AS protospacer, substring(k, {_G + 1}, 3) AS pam, {_GUIDE_HAMMING} AS mismatches FROM
(SELECT doc_id, strand, n, pos, substring(s, pos + 1, {_G + 3}) AS k FROM (SELECT doc_id, strand, length(s) AS n, s, unnest(range(0, greatest(length(s) - {_G + 2}, 0))) AS pos FROM
(SELECT doc_id, '+' AS strand, {DNA} AS s FROM documents UNION ALL SELECT doc_id, '-', replace({REVCOMP.format(DNA)}, 'U', 'T') FROM documents))) WHERE substring(k, {_G + 2}, 2) IN ('GG', 'AG'))"""


@query(f"SELECT doc_id, strand, pos, protospacer, pam, mismatches, CASE WHEN pam[2] = 'G' THEN 100.0::DOUBLE ELSE 25.0::DOUBLE END AS score FROM {_PAM} WHERE mismatches <= 5")
def pam_scan(spark, d):
    return kmers.pam_sites(docs(spark, d), "doc_id", GUIDE, 5)


@query(f"""
WITH h AS (SELECT mismatches, CASE WHEN pam[2] = 'G' THEN 100.0 ELSE 25.0 END AS score FROM {_PAM} WHERE mismatches <= 5),
a AS (SELECT count(*) FILTER (mismatches = 0) AS exact, count(*) AS hits, CAST(coalesce(sum(score), 0) - coalesce(max(score) FILTER (mismatches = 0), 0) AS DOUBLE) AS burden FROM h)
SELECT exact, hits, burden, (SELECT CAST(sum(length({SEQ})) AS BIGINT) FROM documents) AS total_bp, greatest(0.0, least(100.0, 10000.0 / (100.0 + burden))) AS specificity FROM a""")
def offtarget_report(spark, d):
    rows = docs(spark, d)
    return kmers.offtarget_report(kmers.pam_sites(rows, "doc_id", GUIDE, 5), rows.select(F.length("seq").alias("length")))


MOTIF = [{"T": 1.5, "C": -0.5}, {"A": 1.5, "G": -1.0}, {"T": 1.5, "A": 0.25}, {"A": 1.5, "T": 0.25}, {"A": 1.0, "T": 0.75}, {"A": 1.5, "C": -2.0}]
_PWM = " + ".join("CASE substring(k, %d, 1) %s ELSE 0.0 END" % (i + 1, " ".join(f"WHEN '{b}' THEN {x}::DOUBLE" for b, x in c.items())) for i, c in enumerate(MOTIF))


@query(f"SELECT doc_id, pos, score FROM (SELECT doc_id, pos, CAST({_PWM} AS DOUBLE) AS score FROM (SELECT doc_id, pos, substring(s, pos + 1, 6) AS k FROM {KMERS.format(6)})) WHERE score >= 5.5")
def pwm_scan(spark, d):
    return kmers.pwm_scan(docs(spark, d), "doc_id", MOTIF, 5.5)


@query(f"""
WITH w AS (SELECT doc_id, i AS s, substring(q, i + 1, 200) AS w FROM (SELECT doc_id, q, unnest(range(0, length(q) - 199, 50)) AS i FROM (SELECT doc_id, {DNA} AS q FROM documents) WHERE length(q) >= 200)),
c AS (SELECT doc_id, s, length(w) - length(replace(w, 'C', '')) AS c, length(w) - length(replace(w, 'G', '')) AS g, (length(w) - length(replace(w, 'CG', ''))) // 2 AS cg FROM w),
k AS (SELECT doc_id, s, s + 200 AS e FROM c WHERE (c + g) / 200 >= 0.08 AND c * g > 0 AND cg * 200 / (c * g) >= 0.3),
f AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY doc_id ORDER BY s) >= s THEN 0 ELSE 1 END AS f FROM k),
n AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM f)
SELECT doc_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM n GROUP BY doc_id, n.n""")
def cpg_islands(spark, d):
    return kmers.cpg_islands(docs(spark, d), "doc_id", gc=0.08, ratio=0.3)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS transcript_id, CAST(coalesce(n, 1) AS INT) AS exon_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def exon_count(spark, d):
    return formats.gff_transcripts(features_of(spark, d)).select("transcript_id", "exon_count")


@query(f"SELECT CAST(l_orderkey AS VARCHAR) || '.' || l_linenumber AS exon_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {_KEPT})")
def orphan_antijoin(spark, d):
    """Exons that an import leaves out: their transcript, or its gene, is not there."""
    features = features_of(spark, d)
    return formats.gff_exons(features).select("exon_id").join(formats.gff_tables(features)[2].select("exon_id"), "exon_id", "left_anti")


@query(f"SELECT doc_id, pos + 1 AS low, pos + 1 + n AS high FROM (SELECT doc_id, count(*) FILTER (k < 'ATT') AS pos, count(*) FILTER (k = 'ATT') AS n FROM (SELECT doc_id, substring(s, pos + 1, 3) AS k FROM {FMS.format(1)}) GROUP BY doc_id) WHERE n > 0")
def suffix_interval(spark, d):
    return kmers.suffix_interval(docs(spark, d), "doc_id", "ATT")


@query("""
WITH c AS (SELECT p_partkey, 4.0 + p_size AS half, 0.5 AS bio, 2.0 AS ec, 9.0 AS td, 2.0 AS h FROM part), t AS (SELECT *, unnest(range(0, 25)) AS hour FROM c),
x AS (SELECT p_partkey, hour, ec, td, h, 10 * bio * exp(-ln(2) / half * hour) + CASE WHEN hour >= 12 THEN 10 * bio * exp(-ln(2) / half * (hour - 12)) ELSE 0 END AS y FROM t)
SELECT CAST(p_partkey AS VARCHAR) AS compound_id, hour, round(y, 6) AS concentration, round(pow(y, h) / (pow(y, h) + pow(ec, h)), 6) AS effect, round(y, 6) >= ec AND round(y, 6) < td AS within_window FROM x""")
def regimen(spark, d):
    c = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("compound_id"), F.lit(2.0).alias("ec50_um"), F.lit(9.0).alias("td50_um"), F.lit(2.0).alias("hill_coefficient"), (4.0 + F.col("p_size")).alias("half_life_hours"), F.lit(0.5).alias("bioavailability"))
    return relations.regimen(c, 10.0, 12, 2, 24).select("compound_id", F.col("hour").cast("long").alias("hour"), F.round("concentration", 6).alias("concentration"), F.round("effect", 6).alias("effect"), "within_window")


@query(f"""
WITH s AS (SELECT doc_id, length({SEQ}) AS len, sha256({SEQ}) AS sha FROM documents), g AS (SELECT doc_id, doc_id * 10 AS gs, doc_id * 10 + 200 AS ge, quality FROM labels),
r AS (SELECT CAST(doc_id AS VARCHAR) AS symbol, gs, ge, len, sha, CASE WHEN len >= ge THEN greatest(gs - 50, 0) WHEN len > 0 AND gs >= len THEN 0 END AS fs, CASE WHEN len >= ge THEN least(ge + 30, len) WHEN len > 0 AND gs >= len THEN len END AS fe, quality FROM g JOIN s USING (doc_id))
SELECT symbol, fs AS fetch_start, fe AS fetch_end, CASE WHEN len >= ge THEN fs WHEN fe IS NOT NULL THEN gs END AS window_start, CASE WHEN len >= ge THEN fe WHEN fe IS NOT NULL THEN gs + len END AS window_end, quality AS priority, sha AS provenance, coalesce(fe > fs, false) AS valid FROM r""")
def locus_resolve(spark, d):
    seqs = docs(spark, d).select(F.lit(9606).alias("tax_id"), F.lit("a").alias("assembly_name"), F.col("doc_id").cast("string").alias("seq_id"), F.length("seq").cast("long").alias("length_bp"), F.sha2("seq", 256).alias("sha256"))
    labels = t(spark, d, "labels")
    name = F.col("doc_id").cast("string")
    genes = labels.select(name.alias("symbol"), F.lit(9606).alias("tax_id"), F.lit("a").alias("assembly_name"), name.alias("chr"), (F.col("doc_id") * 10).alias("start"), (F.col("doc_id") * 10 + 200).alias("end"))
    targets = labels.select(F.lit(9606).alias("tax_id"), name.alias("symbol"), F.col("quality").alias("priority"))
    return relations.locus_windows(genes, seqs, targets, 50, 30).drop("tax_id", "assembly_name", "chr")


@query("""
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT spot_id, cell_id, round(d2, 9) AS d2 FROM (SELECT s.vec_id AS spot_id, c.vec_id AS cell_id, (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) AS d2, row_number() OVER (PARTITION BY s.vec_id ORDER BY (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y), c.vec_id) AS r
FROM p s JOIN p c ON c.label = 0 AND s.label <> 0 AND (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) <= 0.0025) WHERE r = 1""".replace("AS y FROM embeddings", "AS y, label FROM embeddings"))
def nearest_cell(spark, d):
    p = t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")
    out = relations.nearest_cell(p.filter("label <> 0").withColumnRenamed("vec_id", "spot_id"), p.filter("label = 0").withColumnRenamed("vec_id", "cell_id"), 0.05)
    return out.select("spot_id", "cell_id", F.round("d2", 9).alias("d2"))


CUSTOMER = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]


def batches(spark, d):
    """Existing rows, and new ones that overlap them: other balances, no segment where the key is odd."""
    c = t(spark, d, "customer").select(*CUSTOMER)
    n = F.lit(3)
    old = c.filter(F.pmod("c_custkey", n) < 2)
    new = c.filter(F.pmod("c_custkey", n) > 0).select("c_custkey", "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return old, new


_BATCHES = """
WITH o AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 < 2),
n AS (SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 > 0)
"""


@query(_BATCHES + "SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert_replace(spark, d):
    return catalog.upsert(*batches(spark, d), ["c_custkey"])


@query(_BATCHES + "SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM o FULL JOIN n USING (c_custkey)")
def upsert_coalesce(spark, d):
    return catalog.upsert(*batches(spark, d), ["c_custkey"], fill=True)


@query(_BATCHES + "SELECT c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, CASE WHEN o.c_name IS NULL THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment FROM o FULL JOIN n USING (c_custkey)")
def upsert_partial(spark, d):
    return catalog.upsert(*batches(spark, d), ["c_custkey"], ["c_acctbal"])


@query(_BATCHES + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def seed_ignore(spark, d):
    return catalog.insert_missing(*batches(spark, d), ["c_custkey"])


@query("""
WITH v AS (SELECT p_partkey, substring(p_brand, 1, CAST(p_size % 3 + 1 AS BIGINT)) AS ref, substring(p_type, 1, CAST(p_partkey % 3 + 1 AS BIGINT)) AS alt, CASE WHEN p_size % 2 = 0 THEN '.' ELSE p_name END AS given FROM part)
SELECT p_partkey, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' WHEN length(ref) < length(alt) THEN 'Insertion' WHEN length(ref) > length(alt) THEN 'Deletion' ELSE 'MNP' END AS kind,
CASE WHEN given = '.' THEN 'chr1:' || p_partkey || ':' || ref || '>' || alt ELSE given END AS variant_id FROM v""")
def variant_class(spark, d):
    v = t(spark, d, "part").select("p_partkey", F.substring(F.col("p_brand"), F.lit(1), (F.col("p_size") % 3 + 1).cast("int")).alias("ref"), F.substring(F.col("p_type"), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int")).alias("alt"), F.when(F.col("p_size") % 2 == 0, ".").otherwise(F.col("p_name")).alias("given"))
    return v.select("p_partkey", S.variant_class(F.col("ref"), F.col("alt")).alias("kind"), S.variant_id(F.col("given"), F.lit("chr1"), F.col("p_partkey"), F.col("ref"), F.col("alt")).alias("variant_id"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS id, event_type AS name, CAST(user_id AS VARCHAR) AS note FROM events")
def attr_parse(spark, d):
    text = F.concat(F.lit("ID="), F.col("event_id").cast("string"), F.lit("; Name="), F.lit("x"), F.lit(";name=\""), F.col("event_type"), F.lit("\"; Note \""), F.col("user_id").cast("string"), F.lit("\";"))
    a = t(spark, d, "events").select("event_id", S.attributes(text).alias("a"))
    return a.select("event_id", F.col("a")["id"].alias("id"), F.col("a")["name"].alias("name"), F.col("a")["note"].alias("note"))


@query("""
WITH RECURSIVE e AS (SELECT r_name AS source, n_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5),
w(node, depth) AS (SELECT source, 0 FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT e.target, w.depth + 1 FROM w JOIN e ON e.source = w.node)
SELECT node, CAST(max(depth) AS BIGINT) AS depth FROM w GROUP BY node""")
def grn_topo_order(spark, d):
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    b = n.alias("a").join(n.alias("b"), F.col("b.n_nationkey") == F.col("a.n_nationkey") + 5).select(F.col("a.n_name").alias("source"), F.col("b.n_name").alias("target"))
    return relations.topological_depth(a.unionByName(b))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))), 4) AS total FROM embeddings")
def vector_codec(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", S.decode_vector(S.encode_vector(F.col("embedding"))).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("""
WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrM' WHEN 2 THEN 'y' WHEN 3 THEN 'chr' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS name FROM customer)
SELECT c_custkey, c_custkey % 5 IN (3, 4) AS autosome, c_custkey % 5 IN (0, 2) AS sex, c_custkey % 5 = 1 AS mito FROM c""")
def chrom_class(spark, d):
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "chrX").when(k == 1, "chrM").when(k == 2, "y").when(k == 3, F.concat(F.lit("chr"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    c = t(spark, d, "customer").select("c_custkey", name.alias("name"))
    return c.select("c_custkey", S.is_autosome(F.col("name")).alias("autosome"), S.is_sex_chromosome(F.col("name")).alias("sex"), S.is_mitochondrial(F.col("name")).alias("mito"))


@query("""
WITH c AS (SELECT p_partkey, 1.0 + p_size / 10 AS cl, 20.0 + p_size AS v, 1.5 AS ka FROM part), h AS (SELECT *, unnest(range(0, 25)) AS hour FROM c)
SELECT p_partkey AS compound_id, hour, round(CASE WHEN hour >= 0 THEN 100 * ka / (v * (ka - cl / v)) * (exp(-cl / v * hour) - exp(-ka * hour)) ELSE 0 END + CASE WHEN hour >= 12 THEN 100 * ka / (v * (ka - cl / v)) * (exp(-cl / v * (hour - 12)) - exp(-ka * (hour - 12))) ELSE 0 END, 6) AS concentration FROM h""")
def dosing(spark, d):
    c = t(spark, d, "part").select(F.col("p_partkey").alias("compound_id"), (1.0 + F.col("p_size") / 10).alias("clearance"), (20.0 + F.col("p_size")).alias("volume"), F.lit(1.5).alias("absorption"), F.lit(2.0).alias("ec50"))
    return relations.dosing(c, 100.0, 12, 2, 24).select("compound_id", F.col("hour").cast("long").alias("hour"), F.round("concentration", 6).alias("concentration"))
