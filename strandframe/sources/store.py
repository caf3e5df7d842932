"""The sequence store: whole sequences as Parquet chunks under (tax_id, assembly_name, seq_id), and k-mer indexes on disk.

A sequence is a directory of its own, replaced as a whole by the commit of the write (dynamic partition overwrite), so
readers see the old one or the new one. A slice reads the chunks that it touches: directories are pruned by name, chunks
by the statistics of their number. Each chunk carries the CRC-32 of its symbols and the sequence's length.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.errors import CorruptData, EncodingError, InvalidCoordinates, NotFound
from strandframe.functions import sequences as S
from strandframe.session import cut, drop_cut

#: Symbols of a chunk.
CHUNK = 1 << 16
#: Symbols of the run of chunks that one task puts together.
RUN = 1 << 22
KEYS = ["tax_id", "assembly_name", "seq_id"]
SCHEMA = "chunk_id int, chunk_start bigint, seq string, length_bp bigint, crc bigint, tax_id int, assembly_name string, seq_id string"
#: Fixed value: what a component of a path may not hold.
UNSAFE = r"^$|\.\.|[/\\\x00]"
INDEX_FORMAT = {"format": "strandframe k-mer index", "version": 1}


def _joined(parts: Column) -> Column:
    """Pieces (chunk_id, s) in order, as one string."""
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p["s"]), "")


def _digests(batches):
    """Rows of ``SequenceStore.digests`` from chunks that come in order."""
    import pyarrow as pa

    names = [*KEYS, "length_bp", "sha256", "sound"]
    types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    row = lambda key, n, told, sha, kept: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, n, sha.hexdigest(), kept and n == told), types, strict=True)], names)
    last = None
    for batch in batches:
        column = batch.column
        for i in range(batch.num_rows):
            key = tuple(column(j)[i].as_py() for j in range(3))
            if last is None or key != last[0]:
                if last:
                    yield row(*last)
                last = [key, 0, 0, hashlib.sha256(), True]
            last[1] += column(5)[i].as_py()
            last[2] = max(last[2], column(6)[i].as_py())
            last[3].update(column(4)[i].as_buffer())
            last[4] = last[4] and bool(column(7)[i].as_py())
    if last:
        yield row(*last)


class SequenceStore:
    def __init__(self, spark: SparkSession, root: str, chunk: int = CHUNK):
        self.spark, self.root, self.chunk = spark, f"{root.rstrip('/')}/sequence_store", chunk

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self) -> DataFrame:
        """All chunks."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.root)

    def store(self, records: DataFrame) -> None:
        """Write (tax_id, assembly_name, seq_id, seq), replacing sequences of the same key. Nothing is entered in a catalog.

        Letters are stored in upper case. Symbols outside the alphabet, nulls and unsafe names are errors, and then
        nothing is written. A record is one string, so it is limited to 2 GB; longer ones go by ``store_pieces``.
        """
        self._write(records.withColumn("part", F.lit(0)), alone=True)

    def store_pieces(self, pieces: DataFrame) -> None:
        """``store`` for sequences that come in pieces (tax_id, assembly_name, seq_id, part, seq): they are laid end to end
        in order of ``part``. Only the pieces' lengths are ordered in one task a sequence, so a sequence may be of any size.
        """
        self._write(pieces, alone=False)

    def _write(self, pieces: DataFrame, alone: bool) -> None:
        rows = cut(pieces.select(F.col("tax_id").cast("int"), "assembly_name", "seq_id", "part", F.upper("seq").alias("seq"), F.monotonically_increasing_id().alias("row")))
        try:
            self._check(rows)
            lengths = rows.select(*KEYS, "part", "row", F.length("seq").cast("bigint").alias("n"))
            own = Window.partitionBy(*KEYS)
            before = own.orderBy("part", "row").rowsBetween(Window.unboundedPreceding, -1)
            placed = lengths.select(*KEYS, "row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.sum("n").over(own).alias("length_bp"), F.count("*").over(own).alias("pieces"))
            if alone and (twice := placed.filter("pieces > 1").first()):
                raise ValueError(f"two records of {twice.tax_id}:{twice.assembly_name}:{twice.seq_id}")
            # a piece is cut at the chunks' edges in one pass over it
            room = (self.chunk - F.col("at") % self.chunk).cast("int")
            rest = F.regexp_extract_all(F.substring(F.col("seq"), room + 1, F.length("seq")), F.lit(f"(?s).{{1,{self.chunk}}}"), F.lit(0))
            cuts = F.concat(F.array(F.substring(F.col("seq"), F.lit(1), room)), rest)
            each = rows.select("row", "seq").join(placed, "row").select(*KEYS, "length_bp", "at", F.posexplode(cuts).alias("i", "s"))
            each = each.filter((F.col("s") != "") | (F.col("length_bp") == 0))
            each = each.withColumn("chunk_id", (F.floor(F.col("at") / self.chunk) + F.col("i")).cast("int"))
            each = each.withColumn("run", F.floor(F.col("chunk_id") / max(1, RUN // self.chunk)))
            chunks = each.repartition(*KEYS, "run").groupBy(*KEYS, "run", "chunk_id").agg(F.max("length_bp").alias("length_bp"), _joined(F.collect_list(F.struct("at", "s"))).alias("seq"))
            chunks = chunks.select("chunk_id", (F.col("chunk_id").cast("bigint") * self.chunk).alias("chunk_start"), "seq", "length_bp", F.crc32(F.col("seq").cast("binary")).alias("crc"), *KEYS)
            chunks.sortWithinPartitions(*KEYS, "chunk_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.root)
        finally:
            drop_cut(rows)

    @staticmethod
    def _check(rows: DataFrame) -> None:
        """An error for the first unsafe name, missing sequence or symbol outside the alphabet."""
        unsafe = F.col("assembly_name").rlike(UNSAFE) | F.col("seq_id").rlike(UNSAFE) | F.col("tax_id").isNull() | F.col("seq").isNull()
        at = F.regexp_instr("seq", F.lit(f"[^{S.ALPHABET}]"))
        bad = rows.filter(F.coalesce(unsafe, F.lit(True)) | (at > 0)).select(*KEYS, unsafe.alias("unsafe"), (at - 1).alias("position")).first()
        if bad:
            name = f"{bad.tax_id}:{bad.assembly_name}:{bad.seq_id}"
            if bad.position is not None and bad.position >= 0:
                raise EncodingError(f"{name}: a symbol outside the alphabet at {bad.position}")
            raise ValueError(f"unsafe name or missing sequence: {name}")

    def store_sequence(self, tax_id: int, assembly: str, seq_id: str, seq: str) -> None:
        self.store(self.spark.createDataFrame([(tax_id, assembly, seq_id, seq)], "tax_id int, assembly_name string, seq_id string, seq string"))

    def _of(self, tax_id: int, assembly: str, seq_id: str) -> DataFrame:
        return self.table().filter((F.col("tax_id") == tax_id) & (F.col("assembly_name") == assembly) & (F.col("seq_id") == seq_id))

    def length(self, tax_id: int, assembly: str, seq_id: str) -> int:
        row = self._of(tax_id, assembly, seq_id).filter("chunk_id = 0").select("length_bp").first()
        if row is None:
            raise NotFound(f"no sequence {tax_id}:{assembly}:{seq_id}")
        return row.length_bp

    def fetch(self, tax_id: int, assembly: str, seq_id: str, start: int, end: int) -> str:
        """Symbols [start, end). A start after the end, or an end beyond the sequence, is an error."""
        n = self.length(tax_id, assembly, seq_id)
        if not 0 <= start <= end <= n:
            raise InvalidCoordinates(f"{seq_id}: [{start}, {end}) of {n}")
        touched = self._of(tax_id, assembly, seq_id).filter(F.col("chunk_id").between(start // self.chunk, max(start, end - 1) // self.chunk))
        rows = touched.select("chunk_id", "seq", (F.crc32(F.col("seq").cast("binary")) == F.col("crc")).alias("sound")).orderBy("chunk_id").collect()
        if not all(r.sound for r in rows):
            raise CorruptData(f"{seq_id}: a chunk does not match its checksum")
        first = rows[0].chunk_id * self.chunk if rows else 0
        return "".join(r.seq for r in rows)[start - first : end - first]

    def fetch_full(self, tax_id: int, assembly: str, seq_id: str) -> str:
        return self.fetch(tax_id, assembly, seq_id, 0, self.length(tax_id, assembly, seq_id))

    def slices(self, regions: DataFrame) -> DataFrame:
        """``regions`` (tax_id, assembly_name, seq_id, start, end and any other columns) with ``seq`` and ``valid``.

        Unknown sequences and coordinates out of bounds are rows with a null seq and valid = false. One equi-join on the
        key and the chunk number; a region's pieces are put together by a partial aggregation.
        """
        names = regions.columns
        lo, hi = F.col("start"), F.greatest(F.col("start"), F.col("end") - 1)
        wanted = F.when((lo >= 0) & (lo <= F.col("end")), F.sequence(F.floor(lo / self.chunk), F.floor(hi / self.chunk))).otherwise(F.array(F.lit(0).cast("bigint")))
        numbered = regions.withColumn("__row", F.monotonically_increasing_id())  # below the explode: one number a region
        each = numbered.select("__row", F.struct(*names).alias("__own"), *KEYS, "start", "end", F.explode(wanted.cast("array<int>")).alias("chunk_id"))
        # a region that ends at a chunk's edge, or is empty there, may touch a chunk that does not exist
        size = self.table().filter("chunk_id = 0").select(*KEYS, F.col("length_bp").alias("__n"))
        joined = each.join(size, KEYS, "left").join(self.table().select(*KEYS, "chunk_id", "chunk_start", F.col("seq").alias("__seq")), [*KEYS, "chunk_id"], "left")
        a, b = F.greatest(F.col("start") - F.col("chunk_start"), F.lit(0)), F.col("end") - F.col("chunk_start")
        piece = F.coalesce(F.substring(F.col("__seq"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), F.lit(""))
        whole = joined.groupBy("__row").agg(F.first("__own").alias("__own"), F.first("__n").alias("__n"), _joined(F.collect_list(F.struct("chunk_id", piece.alias("s")))).alias("__seq"))
        valid = F.coalesce((F.col("__own.start") >= 0) & (F.col("__own.start") <= F.col("__own.end")) & (F.col("__own.end") <= F.col("__n")), F.lit(False))
        return whole.select(*(F.col("__own").getField(c).alias(c) for c in names), F.when(valid, F.col("__seq")).alias("seq"), valid.alias("valid"))

    def lengths(self) -> DataFrame:
        """(tax_id, assembly_name, seq_id, length_bp) of all sequences."""
        return self.table().filter("chunk_id = 0").select(*KEYS, "length_bp")

    def whole(self) -> DataFrame:
        """(tax_id, assembly_name, seq_id, seq, sound): sequences in one piece; sound: no chunk is missing or damaged."""
        ok = F.bool_and(F.crc32(F.col("seq").cast("binary")) == F.col("crc"))
        rows = self.table().groupBy(*KEYS).agg(_joined(F.collect_list(F.struct("chunk_id", F.col("seq").alias("s")))).alias("seq"), F.max("length_bp").alias("n"), ok.alias("ok"))
        return rows.select(*KEYS, "seq", (F.col("ok") & (F.length("seq") == F.col("n"))).alias("sound"))

    def digests(self) -> DataFrame:
        """(tax_id, assembly_name, seq_id, length_bp, sha256, sound) of the symbols that are there; sound: no chunk is
        missing or damaged. A sequence goes through one task chunk by chunk and is never held as a whole."""
        kept = F.crc32(F.col("seq").cast("binary")) == F.col("crc")
        rows = self.table().select(*KEYS, "chunk_id", "seq", F.length("seq").cast("bigint").alias("n"), "length_bp", kept.alias("kept"))
        return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "chunk_id").mapInArrow(_digests, "tax_id int, assembly_name string, seq_id string, length_bp bigint, sha256 string, sound boolean")

    def verified(self, sequences: DataFrame) -> DataFrame:
        """(tax_id, assembly_name, seq_id, intact) of catalog rows (tax_id, assembly_name, seq_id, length_bp, sha256):
        whether the stored symbols have that length and digest and every chunk its checksum. Missing ones are not intact."""
        own = self.digests().select(*KEYS, "sound", F.col("length_bp").alias("__n"), F.col("sha256").alias("__sha"))
        joined = sequences.select(*KEYS, "length_bp", "sha256").join(own, KEYS, "left")
        intact = F.col("sound") & (F.col("__n") == F.col("length_bp")) & (F.col("__sha") == F.lower("sha256"))
        return joined.select(*KEYS, F.coalesce(intact, F.lit(False)).alias("intact"))

    def clear_cache(self) -> None:
        """Forget file listings, so that files written by others are seen."""
        if self._exists():
            self.spark.catalog.refreshByPath(self.root)


def save_index(postings: DataFrame, path: str, k: int) -> None:
    """Write a k-mer index (id, pos, kmer), sorted by k-mer within files so that a lookup skips most row groups."""
    postings.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/postings")
    spark = postings.sparkSession
    rows = spark.read.parquet(f"{path}/postings").count()
    meta = json.dumps({**INDEX_FORMAT, "k": k, "rows": rows})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The postings and k of ``save_index``. Another format or version, or missing rows, are an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise NotFound(f"no k-mer index at {path}")
    try:
        meta = json.loads("".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))
    except json.JSONDecodeError as error:
        raise CorruptData(f"{path}: {error}") from error
    if {key: meta.get(key) for key in INDEX_FORMAT} != INDEX_FORMAT:
        raise CorruptData(f"{path}: another format or version")
    postings = spark.read.parquet(f"{path}/postings")
    if postings.count() != meta["rows"]:
        raise CorruptData(f"{path}: rows are missing")
    return postings, meta["k"]


class KeyValues:
    """A small cache of bytes by key, on the driver."""

    def __init__(self):
        self._held: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        return self._held.get(key)

    def set(self, key: str, value: bytes) -> None:
        self._held[key] = bytes(value)

    def remove(self, key: str) -> bytes | None:
        return self._held.pop(key, None)
