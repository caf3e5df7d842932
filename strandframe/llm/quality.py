"""Quality scores by naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams: word unigrams and bigrams (lower-cased) and byte trigrams (as written). Each
is scaled by its class log-count ratio r = log((p + 1) / |p + 1|) - log((q + 1) / |q + 1|) of the labelled rows, and a
text's vector is brought to length 1. A linear hinge-loss model is fitted by dual coordinate descent.

The model is fitted on a sample of labelled rows, in the order of their ids' hashes: MAX_ROWS at most (half of each class
at most), and only so many that they have MAX_FEATURES features in all (4 bytes each on the driver); both are parameters
of ``train``. So it depends on ids and texts alone, not on how
files lie. The fit runs on the driver. Weights are one array of 2^BITS numbers, so what is broadcast has a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import words

BITS = 18
#: Bounds of the training sample: labelled rows, and features of all of them.
MAX_ROWS = 8000
MAX_FEATURES = 16_000_000
PASSES = 12
COST = 1.0
#: Steepness of the logistic curve that turns margins to scores.
STEEP = 3.0


def _features(text_hashes: np.ndarray, raw: np.ndarray) -> np.ndarray:
    parts = [words.mix(text_hashes + np.uint64(1))]
    if len(text_hashes) > 1:
        parts.append(words.mix(text_hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + text_hashes[1:]))
    if len(raw) > 2:
        code = raw.astype(np.uint32)
        seen = np.zeros(1 << 24, bool) if len(code) > 1 << 20 else None
        code = (code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:]
        if seen is not None:
            seen[code] = True
            code = np.flatnonzero(seen).astype(np.uint32)
        parts.append(words.mix(code.astype(np.uint64) + np.uint64(1 << 40)))
    return words.distinct((np.concatenate(parts) & np.uint64((1 << BITS) - 1)).astype(np.uint32))


def feature_sets(column: pa.Array):
    """Sorted distinct feature numbers of each text, in order; null and empty texts have none."""
    raw, at = words._raw(column)
    for first, hashes, counts in words.word_batches(column):
        end = 0
        for i, count in enumerate(counts.tolist()):
            begin, end = end, end + count
            yield _features(hashes[begin:end], raw[at[first + i] : at[first + i + 1]])


class Model:
    """weights: of the features, ratios included; ratios: for the length of a vector."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, bias: float):
        self.weights, self.ratios, self.bias = weights, ratios, bias

    def margin(self, features: np.ndarray) -> float:
        if not len(features):
            return self.bias
        r = self.ratios[features]
        length = float(np.sqrt(np.dot(r, r)))
        return self.bias + (float(self.weights[features].sum()) / length if length else 0.0)

    def score(self, features: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-STEEP * self.margin(features))))


def fit(sets: list[np.ndarray], labels: list[int]) -> Model:
    """Log-count ratios, then dual coordinate descent. Without both classes, a constant model."""
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    size = 1 << BITS
    counts = [np.ones(size), np.ones(size)]
    for s, label in zip(sets, y, strict=True):
        counts[int(label > 0)][s] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    if len(y) == 0 or (y == y[0]).all():
        return Model(np.zeros(size), ratios, float(y[0]) if len(y) else 0.0)
    # Vectors are made anew when they are needed: kept, they would take twice the sample's bytes.
    lengths = [float(np.sqrt(np.dot(ratios[s], ratios[s]))) or 1.0 for s in sets]
    row = lambda i: ratios[sets[i]] / lengths[i]
    w, bias = np.zeros(size), 0.0
    alpha, rng = np.zeros(len(y)), np.random.default_rng(0)
    norms = np.array([np.dot(x, x) for x in map(row, range(len(sets)))]) + 1
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(y)):
            s, x = sets[i], row(i)
            gradient = y[i] * (np.dot(w[s], x) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), COST)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[s] += step * x
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model(w * ratios, ratios, bias)


def held_out(id_col: str):
    """Rows that are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Fitted on labelled rows that aren't held out. A row labelled more than once counts once, by its larger label; of
    several texts of one id the one whose features come first counts; labels other than 0 and 1, null ids and rows without a text are not learnt from.

    What the fit took is given back to the system: the driver does not keep its most for the rest of the session."""
    try:
        return _trained(docs, labels, id_col, text_col, label_col, max_rows, max_features)
    finally:
        words.give_back()


def _trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, max_features: int) -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2)
        sample = part if sample is None else sample.unionByName(part)
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in sample.collect()], "id long, y int")  # max_rows rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(sample), "id").select("id", "y", "text")

    def run(batches):
        for batch in batches:
            sets = pa.array([s.tobytes() for s in feature_sets(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sets], ["id", "y", "features"])

    featured = texts.mapInArrow(words.freeing(run), "id long, y int, features binary")
    rows, total = {}, 0
    for r in featured.orderBy(F.xxhash64("id"), "id", "features").toLocalIterator():
        if r.id in rows:
            continue
        total += len(r.features) // 4
        if total > max_features:
            break
        rows[r.id] = (r.y, np.frombuffer(r.features, np.uint32))
    order = sorted(rows)
    return fit([rows[k][1] for k in order], [rows[k][0] for k in order])


def _scores(model, text_at: int):
    def run(batches):
        m = model.value
        for batch in batches:
            yield batch, np.array([m.score(s) for s in feature_sets(batch.column(text_at))], np.float64)

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Null and empty texts get the model's constant score. A null id is not held out. Repeated rows give a row each. With
    no labels the score is 0.5; with one class only it is a constant on that class's side.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    inner = _scores(model, 1)

    def run(batches):
        for batch, values in inner(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(words.freeing(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    inner = _scores(model, docs.columns.index(text_col))

    def run(batches):
        for batch, values in inner(batches):
            yield batch.filter(pa.array(values >= 0.5))

    return docs.mapInArrow(words.freeing(run), docs.schema)
