"""Locus resolution, nearest cells, regulatory order and dosing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.session import cut, drop_cut


def locus_windows(genes: DataFrame, sequences: DataFrame, targets: DataFrame, upstream: int, downstream: int) -> DataFrame:
    """Windows of genes on their sequences.

    genes (symbol, tax_id, assembly_name, chr, start, end), sequences (tax_id, assembly_name, seq_id, length_bp, sha256),
    targets (tax_id, symbol, priority). A sequence that reaches the gene's end is cut with flanks; one that ends before
    the gene starts is a cut-out of the gene itself, reported at the gene's place; others are ``valid = false``.
    """
    seq = sequences.select("tax_id", "assembly_name", F.col("seq_id").alias("chr"), F.col("length_bp").alias("len"), F.coalesce("sha256", F.lit("")).alias("provenance"))
    own = targets.select("tax_id", "symbol", F.col("priority").alias("own"))
    any_of = targets.groupBy("symbol").agg(F.min_by("priority", F.struct((F.col("tax_id") != 9606), "tax_id")).alias("other"))
    rows = genes.join(seq, ["tax_id", "assembly_name", "chr"]).join(own, ["tax_id", "symbol"], "left").join(any_of, "symbol", "left")
    whole, cutout = F.col("len") >= F.col("end"), (F.col("len") > 0) & (F.col("start") >= F.col("len"))
    lo = F.when(whole, F.greatest(F.col("start") - upstream, F.lit(0))).when(cutout, F.lit(0))
    hi = F.when(whole, F.least(F.col("end") + downstream, F.col("len"))).when(cutout, F.col("len"))
    out = rows.select("symbol", "tax_id", "assembly_name", "chr", lo.alias("fetch_start"), hi.alias("fetch_end"), F.when(whole, lo).when(cutout, F.col("start")).alias("window_start"), F.when(whole, hi).when(cutout, F.col("start") + F.col("len")).alias("window_end"), F.coalesce("own", "other").alias("priority"), "provenance")
    return out.withColumn("valid", F.coalesce(F.col("fetch_end") > F.col("fetch_start"), F.lit(False)))


def locus_sequences(genes: DataFrame, sequences: DataFrame, targets: DataFrame, store, upstream: int, downstream: int) -> DataFrame:
    """``locus_windows`` with the symbols of each window as ``sequence``, fetched from a store in one join."""
    windows = locus_windows(genes, sequences, targets, upstream, downstream)
    asked = windows.withColumns({"seq_id": F.col("chr"), "start": F.col("fetch_start"), "end": F.col("fetch_end")}).withColumnRenamed("valid", "window_valid")
    out = store.slices(asked)
    return out.select(*(c for c in windows.columns if c != "valid"), F.when(F.col("window_valid"), F.col("seq")).alias("sequence"), (F.col("window_valid") & F.col("valid")).alias("valid"))


def cell_totals(spots: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """(cell_id, total_transcripts): spots of each cell, 0 where it has none."""
    counts = nearest_cell(spots, cells, radius).groupBy("cell_id").agg(F.count("*").alias("n"))
    return cells.select("cell_id").join(counts, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("total_transcripts"))


#: Spots of a tile, on the average.
TILE = 5000
#: Pairs of a spot and a cell that are compared at once.
PAIRS = 1 << 20


def nearest_cell(spots: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """(spot_id, cell_id, d2): the nearest cell within ``radius``, ties to the smaller id. Both sides: (id, x, y).

    The plane is dealt in tiles of whole squares of side ``radius``; cells go to the tiles of the nine squares around them.
    Within a tile spots are looked up in grids that get coarser until a cell is found, so no table of pairs is made.
    """
    square = lambda c: F.floor(F.col(c) / radius).cast("long")
    sound = lambda df: df.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    a = sound(spots).select("spot_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), square("x").alias("gx"), square("y").alias("gy"))
    held = a.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct("gx", "gy")).alias("squares")).first()
    side = max(1, int((TILE * held.squares / max(1, held.n)) ** 0.5))
    tile = lambda c: F.floor(c / side).cast("long")
    a = a.select("spot_id", "x", "y", tile(F.col("gx")).alias("tx"), tile(F.col("gy")).alias("ty"))
    around = F.array_distinct(F.array(*(F.struct(tile(square("x") + i).alias("tx"), tile(square("y") + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    b = sound(cells).select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.explode(around).alias("t")).select("cell_id", "x", "y", "t.tx", "t.ty")
    schema = T.StructType([spots.schema["spot_id"], cells.schema["cell_id"], T.StructField("d2", T.DoubleType())])

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        right = right.take(pc.sort_indices(right.column("cell_id"), null_placement="at_start"))
        place = lambda t: [t.column(c).to_numpy() for c in "xy"]
        cell, d2 = _nearest(*place(left), *place(right), radius)
        hit = np.flatnonzero(cell >= 0)
        return pa.table([left.column("spot_id").take(pa.array(hit)), right.column("cell_id").take(pa.array(cell[hit])), pa.array(d2[hit])], names=["spot_id", "cell_id", "d2"])

    near = a.groupBy("tx", "ty").cogroup(b.groupBy("tx", "ty")).applyInArrow(run, schema)
    best = near.groupBy("spot_id").agg(F.min(F.struct("d2", "cell_id")).alias("m"))
    return best.select("spot_id", F.col("m.cell_id").alias("cell_id"), F.col("m.d2").alias("d2"))


def _nearest(sx, sy, x, y, radius: float):
    """Of each spot the first of the nearest cells within ``radius`` (-1: none) and its squared distance."""
    import numpy as np

    cell, most = np.full(len(sx), -1, np.int64), np.full(len(sx), np.inf)
    if not len(sx) or not len(x):
        return cell, most
    _, first = np.unique(x + 1j * y, return_index=True)  # of cells at one place the first
    first.sort()
    x, y = x[first], y[first]
    left, last = np.arange(len(sx)), radius * 1.002
    width = min(last, 3 * radius / (len(x) / 2) ** 0.5)
    while len(left):
        across = lambda v, low: np.floor((v - low) / width).astype(np.int64)  # noqa: E731, B023
        cx, cy = across(x, x.min()), across(y, y.min())
        columns, rows = cx.max() + 1, cy.max() + 1
        key = cy * columns + cx
        order = np.argsort(key, kind="stable")
        key = key[order]
        qx, qy = np.clip(across(sx[left], x.min()), -1, columns), np.clip(across(sy[left], y.min()), -1, rows)
        # the three rows of squares around a spot are three runs of cells; a few more of other rows do no harm
        begin = np.stack([np.searchsorted(key, (qy + j) * columns + qx - 1, "left") for j in (-1, 0, 1)], 1)
        end = np.stack([np.searchsorted(key, (qy + j) * columns + qx + 1, "right") for j in (-1, 0, 1)], 1)
        total = np.cumsum((end - begin).sum(1))
        done = np.zeros(len(left), bool)
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            n = (end - begin)[at:to].ravel()
            spot = np.repeat(np.repeat(np.arange(at, to), 3), n)
            other = order[np.arange(len(spot)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to].ravel(), n)]
            own = left[spot]
            d2 = (sx[own] - x[other]) * (sx[own] - x[other]) + (sy[own] - y[other]) * (sy[own] - y[other])
            best, found = np.full(to - at, np.inf), np.full(to - at, len(x))
            np.minimum.at(best, spot - at, d2)
            tie = d2 == best[spot - at]
            np.minimum.at(found, spot[tie] - at, other[tie])
            # what lies outside the squares around a spot is farther than a square's side
            ok = best <= (radius * radius if width >= last else min(radius, width * 0.999) ** 2)
            cell[left[at:to][ok]], most[left[at:to][ok]] = first[found[ok]], best[ok]
            done[at:to] = ok
            at = to
        if width >= last:
            break
        left, width = left[~done], min(2 * width, last)
    return cell, most


class Cycle(ValueError):
    pass


def topological_depth(edges: DataFrame) -> DataFrame:
    """(node, depth) of a graph (source, target): the longest way from a root. A cycle is an error.

    Nodes without an unplaced predecessor leave in rounds; a round is a join, and there are as many as the depth.
    """
    edges = cut(edges.select("source", "target").distinct())
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    left, placed, depth = cut(nodes), None, 0
    while not left.isEmpty():
        live = edges.join(left.withColumnRenamed("node", "source"), "source", "left_semi")
        roots = cut(left.join(live.select(F.col("target").alias("node")), "node", "left_anti"))
        if roots.isEmpty():
            raise Cycle("the graph has a cycle")
        now = roots.withColumn("depth", F.lit(depth).cast("long"))
        placed = now if placed is None else placed.unionByName(now)
        rest = cut(left.join(roots, "node", "left_anti"))
        drop_cut(left)
        left, depth = rest, depth + 1
    drop_cut(left)
    return placed if placed is not None else nodes.withColumn("depth", F.lit(0).cast("long"))


def dosing(compounds: DataFrame, dose: float, interval: int, doses: int, hours: int) -> DataFrame:
    """(compound_id, hour, concentration, effect): one compartment, first-order absorption, doses superposed, Hill effect.

    Our own textbook model. compounds: (compound_id, clearance, volume, absorption, ec50).
    """
    h = compounds.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours))))
    ke = F.col("clearance") / F.col("volume")
    total = F.lit(0.0)
    for k in range(doses):
        t = F.col("hour") - k * interval
        apart = F.col("absorption") - ke
        # equal rates have the limit t exp(-ke t)
        shape = F.when(F.abs(apart) > 1e-9 * ke, F.try_divide(F.exp(-ke * t) - F.exp(-F.col("absorption") * t), apart)).otherwise(t * F.exp(-ke * t))
        total = total + F.when(t >= 0, F.lit(dose) * F.col("absorption") / F.col("volume") * shape).otherwise(0.0)
    return h.select("compound_id", "hour", "ec50", total.alias("concentration")).select("compound_id", "hour", "concentration", (F.col("concentration") / (F.col("concentration") + F.col("ec50"))).alias("effect"))


def regimen(compounds: DataFrame, dose: float, interval: int, doses: int, hours: int) -> DataFrame:
    """(compound_id, hour, concentration, effect, within_window) of rows of ``pharma_compounds``.

    Our own textbook model: each dose adds ``dose`` x bioavailability (micromolar) that decays by the half-life; the
    effect is a Hill curve; within_window: from ec50 to below td50.
    """
    each = compounds.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours))))
    rate, total = F.log(F.lit(2.0)) / F.col("half_life_hours"), F.lit(0.0)
    for k in range(doses):
        t = F.col("hour") - k * interval
        total = total + F.when(t >= 0, F.lit(float(dose)) * F.col("bioavailability") * F.exp(-rate * t)).otherwise(0.0)
    each = each.withColumn("concentration", total)
    powers = F.pow("concentration", "hill_coefficient"), F.pow("ec50_um", "hill_coefficient")
    return each.select("compound_id", "hour", "concentration", (powers[0] / (powers[0] + powers[1])).alias("effect"), ((F.col("concentration") >= F.col("ec50_um")) & (F.col("concentration") < F.col("td50_um"))).alias("within_window"))
