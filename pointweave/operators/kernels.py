"""Strictly sequential recurrences: one grouped Arrow kernel per slice, which bounds its memory."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pointweave.functions.columns import QUANT_MULTIPLIERS, QUANT_STEPS

CACHE = 32
#: A layer's subsampling looks at the 27 cells around a survivor; the order has no effect, as it only sets flags.
AROUND = tuple(itertools.product((-1, 0, 1), repeat=3))


def quantised(d: int, qp: int) -> tuple[int, int]:
    """The coded magnitude with sign, and what it reconstructs to."""
    q = (abs(d) * QUANT_MULTIPLIERS[qp] + 8192) >> 14
    back = (q * QUANT_STEPS[qp] + 32) >> 6
    return (q, back) if d >= 0 else (-q, -back)


def cache_values(refl: list[int], size: int = CACHE) -> list[tuple[int, int]]:
    """Per value the index of the nearest cached value (first of equals; -1 of an empty cache) and that value (0).

    The cache starts empty. A value that it holds changes places with the oldest entry; another one is put at the end,
    and the oldest goes once ``size`` are held.
    """
    cache, out = [], []
    for v in refl:
        best = min(range(len(cache)), key=lambda i: abs(v - cache[i]), default=-1)
        out.append((best, cache[best] if cache else 0))
        if v in cache:
            at = cache.index(v)
            cache[at], cache[0] = cache[0], cache[at]
        else:
            cache = [*cache[len(cache) == size :], v]
    return out


def predict_refl_cache(points: DataFrame) -> DataFrame:
    """slice_id, pos, refl, cache_index, pred_refl in the slice's order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        found = cache_values([int(v) for v in pdf["refl"]])
        return pd.DataFrame({"slice_id": pdf["slice_id"], "pos": pdf["pos"], "refl": pdf["refl"], "cache_index": [i for i, _ in found], "pred_refl": [v for _, v in found]})

    return points.select("slice_id", "pos", "refl").groupBy("slice_id").applyInPandas(run, "slice_id long, pos long, refl long, cache_index int, pred_refl long")


def divided(a: int, b: int) -> int:
    """Integer division towards zero."""
    return a // b if a >= 0 else -(-a // b)


def refl_prediction(pos: int, recon: list[int], cells: list[tuple[int, int, int]], near: list[tuple[int, int]]) -> int:
    """From reconstructed values only; near: (distance, places back) of the three nearest of the points before."""
    if pos == 0:
        return 0
    if pos == 1:
        return recon[0]
    if pos == 2:
        w1, w2 = (abs(cells[2][0] - c[0]) + abs(cells[2][1] - c[1]) + 16 * abs(cells[2][2] - c[2]) for c in (cells[1], cells[0]))
        top, whole = w2 * recon[1] + w1 * recon[0], w1 + w2
        return divided(2 * top + (whole if top >= 0 else -whole), 2 * whole)
    (a, _), (b, _), (c, _) = near
    u, v, w = (recon[pos - back] for _, back in near)
    under = a * b + b * c + a * c
    if under:
        return divided(b * c * u + a * c * v + a * b * w, under)
    zero = [x for d, x in zip((a, b, c), (u, v, w)) if d == 0]
    return divided(sum(zero), len(zero))


def _fold_refl(pdf: pd.DataFrame, qp: int, symbols: str | None) -> tuple[list[int], list[int]]:
    """Coded residuals and reconstruction, point by point; symbols: the column of given residuals, else they are made."""
    cells = list(zip(*(pdf[c].tolist() for c in "xyz")))
    coded, recon = [], []
    for pos, (given, ds, backs) in enumerate(zip(pdf[symbols or "refl"].tolist(), pdf["distances"], pdf["backs"])):
        guess = refl_prediction(pos, recon, cells, list(zip(map(int, ds), map(int, backs))))
        q = int(given) if symbols else quantised(int(given) - guess, qp)[0]
        coded.append(q)
        recon.append(max(-32768, min(32767, guess + restored(q, qp))))
    return coded, recon


def restored(q: int, qp: int) -> int:
    """What a coded residual stands for."""
    back = (abs(q) * QUANT_STEPS[qp] + 32) >> 6
    return back if q >= 0 else -back


PLACED = ("slice_id", "pos", "x", "y", "z", "distances", "backs")


def code_refl(points: DataFrame, qp: int) -> DataFrame:
    """Lossy reflectance. points: slice_id, pos, x, y, z, refl, distances, backs; adds coded and recon, keeps the geometry.

    Each point is predicted from the reconstructions of its neighbours, so a slice is one sequence.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        coded, recon = _fold_refl(pdf, qp, None)
        return pdf.assign(coded=coded, recon=recon)

    own = points.select(*PLACED, "refl")
    schema = StructType([*own.schema.fields, *(StructField(n, LongType()) for n in ("coded", "recon"))])
    return own.groupBy("slice_id").applyInPandas(run, schema)


def decode_refl(symbols: DataFrame, qp: int) -> DataFrame:
    """slice_id, pos, recon from coded residuals and geometry alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"slice_id": pdf["slice_id"], "pos": pdf["pos"], "recon": _fold_refl(pdf, qp, "coded")[1]})

    return symbols.select(*PLACED, "coded").groupBy("slice_id").applyInPandas(run, "slice_id long, pos long, recon long")


def color_prediction(recon: list[tuple[int, int, int]], near: list[tuple[int, int]]) -> tuple[int, int, int]:
    """near: (weight, position) of the candidates in order. With several, the last two channels come from the first."""
    if not near:
        return recon[-1] if recon else (0, 0, 0)
    total = sum(w for w, _ in near)
    mean = [sum(w * recon[p][c] for w, p in near) // total for c in range(3)]
    return (mean[0], *recon[near[0][1]][1:]) if len(near) > 1 else tuple(mean)


def _fold_color(pdf: pd.DataFrame, qp: int, given: list[str], coded_already: bool) -> tuple[list[tuple], list[tuple]]:
    coded, recon = [], []
    for *values, weights, places in zip(*(pdf[c].tolist() for c in given), pdf["weights"], pdf["places"]):
        guess = color_prediction(recon, list(zip(map(int, weights), map(int, places))))
        own, back, before = [], [], 0
        for value, g in zip(values, guess):
            q = int(value) if coded_already else quantised(int(value) - g - before, qp)[0]
            own.append(q)
            back.append(max(0, min(255, restored(q, qp) + g + before)))
            before = back[-1] - g  # the next channel's residual is what this one's leaves
        coded.append(tuple(own))
        recon.append(tuple(back))
    return coded, recon


def code_color(points: DataFrame, qp: int) -> DataFrame:
    """Lossy colour with cross-component prediction. points: slice_id, pos, r, g, b, weights, places; adds d0..d2 and c0..c2."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        coded, recon = _fold_color(pdf, qp, ["r", "g", "b"], False)
        more = {f"{n}{i}": [row[i] for row in rows] for n, rows in (("d", coded), ("c", recon)) for i in range(3)}
        return pdf.assign(**more)

    own = points.select("slice_id", "pos", "r", "g", "b", "weights", "places")
    schema = StructType([*own.schema.fields, *(StructField(n, LongType()) for n in ("d0", "d1", "d2", "c0", "c1", "c2"))])
    return own.groupBy("slice_id").applyInPandas(run, schema)


def decode_color(symbols: DataFrame, qp: int) -> DataFrame:
    """slice_id, pos, r, g, b from coded residuals and geometry alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        recon = _fold_color(pdf, qp, ["d0", "d1", "d2"], True)[1]
        return pd.DataFrame({"slice_id": pdf["slice_id"], "pos": pdf["pos"], **{c: [row[i] for row in recon] for i, c in enumerate("rgb")}})

    own = symbols.select("slice_id", "pos", "weights", "places", "d0", "d1", "d2")
    return own.groupBy("slice_id").applyInPandas(run, "slice_id long, pos long, r long, g long, b long")


def layers_of(cells: np.ndarray, shift: int, layers: int) -> np.ndarray:
    """Layer of each point, points in order: a survivor flags every later point near it; the flagged make the layer."""
    layer = np.zeros(len(cells), dtype=np.int64)
    rest, placed = np.arange(len(cells)), False
    for at in range(layers):
        if at == layers - 1 or len(rest) <= 1:
            layer[rest] = at
            break
        by_cell: dict[tuple[int, int, int], list[int]] = {}
        keys = [tuple(c) for c in (cells[rest] >> shift // 3).tolist()]
        for i, key in enumerate(keys):
            by_cell.setdefault(key, []).append(i)
        flagged = np.zeros(len(rest), dtype=bool)
        for i, (x, y, z) in enumerate(keys):
            if not flagged[i]:
                for dx, dy, dz in AROUND:
                    for j in by_cell.get((x + dx, y + dy, z + dz), ()):
                        if j > i:
                            flagged[j] = True
        layer[rest[flagged]] = at
        placed = placed or bool(flagged.any())
        shift += 3 if placed else 0
        rest = rest[~flagged]
    return layer


def lod_layers(points: DataFrame, layers: int = 4) -> DataFrame:
    """slice_id, pos, layer; points: slice_id, pos, x, y, z and the shift of their slice (null: 3)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"slice_id": pdf["slice_id"], "pos": pdf["pos"], "layer": layers_of(pdf[["x", "y", "z"]].to_numpy(), int(pdf["shift"].iloc[0]), layers)})

    own = points.select("slice_id", "pos", "x", "y", "z", F.coalesce("shift", F.lit(3)).alias("shift"))
    return own.groupBy("slice_id").applyInPandas(run, "slice_id long, pos long, layer long")


#: Fixed values of the adaptive bin model: per number of less probable bins seen (3 and more alike) the rate and the step towards the middle.
ADAPT_RATES, ADAPT_STEPS = (3, 3, 4, 5), (197, 197, 95, 46)
ADAPT_START, ADAPT_HALF = 1023, 1024


def adapted(state: tuple[int, int, int, int], bit: int) -> tuple[int, int, int, int]:
    """The next (level, cycle, more probable bin, count of less probable bins). The level falls as the probable bin is confirmed."""
    level, cycle, probable, surprises = state
    rate = ADAPT_RATES[cycle]
    if bit == probable:
        return level - (level >> rate) - (level >> rate + 2), max(cycle, 1), probable, surprises
    level += ADAPT_STEPS[cycle]
    if level >= ADAPT_HALF:
        level, probable = 2 * ADAPT_HALF - 1 - level, 1 - probable
    return level, min(cycle + 1, 3), probable, surprises + 1


def adapt_contexts(bins: DataFrame) -> DataFrame:
    """Every context's state after a slice's bins. bins: slice_id, ctx, pos, bit; models start anew with each slice, which bounds a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        states: dict[int, tuple[int, int, int, int]] = {}
        pdf = pdf.sort_values("pos")
        for ctx, bit in zip(pdf["ctx"].tolist(), pdf["bit"].tolist()):
            states[ctx] = adapted(states.get(ctx, (ADAPT_START, 0, 0, 0)), bit)
        rows = [(pdf["slice_id"].iloc[0], ctx, *s) for ctx, s in states.items()]
        return pd.DataFrame(rows, columns=["slice_id", "ctx", "level", "cycle", "probable", "surprises"])

    schema = "slice_id long, ctx long, level long, cycle long, probable long, surprises long"
    return bins.select("slice_id", "ctx", "pos", "bit").groupBy("slice_id").applyInPandas(run, schema)
