"""Scalar column expressions on points, colours and residuals. All stay inside code generation."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantisation multipliers and steps per quantisation parameter 0 to 63; a step doubles every 8.
QUANT_MULTIPLIERS = (
    16384, 15024, 13777, 12634, 11585, 10624, 9742, 8933, 8192, 7512, 6889, 6317, 5793, 5312, 4871, 4467,
    4096, 3756, 3444, 3158, 2896, 2656, 2435, 2233, 2048, 1878, 1722, 1579, 1448, 1328, 1218, 1117,
    1024, 939, 861, 790, 724, 664, 609, 558, 512, 470, 431, 395, 362, 332, 304, 279,
    256, 235, 215, 197, 181, 166, 152, 140, 128, 117, 108, 99, 91, 83, 76, 70,
)
QUANT_STEPS = (
    64, 70, 76, 83, 91, 99, 108, 117, 128, 140, 152, 166, 181, 197, 215, 235,
    256, 279, 304, 332, 362, 395, 431, 470, 512, 558, 609, 664, 724, 790, 861, 939,
    1024, 1117, 1218, 1328, 1448, 1579, 1722, 1878, 2048, 2233, 2435, 2656, 2896, 3158, 3444, 3756,
    4096, 4467, 4871, 5312, 5793, 6317, 6889, 7512, 8192, 8933, 9742, 10624, 11585, 12634, 13777, 15024,
)
QUANT_SHIFT, STEP_SHIFT = 14, 6
#: BT.709 full range.
RGB_TO_YUV = ((0.212600, 0.715200, 0.072200), (-0.114572, -0.385428, 0.5), (0.5, -0.454153, -0.045847))
V_TO_R, U_TO_G, V_TO_G, U_TO_B = 1.57480, 0.18733, 0.46813, 1.85563
MORTON_BITS = 21


def clip(n: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(n, F.lit(high)))


def norm_l1(*d: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.abs(x) for x in d])


def norm_l2sq(*d: Column) -> Column:
    return reduce(lambda a, b: a + b, [x * x for x in d])


def byte(x: Column) -> Column:
    """Rounded half away from zero and clipped to an unsigned byte."""
    return clip(F.round(x).cast("long"), 0, 255)


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rows = [m[0] * r + m[1] * g + m[2] * b for m in RGB_TO_YUV]
    return byte(rows[0]), byte(rows[1] + 128.0), byte(rows[2] + 128.0)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    u, v = u - 128.0, v - 128.0
    return byte(y + V_TO_R * v), byte(y - U_TO_G * u - V_TO_G * v), byte(y + U_TO_B * u)


def in_range(code: Column, bits: int, *axes: Column) -> Column:
    """A code of coordinates; where one doesn't fit into ``bits`` bits that is an error, not a cut."""
    fit = reduce(lambda a, b: a & b, [(v >= 0) & (v < (1 << bits)) for v in axes])
    return F.when(F.coalesce(fit, F.lit(True)), code).otherwise(F.raise_error(F.lit(f"a coordinate doesn't fit into {bits} bits")))


def morton3(x: Column, y: Column, z: Column, bits: int = MORTON_BITS) -> Column:
    """Interleaved code, x before y before z in each triple; coordinates of more than ``bits`` bits, or negative, are errors."""
    if not 0 < bits <= MORTON_BITS:
        raise ValueError("a Morton code holds at most 21 bits per axis")
    x, y, z = (v.cast("long") for v in (x, y, z))
    parts = [F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), 3 * i + place) for v, place in ((x, 2), (y, 1), (z, 0)) for i in range(bits)]
    return in_range(reduce(lambda a, b: a.bitwiseOR(b), parts), bits, x, y, z)


def unmorton(code: Column, place: int, bits: int = MORTON_BITS) -> Column:
    """One coordinate of a code: place 2 is x, 1 is y, 0 is z."""
    parts = [F.shiftleft(F.shiftright(code, 3 * i + place).bitwiseAND(F.lit(1)), i) for i in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def child_index(x: Column, y: Column, z: Column, level: int) -> Column:
    bit = lambda v, w: F.shiftright(v, level).bitwiseAND(F.lit(1)) * w
    return bit(x, 4) + bit(y, 2) + bit(z, 1)


def bit_length(n: Column) -> Column:
    """Bits of a positive integer; 0 for 0."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.length(F.bin(n)))


def ceil_log2(x: Column) -> Column:
    return F.when(x <= 1, x - 1).otherwise(F.length(F.bin(x - 1)).cast("long"))


def _table(values: tuple[int, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def quant_residual(r: Column, qp: Column) -> Column:
    return F.shiftright(r * _table(QUANT_MULTIPLIERS, qp) + (1 << QUANT_SHIFT - 1), QUANT_SHIFT)


def dequant_residual(q: Column, qp: Column) -> Column:
    return F.shiftright(q * _table(QUANT_STEPS, qp) + (1 << STEP_SHIFT - 1), STEP_SHIFT)


def zigzag(v: Column) -> Column:
    return F.when(v < 0, -1 - 2 * v).otherwise(2 * v)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 1, -F.shiftright(u + 1, 1)).otherwise(F.shiftright(u, 1))


def psnr(mse: Column, peak: Column, factor: int = 1) -> Column:
    """Decibels; infinite where nothing differs."""
    ratio = factor * peak * peak / F.when(mse > 0, mse)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(ratio))


def tokenize(line: Column) -> Column:
    return F.filter(F.split(line, "[ \\t\\r\\n]+"), lambda t: t != "")


def frame_number(path: Column) -> Column:
    digits = F.regexp_extract(path, r"(\d+)\.[^.]*$", 1)
    return F.when(digits != "", digits.cast("long"))


#: The rule of the Hilbert curve. A curve starts at a corner and walks its eight octants in Gray order over the axes
#: (a, b, c), a fastest. Per octant in that order: the axes of its own curve, and along which axes its start lies opposite.
HILBERT_RULE = (("bca", ""), ("cab", ""), ("cab", ""), ("abc", "ab"), ("abc", "ab"), ("cab", "bc"), ("cab", "bc"), ("bca", "ac"))
HILBERT_BITS = 20


@cache
def hilbert_tables(bits: int = HILBERT_BITS) -> tuple[list[int], list[int]]:
    """(next state, rank) for state * 8 + octant; state 0 is the one in which a curve over ``bits`` bits starts.

    Levels above the coordinates' bits lie in first octants, which only turn the axes.
    """
    axes = (1, 2, 4)  # of the whole curve of HILBERT_BITS: z fastest, x slowest
    for _ in range(HILBERT_BITS - bits):
        axes = tuple(axes["abc".index(k)] for k in HILBERT_RULE[0][0])
    states, following, rank = [(0, axes)], [], []
    for start, own in states:  # grows while it is read
        name = dict(zip("abc", own))
        to, at = [0] * 8, [0] * 8
        for i, (turned, flipped) in enumerate(HILBERT_RULE):
            gray = i ^ i >> 1
            octant = start ^ sum(w for k, w in enumerate(own) if gray >> k & 1)
            child = (start ^ sum(name[k] for k in flipped), tuple(name[k] for k in turned))
            if child not in states:
                states.append(child)
            to[octant], at[octant] = states.index(child), i
        following += to
        rank += at
    return following, rank


def hilbert3(x: Column, y: Column, z: Column, bits: int = HILBERT_BITS) -> Column:
    """Place on the Hilbert curve; coordinates of up to ``bits`` bits, not negative. One fold over the bits, from the highest."""
    if not 0 < bits <= HILBERT_BITS:
        raise ValueError("a Hilbert code holds at most 20 bits per axis")
    following, rank = hilbert_tables(bits)

    def step(acc: Column, level: Column) -> Column:
        bit = lambda v, w: F.call_function("shiftright", v, level).bitwiseAND(F.lit(1)) * w
        at = acc["state"] * 8 + bit(x, 4) + bit(y, 2) + bit(z, 1)
        return F.struct(_table(following, at).alias("state"), (acc["code"] * 8 + _table(rank, at)).alias("code"))

    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("code"))
    code = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["code"])
    return in_range(code, bits, x, y, z)


def split_params(sizes: list[Column], before: Column, smallest: Column) -> tuple[Column, Column]:
    """Bounds of the partial splits: how many come first, and the size at which they start; 0 for cubes."""
    low, high = F.least(*sizes), F.greatest(*sizes)
    return F.least(before, high - low), F.when(low == high, F.lit(0).cast("long")).otherwise(F.least(smallest, low))


def split_sizes(sizes: list[Column], before: Column, smallest: Column) -> list[Column]:
    """Sizes (as powers of two) after one split: the longest axes only, or all; a single cell stays."""
    low, high = F.least(*sizes), F.greatest(*sizes)
    partial = (before > 0) | (low == smallest)
    return [F.when(high == 0, v).when(partial & (v < high), v).otherwise(v - 1) for v in sizes]
