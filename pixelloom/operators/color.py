"""Colour transforms between described spaces: curves, matrices, profiles and look-up tables, as projections.

A ``Space`` says how samples become linear light (a curve) and where that light's primaries are (a matrix to XYZ under D50).
``transform`` decodes, multiplies by one matrix made on the driver, clamps and encodes, all in SQL expressions: no shuffle and no
Python. Tables of sampled curves and of look-up tables are bounded by their formats and travel as one broadcast row.

Defined cases: null samples stay null; alpha passes through; spaces that are not stated in full, profiles that are neither
matrix/TRC nor gray, and premultiplied pixels are refused with UNSUPPORTED.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MAX, ImageError

# Primaries and white points (x, y), the Bradford cone matrix, and constants of the published curves.
D65, D50_XYZ = (0.3127, 0.3290), (0.9642, 1.0, 0.8249)
PRIMARIES = {
    "BT709": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)), "P3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060)),
    "BT2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)), "ADOBE": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06)),
}
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
PQ = (2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32)
HLG = (0.17883277, 0.28466892, 0.55991073)


@dataclass(frozen=True)
class Curve:
    """``kind`` is LINEAR, SRGB, BT709, BT1886, PQ, HLG, GAMMA, PARAMETRIC (``values`` g, a, b, c, d, e, f) or SAMPLED (0..1)."""

    kind: str
    values: tuple[float, ...] = ()

    def decode(self, v: str) -> str:
        """SQL of the linear light of ``v`` in 0..1; SAMPLED is not an expression of its own."""
        d = lambda x: f"{float(x)!r}D"
        if self.kind == "LINEAR":
            return v
        if self.kind == "SRGB":
            return f"if({v} <= 0.04045D, {v} / 12.92D, power(({v} + 0.055D) / 1.055D, 2.4D))"
        if self.kind == "BT709":
            return f"if({v} < 0.081D, {v} / 4.5D, power(({v} + 0.099D) / 1.099D, {d(1 / 0.45)}))"
        if self.kind in ("BT1886", "GAMMA"):
            return f"power({v}, {d(2.4 if self.kind == 'BT1886' else self.values[0])})"
        if self.kind == "PQ":
            m1, m2, c1, c2, c3 = PQ
            p = f"power({v}, {d(1 / m2)})"
            return f"power(greatest({p} - {d(c1)}, 0D) / ({d(c2)} - {d(c3)} * {p}), {d(1 / m1)})"
        if self.kind == "HLG":
            a, b, c = HLG
            return f"if({v} <= 0.5D, {v} * {v} / 3D, (exp(({v} - {d(c)}) / {d(a)}) + {d(b)}) / 12D)"
        if self.kind == "PARAMETRIC":
            g, a, b, c, e0, e, f = self.values
            return f"if({v} >= {d(e0)}, power(greatest({d(a)} * {v} + {d(b)}, 0D), {d(g)}) + {d(e)}, {d(c)} * {v} + {d(f)})"
        raise ImageError("UNSUPPORTED", f"no expression for {self.kind}")

    def encode(self, v: str) -> str:
        """SQL of the sample in 0..1 of linear light ``v``."""
        d = lambda x: f"{float(x)!r}D"
        if self.kind == "LINEAR":
            return v
        if self.kind == "SRGB":
            return f"if({v} <= 0.0031308D, {v} * 12.92D, 1.055D * power({v}, {d(1 / 2.4)}) - 0.055D)"
        if self.kind == "BT709":
            return f"if({v} < 0.018D, {v} * 4.5D, 1.099D * power({v}, 0.45D) - 0.099D)"
        if self.kind in ("BT1886", "GAMMA"):
            return f"power({v}, {d(1 / (2.4 if self.kind == 'BT1886' else self.values[0]))})"
        if self.kind == "PQ":
            m1, m2, c1, c2, c3 = PQ
            p = f"power({v}, {d(m1)})"
            return f"power(({d(c1)} + {d(c2)} * {p}) / (1D + {d(c3)} * {p}), {d(m2)})"
        if self.kind == "HLG":
            a, b, c = HLG
            return f"if({v} <= {d(1 / 12)}, sqrt(3D * {v}), {d(a)} * ln(greatest(12D * {v} - {d(b)}, 1e-12D)) + {d(c)})"
        if self.kind == "PARAMETRIC":
            g, a, b, c, e0, e, f = self.values
            edge = c * e0 + f
            low = f"({v} - {d(f)}) / {d(c)}" if c else "0D"
            return f"if({v} >= {d(edge)}, (power(greatest({v} - {d(e)}, 0D), {d(1 / g)}) - {d(b)}) / {d(a)}, {low})"
        raise ImageError("UNSUPPORTED", f"no expression for {self.kind}")

    def table(self, size: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Samples of a SAMPLED curve, and of its inverse at ``size`` places."""
        there = np.maximum.accumulate(np.asarray(self.values, float))
        return there, np.interp(np.linspace(0, 1, size), there, np.linspace(0, 1, len(there)))


@dataclass(frozen=True)
class Space:
    """Curves of the three channels and the matrix from linear RGB to XYZ under D50; a gray space has one curve and no matrix."""

    curves: tuple[Curve, ...]
    matrix: tuple[tuple[float, ...], ...] | None

    @property
    def gray(self) -> bool:
        return len(self.curves) == 1


def to_xyz(primaries: tuple, white: tuple[float, float] = D65) -> np.ndarray:
    """Linear RGB of the primaries to XYZ, adapted to D50 by Bradford."""
    full = lambda p: np.array((p[0] / p[1], 1.0, (1 - p[0] - p[1]) / p[1]))
    columns = np.stack([full(p) for p in primaries], 1)
    own = columns * np.linalg.solve(columns, full(white))
    cone = np.array(BRADFORD)
    adapt = np.linalg.inv(cone) @ np.diag((cone @ np.array(D50_XYZ)) / (cone @ full(white))) @ cone
    return adapt @ own


def space(primaries: str | tuple, curve: Curve | str, white: tuple[float, float] = D65) -> Space:
    """A space of named or stated primaries and one curve."""
    curve = Curve(curve) if isinstance(curve, str) else curve
    if isinstance(primaries, str) and primaries not in PRIMARIES:
        raise ImageError("UNSUPPORTED", f"unknown primaries {primaries}")
    return Space((curve,) * 3, tuple(map(tuple, to_xyz(PRIMARIES[primaries] if isinstance(primaries, str) else primaries, white))))


SRGB = space("BT709", "SRGB")


def from_icc(profile: bytes) -> Space:
    """The space of a matrix/TRC or gray profile; look-up table profiles and damaged ones are refused."""
    try:
        model = profile[16:20]
        (n,) = struct.unpack_from(">I", profile, 128)
        tags = {name: profile[at : at + size] for name, at, size in (struct.unpack_from(">4sII", profile, 132 + 12 * k) for k in range(n))}
        if model == b"GRAY" and b"kTRC" in tags:
            return Space((_curve(tags[b"kTRC"]),), None)
        if model != b"RGB " or not {b"rXYZ", b"gXYZ", b"bXYZ", b"rTRC", b"gTRC", b"bTRC"} <= set(tags):
            raise ImageError("UNSUPPORTED", "not a matrix/TRC profile")
        columns = [np.array(struct.unpack_from(">3i", tags[c + b"XYZ"], 8)) / 65536 for c in (b"r", b"g", b"b")]
        return Space(tuple(_curve(tags[c + b"TRC"]) for c in (b"r", b"g", b"b")), tuple(map(tuple, np.stack(columns, 1))))
    except (struct.error, KeyError, IndexError) as e:
        raise ImageError("CORRUPT", "a profile ends early") from e


def _curve(tag: bytes) -> Curve:
    if tag[:4] == b"curv":
        (n,) = struct.unpack_from(">I", tag, 8)
        values = struct.unpack_from(f">{n}H", tag, 12)
        return Curve("LINEAR") if n == 0 else Curve("GAMMA", (values[0] / 256,)) if n == 1 else Curve("SAMPLED", tuple(v / 65535 for v in values))
    if tag[:4] == b"para":
        kind = struct.unpack_from(">H", tag, 8)[0]
        count = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}.get(kind)
        if count is None:
            raise ImageError("UNSUPPORTED", f"parametric curve {kind}")
        p = [v / 65536 for v in struct.unpack_from(f">{count}i", tag, 12)]
        g, a, b, c, d, e, f = {
            0: lambda: (p[0], 1, 0, 0, 0, 0, 0), 1: lambda: (p[0], p[1], p[2], 0, -p[2] / p[1], 0, 0), 2: lambda: (p[0], p[1], p[2], 0, -p[2] / p[1], p[3], p[3]),
            3: lambda: (*p, 0, 0), 4: lambda: tuple(p),
        }[kind]()
        return Curve("PARAMETRIC", (g, a, b, c, d, e, f))
    raise ImageError("UNSUPPORTED", "unknown curve type")


def _looked_up(table: str, v: str) -> str:
    """SQL of the linear interpolation in the array column ``table`` at ``v`` in 0..1."""
    at = f"({v} * (size({table}) - 1))"
    low = f"cast(least(floor({at}), size({table}) - 2) as int)"
    return f"({table}[{low}] + ({at} - {low}) * ({table}[{low} + 1] - {table}[{low}]))"


def transform(df: DataFrame, source: Space, target: Space = SRGB, bits: int = 8, premultiplied: bool = False) -> DataFrame:
    """``df`` with ``r, g, b`` of ``source`` as those of ``target``, rounded half up; gray sources read ``v`` and become ``r, g, b``."""
    if premultiplied:
        raise ImageError("UNSUPPORTED", "premultiplied colour has no colour of its own")
    if target.gray:
        raise ImageError("UNSUPPORTED", "a gray target")
    top = float(MAX[bits])
    tables: dict[str, list[float]] = {}

    def through(curve: Curve, v: str, back: bool) -> str:
        if curve.kind != "SAMPLED":
            return curve.encode(v) if back else curve.decode(v)
        name = f"__t{len(tables)}"
        tables[name] = curve.table()[back].tolist()
        return _looked_up(name, v)

    channels = ["v"] * 3 if source.gray else ["r", "g", "b"]
    curves = source.curves * 3 if source.gray else source.curves
    linear = [through(c, f"({n} / {top!r}D)", False) for c, n in zip(curves, channels)]
    if source.gray:
        mixed = linear
    else:
        both = np.linalg.solve(np.array(target.matrix), np.array(source.matrix))
        mixed = [" + ".join(f"{float(k)!r}D * __l{i}" for i, k in enumerate(row)) for row in both]
    encode = [through(c, f"__m{i}", True) for i, c in enumerate(target.curves)]
    if tables:
        one = df.sparkSession.createDataFrame([tuple(tables.values())], ", ".join(f"{n} array<double>" for n in tables))
        df_in = df.crossJoin(F.broadcast(one))  # one row
    else:
        df_in = df
    keep = [c for c in df.columns if not (source.gray and c == "v")]
    step = df_in.selectExpr("*", *[f"{e} as __l{i}" for i, e in enumerate(linear)])
    step = step.selectExpr("*", *[f"least(1D, greatest(0D, {m if not source.gray else f'__l{i}'})) as __m{i}" for i, m in enumerate(mixed)])
    new = {c: f"cast(floor(least(1D, greatest(0D, {e})) * {top!r}D + 0.5D) as int) as {c}" for c, e in zip("rgb", encode)}
    return step.selectExpr(*[new.get(c, c) for c in keep], *[e for c, e in new.items() if c not in keep])


def lut_transform(df: DataFrame, grid: list[tuple[float, float, float]], size: int, bits: int = 8) -> DataFrame:
    """``r, g, b`` through a ``size``^3 look-up table of colours in 0..1, red outermost, interpolated in all three directions.

    The table is one broadcast row; formats bound it to 255 places a side, and this function to 65.
    """
    if not 2 <= size <= 65 or len(grid) != size**3:
        raise ImageError("UNSUPPORTED", "a table of that size")
    top = float(MAX[bits])
    one = df.sparkSession.createDataFrame([tuple([p[i] for p in grid] for i in range(3))], ", ".join(f"__{c} array<double>" for c in "rgb"))
    at = df.crossJoin(F.broadcast(one)).selectExpr("*", *[f"({c} / {top!r}D * {size - 1}) as __at_{c}" for c in "rgb"])
    at = at.selectExpr("*", *[f"cast(least(floor(__at_{c}), {size - 2}) as int) as __lo_{c}" for c in "rgb"])
    at = at.selectExpr("*", *[f"(__at_{c} - __lo_{c}) as __f_{c}" for c in "rgb"])
    out = {}
    for c in "rgb":
        corners = []
        for k in range(8):
            bit = {n: k >> i & 1 for i, n in enumerate("rgb")}
            weight = " * ".join(f"__f_{n}" if b else f"(1D - __f_{n})" for n, b in bit.items())
            place = f"((__lo_r + {bit['r']}) * {size} + __lo_g + {bit['g']}) * {size} + __lo_b + {bit['b']}"
            corners.append(f"{weight} * __{c}[{place}]")
        out[c] = f"cast(floor(least(1D, greatest(0D, {' + '.join(corners)})) * {top!r}D + 0.5D) as int) as {c}"
    return at.selectExpr(*[out.get(c, c) for c in df.columns])


__all__ = ["PRIMARIES", "SRGB", "Curve", "Space", "from_icc", "lut_transform", "space", "to_xyz", "transform"]
