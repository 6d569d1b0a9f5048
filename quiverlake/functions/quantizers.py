"""Int8 quantisers as columns.

A quantiser prepares a vector (identity, unit length, rotation, mean-centring
or centring with rotation) and codes it by one scale a vector: scale =
max|x| / levels, code = x / scale in float, rounded half to even, within the
levels. Queries are prepared alike, so that approximate scores are products in
the prepared space. ``decode`` gives back prepared components; ``restored``
also undoes a rotation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiverlake.functions import vectors as V


@dataclass(frozen=True)
class Quantizer:
    name: str
    prepare: Callable[[Column], Column]
    levels: int = 127
    shift: int = 0

    def _scale(self, prepared: Column) -> Column:
        top = F.array_max(F.transform(V.doubles(prepared), lambda x: F.abs(x)))
        return F.when(F.coalesce(top, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(top / float(self.levels))

    def encode(self, v: Column) -> Column:
        """(codes array<tinyint>, scale double). The prepared vector and its scale are worked out once."""
        low, high = F.lit(-float(self.levels)), F.lit(float(self.levels))

        def coded(p: Column) -> Column:
            step = p["scale"].cast("float").cast("double")
            code = lambda x: F.greatest(low, F.least(high, F.rint((x.cast("double") / step).cast("float")))).cast("tinyint")
            return F.struct(F.transform(p["v"], code).alias("codes"), p["scale"].alias("scale"))

        return V.let(self.prepare(v).cast("array<float>"), lambda x: V.let(F.struct(x.alias("v"), self._scale(x).alias("scale")), coded))

    def decode(self, encoded: Column) -> Column:
        """Codes times scale, in float, in the prepared space."""

        def spread(e: Column) -> Column:
            step = e["scale"].cast("float").cast("double")
            return F.transform(e["codes"], lambda c: (c.cast("double") * step).cast("float"))

        return V.let(encoded, spread)

    def restored(self, encoded: Column) -> Column:
        """Decoded components at their own places."""
        return V.rolled(self.decode(encoded), -self.shift) if self.shift else self.decode(encoded)

    def approx_score(self, query: Column, encoded: Column) -> Column:
        """Product of the prepared query with the decoded vector."""
        return V.dot(self.prepare(query), self.decode(encoded))

    @staticmethod
    def code_bytes(encoded: Column) -> Column:
        return F.size(encoded["codes"])


def _as_float(v: Column) -> Column:
    return v.cast("array<float>")


SCALAR = Quantizer("scalar", _as_float)
NORMALIZED = Quantizer("normalized", V.unit)
ROTATED = Quantizer("rotate", lambda v: V.rolled(_as_float(v), 1), shift=1)
SHIFTED = Quantizer("shift", lambda v: V.rolled(_as_float(v), 2), shift=2)
RESIDUAL = Quantizer("residual", V.centred)
CENTERED_ROTATED = Quantizer("centered", lambda v: V.rolled(V.centred(v), 1), shift=1)

QUANTIZERS: dict[str, Quantizer] = {q.name: q for q in (SCALAR, NORMALIZED, ROTATED, SHIFTED, RESIDUAL, CENTERED_ROTATED)}


def quantizer(name: str, levels: int = 127) -> Quantizer:
    found = QUANTIZERS[name]
    return found if levels == found.levels else Quantizer(f"{name}-{levels}", found.prepare, levels, found.shift)
