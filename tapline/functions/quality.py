"""Voice-quality scoring: codec parameters, R-factor and MOS columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import round_exact

# Payload type -> (codec, clock Hz, Ie, Bpl), ITU-T G.113 Appendix I.
CODECS = {
    0: ("PCMU (G.711u)", 8000, 0.0, 25.1),
    3: ("GSM", 8000, 20.0, 10.0),
    4: ("G.723.1", 8000, 15.0, 16.1),
    8: ("PCMA (G.711a)", 8000, 0.0, 25.1),
    9: ("G.722", 16000, 13.0, 18.0),
    15: ("G.728", 8000, 7.0, 19.0),
    18: ("G.729", 8000, 11.0, 19.0),
}
DYNAMIC_CODEC = ("dynamic", 8000, 0.0, 25.1)
ONE_WAY_DELAY_MS = 30.0
MOS_WARN_BELOW = 3.6
MOS_ERROR_BELOW = 2.6


def _codec_struct(row) -> Column:
    name, clock, ie, bpl = row
    return F.struct(
        F.lit(name).alias("codec"),
        F.lit(clock).alias("clock_hz"),
        F.lit(ie).cast("double").alias("ie"),
        F.lit(bpl).cast("double").alias("bpl"),
    )


def codec_for(payload_type: Column) -> Column:
    """Codec parameters of a payload type; unknown or null types are dynamic."""
    out = _codec_struct(DYNAMIC_CODEC)
    for number, row in CODECS.items():
        out = F.when(payload_type == number, _codec_struct(row)).otherwise(out)
    return out


def r_factor(loss_pct: Column, delay_ms: Column, ie: Column, bpl: Column) -> Column:
    late = F.when(delay_ms > 177.3, F.lit(0.11) * (delay_ms - F.lit(177.3))).otherwise(F.lit(0.0))
    total = loss_pct + bpl
    impaired = F.when(total == 0, ie).otherwise(ie + (F.lit(95.0) - ie) * (loss_pct / total))
    return F.lit(93.2) - (F.lit(0.024) * delay_ms + late) - impaired


def r_to_mos(r: Column) -> Column:
    curve = F.lit(1.0) + F.lit(0.035) * r + F.lit(7e-6) * r * (r - F.lit(60.0)) * (F.lit(100.0) - r)
    return (
        F.when(r <= 0, F.lit(1.0))
        .when(r >= 100, F.lit(4.5))
        .otherwise(F.greatest(F.lit(1.0), F.least(F.lit(4.5), round_exact(curve, 2))))
    )


def mos_band(mos: Column) -> Column:
    return F.when(mos < MOS_ERROR_BELOW, "poor").when(mos < MOS_WARN_BELOW, "degraded").otherwise("good")
