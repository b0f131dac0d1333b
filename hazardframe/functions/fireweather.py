"""Fire-danger codes of the Canadian system (Van Wagner 1987) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardframe.functions.base import col, dbl

# Day-length factors by calendar month, January to December.
DMC_DAY_LENGTH = [6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0]
DC_DAY_LENGTH = [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6]
# Fresh-season start codes (FFMC, DMC, DC).
START_CODES = (85.0, 6.0, 15.0)


def _by_month(values, month) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), col(month).cast("int"))


def _moisture(ffmc) -> Column:
    f = dbl(ffmc)
    return F.lit(147.2) * (F.lit(101.0) - f) / (F.lit(59.5) + f)


def let(value: Column, use) -> Column:
    """Bind ``value`` once and use it several times inside an interpreted fold."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ffmc_terms(temp, rh, wind, rain) -> dict[str, Column]:
    """The parts of the FFMC update that do not depend on yesterday's code."""
    t, h, w, r = dbl(temp), dbl(rh), dbl(wind), dbl(rain)
    rf = F.greatest(r - 0.5, F.lit(1e-12))
    rained = r > 0.5
    heat = 0.18 * (21.1 - t) * (1.0 - F.exp(-0.115 * h))
    steam = F.exp((h - 100.0) / 10.0)

    def kept(x: Column) -> Column:
        base = 0.424 * (1.0 - F.pow(x, F.lit(1.7))) + 0.0694 * F.sqrt(w) * (1.0 - F.pow(x, F.lit(8.0)))
        return F.pow(F.lit(10.0), -(base * 0.581 * F.exp(0.0365 * t)))

    return {
        "wet_gain": F.when(rained, 42.5 * rf * (1.0 - F.exp(-6.93 / rf))),
        "soak_gain": F.when(rained, 0.0015 * F.sqrt(rf)),
        "dry_eq": 0.942 * F.pow(h, F.lit(0.679)) + 11.0 * steam + heat,
        "dry_kept": kept(h / 100.0),
        "wet_eq": 0.618 * F.pow(h, F.lit(0.753)) + 10.0 * steam + heat,
        "wet_kept": kept((100.0 - h) / 100.0),
    }


def ffmc_next(previous: Column, k) -> Column:
    """FFMC update from yesterday's code and the day's terms ``k``."""

    def rained(m0: Column) -> Column:
        over = F.when(m0 > 150.0, m0 - 150.0).otherwise(0.0)
        wetted = m0 + k["wet_gain"] * F.exp(-100.0 / (251.0 - m0)) + k["soak_gain"] * over * over
        return F.when(k["wet_gain"].isNotNull(), F.least(wetted, F.lit(250.0))).otherwise(m0)

    def settled(m: Column) -> Column:
        return (
            F.when(m > k["dry_eq"], k["dry_eq"] + (m - k["dry_eq"]) * k["dry_kept"])
            .when(m < k["wet_eq"], k["wet_eq"] - (k["wet_eq"] - m) * k["wet_kept"])
            .otherwise(m)
        )

    return let(let(let(_moisture(previous), rained), settled), lambda m: 59.5 * (250.0 - m) / (147.2 + m))


def dmc_terms(temp, rh, rain, month) -> dict[str, Column]:
    t, h, r = dbl(temp), dbl(rh), dbl(rain)
    drying = 1.894 * (t + 1.1) * (100.0 - h) * _by_month(DMC_DAY_LENGTH, month) * 1e-6
    return {
        "duff_rain": F.when(r > 1.5, 0.92 * r - 1.27),
        "duff_drying": F.when(t > -1.1, 100.0 * drying).otherwise(0.0),
    }


def dmc_next(previous: Column, k) -> Column:
    p = previous
    log_p = F.log(F.greatest(p, F.lit(1e-12)))
    slope = (
        F.when(p <= 33.0, 100.0 / (0.5 + 0.3 * p))
        .when(p <= 65.0, 14.0 - 1.3 * log_p)
        .otherwise(6.2 * log_p - 17.2)
    )
    eff = k["duff_rain"]
    wet = F.exp(5.6348 - p / 43.43) + 1000.0 * eff / (48.77 + slope * eff)
    rained = F.greatest(F.lit(0.0), 43.43 * (5.6348 - F.log(F.greatest(wet, F.lit(1e-12)))))
    return F.when(eff.isNotNull(), rained).otherwise(p) + k["duff_drying"]


def dc_terms(temp, rain, month) -> dict[str, Column]:
    t, r = dbl(temp), dbl(rain)
    lf = _by_month(DC_DAY_LENGTH, month)
    warm = F.when(t > -2.8, 0.36 * (t + 2.8) + lf).otherwise(lf)
    return {
        "deep_rain": F.when(r > 2.8, 3.937 * (0.83 * r - 1.27)),
        "deep_drying": 0.5 * F.greatest(F.lit(0.0), warm),
    }


def dc_next(previous: Column, k) -> Column:
    recharge = 800.0 * F.exp(-previous / 400.0) + k["deep_rain"]
    rained = F.greatest(F.lit(0.0), 400.0 * F.log(800.0 / F.greatest(recharge, F.lit(1e-12))))
    return F.when(k["deep_rain"].isNotNull(), rained).otherwise(previous) + k["deep_drying"]


def ffmc(previous, temp, rh, wind, rain) -> Column:
    """Today's fine fuel moisture code from yesterday's."""
    return ffmc_next(dbl(previous), ffmc_terms(temp, rh, wind, rain))


def dmc(previous, temp, rh, rain, month) -> Column:
    """Today's duff moisture code from yesterday's."""
    return dmc_next(dbl(previous), dmc_terms(temp, rh, rain, month))


def dc(previous, temp, rain, month) -> Column:
    """Today's drought code from yesterday's."""
    return dc_next(dbl(previous), dc_terms(temp, rain, month))


def isi(ffmc_code, wind) -> Column:
    """Initial spread index of one hour."""
    m = _moisture(ffmc_code)
    fuel = 91.9 * F.exp(-0.1386 * m) * (1.0 + F.pow(m, F.lit(5.31)) / 4.93e7)
    return 0.208 * F.exp(0.05039 * dbl(wind)) * fuel


def bui(dmc_code, dc_code) -> Column:
    """Build-up index."""
    p, d = dbl(dmc_code), dbl(dc_code)
    total = p + 0.4 * d
    low = F.when(total > 0, 0.8 * p * d / total).otherwise(0.0)  # in this order: exact ties of two-decimal codes hang on it
    high = p - (1.0 - 0.8 * d / F.when(total > 0, total)) * (0.92 + F.pow(0.0114 * p, F.lit(1.7)))
    return F.when(p <= 0.4 * d, low).otherwise(high)


def fwi(isi_value, bui_value) -> Column:
    """Fire weather index."""
    b = dbl(bui_value)
    fuel = F.when(b <= 80.0, 0.626 * F.pow(b, F.lit(0.809)) + 2.0).otherwise(
        1000.0 / (25.0 + 108.64 * F.exp(-0.023 * b))
    )
    mix = 0.1 * dbl(isi_value) * fuel
    scaled = F.exp(2.72 * F.pow(0.434 * F.log(F.greatest(mix, F.lit(1.0))), F.lit(0.647)))
    return F.when(mix > 1.0, scaled).otherwise(mix)


def _dried(m: float, temp: float, rh: float, wind: float) -> float:
    """One day's drying or wetting of fine fuel towards its equilibrium."""
    heat = 0.18 * (21.1 - temp) * (1.0 - math.exp(-0.115 * rh))
    steam = math.exp((rh - 100.0) / 10.0)
    dry, wet = 0.942 * rh**0.679 + 11.0 * steam + heat, 0.618 * rh**0.753 + 10.0 * steam + heat
    if wet <= m <= dry:
        return m
    side = rh / 100.0 if m > dry else (100.0 - rh) / 100.0
    speed = (0.424 * (1.0 - side**1.7) + 0.0694 * math.sqrt(wind) * (1.0 - side**8.0)) * 0.581 * math.exp(0.0365 * temp)
    goal = dry if m > dry else wet
    return goal + (m - goal) * 10.0**-speed


def next_codes(codes: tuple[float, float, float], temp: float, rh: float, wind: float, rain: float, month: int) -> tuple[float, float, float]:
    """Today's three codes from yesterday's, for the stream's carried state; the columns above say the same."""
    fine, duff, deep = codes
    m = 147.2 * (101.0 - fine) / (59.5 + fine)
    if rain > 0.5:
        r = rain - 0.5
        over = max(0.0, m - 150.0)
        m = min(250.0, m + 42.5 * r * math.exp(-100.0 / (251.0 - m)) * (1.0 - math.exp(-6.93 / r)) + 0.0015 * over * over * math.sqrt(r))
    m = _dried(m, temp, rh, wind)
    if rain > 1.5:
        slope = 100.0 / (0.5 + 0.3 * duff) if duff <= 33.0 else 14.0 - 1.3 * math.log(duff) if duff <= 65.0 else 6.2 * math.log(duff) - 17.2
        gain = 0.92 * rain - 1.27
        moist = math.exp(5.6348 - duff / 43.43) + 1000.0 * gain / (48.77 + slope * gain)
        duff = max(0.0, 43.43 * (5.6348 - math.log(max(moist, 1e-12))))
    duff += 100.0 * 1.894 * (temp + 1.1) * (100.0 - rh) * DMC_DAY_LENGTH[month - 1] * 1e-6 if temp > -1.1 else 0.0
    if rain > 2.8:
        stored = 800.0 * math.exp(-deep / 400.0) + 3.937 * (0.83 * rain - 1.27)
        deep = max(0.0, 400.0 * math.log(800.0 / max(stored, 1e-12)))
    deep += 0.5 * max(0.0, DC_DAY_LENGTH[month - 1] + (0.36 * (temp + 2.8) if temp > -2.8 else 0.0))
    return 59.5 * (250.0 - m) / (147.2 + m), duff, deep
