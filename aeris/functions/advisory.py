"""Serving-side advisory expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guideline thresholds and advice messages.
ADVICE_NO2_ABOVE = 20.0
ADVICE_O3_ABOVE = 60.0
NO2_ADVICE = ("NO2 levels are above the guideline. People with respiratory "
              "conditions should take precautions.")
O3_ADVICE = ("Ozone levels are high. Reduce outdoor activities, especially "
             "during midday hours.")
SAFE_ADVICE = ("Pollutant levels are within safe limits. Enjoy your outdoor "
               "activities.")

# AQI bands as (low, high, name, advisory).
AQI_BANDS = [
    (0, 50, "Good", "None"),
    (51, 100, "Moderate",
     "Usually sensitive individuals should consider limiting prolonged outdoor exertion."),
    (101, 150, "Unhealthy for Sensitive Groups",
     "Children, active adults, and people with respiratory disease, such as asthma, "
     "should limit prolonged outdoor exertion."),
    (151, 200, "Unhealthy",
     "Children, active adults, and people with respiratory disease, such as asthma, "
     "should avoid outdoor exertion; everyone else should limit prolonged outdoor exertion."),
    (201, 300, "Very Unhealthy",
     "Children, active adults, and people with respiratory disease, such as asthma, "
     "should avoid outdoor exertion; everyone else should limit outdoor exertion."),
    (301, 500, "Hazardous", "Everyone should avoid all physical activity outdoors."),
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def health_advice(no2, o3) -> Column:
    """array<string> of advice; the safe message when no threshold is exceeded."""
    msgs = F.filter(F.array(F.when(_c(no2) > ADVICE_NO2_ABOVE, F.lit(NO2_ADVICE)),
                            F.when(_c(o3) > ADVICE_O3_ABOVE, F.lit(O3_ADVICE))),
                    lambda m: m.isNotNull())
    return F.when(F.size(msgs) == 0, F.array(F.lit(SAFE_ADVICE))).otherwise(msgs)


def _band_field(value, pick: int) -> Column:
    """Band attribute for an index value; bands are closed integer ranges.

    Fractional values between two bands (e.g. 50.5) fall in the upper band:
    the band is chosen by ceil(value).
    """
    v = F.ceil(_c(value))
    expr = None
    for band in AQI_BANDS:
        cond = (v >= band[0]) & (v <= band[1])
        expr = F.when(cond, F.lit(band[pick])) if expr is None else expr.when(cond, F.lit(band[pick]))
    return expr


def aqi_band(value) -> Column:
    """Band name; NULL for negative, above 500 or NULL values."""
    return _band_field(value, 2)


def aqi_advisory(value) -> Column:
    return _band_field(value, 3)


def display_round(col, digits: int = 3) -> Column:
    return F.round(_c(col), digits)
