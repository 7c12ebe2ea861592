"""Scales of air quality, fires and earthquakes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands of the index by pollutant: unit, decimals, (low, high, index low, index high); fixed values.
BREAKPOINTS = {
    "pm25": ("ug/m3", 1, ((0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500))),
    "pm10": ("ug/m3", 0, ((0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150), (255, 354, 151, 200), (355, 424, 201, 300), (425, 604, 301, 500))),
    "o3": ("ppm", 3, ((0.0, 0.054, 0, 50), (0.055, 0.070, 51, 100), (0.071, 0.085, 101, 150), (0.086, 0.105, 151, 200), (0.106, 0.200, 201, 300))),
    "no2": ("ppb", 0, ((0, 53, 0, 50), (54, 100, 51, 100), (101, 360, 101, 150), (361, 649, 151, 200), (650, 1249, 201, 300), (1250, 2049, 301, 500))),
    "so2": ("ppb", 0, ((0, 35, 0, 50), (36, 75, 51, 100), (76, 185, 101, 150), (186, 304, 151, 200), (305, 604, 201, 300), (605, 1004, 301, 500))),
    "co": ("ppm", 1, ((0.0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150), (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300), (30.5, 50.4, 301, 500))),
}
MOLAR_MASS = {"o3": 48.00, "no2": 46.0055, "so2": 64.066, "co": 28.010}
LITRES_PER_MOLE = 24.45
#: Lower ends and names of the index's categories; severity of each category; fixed values.
CATEGORIES = ((301, "Hazardous"), (201, "Very Unhealthy"), (151, "Unhealthy"), (101, "Unhealthy for Sensitive Groups"), (51, "Moderate"), (0, "Good"))
SEVERITIES = (10, 25, 45, 65, 85, 100)
#: Acres and severity; magnitudes and severity; colours of shaking alerts; buckets of fires; fixed values.
ACRES = ((100_000, 95), (50_000, 85), (10_000, 70), (1_000, 50), (100, 30), (10, 15))
MAGNITUDES = ((8.0, 95), (7.0, 85), (6.0, 70), (5.0, 50), (4.0, 35))
COLOURS = {"red": 95, "orange": 80, "yellow": 55, "green": 30}
FIRE_BUCKETS = (80, 60, 40, 20)


def banded(value: Column, bands: tuple, other) -> Column:
    """The first band whose lower end the value reaches."""
    out = None
    for floor, result in bands:
        out = F.when(value >= floor, result) if out is None else out.when(value >= floor, result)
    return out.otherwise(other)


def category(aqi: Column) -> Column:
    return banded(aqi, tuple((floor, 5 - i) for i, (floor, _) in enumerate(CATEGORIES)), 0)


def label(aqi: Column) -> Column:
    return banded(aqi, CATEGORIES, "Good")


def severity(aqi: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), category(aqi) + 1)


def unit_name(unit: Column) -> Column:
    u = F.replace(F.translate(F.lower(F.trim(F.coalesce(unit, F.lit("")))), "µμ³", "uu3"), F.lit("ugm3"), F.lit("ug/m3"))
    return u


def converted(parameter: str, value: Column, unit: Column) -> Column:
    """The value in the table's unit; null for a unit that has no honest conversion."""
    want, u, value = BREAKPOINTS[parameter][0], unit_name(unit), value.cast("double")
    if want == "ug/m3":
        return F.when(u == want, value).when(u == "mg/m3", value * 1000.0)
    ppm = F.when(u == "ppm", value).when(u == "ppb", value / 1000.0).when(u == "ug/m3", value * LITRES_PER_MOLE / MOLAR_MASS[parameter] / 1000.0)
    return F.when(u == want, value).otherwise(ppm if want == "ppm" else ppm * 1000.0)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _choose(parameter: Column, of) -> Column:
    out = F.lit(None)
    for name in BREAKPOINTS:
        out = F.when(parameter == name, of(name)).otherwise(out)
    return out


def _bands(name: str) -> Column:
    fields = ("low", "high", "least", "most")
    return F.array(*[F.struct(*[F.lit(float(x)).alias(f) for f, x in zip(fields, band)]) for band in BREAKPOINTS[name][2]])


def aqi(parameter: Column, value: Column, unit: Column) -> Column:
    """The air quality index of a concentration: truncated to the pollutant's decimals, linear inside a band,
    the band's low end in a gap, the top above the table; null if negative, not convertible or of no table."""
    ten = _choose(parameter, lambda name: F.lit(float(10 ** BREAKPOINTS[name][1])))
    bands = _choose(parameter, _bands)

    def placed(cut: Column) -> Column:
        def inside(b: Column) -> Column:
            line = F.bround((b["most"] - b["least"]) / (b["high"] - b["low"]) * (cut - b["low"]) + b["least"])
            return F.coalesce(F.when(cut < b["low"], b["least"]).otherwise(line), F.get(bands, F.size(bands) - 1)["most"])

        return F.when(cut >= 0, _let(F.get(F.filter(bands, lambda b: cut <= b["high"]), F.lit(0)), inside))

    converted_value = _choose(parameter, lambda name: converted(name, value, unit))
    return _let(F.when(converted_value >= 0, F.floor(converted_value * ten) / ten), placed).cast("int")


def corrected_pm25(raw: Column, humidity: Column) -> Column:
    """A light-scattering sensor's reading corrected for humidity, piecewise in the reading."""
    pa = F.greatest(F.lit(0.0), raw.cast("double"))
    rh = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(humidity.cast("double"), F.lit(0.0))))
    damp = F.lit(0.0862) * rh
    low, high = pa / 20.0 - 1.5, pa / 50.0 - 4.2
    out = (
        F.when(pa < 30, 0.524 * pa - damp + 5.75)
        .when(pa < 50, (0.786 * low + 0.524 * (1 - low)) * pa - damp + 5.75)
        .when(pa < 210, 0.786 * pa - damp + 5.75)
        .when(pa < 260, (0.69 * high + 0.786 * (1 - high)) * pa - damp * (1 - high) + 2.966 * high + 5.75 * (1 - high) + 8.84e-4 * high * pa * pa)
        .otherwise(0.69 * pa + 8.84e-4 * pa * pa + 2.97)
    )
    return F.greatest(F.lit(0.0), out)


def fire_severity(acres: Column, contained: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), contained.cast("double"))) / 100.0
    return F.greatest(F.lit(5), F.bround(banded(acres, ACRES, 5) * (1.0 - 0.6 * share)).cast("int"))


def quake_severity(magnitude: Column, colour: Column) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), F.lower(F.trim(F.coalesce(colour, F.lit("")))))
    return F.coalesce(known, banded(magnitude, MAGNITUDES, 20))


def alert_bucket(severity: Column, kind: Column) -> Column:
    """The step of a severity on which alerts speak again."""
    fire = banded(severity, tuple((f, 4 - i) for i, f in enumerate(FIRE_BUCKETS)), 0)
    air = F.lit(5)
    for step in range(5, -1, -1):
        air = F.when(severity <= SEVERITIES[step], step).otherwise(air)
    return F.when(kind == "wildfire", fire).when(kind == "air_quality", air).otherwise(F.floor(severity / 20).cast("int"))


def from_millis(ms: Column) -> Column:
    """A moment from epoch milliseconds; null unless positive."""
    return F.when(ms > 0, F.timestamp_millis(ms.cast("long")).cast("timestamp_ntz"))


def moment(value: Column) -> Column:
    """A moment from text that holds epoch milliseconds or an ISO date and time; null if it holds neither."""
    text = F.btrim(value)
    return F.coalesce(from_millis(text.try_cast("double")), F.when(~text.rlike(r"^[-+0-9.eE]+$"), F.try_to_timestamp(text).cast("timestamp_ntz")))
