"""Column functions. Null is the only missing value: no NaN or infinity comes out of any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of a missing reading, and the form of a number.
MISSING_CODES = ("-9999", "-9999,0")
NUMBER = r"[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?"
PLAIN = rf"^(?!({'|'.join(MISSING_CODES)})\z){NUMBER}$"

#: Physical limits of the hourly measures, bounds included; None is open.
QC_LIMITS: dict[str, tuple[float | None, float | None]] = {
    "tmax_c": (-10, 50), "tmin_c": (-10, 50), "temp_drybulb_c": (-10, 50),
    "rh_pct": (0, 100), "rh_max_pct": (0, 100), "rh_min_pct": (0, 100),
    "precip_mm": (0, None), "wind_speed_ms": (0, 50), "wind_gust_ms": (0, 50), "radiation_kj": (0, None),
    "pressure_mbar": (850, 1100), "pressure_max_mbar": (850, 1100), "pressure_min_mbar": (850, 1100),
}


def parse_comma_numeric(text: Column) -> Column:
    """A number with a decimal comma; missing codes and whatever isn't a plain number give null. It is one test and one cast: files have many such columns,
    and Java's virtual machine doesn't compile a method of over 8,000 bytes, which is what Spark makes of a projection."""
    return F.when(text.rlike(PLAIN), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def parse_station_date(text: Column) -> Column:
    """A date written with dashes or slashes."""
    return F.try_to_date(F.replace(text, F.lit("/"), F.lit("-")), "yyyy-MM-dd")


def within(value: Column, low: float | None, high: float | None) -> Column:
    """value, or null outside the limits."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.when(ok, value)


def apparent_temp(temp_c: Column, rh_pct: Column, wind_ms: Column) -> Column:
    """Apparent temperature; the vapour pressure is in kPa."""
    vapour = rh_pct / 100 * 6.105 * F.exp(F.try_divide(17.27 * temp_c, 237.7 + temp_c)) / 10
    return -2.7 + 1.04 * temp_c + 2.0 * vapour - 0.65 * wind_ms


def season(month: Column) -> Column:
    """Season of the southern hemisphere."""
    return F.when(month.isin(12, 1, 2), "Summer").when(month.between(3, 5), "Autumn").when(month.between(6, 8), "Winter").when(month.between(9, 11), "Spring")


def month_of_label(yr_mo: Column) -> Column:
    return F.substring_index(yr_mo, "-", -1).try_cast("int")


def period_bucket(year: Column, cuts=(2014, 2019)) -> Column:
    """Number of the period: 1 up to the first cut, and so on."""
    out = F.lit(len(cuts) + 1)
    for k in range(len(cuts), 0, -1):
        out = F.when(year <= cuts[k - 1], k).otherwise(out)
    return F.when(year.isNotNull(), out)


def is_over(value: Column, threshold: Column) -> Column:
    """True if a value is over its threshold; a missing one is not."""
    return F.coalesce(value > threshold, F.lit(False))


def excess(value: Column, threshold: Column) -> Column:
    """How far a value is over its threshold, 0 if it isn't or is missing."""
    return F.greatest(value - threshold, F.lit(0.0))


def birth_date_estimate(day: Column, age: Column) -> Column:
    """The date `age` years of 365.25 days before, rounded half to even."""
    return F.date_sub(day, F.bround(age * 365.25).cast("int"))


def map_code(code: Column, names: dict) -> Column:
    """The name of a code; other codes give null."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def hw_label(metric: Column, percent: Column, days: Column) -> Column:
    """metric_pNN_dN of a definition; 92.5 is written 925."""
    return F.concat(metric, F.lit("_p"), F.regexp_replace(F.format_string("%s", percent.cast("decimal(5,1)")), r"\.0$|\.", ""), F.lit("_d"), days.cast("string"))


#: What the index' metrics and windows are called.
METRIC_LABELS = {
    "hw_count": "HW count", "hw_total_days": "Total HW days", "hw_mean_excess": "Mean excess temp", "hw_degree_days": "Degree-days", "hw_mean_humidity": "Mean humidity",
    "hw_apparent_excess": "Apparent temp excess",
}
WINDOW_LABELS = {"6_10": "6–10 years", "11_18": "11–18 years", "cumulative": "Cumulative"}


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), code)


def parsed_label(label: Column) -> Column:
    """A definition's metric, percentile as text (92.5th), shortest duration as text (≥3d) and a short name."""
    digits = F.regexp_extract(label, r"_p([0-9]+)_", 1)
    percent = F.concat(F.substring(digits, 1, 2), F.when(F.length(digits) > 2, F.concat(F.lit("."), F.substring(digits, 3, 9))).otherwise(""), F.lit("th"))
    days = F.regexp_extract(label, r"_d([0-9]+)$", 1)
    metric = F.regexp_extract(label, r"^([a-z]+)_", 1)
    return F.struct(
        metric.alias("metric"), percent.alias("threshold"), F.concat(F.lit("≥"), days, F.lit("d")).alias("duration"),
        F.concat(F.initcap(metric), F.lit(" "), percent, F.lit(" ≥"), days, F.lit("d")).alias("short_name"),
    )


def plus_years(day: Column, years: int, leap_birth: str = "null") -> Column:
    """The same date years later. A 29 February that the later year lacks gives null, or with 'clamp' the 28th."""
    later = F.add_months(day, 12 * years)
    return later if leap_birth == "clamp" else F.when(F.dayofmonth(later) == F.dayofmonth(day), later)
