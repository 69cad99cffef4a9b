"""Scalar column functions. Each is built of Spark expressions only; null input gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolake.functions import dims


def lookup(key: Column, table: dict, otherwise: Column | None = None) -> Column:
    """The value of a small fixed table: one literal map, so the key is computed once."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def finite(x: Column) -> Column:
    """A number, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def number(text: Column) -> Column:
    """A finite double of a text, else null."""
    return finite(F.trim(text).try_cast("double"))


def holds(condition: Column) -> Column:
    """A condition with null as false."""
    return F.coalesce(condition, F.lit(False))


def normalise_country(code: Column) -> Column:
    """GR, IT or NO, with EL as GR; null for others."""
    return lookup(F.upper(F.trim(code)), dims.COUNTRIES)


def parse_date(text: Column) -> Column:
    """A calendar date of YYYYMMDD or YYYY-MM-DD."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))).cast("date")


def parse_unit(uom: Column) -> Column:
    """A struct (plain, basis): mg{NO3}/L is (mg/L, NO3); other labels are (trimmed, null)."""
    pattern = r"^([A-Za-z]+)\{([^{}/]+)\}/([A-Za-z]+)$"
    t = F.trim(uom)
    inside = t.rlike(pattern)
    plain = F.when(inside, F.concat_ws("/", F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 3))).otherwise(t)
    return F.struct(plain.alias("plain"), F.when(inside, F.regexp_extract(t, pattern, 2)).alias("basis"))


def unit_factor(source: Column, target: Column) -> Column:
    """What a value is multiplied by on the way from one unit to another; null across families.

    A missing source unit is accepted for pH only.
    """
    family = {k: v[0] for k, v in dims.UNITS.items()}
    factor = {k: v[1] for k, v in dims.UNITS.items()}
    same = lookup(source, family) == lookup(target, family)
    return F.when(source.isNull() & (target == "pH"), F.lit(1.0)).when(same, lookup(source, factor) / lookup(target, factor))


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    return value * unit_factor(source, target)


def month_pos(year: Column, month: Column) -> Column:
    """Months since year 0."""
    return (year * 12 + month - 1).cast("int")


def month_text(pos: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(pos / 12).cast("int"), (pos % 12 + 1).cast("int"))


def parse_year_month(text: Column) -> Column:
    """The month position of a strict YYYY-MM with a year of 1900 to 2100."""
    year, month = F.substring(text, 1, 4).try_cast("int"), F.substring(text, 6, 2).try_cast("int")
    return F.when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$") & year.between(1900, 2100), month_pos(year, month))


def excursion(observed: Column, limit: Column, is_lower: Column) -> Column:
    """How far a value is beyond its limit, relative to it: 0 if met, 999 for a divisor of 0 or less."""
    above = F.when(observed <= limit, 0.0).when(limit <= 0, 999.0).otherwise(F.try_divide(observed, limit) - 1)
    below = F.when(observed >= limit, 0.0).when(observed <= 0, 999.0).otherwise(F.try_divide(limit, observed) - 1)
    return F.when(finite(observed).isNull() | finite(limit).isNull(), None).when(is_lower, below).otherwise(above)


def classify_wqi(score: Column) -> Column:
    return F.when(score >= 95, "Excellent").when(score >= 80, "Good").when(score >= 65, "Fair").when(score >= 45, "Marginal").when(score >= 0, "Poor")


def classify_eqr(eqr: Column) -> Column:
    return F.when(eqr >= 0.8, "High").when(eqr >= 0.6, "Good").when(eqr >= 0.4, "Moderate").when(eqr >= 0.2, "Poor").when(eqr < 0.2, "Bad")


def classify_quantity(value: Column, comparator: Column, limit: Column, is_lower: Column) -> Column:
    """exact, pass-by-bound, indeterminate or invalid."""
    v, plain = finite(value), F.coalesce(comparator, F.lit("")) == ""
    passes = holds((~is_lower & comparator.isin("<", "<=") & (v <= limit)) | (is_lower & comparator.isin(">", ">=") & (v >= limit)))
    return F.when(v.isNull(), "invalid").when(plain, "exact").when(passes, "pass-by-bound").otherwise("indeterminate")


def range_limit(value: Column, lower: Column, upper: Column) -> Column:
    """The bound that a value of a two-sided range is held against, as a struct (limit_value, is_lower)."""
    return F.struct(F.when(value < lower, lower).otherwise(upper).alias("limit_value"), (value < lower).alias("is_lower"))


def physically_possible(parameter: Column, value: Column) -> Column:
    v = finite(value)
    return F.when(v.isNull(), False).when(parameter == "pH", v.between(0, 14)).when(parameter == "Water temperature", True).otherwise(v >= 0)


def oxygen_saturation(celsius: Column) -> Column:
    """Dissolved oxygen in mg/L at equilibrium with air (Benson and Krause), 0 to 40 degrees."""
    t = celsius + 273.15
    # The published coefficients.
    log = -139.34411 + 1.575701e5 / t - 6.642308e7 / (t * t) + 1.243800e10 / (t * t * t) - 8.621949e11 / (t * t * t * t)
    return F.when(celsius.between(0, 40), F.exp(log))


def saturation_deviation(oxygen: Column, celsius: Column) -> Column:
    """How far the saturation is from 100 percent."""
    return F.abs(100 - 100 * oxygen / oxygen_saturation(celsius))


def quality_class(text: Column) -> Column:
    """The label behind a code: '1 - Excellent' is Excellent; null if there is no code."""
    return F.when(text.rlike(r"^\d+ ?- ?.+$"), F.trim(F.regexp_extract(text, r"^\d+ ?- ?(.+)$", 1)))


def safe_url(url: Column) -> Column:
    return F.when(F.trim(url).rlike(r"^(?i)https?://\S+$"), F.trim(url))


def assess(mean: Column, limit: Column, is_lower: Column) -> Column:
    return F.when(limit.isNull(), "not-scored").when(mean.isNull(), "indeterminate").when(F.when(is_lower, mean >= limit).otherwise(mean <= limit), "within-limit").otherwise("exceeds-limit")


def crossing(a: Column, b: Column) -> Column:
    """How the comparison with the limit changed; null if one of the two was not judged."""
    judged = a.isin("within-limit", "exceeds-limit") & b.isin("within-limit", "exceeds-limit")
    return F.when(~holds(judged), None).when(a == b, "none").when(b == "exceeds-limit", "within-to-exceeds").otherwise("exceeds-to-within")


def change(a: Column, b: Column, unit: Column, decimals: int = dims.DECIMALS) -> dict[str, Column]:
    """The columns absolute, relative_percent, relative_percent_note and direction of a change from a to b."""
    both = a.isNotNull() & b.isNotNull()
    zero = F.round(a, decimals) == 0
    same = F.round(a, decimals) == F.round(b, decimals)
    return {
        "absolute": F.when(both, F.round(b - a, decimals) + F.lit(0.0)),
        "relative_percent": F.when(both & ~zero, F.round(100 * F.try_divide(b - a, F.abs(a)), dims.PERCENT_DECIMALS) + F.lit(0.0)),
        "relative_percent_note": F.when(a.isNull(), "baseline-missing").when(b.isNull(), "comparison-missing").when(zero, "baseline-zero").when(unit.isin(*dims.INTERVAL_UNITS), "interval-scale"),
        "direction": F.when(both & same, "no-change").when(both & (b > a), "increased").when(both, "decreased"),
    }


def flags(**conditions: Column) -> Column:
    """The sorted names of the conditions that hold; underscores become hyphens."""
    return F.array_sort(F.array_compact(F.array(*[F.when(holds(c), F.lit(k.replace("_", "-"))) for k, c in conditions.items()])))


def generalise_coordinates(lat: Column, lon: Column, km: float) -> Column:
    """A struct (lat, lon) on a grid of `km`; the longitude's step follows from the snapped latitude."""
    step = km / 111.32
    la = F.least(F.greatest(F.rint(lat / step) * step, F.lit(-90.0)), F.lit(90.0))
    lo_step = step / F.cos(F.radians(F.least(F.abs(la), F.lit(89.9))))
    lo = F.rint(lon / lo_step) * lo_step
    wrapped = F.when((lo > 180) | (lo < -180), (lo + 180) - F.floor((lo + 180) / 360) * 360 - 180).otherwise(lo)
    return F.struct(F.round(la, 6).alias("lat"), F.round(wrapped, 6).alias("lon"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a sphere of 6371.0088 km."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def round_figures(x: Column, figures: Column | int, mode: str = "nearest") -> Column:
    """x to so many significant figures (1 to 17), by the digits of its shortest decimal text.

    `nearest` rounds half away from zero, `down` and `up` towards the smaller and the larger number. Zero
    stays zero; NaN and infinities give null.
    """
    f = F.lit(figures) if isinstance(figures, int) else figures
    text = F.abs(x).cast("string")
    mantissa, power = F.split(text, "E")[0], F.coalesce(F.get(F.split(text, "E"), F.lit(1)).cast("int"), F.lit(0))
    whole, part = F.split(mantissa, r"\.")[0], F.coalesce(F.get(F.split(mantissa, r"\."), F.lit(1)), F.lit(""))
    every = F.concat(whole, part)
    digits = F.ltrim(every, F.lit("0"))
    first = F.length(whole) - (F.length(every) - F.length(digits)) - 1 + power  # the power of ten of the first digit
    rest = F.substring(digits, f + 1, F.lit(400))
    away = {"nearest": F.substring(rest, 1, 1) >= "5", "down": (x < 0) & rest.rlike("[1-9]"), "up": (x > 0) & rest.rlike("[1-9]")}[mode]
    head = F.rpad(F.substring(digits, F.lit(1), f), f, F.lit("0")).cast("long") + F.coalesce(away.cast("long"), F.lit(0))
    value = F.concat(head.cast("string"), F.lit("E"), (first - f + 1).cast("string")).cast("double")
    return F.when(finite(x).isNull(), None).when(x == 0, 0.0).otherwise(F.signum(x) * value)


def site_kind(name: Column, type_code: Column) -> Column:
    """water-body, air-station, city or other, from the type's code and whole words of the name."""
    words = F.lower(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"))
    return F.when(type_code == "420531007", "water-body").when(words.rlike(r"\b(air|airquality|pm10|pm25)\b"), "air-station").when(words.rlike(r"\b(river|lake|stream|spring|water|almyros|torrent|canal)\b"), "water-body").when(type_code == "288520005", "city").otherwise("other")
