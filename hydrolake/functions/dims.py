"""Fixed values of the domain: determinands, units, limits, codes. They must equal the published ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Country codes, categories, matrices and statuses.
COUNTRIES = {"EL": "GR", "GR": "GR", "IT": "IT", "NO": "NO"}
CATEGORIES = ("RW", "LW")
MATRICES = ("W", "W-DIS")
MISSING = ("L", "M", "N", "O", "W")
UNRELIABLE = ("U", "V")
BELOW_LOQ = ("1", "true", "TRUE", "True")
MIN_YEAR = 2010
MIN_SAMPLES, MIN_AGGREGATES, FEW_SITES, DECIMALS, PERCENT_DECIMALS = 3, 1, 5, 6, 4
INTERVAL_UNITS = ("Cel", "pH")

# Standard atomic weights and the ratios of ions to their element.
P, O, N, H = 30.973762, 15.999, 14.0067, 1.008
PO4_PER_P = (P + 4 * O) / P
NO3_PER_N = (N + 3 * O) / N
NH4_PER_N = (N + 4 * H) / N
NO2_PER_N = (N + 2 * O) / N

# Unit -> (family, factor to the family's base).
UNITS = {
    "ng/L": ("concentration", 1e-6), "ug/L": ("concentration", 1e-3), "mg/L": ("concentration", 1.0), "g/L": ("concentration", 1e3),
    "ng/l": ("concentration", 1e-6), "ug/l": ("concentration", 1e-3), "mg/l": ("concentration", 1.0), "g/l": ("concentration", 1e3),
    "uS/cm": ("conductivity", 1.0), "mS/cm": ("conductivity", 1e3), "Cel": ("temperature", 1.0), "pH": ("ph", 1.0), "[pH]": ("ph", 1.0),
}

# Parameter -> (unit, drinking-water limit, whether it is a minimum).
PARAMETERS = {
    "Aluminium dissolved": ("ug/L", 200.0, False), "Ammonium": ("mg/L", 0.50, False), "Arsenic dissolved": ("ug/L", 10.0, False),
    "Cadmium dissolved": ("ug/L", 5.0, False), "Copper dissolved": ("ug/L", 2000.0, False), "Dissolved Oxygen": ("mg/L", 6.0, True),
    "Electrical conductivity": ("uS/cm", 2500.0, False), "Conductivity": ("uS/cm", 2500.0, False), "Iron dissolved": ("ug/L", 200.0, False),
    "Lead dissolved": ("ug/L", 10.0, False), "Mercury dissolved": ("ug/L", 1.0, False), "Nickel dissolved": ("ug/L", 20.0, False),
    "Nitrate": ("mg/L", 50.0, False), "Nitrite": ("mg/L", 0.50, False), "pH": ("pH", 8.5, False), "Sulphate": ("mg/L", 250.0, False),
    "Total phosphates": ("mg/L", 0.10, False), "Water temperature": ("Cel", 25.0, False), "Zinc dissolved": ("ug/L", 100.0, False),
}
# Ranges, spellings, limits of rivers and countries, saturation, dated limits, kinds of sources, plausible values.
RANGES = {"pH": (6.5, 9.5)}
#: Other spellings of a parameter in nested records.
ALIASES = {"703421000": "Water temperature", "temperature (water)": "Water temperature", "watertemperature": "Water temperature"}
SURFACE_LIMITS = {"Lead dissolved": 1.2, "Mercury dissolved": 0.07, "Nickel dissolved": 4.0}
NEEDS_HARDNESS = ("Cadmium dissolved",)
NATIONAL_LIMITS = {
    "IT": {"Total phosphates": 0.100 * PO4_PER_P, "Nitrate": 1.2 * NO3_PER_N, "Ammonium": 0.06 * NH4_PER_N},
    "GR": {"Total phosphates": 0.165 * PO4_PER_P, "Nitrate": 0.60 * NO3_PER_N, "Ammonium": 0.06 * NH4_PER_N, "Nitrite": 0.008 * NO2_PER_N, "Dissolved Oxygen": 6.4},
}
SATURATION_COUNTRIES = {"IT": 20.0}
TEMPERATURE_INTERPRETIVE = ("IT", "GR")
DATED_LIMITS = {"Lead dissolved": ("2036-01-12", 5.0)}
DRINKING_LEGAL = ("Arsenic dissolved", "Cadmium dissolved", "Copper dissolved", "Lead dissolved", "Mercury dissolved", "Nickel dissolved", "Nitrate", "Nitrite")
DRINKING_INDICATOR = ("Aluminium dissolved", "Ammonium", "Conductivity", "Electrical conductivity", "Iron dissolved", "Sulphate", "pH")
PLAUSIBLE = {"EEA_3152-01-0": (0.0, 14.0)}

CHEMISTRY, SOLIDS, ORGANIC = "water-chemistry", "solids-turbidity", "organic-matter"
METAL = "W is not the dissolved fraction that the limit means"
NO_NAME = "no parameter has the same meaning"
# Code, label, parameter name, matrix of the name, basis of the unit, factor, reason, group, expected unit (measurement only).
DETERMINANDS = [
    ("EEA_3152-01-0", "pH", "pH", "W", None, 1.0, None, CHEMISTRY, None),
    ("EEA_3132-01-2", "Dissolved oxygen", "Dissolved Oxygen", "W", None, 1.0, None, CHEMISTRY, None),
    ("EEA_3131-01-9", "Oxygen saturation", None, "W", None, 1.0, "saturation needs each sample's temperature", CHEMISTRY, None),
    ("EEA_3121-01-5", "Water temperature", "Water temperature", "W", None, 1.0, None, CHEMISTRY, None),
    ("EEA_3142-01-6", "Electrical conductivity", "Electrical conductivity", "W", None, 1.0, None, CHEMISTRY, None),
    ("CAS_14797-55-8", "Nitrate", "Nitrate", "W", "NO3", 1.0, None, CHEMISTRY, None),
    ("CAS_14797-65-0", "Nitrite", "Nitrite", "W", "NO2", 1.0, None, CHEMISTRY, None),
    ("CAS_14798-03-9", "Ammonium", "Ammonium", "W", "NH4", 1.0, None, CHEMISTRY, None),
    ("CAS_14265-44-2", "Phosphate", None, "W", "P", 1.0, "orthophosphate is not total phosphorus", CHEMISTRY, None),
    ("CAS_7723-14-0", "Total phosphorus", "Total phosphates", "W", "P", PO4_PER_P, None, CHEMISTRY, None),
    ("CAS_18785-72-3", "Sulphate", "Sulphate", "W", None, 1.0, None, CHEMISTRY, None),
    ("CAS_16887-00-6", "Chloride", None, "W", None, 1.0, NO_NAME, CHEMISTRY, None),
    ("CAS_7440-43-9", "Cadmium and its compounds", "Cadmium dissolved", "W-DIS", None, 1.0, METAL, CHEMISTRY, None),
    ("CAS_7439-97-6", "Mercury and its compounds", "Mercury dissolved", "W-DIS", None, 1.0, METAL, CHEMISTRY, None),
    ("CAS_7439-92-1", "Lead and its compounds", "Lead dissolved", "W-DIS", None, 1.0, METAL, CHEMISTRY, None),
    ("CAS_7440-02-0", "Nickel and its compounds", "Nickel dissolved", "W-DIS", None, 1.0, METAL, CHEMISTRY, None),
    ("CAS_7440-38-2", "Arsenic and its compounds", "Arsenic dissolved", "W-DIS", None, 1.0, METAL, CHEMISTRY, None),
    ("CAS_7440-66-6", "Zinc and its compounds", "Zinc dissolved", "W-DIS", None, 1.0, METAL, CHEMISTRY, None),
    ("CAS_7440-50-8", "Copper and its compounds", "Copper dissolved", "W-DIS", None, 1.0, METAL, CHEMISTRY, None),
    ("CAS_7439-89-6", "Iron and its compounds", "Iron dissolved", "W-DIS", None, 1.0, METAL, CHEMISTRY, None),
    ("CAS_7429-90-5", "Aluminium and its compounds", "Aluminium dissolved", "W-DIS", None, 1.0, METAL, CHEMISTRY, None),
    ("EEA_3112-01-4", "Turbidity", None, "W", None, 1.0, "measurement only", SOLIDS, "{NTU}"),
    ("EEA_31-02-7", "Total suspended solids", None, "W", None, 1.0, "measurement only", SOLIDS, "mg/L"),
    ("EEA_3111-01-1", "Secchi depth", None, "W", None, 1.0, "measurement only", SOLIDS, "m"),
    ("EEA_3133-06-0", "Total organic carbon (TOC)", None, "W", None, 1.0, "measurement only", ORGANIC, "mg{C}/L"),
    ("EEA_3133-05-9", "Dissolved organic carbon (DOC)", None, "W-DIS", None, 1.0, "measurement only", ORGANIC, "mg{C}/L"),
    ("EEA_3164-01-0", "Chlorophyll a", None, "W", None, 1.0, "measurement only", ORGANIC, "ug/L"),
    ("EEA_3133-01-5", "BOD5", None, "W", None, 1.0, "measurement only", ORGANIC, "mg{O2}/L"),
    ("EEA_3133-03-7", "CODCr", None, "W", None, 1.0, "measurement only", ORGANIC, "mg{O2}/L"),
]
DETERMINAND_COLUMNS = ("code", "label", "closed_name", "own_matrix", "basis", "basis_factor", "reason", "group", "expected_unit")
DETERMINAND_SCHEMA = "code string, label string, closed_name string, own_matrix string, basis string, basis_factor double, reason string, `group` string, expected_unit string"


def determinands(spark: SparkSession) -> DataFrame:
    """The determinand dimension; 29 rows."""
    return spark.createDataFrame(DETERMINANDS, DETERMINAND_SCHEMA)


def parameters(spark: SparkSession) -> DataFrame:
    """(parameter, unit, limit_value, is_lower); 19 rows."""
    return spark.createDataFrame([(k, *v) for k, v in PARAMETERS.items()], "parameter string, unit string, limit_value double, is_lower boolean")


def surface_limits(spark: SparkSession) -> DataFrame:
    """(country, parameter, limit_value) of rivers; a null country holds for all."""
    rows = [(None, p, v) for p, v in SURFACE_LIMITS.items()] + [(c, p, v) for c, own in NATIONAL_LIMITS.items() for p, v in own.items()]
    return spark.createDataFrame(rows, "country string, parameter string, limit_value double")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    return repr(x) if isinstance(x, float) else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows, name: str, columns) -> str:
    """Rows as an SQL table expression."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f') AS {name}({", ".join(chr(34) + c + chr(34) for c in columns)})'
