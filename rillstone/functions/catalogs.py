"""Catalogues as dimension tables: names through aliases and normal forms to one row, and values in its canonical unit.

``markers`` and ``metrics`` are the built-in dimensions. ``resolved`` joins measurements to a catalogue: a name is brought
to its normal form (case, accents, anything but letters and digits), looked up among keys, display names and aliases, and
its value is converted from the unit that it came with. Defined results:

* an alias that two entries claim resolves to neither: ``ambiguous``, with both keys; a key or display name beats an alias;
* a name that is not found is kept as ``unknown``, its normal form as its own key (a custom entry), value and unit as given;
* a unit that the entry cannot convert gives ``unknown unit`` and no value; no unit at all means the canonical one.

The catalogue has a few hundred rows at most, which is checked before it is broadcast; above that it is joined.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, display name, category, unit, decimals, aliases of the markers.
MARKERS = (
    ("total_cholesterol", "Total cholesterol", "blood_panel", "mmol/L", 2, ("cholesterol", "chol", "tc")),
    ("ldl", "LDL cholesterol", "blood_panel", "mmol/L", 2, ("ldl-c", "low density lipoprotein")),
    ("hdl", "HDL cholesterol", "blood_panel", "mmol/L", 2, ("hdl-c", "high density lipoprotein")),
    ("triglycerides", "Triglycerides", "blood_panel", "mmol/L", 2, ("tg", "trigs")),
    ("fasting_glucose", "Fasting glucose", "blood_panel", "mmol/L", 1, ("glucose", "blood sugar")),
    ("hba1c", "HbA1c", "blood_panel", "mmol/mol", 0, ("a1c", "glycated haemoglobin")),
    ("ferritin", "Ferritin", "blood_panel", "µg/L", 0, ()),
    ("iron", "Serum iron", "blood_panel", "µmol/L", 1, ("fe",)),
    ("transferrin_saturation", "Transferrin saturation", "blood_panel", "%", 0, ("tsat",)),
    ("haemoglobin", "Haemoglobin", "blood_panel", "g/L", 0, ("hemoglobin", "hb", "hgb")),
    ("vitamin_d", "Vitamin D", "blood_panel", "nmol/L", 0, ("25-oh vitamin d", "vit d")),
    ("vitamin_b12", "Vitamin B12", "blood_panel", "ng/L", 0, ("b12", "cobalamin")),
    ("folate", "Folate", "blood_panel", "µg/L", 1, ("folic acid", "vitamin b9")),
    ("tsh", "TSH", "blood_panel", "mIU/L", 2, ("thyrotropin",)),
    ("free_t4", "Free T4", "blood_panel", "pmol/L", 1, ("ft4",)),
    ("crp", "C-reactive protein (CRP)", "blood_panel", "mg/L", 1, ("hs-crp", "c reactive protein")),
    ("egfr", "eGFR", "blood_panel", "mL/min/1.73m²", 0, ("gfr",)),
    ("creatinine", "Creatinine", "blood_panel", "µmol/L", 0, ("crea",)),
    ("alt", "ALT", "blood_panel", "U/L", 0, ("gpt", "alat")),
    ("ast", "AST", "blood_panel", "U/L", 0, ("got", "asat")),
    ("ggt", "GGT", "blood_panel", "U/L", 0, ("gamma gt",)),
    ("sodium", "Sodium", "blood_panel", "mmol/L", 0, ("na",)),
    ("potassium", "Potassium", "blood_panel", "mmol/L", 1, ("k",)),
    ("bp_systolic", "Blood pressure (systolic)", "blood_pressure", "mmHg", 0, ("systolic", "sys")),
    ("bp_diastolic", "Blood pressure (diastolic)", "blood_pressure", "mmHg", 0, ("diastolic", "dia")),
    ("resting_pulse", "Resting pulse", "blood_pressure", "bpm", 0, ("pulse",)),
    ("weight", "Weight", "body", "kg", 1, ("body weight", "mass")),
    ("waist", "Waist", "body", "cm", 1, ("waist circumference",)),
)
# Factors and offsets from a unit to the canonical one, for all entries or for one.
UNITS = {
    (None, "mg/dL", "g/L"): (0.01, 0.0), (None, "g/dL", "g/L"): (10.0, 0.0), (None, "ng/mL", "µg/L"): (1.0, 0.0), (None, "pg/mL", "ng/L"): (1.0, 0.0), (None, "mg/dL", "mg/L"): (10.0, 0.0),
    (None, "lb", "kg"): (0.45359237, 0.0), (None, "in", "cm"): (2.54, 0.0), (None, "uIU/mL", "mIU/L"): (1.0, 0.0), (None, "kPa", "mmHg"): (7.50062, 0.0),
    ("total_cholesterol", "mg/dL", "mmol/L"): (0.02586, 0.0), ("ldl", "mg/dL", "mmol/L"): (0.02586, 0.0), ("hdl", "mg/dL", "mmol/L"): (0.02586, 0.0), ("triglycerides", "mg/dL", "mmol/L"): (0.01129, 0.0),
    ("fasting_glucose", "mg/dL", "mmol/L"): (0.0555, 0.0), ("hba1c", "%", "mmol/mol"): (10.929, -23.497), ("vitamin_d", "ng/mL", "nmol/L"): (2.496, 0.0), ("creatinine", "mg/dL", "µmol/L"): (88.42, 0.0), ("iron", "µg/dL", "µmol/L"): (0.179, 0.0),
}
#: Entries up to which a catalogue is broadcast.
MOST = 10_000


def plain(name: str) -> str:
    """The normal form of a name: no accents, no case, letters and digits only."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return "".join(c for c in bare.lower() if c.isascii() and c.isalnum())


def normal(name: Column) -> Column:
    """``plain`` as a column, for names in Latin letters."""
    accents, letters = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"
    return F.regexp_replace(F.translate(F.lower(name), accents, letters), "[^a-z0-9]", "")


def entries(spark: SparkSession, rows=MARKERS) -> DataFrame:
    """key, display, category, unit, decimals: a row an entry."""
    return spark.createDataFrame([r[:5] for r in rows], "key string, display string, category string, unit string, decimals int")


def names(spark: SparkSession, rows=MARKERS) -> DataFrame:
    """name (in normal form), keys: every name, the keys that it may stand for; own names before aliases."""
    own = [(plain(n), r[0], 0) for r in rows for n in {r[0], r[1]}]
    other = [(plain(a), r[0], 1) for r in rows for a in r[5]]
    df = spark.createDataFrame(own + other, "name string, key string, rank int")
    best = df.groupBy("name").agg(F.min("rank").alias("rank"))
    return df.join(best, ["name", "rank"]).groupBy("name").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def conversions(spark: SparkSession, rows=MARKERS, units=UNITS) -> DataFrame:
    """key, source (a unit without case), factor, shift: what each entry converts; its own unit among them."""
    out = []
    for r in rows:
        known = {r[3].lower(): (1.0, 0.0)}
        known |= {a.lower(): v for (key, a, to), v in units.items() if to == r[3] and key is None}
        known |= {a.lower(): v for (key, a, to), v in units.items() if to == r[3] and key == r[0]}
        out += [(r[0], a, float(f), float(s)) for a, (f, s) in known.items()]
    return spark.createDataFrame(out, "key string, source string, factor double, shift double")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST + 1).count() <= MOST else df


def resolved(rows: DataFrame, name: str = "name", value: str = "value", unit: str = "unit", catalogue=MARKERS, units=UNITS) -> DataFrame:
    """``rows`` with key, status, keys (where ambiguous), canonical (the value) and canonical_unit."""
    spark = rows.sparkSession
    found = _small(names(spark, catalogue).select(F.col("name").alias("_n"), F.col("keys").alias("_keys")))
    kinds = _small(entries(spark, catalogue).select(F.col("key").alias("_k"), F.col("unit").alias("_unit"), F.col("decimals").alias("_places")))
    turns = _small(conversions(spark, catalogue, units).select(F.col("key").alias("_ck"), F.col("source").alias("_source"), "factor", "shift"))
    out = rows.withColumn("_norm", normal(F.col(name))).join(found, F.col("_norm") == F.col("_n"), "left")
    out = out.withColumn("key", F.when(F.size("_keys") == 1, F.col("_keys")[0]).when(F.col("_keys").isNull() & (F.col("_norm") != ""), F.col("_norm")))
    out = out.join(kinds, F.col("key") == F.col("_k"), "left")
    out = out.withColumn("_given", F.lower(F.coalesce(F.nullif(F.trim(F.col(unit)), F.lit("")), F.col("_unit"))))
    out = out.join(turns, (F.col("_k") == F.col("_ck")) & (F.col("_given") == F.col("_source")), "left")
    status = F.when(F.size("_keys") > 1, "ambiguous").when(F.col("_k").isNull(), "unknown").when(F.col("factor").isNull(), "unknown unit").otherwise("known")
    canonical = F.when(status == "known", F.col(value) * F.col("factor") + F.col("shift")).when(status == "unknown", F.col(value))
    names_ = [F.col(c) for c in rows.columns]
    return out.select(*names_, "key", status.alias("status"), F.when(F.size("_keys") > 1, F.col("_keys")).alias("keys"), canonical.alias("canonical"), F.when(status == "known", F.col("_unit")).when(status == "unknown", F.col(unit)).alias("canonical_unit"))
