"""Writers: stores in key order, resources as JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolake.functions import scalars as S

# Fixed value: the URL namespace of version 5 identifiers.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Significant digits of written values.
FIGURES = 6


def write_store(df: DataFrame, path: str, key: list[str], partition_by: str | None = "country") -> None:
    """Rows in key order as Parquet: written beside `path` and published when whole, so a failure leaves the old store.

    An empty store is refused; what was written tells, so the input runs once.
    """
    spark = df.sparkSession
    staged, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "old"))
    ordered = df.repartitionByRange(*key).sortWithinPartitions(*key)
    (ordered.write.partitionBy(partition_by) if partition_by else ordered.write).parquet(staged)
    jvm = spark._jvm.org.apache.hadoop.fs
    place = {p: jvm.Path(p) for p in (path, staged, old)}
    files = place[path].getFileSystem(spark._jsc.hadoopConfiguration())
    if spark.read.schema(df.schema).parquet(staged).isEmpty():
        files.delete(place[staged], True)
        raise ValueError("the store would be empty")
    had = files.exists(place[path])
    if had and not files.rename(place[path], place[old]):
        raise OSError(f"{path} can't be moved")
    if not files.rename(place[staged], place[path]):
        raise OSError(f"{staged} can't be published")
    if had:
        files.delete(place[old], True)


def provenance(dropped: DataFrame, reason: str = "reason", **settings: str) -> DataFrame:
    """(key, value): the settings, and every drop counter as one JSON text."""
    counts = dropped.groupBy(F.coalesce(reason, F.lit("kept")).alias("k")).agg(F.count("*").alias("n"))
    one = counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("value")).withColumn("key", F.lit("counters"))
    own = dropped.sparkSession.createDataFrame(sorted(settings.items()), "key string, value string") if settings else None
    out = one.select("key", "value")
    return out if own is None else own.unionByName(out)


def uuid5(name: Column) -> Column:
    """The version 5 identifier of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def observations(df: DataFrame, site: str, parameter: str, value: str, unit: str, period: str) -> DataFrame:
    """(id, json): one final observation for each row with a number, six significant digits, one per id."""
    v = F.col(value)
    six = S.round_figures(v, FIGURES)
    ident = uuid5(F.concat_ws("|", F.col(site).cast("string"), F.col(parameter).cast("string"), F.col(period).cast("string")))
    body = F.to_json(F.struct(F.lit("Observation").alias("resourceType"), ident.alias("id"), F.lit("final").alias("status"), F.struct(F.col(parameter).cast("string").alias("text")).alias("code"), F.struct(F.concat(F.lit("Location/"), F.col(site).cast("string")).alias("reference")).alias("subject"), F.col(period).cast("string").alias("effectiveDateTime"), F.struct(six.alias("value"), F.col(unit).alias("unit"), F.lit("http://unitsofmeasure.org").alias("system")).alias("valueQuantity")))
    return df.filter(v.isNotNull() & ~F.isnan(v)).select(ident.alias("id"), body.alias("json")).groupBy("id").agg(F.min("json").alias("json"))


def detected_issues(findings: DataFrame, base_url: str, at: str) -> DataFrame:
    """(id, json): one issue for each observation `id` and `finding`, which refers to the observation."""
    ident = uuid5(F.concat_ws("|", F.lit("issue"), F.col("id").cast("string"), "finding"))
    target = F.concat(F.lit(base_url.rstrip("/") + "/Observation/"), F.col("id").cast("string"))
    body = F.to_json(F.struct(F.lit("DetectedIssue").alias("resourceType"), ident.alias("id"), F.lit("final").alias("status"), F.struct(F.col("finding").alias("text")).alias("code"), F.lit(at).alias("identifiedDateTime"), F.array(F.struct(target.alias("reference"))).alias("implicated")))
    return findings.select("id", "finding").distinct().select(ident.alias("id"), body.alias("json"))


def measurements(rows: DataFrame, origin: str = "real-derived", ucum: tuple[str, ...] = ("mg/L", "ug/L", "ng/L", "g/L", "uS/cm", "mS/cm", "Cel", "pH", "%")) -> DataFrame:
    """(id, json): measured values (name, site, parameter, at, value, unit, comparator) as observations, one per name.

    Values have six significant digits; a unit that is a code gets its system; rows without a number are left out.
    """
    ident, coded = uuid5(F.col("name")), F.col("unit").isin(*ucum)
    quantity = F.struct(S.round_figures(F.col("value"), FIGURES).alias("value"), F.when(F.col("comparator").isin("<", "<=", ">", ">="), F.col("comparator")).alias("comparator"), "unit", F.when(coded, "http://unitsofmeasure.org").alias("system"), F.when(coded, F.col("unit")).alias("code"))
    tag = F.struct(F.array(F.struct(F.lit(origin).alias("code"))).alias("tag"))
    body = F.to_json(F.struct(F.lit("Observation").alias("resourceType"), ident.alias("id"), tag.alias("meta"), F.lit("final").alias("status"), F.struct(F.col("parameter").cast("string").alias("text")).alias("code"), F.struct(F.concat(F.lit("Location/"), F.col("site").cast("string")).alias("reference")).alias("subject"), F.col("at").cast("string").alias("effectiveDateTime"), quantity.alias("valueQuantity")))
    return rows.filter(S.finite(F.col("value")).isNotNull()).select(ident.alias("id"), body.alias("json")).groupBy("id").agg(F.min("json").alias("json"))


def write_ndjson(resources: DataFrame, path: str) -> None:
    resources.select("json").write.mode("overwrite").text(path)
