"""Readers with fixed schemas. Missing required columns are an error; schemas are never inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hydrolake.functions import scalars as S

from hydrolake.operators.index import LOCATION, OBSERVATION
from hydrolake.operators.lineage import cut
from hydrolake.operators.measurements import NAMES

CLASSIFICATION_COLUMNS = ("countryCode", "bathingWaterIdentifier", "groupIdentifier", "bathingWaterName", "bathingWaterType", "geographicalConstraint", "lon", "lat", "bwProfile", "season", "quality", "monitoringCalendar", "management")
SITE_COLUMNS = ("countryCode", "monitoringSiteIdentifier", "monitoringSiteName", "confidentialityStatus", "lat", "lon")
PAGE = "format int, prefix string, template_sha256 string, seq int, after_uid bigint, last_uid bigint, rows array<struct<UID: bigint, season: string, bathingWaterIdentifier: string, sampleDate: string, escherichiaColiValue: string, intestinalEnterococciValue: string, escherichiaColiStatus: string, intestinalEnterococciStatus: string, sampleStatus: string, metadata_observationStatus: string, hasRemarks: int>>"


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of text files whose quoted fields may hold line breaks, but for each file's first; blank lines are left out.

    Files are read in splits, side by side. The number of quotes before a split tells whether it begins within a
    quoted field: counts of the splits, summed up in order, say so for each. A split then gives its whole records,
    and the pieces of records that go over its ends meet in the order of splits.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "split").agg((F.sum(quotes) % 2).alias("odd"))
    before = (F.sum("odd").over(W.partitionBy("file").orderBy("split")) - F.col("odd")) % 2 == 1
    begun = cut(splits.select("file", "split", before.alias("within")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, inside, kind, first = None, [], False, "record", False

        for batch in batches:
            out: list[tuple] = []
            odd = pc.bit_wise_and(pc.count_substring(batch.column("line"), '"'), 1).to_pylist()
            for line, file, split, within, turns in zip(*(batch.column(c).to_pylist() for c in ("line", "file", "split", "within")), odd):
                if place != (file, split):
                    if held:
                        out.append((*place, "middle" if kind == "head" else "tail", "\n".join(held)))
                    place, held, inside, first = (file, split), [], within, split == 0
                    kind = "head" if within else "record"
                held.append(line)
                inside ^= bool(turns)
                if not inside:
                    text = "\n".join(held)
                    if kind == "head" or not first and text.strip():
                        out.append((file, split, kind, text))
                    first = first and not text.strip("\ufeff \t\r\n")  # the header is the first line that isn't blank
                    held, kind = [], "record"
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], ["file", "split", "kind", "text"])
        if held:
            yield pa.record_batch([pa.array([x]) for x in (*place, "middle" if kind == "head" else "tail", "\n".join(held))], ["file", "split", "kind", "text"])

    # A row a split. The join keeps the order of lines, which are not shuffled.
    found = lines.join(F.broadcast(begun), ["file", "split"]).select("line", "file", "split", "within").mapInArrow(whole, "file string, split long, kind string, text string")
    pieces = found.filter("kind <> 'record'").withColumn("k", S.lookup(F.col("kind"), {"head": 0, "middle": 1, "tail": 2}))
    own = F.count_if(F.col("kind") == "tail").over(W.partitionBy("file").orderBy("split", "k"))
    joined = pieces.withColumn("own", own).groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("split", "k", "text"))).alias("p"))
    return found.filter("kind = 'record'").select(F.col("text").alias("record")).unionByName(joined.select(F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("record")))


def _csv(spark: SparkSession, path: str, needed: tuple[str, ...]) -> DataFrame:
    """CSV files by their header: quoted fields may span lines; all columns are text; short and long rows are marked."""
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    columns = [c.lstrip("\ufeff").strip() for c in head.columns]
    if missing := [c for c in needed if c not in columns]:
        raise ValueError(f"columns are missing: {missing}")
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "multiLine": "true"}
    rows = quoted_records(spark, path).select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    return rows.select(*needed, F.col("_corrupt").isNotNull().alias("_malformed"))


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """The eleven used columns, in any order of the header, and `_malformed`. Files are read in splits, side by side."""
    return _csv(spark, path, tuple(NAMES))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, SITE_COLUMNS).withColumn("input_order", F.monotonically_increasing_id())


#: The bathing operators' names of the columns of a classification file.
CLASSIFICATION_NAMES = dict(zip(CLASSIFICATION_COLUMNS, ("country_code", "bw_id", "group_id", "name", "type", "constraint", "lon", "lat", "profile", "season", "quality", "calendar", "management")))


def read_classifications(spark: SparkSession, path: str) -> DataFrame:
    """All thirteen columns, under the names that the bathing operators use."""
    c = _csv(spark, path, CLASSIFICATION_COLUMNS)
    return c.select(*[F.col(k).alias(v) for k, v in CLASSIFICATION_NAMES.items()])


def read_sample_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files, one page a file in any folder below `path`, with `uids` for the chain's check.

    A file that is no page has nulls in all columns and so breaks the chain at its place.
    """
    pages = spark.read.schema(PAGE).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return pages.withColumn("uids", F.transform("rows", lambda r: r["UID"]))


#: Columns of a page's rows by the names that the sample operators use.
SAMPLE_NAMES = {
    "UID": "uid", "season": "season", "bathingWaterIdentifier": "bw_id", "sampleDate": "sample_date",
    "escherichiaColiValue": "ec_value", "escherichiaColiStatus": "ec_status",
    "intestinalEnterococciValue": "ie_value", "intestinalEnterococciStatus": "ie_status",
}


def samples_of(pages: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Raw sample rows of valid pages; raises if a prefix has not the expected (prefix, n) rows."""
    each = pages.filter("valid").select("prefix", "seq", F.posexplode("rows").alias("place", "r"))
    own = [F.col(f"r.{k}").alias(v) for k, v in SAMPLE_NAMES.items()]
    rows = each.select("prefix", "seq", "place", *own, F.coalesce("r.hasRemarks", F.lit(0)).alias("has_remarks"))
    if expected is not None:
        got = pages.filter("valid").groupBy("prefix").agg(F.sum(F.size("rows")).alias("got"))
        wrong = expected.join(got, "prefix", "left").filter(F.coalesce("got", F.lit(0)) != F.col("n")).limit(5).collect()
        if wrong:
            raise ValueError(f"rows and count differ: {[r['prefix'] for r in wrong]}")
    return rows


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATION).option("multiLine", True).json(path)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCATION).option("multiLine", True).json(path)


def verify_manifest(spark: SparkSession, path: str, manifest: DataFrame, depth: int = 1) -> DataFrame:
    """(name, sha256, found, state): the files of a folder against the manifest (name, sha256).

    A name is the last `depth` parts of a file's path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/").alias("name"), F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.lower("sha256") == F.col("found"), "ok").otherwise("differs")
    return manifest.join(files, "name", "full_outer").withColumn("state", state)
