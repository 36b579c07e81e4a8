"""An annotated speech corpus: speaker folders with recordings, annotation tiers and a table of speakers."""

from __future__ import annotations

import io
import os
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.text import clean_attribute, clean_dialect_token, clean_orthographic_token, clean_phonemic, clean_transliteration, join_orthographic, strip
from .manifest import indexed, recorded_seconds

#: Columns of the speaker table and what they are called here (fixed values).
ATTRIBUTES = {
    "cdnr": "volume",
    "filenr": "speaker_number",
    "diaclass": "dialect_class",
    "diareg": "dialect_region",
    "age": "age",
    "sex": "sex",
    "height": "height_cm",
    "weight": "weight_kg",
    "born": "birth_location",
    "time": "longest_residence_location",
    "parents": "parents_dialect_relation",
    "mother": "mother_origin",
    "father": "father_origin",
    "school": "education_level",
    "profession": "profession",
    "diaself": "dialect_self",
}


def located(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, speaker, stem, name) of the files below the speakers' folders, which have all-digit names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    out = files.select("path", F.element_at(parts, -2).alias("speaker"), F.element_at(parts, -1).alias("name"))
    return out.where(F.col("speaker").rlike("^[0-9]+$")).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))


def segments(spark: SparkSession, root: str, channel: str = "c") -> DataFrame:
    """Recordings of a channel: the .wav files, and .nis files of the speakers that have no .wav."""
    wav, nis = (located(spark, root, f"sp1{channel}*.{kind}") for kind in ("wav", "nis"))
    return with_fallback(wav, nis, "speaker")


def with_fallback(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose keys ``first`` doesn't have."""
    return first.unionByName(second.join(first.select(*keys).distinct(), [*keys], "left_anti"))


def tier(lines: Column, name: str) -> Column:
    """The third fields of the lines of a tier, in their order."""
    own = F.filter(F.transform(lines, lambda x: F.split(x, "\t", 3)), lambda x: (x[0] == f"{name}:") & (F.size(x) == 3))
    return F.transform(own, lambda x: x[2])


def annotations(spark: SparkSession, root: str) -> DataFrame:
    """(speaker, stem, ort, dialect, kan) of the annotation files; a tier without words is null, undecodable bytes are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.par").load(root)
    parts = F.split("path", "/")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    rows = files.select(F.element_at(parts, -2).alias("speaker"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("stem"), F.split(text, "\r?\n").alias("lines"))

    def said(tokens: Column) -> Column:
        return F.filter(tokens, lambda t: t != "")

    ort = join_orthographic(said(F.transform(tier(F.col("lines"), "ORT"), clean_orthographic_token)))
    dialect = F.array_join(said(F.transform(tier(F.col("lines"), "TR2"), clean_dialect_token)), " ")
    kan = F.array_join(said(F.transform(tier(F.col("lines"), "KAN"), clean_phonemic)), " ")
    return rows.select("speaker", "stem", *(F.nullif(c, F.lit("")).alias(n) for c, n in ((ort, "ort"), (dialect, "dialect"), (kan, "kan"))))


def transliterations(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): transliteration files without comments, from the first colon on."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\r?\n").alias("lines"))
    kept = F.filter(F.transform("lines", strip), lambda x: (x != "") & ~x.startswith(";"))
    joined = F.array_join(kept, " ")
    after = F.when(joined.contains(":"), F.regexp_replace(joined, "(?s)^[^:]*:", "")).otherwise(joined)
    return rows.select("file", F.when(F.size(kept) > 0, clean_transliteration(after)).alias("text"))


def zero_filled(number: Column, width: int = 3) -> Column:
    """A number's text filled up with zeros; longer ones stay whole."""
    return F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)


#: Where the speaker table lies below a corpus or in its archive, the first that is there, and the archive's name (fixed values).
TABLE_PLACES = ("table/sprk_att.txt", "RVG1Docu/table/sprk_att.txt")
TABLE_ARCHIVE = "CLARINDocu.zip"


@F.pandas_udf(BinaryType())
def archived_table(archives: pd.Series) -> pd.Series:
    """The speaker tables that ZIP archives hold; null where there is none or the archive can't be read."""

    def table(content: bytes | None) -> bytes | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                return next((archive.read(place) for place in TABLE_PLACES if place in archive.namelist()), None)
        except zipfile.BadZipFile:
            return None

    return archives.map(table)


def found_table(spark: SparkSession, root: str) -> DataFrame:
    """(content) of a corpus's speaker table: one row, or none where neither its places nor its archive hold one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{sprk_att.txt,{TABLE_ARCHIVE}}}").load(root)
    ways = [F.col("path").endswith(f"{root.rstrip('/').rpartition('/')[2]}/{place}") for place in (*TABLE_PLACES, TABLE_ARCHIVE)]
    choice = reduce(lambda chosen, k: chosen.when(ways[k], k), range(1, len(ways)), F.when(ways[0], 0))
    first = files.withColumn("choice", choice).where("choice is not null").orderBy("choice").limit(1)
    packed = F.col("path").endswith(TABLE_ARCHIVE)
    content = F.when(packed, archived_table(F.when(packed, F.col("content")))).otherwise(F.col("content"))
    return first.select(content.alias("content")).where("content is not null")


def resolved_root(given: str | None, variable: str, default: str) -> str:
    """A corpus's folder: as given, else from an environment variable, else the default."""
    return given or os.environ.get(variable) or default


def speakers(table: DataFrame) -> DataFrame:
    """(speaker, attributes) of a speaker table's ``content``, Latin-1 and tab-separated; of rows with one number the last is taken."""
    whole = table.select(F.decode("content", "ISO-8859-1").alias("value"))
    lines = whole.select(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    header = F.transform(F.split(F.col("lines")[0], "\t"), strip)
    rows = lines.select(header.alias("header"), F.posexplode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line", "row"))
    given = F.map_from_arrays(F.col("header"), F.transform("header", lambda _, k: clean_attribute(F.coalesce(F.get(F.split("row", "\t"), k), F.lit("")))))
    values = F.map_filter(F.create_map(*(x for old, new in ATTRIBUTES.items() for x in (F.lit(new), F.try_element_at(given, F.lit(old))))), lambda _, v: v.isNotNull())
    named = rows.select("line", zero_filled(F.try_element_at(given, F.lit("filenr"))).alias("speaker"), values.alias("attributes")).where("speaker is not null")
    return named.groupBy("speaker").agg(F.max_by("attributes", "line").alias("attributes"))


def durations(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path, duration) of recordings, by their headers, of which just the beginnings are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", recorded_seconds(F.regexp_replace("path", "^file:/+", "/")).alias("duration"))


def with_speakers(samples: DataFrame, table: DataFrame) -> DataFrame:
    """Samples with their speakers' attributes in ``metadata``, their names prefixed; a speaker that isn't in the table has none."""
    out = samples.join(table.withColumnRenamed("speaker", "speaker_id"), "speaker_id", "left")
    prefixed = F.transform_keys("attributes", lambda k, _: F.concat(F.lit("speaker_"), k))
    return out.withColumn("metadata", F.map_concat("metadata", F.coalesce(prefixed, F.create_map().cast("map<string,string>")))).drop("attributes")


#: Where the corpus is if nothing else says so, and the variable that does (fixed values).
ROOT, ROOT_VARIABLE = "data/BAS-RVG1", "BAS_RVG1_DATA_DIR"


def read_corpus(spark: SparkSession, root: str | None = None, channel: str = "c", table: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Samples of the corpus: recordings with a dialect or an orthographic text, numbered by speaker and file.

    The speakers' attributes come from ``table``, or from where a corpus has its own. Without a ``root`` it is
    where the environment says, or ROOT.
    """
    root = resolved_root(root, ROOT_VARIABLE, ROOT)
    rows = segments(spark, root, channel).join(annotations(spark, root), ["speaker", "stem"], "left")
    rows = rows.where(F.coalesce("dialect", "ort").isNotNull()).withColumn("dataset", F.lit("rvg1"))
    rows = indexed(rows, "speaker", "name", offset=offset, limit=limit).join(durations(spark, root, f"sp1{channel}*.wav"), "path", "left")
    references = F.create_map(*(x for n in ("dialect", "ort", "kan") for x in (F.lit(n), F.col(n))))
    out = rows.select(
        "dataset",
        "idx",
        F.col("path").alias("audio_path"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
        F.coalesce("dialect", "ort").alias("transcript"),
        F.map_filter(references, lambda _, v: v.isNotNull() & (v != "")).alias("references"),
        F.when(F.col("ort").isNotNull(), "ort").otherwise("dialect").alias("primary_reference"),
        F.col("speaker").alias("speaker_id"),
        F.create_map(F.lit("stem"), F.col("stem")).alias("metadata"),
    )
    return with_speakers(out, speakers(spark.read.format("binaryFile").load(table) if table else found_table(spark, root)))
