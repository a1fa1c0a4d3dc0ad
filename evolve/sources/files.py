"""Script folders as a DataFrame.

Each project names a list of folders (its locations).  All folders of all
projects are read by one ``binaryFile`` scan, so listing and reading spread over
the cluster; each file is matched to its project by its parent folder.  Only
the files directly inside a folder count (sub-folders are separate locations),
and only ``*.sql`` names can match a script pattern, so the listing is
filtered by name before any content is read.  A missing folder is an error.

For fleets with very many folders, :func:`read_script_roots` takes the folders
as a DataFrame: the few roots above them are scanned once, recursively, and
files meet their projects by an equi-join on the parent folder, so no list of
folders passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _qualify(spark: SparkSession, location: str) -> str:
    """The folder's full, normalised URI: paths without a scheme lie in the
    session's default file system."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    path = path_of(location.rstrip("/") or "/")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path_of(fs.makeQualified(path).toUri().normalize()).toString()


def read_script_files(spark: SparkSession, locations: dict[str, list[str]]) -> DataFrame:
    """(project, path, file_name, content) for every ``*.sql`` file directly in
    a project's locations; ``content`` holds the file's bytes unchanged."""
    pairs = [(project, _qualify(spark, loc)) for project, locs in locations.items() for loc in locs]
    if not pairs:
        raise ValueError("no locations given")
    # Loading the folders themselves lists the files directly inside them (not
    # the files of sub-folders); a missing folder raises PATH_NOT_FOUND.
    raw = (spark.read.format("binaryFile")
           .option("pathGlobFilter", "*.sql")
           .load(sorted({loc for _, loc in pairs})))
    locs = spark.createDataFrame(pairs, "project string, location string")
    files = raw.select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("location"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        # bytes kept as they are (a string is a byte sequence, as in the
        # reference), so checksums of files that are not valid UTF-8 match too
        F.col("content").cast("string").alias("content"),
    )
    lost = F.raise_error(F.concat(F.lit("no location holds the file "), F.col("path")))
    return (files.join(locs, _norm(files["location"]) == _norm(locs["location"]), "left")
            .select(F.coalesce("project", lost.cast("string")).alias("project"), "path", "file_name", "content"))


def _norm(c):
    # "file:/a/b" and "file:///a/b" name the same folder
    return F.regexp_replace(c, r"^file:/+", "file:/")


def _folder(spark: SparkSession, c):
    """A location column as the folder part of file paths: with the session's
    default file system where it has no scheme, single slashes, no last one."""
    default = _qualify(spark, "/").rstrip("/")   # e.g. file: or hdfs://host:port
    full = F.when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), c).otherwise(F.concat(F.lit(default), c))
    return F.regexp_replace(F.regexp_replace(_norm(full), r"(?<![:/])/+", "/"), r"(?<=.)/+$", "")


def read_script_roots(spark: SparkSession, roots: list[str], locations: DataFrame) -> DataFrame:
    """(project, path, file_name, content) for every ``*.sql`` file directly in
    a location, from one recursive scan of ``roots``.

    ``locations``: (project, location), absolute folders below the roots; a
    folder may belong to several projects.  Files in no location are not read
    further than their name.  Folders can't be told from missing ones by the
    files in them: :func:`silent_locations` lists those without any file."""
    if not roots:
        raise ValueError("no roots given")
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").option("recursiveFileLookup", "true")
           .load(sorted({_qualify(spark, r) for r in roots})))
    folders = _folders(spark, locations)
    # names meet the folders first: they are short, and only listed files' contents move
    names = raw.select("path", _norm(F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).alias("_folder")) \
        .join(folders, "_folder").select("project", "path")
    return (raw.select("path", F.col("content").cast("string").alias("content"))
            .join(names, "path")
            .select("project", "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "content"))


def _folders(spark: SparkSession, locations: DataFrame) -> DataFrame:
    return locations.select("project", _folder(spark, F.col("location")).alias("_folder")).distinct()


def silent_locations(spark: SparkSession, files: DataFrame, locations: DataFrame) -> DataFrame:
    """(project, location) of the locations that gave no file: missing or empty
    folders, or folders outside the roots."""
    seen = files.select("project", _norm(F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).alias("_folder")).distinct()
    return (locations.select("project", "location", _folder(spark, F.col("location")).alias("_folder"))
            .join(seen, ["project", "_folder"], "left_anti").select("project", "location"))
