"""Station files in, tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swelter.functions import columns as C
from swelter.sources import archives, shared

#: The fields of an hourly file, by position.
FIELDS = [
    "date", "hour_utc", "precip_mm", "pressure_mbar", "pressure_max_mbar", "pressure_min_mbar", "radiation_kj", "temp_drybulb_c", "dewpoint_c", "tmax_c", "tmin_c",
    "dewpoint_max_c", "dewpoint_min_c", "rh_max_pct", "rh_min_pct", "rh_pct", "wind_dir_deg", "wind_gust_ms", "wind_speed_ms",
]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path and name of every file under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def select_station_files(names: DataFrame, stations: DataFrame, name: str = "name") -> DataFrame:
    """One file per station and year: names that contain the station's code; a full-year name (_A_31-12-<year>.CSV) first,
    then by name, then by archive if there is such a column, so that a file that lies in several archives counts once.
    stations: station, code. names: name, year."""
    n = F.col(name)
    # every part of a name that is as long as some code joins codes by equality; codes longer than every name can't be in one
    longest = names.agg(F.max(F.length(n))).first()[0] or 0
    lengths = [r[0] for r in stations.select(F.length("code").alias("k")).where(f"k BETWEEN 1 AND {longest}").distinct().orderBy("k").collect()]
    sizes = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    parts = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(n) - k + 1)), lambda i: F.substring(n, i, k))))
    runs = names.withColumn("__run", F.explode(F.array_distinct(parts)))
    both = runs.join(stations, F.col("__run") == F.col("code")).drop("__run")
    full = F.upper(n).endswith(F.concat(F.lit("_A_31-12-"), F.col("year").cast("string"), F.lit(".CSV")))
    best = Window.partitionBy("station", "year").orderBy(F.when(full, 0).otherwise(1), n, *(["archive"] if "archive" in names.columns else []))
    return both.withColumn("is_full_year", full).withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


#: Years that may be expected: they go along in the plan.
MOST_YEARS = 10_000


def check_station_years(found: DataFrame, stations: DataFrame, years: DataFrame) -> DataFrame:
    """station and year of every expected file that is missing. More than MOST_YEARS years are an error."""
    wanted = [r[0] for r in years.select("year").distinct().head(MOST_YEARS + 1)]
    if len(wanted) > MOST_YEARS:
        raise ValueError(f"more than {MOST_YEARS} years are expected")
    expected = stations.select("station", F.explode(F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<int>")).alias("year"))
    return expected.join(found.select("station", "year").distinct(), ["station", "year"], "left_anti")


def read_archives(spark: SparkSession, path: str, member: str = "") -> DataFrame:
    """Lines of the members of zip archives whose names contain `member`: archive, name, line_no, line. What is damaged gives no line."""
    held = archives.pieces(spark, path)
    listed = archives.contents(spark, path, held)
    lines = archives.member_lines(spark, path, listed.where(F.col("name").contains(member)), held)
    return lines.where("damage IS NULL").drop("damage")


def split_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """The text fields of an hourly file's lines, by position; further fields are left out."""
    parts = F.split(F.col(line), ";")
    return lines.withColumns({c: F.trim(F.get(parts, F.lit(k))) for k, c in enumerate(FIELDS)}).drop(line)


def chosen_members(listed: DataFrame, stations_: DataFrame) -> DataFrame:
    """Rows of archives.contents for the best member of each station and year (see select_station_files), with city, the station.
    Year and code are taken from the member's name."""
    named = listed.where("damage IS NULL").withColumn("year", F.regexp_extract("name", r"-(\d{4})\.[^.]*$", 1).try_cast("int"))
    return select_station_files(named, stations_).withColumnRenamed("station", "city")


def archive_lines(spark: SparkSession, path: str, stations_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of the chosen members with their city, damage of archives and chosen members)."""
    held = archives.pieces(spark, path)
    listed = archives.contents(spark, path, held)
    chosen = shared.written(chosen_members(listed, stations_), "chosen-members")
    lines = archives.member_lines(spark, path, chosen, held)
    members = chosen.select("archive", "name", "city")
    with_city = lines.join(shared.small(members), ["archive", "name"])
    return with_city.where("damage IS NULL").drop("damage"), archives.damage(listed, lines)


def archive_readings(spark: SparkSession, path: str, stations_: DataFrame) -> DataFrame:
    """Typed readings out of zip archives: of each station and year the best member, its lines split and parsed. city is the station.
    Damaged archives and members give no reading; archive_lines reports them."""
    return parse_hourly(split_fields(archive_lines(spark, path, stations_)[0]))


def skipped_files(spark: SparkSession, path: str, readings: DataFrame, file_path: str) -> DataFrame:
    """name and path of the files that gave no reading: broken ones that were passed over, and empty ones. file_path: the
    readings' column with their file's whole path."""
    return list_files(spark, path).join(readings.select(F.col(file_path).alias("path")).distinct(), "path", "left_anti").select("name", "path")


def parse_hourly(raw: DataFrame) -> DataFrame:
    """Typed readings from text fields: rows whose first field is a date; the hour stays text."""
    rows = raw.where(F.col("date").rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$")).withColumns({c: F.trim(F.col(c)) for c in FIELDS[2:]})
    typed = {c: C.parse_comma_numeric(F.col(c)) for c in FIELDS[2:]}
    return rows.withColumns({"date": C.parse_station_date(F.col("date"))} | typed).where(F.col("date").isNotNull())


def read_hourly(spark: SparkSession, path: str, city=None, ignore_corrupt: bool = False) -> DataFrame:
    """Hourly station files under a path or glob: text fields by position, Latin-1, a header of any length. city: a column
    made from file_name, by default the file's name. A broken file fails the job unless ignore_corrupt is set."""
    schema = ", ".join(f"{c} string" for c in FIELDS)
    reader = spark.read.schema(schema).option("sep", ";").option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    raw = reader.option("ignoreCorruptFiles", ignore_corrupt).csv(path).withColumn("file_name", F.col("_metadata.file_name"))
    return parse_hourly(raw).withColumn("city", city if city is not None else F.col("file_name"))


def write_table(df: DataFrame, path: str, by: str | None = "city", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet") -> DataFrame:
    """A table written before; CSV needs its schema (TRUE and FALSE read as booleans)."""
    if kind == "csv":
        if not schema:
            raise ValueError("a CSV table needs its schema")
        return spark.read.schema(schema).option("header", True).csv(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_csv_table(df: DataFrame, path: str, small: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header; small tables go to one file."""
    (df.coalesce(1) if small else df).write.mode(mode).option("header", True).csv(path)
