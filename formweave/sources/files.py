"""File sources and sinks, schema gates, bundles.

Everything is written by the executors as part files; nothing is gathered in
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave import schemas
from formweave.operators.tracker import CSV_HEADER, csv_line, documents_by_role, newest_first

BUNDLE_FORMAT, DIAGNOSTICS_FORMAT, FORMAT_VERSION = "formweave-bundle", "formweave-diagnostics", 1
NOTE = "Holds the form's outline; nothing a person typed or saved is in here."
MIME_BY_ENDING = {"txt": "text/plain", "pdf": "application/pdf",
                  "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def _folder_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_pages(spark: SparkSession, folder: str, file_name: str = "page.html") -> DataFrame:
    """page_id (the page's directory) and html of <folder>/*/page.html."""
    pages = spark.read.text(f"{folder}/*/{file_name}", wholetext=True)
    return pages.select(_folder_name(F.col("_metadata.file_path")).alias("page_id"), F.col("value").alias("html"))


def read_golden(spark: SparkSession, folder: str, file_name: str = "golden.json") -> DataFrame:
    """page_id, url, fields, expect_no_fill of <folder>/*/golden.json."""
    golden = spark.read.schema(schemas.GOLDEN).option("multiLine", True).json(f"{folder}/*/{file_name}")
    return golden.select(
        _folder_name(F.col("_metadata.file_path")).alias("page_id"), "url", "fields",
        F.coalesce(F.col("expectNoFill"), F.array().cast("array<string>")).alias("expect_no_fill"),
    )


def read_cv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file_name, mime and text of every file of a folder."""
    files = spark.read.text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    mime = F
    for end, kind in MIME_BY_ENDING.items():
        mime = mime.when(ending == end, F.lit(kind))
    return files.select(
        F.col("_metadata.file_path").alias("doc_id"), name.alias("file_name"), mime.otherwise("").alias("mime"),
        F.col("value").alias("text"),
    )


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """A declared table; filters on its columns reach the scan."""
    return spark.read.schema(schema).format(format).load(path)


def validated(
    lines: DataFrame, schema: str, required: list[str], enums: dict[str, list[str]] | None = None,
    defaults: dict[str, object] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) from JSON lines (column `value`): reject by default.

    A line is rejected when it does not parse, lacks a required member or has
    a value outside its enumeration; absent members take their defaults.
    """
    parsed = lines.select(
        "value",
        F.from_json("value", f"{schema.strip()}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
    )
    present = [F.col(f"r.{c}").isNotNull() for c in required]
    member = [F.col(f"r.{c}").isNull() | F.col(f"r.{c}").isin(v) for c, v in (enums or {}).items()]
    ok = F.col("r._corrupt").isNull() & F.col("r").isNotNull()
    for test in present + member:
        ok = ok & test
    ok = F.coalesce(ok, F.lit(False))
    good = parsed.filter(ok).select("r.*").drop("_corrupt")
    for name, value in (defaults or {}).items():
        good = good.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return good, parsed.filter(~ok).select("value")


def write_history_csv(apps: DataFrame, path: str) -> None:
    """Newest first; the unquoted header is the first line of the first part file."""
    spark = apps.sparkSession
    lines = apps.select(
        F.lit(1).alias("part"), F.col("first_seen_us").alias("at"), "id", csv_line().alias("value")
    )
    header = spark.range(1).select(
        F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("").alias("id"), F.lit(CSV_HEADER).alias("value")
    )
    ordered = header.unionByName(lines).orderBy("part", F.col("at").desc(), "id")
    ordered.select("value").write.mode("overwrite").text(path)


def write_history_json(shown: DataFrame, path: str) -> None:
    """The applications in view, as JSON lines, newest first."""
    newest_first(shown).write.mode("overwrite").json(path)


def diagnostics(log: DataFrame, exported_at: str) -> DataFrame:
    """One report per candidate; log is the trimmed fill log, so a report is bounded."""
    members = [c for c in log.columns if c != "cand"]
    entries = F.transform(
        F.reverse(F.array_sort(F.collect_list(F.struct("at_us", "id", F.struct(*members).alias("e"))))), lambda x: x["e"]
    )
    report = F.struct(
        F.lit(DIAGNOSTICS_FORMAT).alias("format"), F.lit(FORMAT_VERSION).alias("version"),
        F.lit(exported_at).alias("exportedAt"), F.lit(NOTE).alias("note"), F.col("entries"),
    )
    return log.groupBy("cand").agg(entries.alias("entries")).select("cand", F.to_json(report).alias("report"))


def export_bundle(
    profiles: DataFrame, answers: DataFrame, documents: DataFrame, settings: DataFrame, exported_us: int
) -> DataFrame:
    """cand, section, value: one JSON line per record, so that no candidate must fit in one row."""
    line = lambda df, section: df.select(
        "cand", F.lit(section).alias("section"),
        F.to_json(F.struct(*[c for c in df.columns if c != "cand"]), {"ignoreNullFields": "false"}).alias("value"),
    )
    header = profiles.select(
        "cand", F.lit(BUNDLE_FORMAT).alias("format"), F.lit(FORMAT_VERSION).alias("version"),
        F.lit(exported_us).alias("exported_us"),
    )
    return (
        line(header, "header").unionByName(line(profiles, "profile")).unionByName(line(answers, "answer"))
        .unionByName(line(documents, "document")).unionByName(line(settings, "settings"))
    )


def import_bundle(bundle: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(profiles, answers, documents, rejected) of a bundle.

    Candidates without a header of this format and version are rejected
    whole.  Settings are exported but not imported; one document per role.
    """
    header = F.from_json("value", "format string, version int")
    known = (
        bundle.filter("section = 'header'").withColumn("h", header)
        .filter((F.col("h.format") == BUNDLE_FORMAT) & (F.col("h.version") == FORMAT_VERSION)).select("cand").distinct()
    )
    accepted = bundle.join(known, "cand", "left_semi")

    def part(section: str, schema: str, key: str) -> DataFrame:
        rows = accepted.filter(F.col("section") == section)
        return (
            rows.select("cand", F.from_json("value", schema.strip().replace("cand string, ", "", 1)).alias("r"))
            .select("cand", "r.*").filter(F.col(key).isNotNull())
        )

    profiles = part("profile", schemas.PROFILES, "version").filter("version = 1")
    return (
        profiles, part("answer", schemas.ANSWERS, "id"), documents_by_role(part("document", schemas.DOCUMENTS, "id")),
        bundle.join(known, "cand", "left_anti"),
    )


def upsert_by_id(current: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("cand", "id")) -> DataFrame:
    """Rows of `incoming` replace those of `current` with the same key."""
    return current.join(incoming, list(keys), "left_anti").unionByName(incoming)
