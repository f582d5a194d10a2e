"""The life cycle of documents as set operations: listing, stages, reverting, languages.

A stage is one job over all documents of a status; documents it can't handle
come out as rows of errors (id, code, message), the rest with their new status.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import schemas as S
from papyra.functions.text import strip
from papyra.operators import rules

#: stage: status it starts from, status it gives, path column it needs, path column it fills.
STAGES = {
    "convert": ("raw", "converted", "file_path", "converted_path"),
    "clean": ("converted", "cleaned", "converted_path", "cleaned_path"),
    "extract": ("cleaned", "ner", "cleaned_path", "ner_path"),
    "resolve": ("ner", "fuzzyMatching", "ner_path", None),
}
NOT_FOUND, CONFLICT, UNREADABLE, INVALID = 404, 409, 500, 422
PAGE, MOST_PAGE = 50, 200


def filtered(documents: DataFrame, file_type: str | None = None, status: str | None = None, incubator_number: int | None = None, language: str | None = None) -> DataFrame:
    """Optional equality filters: the first two don't count when empty, the others only when None."""
    wanted = [("file_type", file_type or None), ("status", status or None), ("incubator_number", incubator_number), ("language", language)]
    return reduce(lambda d, w: d.where(F.col(w[0]) == w[1]), (w for w in wanted if w[1] is not None), documents)


def page(documents: DataFrame, skip: int = 0, limit: int = PAGE) -> DataFrame:
    """Newest first, then by id."""
    if skip < 0 or not 1 <= limit <= MOST_PAGE:
        raise ValueError(f"skip is at least 0, limit from 1 to {MOST_PAGE}")
    return documents.orderBy(F.desc("uploaded_at"), "id").offset(skip).limit(limit)


def by_status(documents: DataFrame, status: str) -> DataFrame:
    return documents.where(F.col("status") == status)


def one(documents: DataFrame, id_: str) -> DataFrame:
    return documents.where(F.col("id") == id_).limit(1)


def canonical_by_name(registry: DataFrame, name: str, category: str) -> DataFrame:
    return registry.where((F.col("canonical_name") == name) & (F.col("category") == category))


def counts(documents: DataFrame) -> DataFrame:
    """status, documents: every status, zero included."""
    frame = documents.sparkSession.createDataFrame([(s,) for s in S.STATUSES], "status string")
    return frame.join(documents.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("documents"))


def language_value(value) -> Column:
    """Lower case without blanks; null unless it had 2 to 10 characters before that."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.length(c).between(2, 10), F.lower(strip(c)))


def with_languages(documents: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the languages of updates (id, language) set, and the errors of ids that aren't there."""
    u = updates.select("id", F.col("language").alias("_new"), F.lit(True).alias("_set"))
    done = documents.join(u, "id", "left").withColumn("language", F.when(F.col("_set"), language_value("_new")).otherwise(F.col("language"))).select(*documents.columns)
    missing = updates.join(documents.select("id"), "id", "left_anti").select("id", F.lit(NOT_FOUND).alias("code"), F.lit("document not found").alias("message"))
    return done, missing


def requested(documents: DataFrame, ids: DataFrame, stage: str) -> DataFrame:
    """id, code, message of requests (id) that a stage refuses; code is null where it may run."""
    start, _, needs, _ = STAGES[stage]
    found = ids.select("id").join(documents.select("id", "status", F.col(needs).alias("_path")), "id", "left")
    code = F.when(F.col("status").isNull(), NOT_FOUND).when(F.col("status") != start, CONFLICT).when(F.col("_path").isNull(), CONFLICT if stage == "resolve" else UNREADABLE)
    message = F.when(code == NOT_FOUND, "document not found").when(F.col("status") != start, F.concat(F.lit("status is "), F.col("status"))).when(code.isNotNull(), "no input file")
    return found.select("id", code.alias("code"), message.alias("message"))


def run_stage(documents: DataFrame, stage: str, contents: DataFrame, work: Callable[[DataFrame], DataFrame], where: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs a stage over all documents of its status.

    contents has id and text of the input files; work maps (id, text) to (id,
    output, error). Returns the documents with status and path moved on, the
    outputs, and the errors.
    """
    start, to, _, fills = STAGES[stage]
    mine = by_status(documents, start).select("id").join(contents, "id", "left")
    empty = mine.where("text is null or text = ''").select("id", F.lit(UNREADABLE).alias("code"), F.lit("input file missing or empty").alias("message"))
    said = work(mine.where("text != ''"))
    errors = empty.union(said.where("error is not null").select("id", F.lit(INVALID).alias("code"), "error"))
    done = said.where("error is null").select("id", "output")
    moved = documents.join(done.select("id", F.lit(True).alias("_done")), "id", "left").withColumn("status", F.when(F.col("_done"), to).otherwise(F.col("status")))
    if fills:
        path = where(F.col("id")) if where else F.concat_ws("/", F.lit(to), F.col("id"))
        moved = moved.withColumn(fills, F.when(F.col("_done"), path).otherwise(F.col(fills)))
    return moved.select(*documents.columns), done, errors


def reverted(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """What one step back does to each id: new_status, paths after it, files to delete, whether mentions go; code 409 for raw, 404 for unknown.

    Canonicals and aliases always stay.
    """
    d = ids.select("id").join(documents, "id", "left")
    s = F.col("status")
    to = F.when(s == "fuzzyMatching", "ner").when(s == "ner", "cleaned").when(s == "cleaned", "converted").when(s == "converted", "raw")
    gone = {"ner_path": s.isin("ner", "cleaned"), "cleaned_path": s == "cleaned", "converted_path": s == "converted"}
    files = F.filter(F.array(*(F.when(when, F.col(c)) for c, when in gone.items())), lambda p: p.isNotNull())
    code = F.when(s.isNull(), NOT_FOUND).when(s == "raw", CONFLICT)
    return d.select("id", s.alias("old_status"), to.alias("new_status"), *(F.when(~when, F.col(c)).alias(c) for c, when in gone.items()), F.array_join(files, " | ").alias("delete_files"), F.coalesce(s.isin("ner", "cleaned"), F.lit(False)).alias("delete_mentions"), code.cast("int").alias("code"))


def apply_revert(documents: DataFrame, mentions: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and mentions after a revert plan."""
    ok = plan.where("code is null").select("id", "new_status", *(F.col(c).alias(f"_{c}") for c in ("ner_path", "cleaned_path", "converted_path")), "delete_mentions")
    j = documents.join(ok, "id", "left")
    moved = F.col("new_status").isNotNull()
    for c in ("ner_path", "cleaned_path", "converted_path"):
        j = j.withColumn(c, F.when(moved, F.col(f"_{c}")).otherwise(F.col(c)))
    j = j.withColumn("status", F.coalesce("new_status", "status"))
    gone = ok.where("delete_mentions").select(F.col("id").alias("document_id"))
    return j.select(*documents.columns), mentions.join(gone, "document_id", "left_anti")


def removed(documents: DataFrame, mentions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and mentions without the ids, and the files and folders to delete."""
    paths = documents.join(ids.select("id"), "id", "left_semi").select("id", F.explode(F.array("file_path", "converted_path", "cleaned_path", "ner_path", "images_path")).alias("path")).where("path is not null")
    return documents.join(ids.select("id"), "id", "left_anti"), mentions.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti"), paths


def ingested(files: DataFrame, incubator_number: int, metadata: str | None = None, language: str | None = None) -> DataFrame:
    """Rows of new documents from a binaryFile scan (path, length, modificationTime); metadata that is no JSON object or a file without a name raises RuleError."""
    if not 1 <= incubator_number <= 8:
        raise ValueError("incubator_number is 1 to 8")
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    rows = files.select(F.sha2("path", 256).alias("id"), name.alias("original_filename"), F.col("path").alias("file_path"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("file_type"), F.col("length").cast("long").alias("file_size_bytes"), F.lit("raw").alias("status"), F.lit(incubator_number).cast("short").alias("incubator_number"), language_value(F.lit(language).cast("string")).alias("language"), F.col("modificationTime").cast("timestamp_ntz").alias("uploaded_at"), F.lit(metadata).cast("string").alias("metadata"))
    rules.enforce(rules.metadata_rules(rows))
    return rows.select("*", *(F.lit(None).cast("string").alias(c) for c in ("converted_path", "cleaned_path", "ner_path", "images_path")))
