"""Readers of question sets, predictions, catalogs, PDFs and parsed documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X

#: Names under which a prediction row may hold its id and its answer, in
#: order.
ID_FIELDS = ("question_id", "global_qa_id", "global_id", "id")
ANSWER_FIELDS = ("prediction", "model_answer", "answer", "response", "output")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lenient: blank lines are skipped, a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw) of text files, lines from 1; files are read in splits.

    A split's lines are numbered where they are read; a row a split says how many lines
    stand before it.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(splits, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "raw")


def jsonl_strict(spark: SparkSession, path: str) -> DataFrame:
    """(line, value variant) in order: a line that is no JSON object raises with its place."""
    rows = numbered_lines(spark, path).where(~X.is_blank(F.col("raw")))
    value = F.try_parse_json(F.trim("raw"))
    where = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    shape = F.schema_of_variant(value)
    checked = F.when(value.isNull(), F.raise_error(F.concat(F.lit("not JSON: "), where))).when(~shape.startswith("OBJECT"), F.raise_error(F.concat(F.lit("no object: "), where))).otherwise(value)
    return rows.orderBy("file", "line").select("line", checked.alias("value"))


def json_or_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, value variant) by suffix: one value, or one a line."""
    if path.endswith(".jsonl"):
        return jsonl_strict(spark, path)
    return spark.read.text(path, wholetext=True).select(F.lit(1).cast("long").alias("line"), F.parse_json("value").alias("value"))


def _first(value: Column, names: tuple[str, ...]) -> Column:
    """The first key that is there; a null under it ends the search with ''."""
    keys = F.json_object_keys(F.to_json(value))
    out = F.lit("")
    for name in reversed(names):
        found = X.string_value(F.try_variant_get(value, f"$.{name}", "variant"))
        if name == "answer":
            inner = F.try_variant_get(value, "$.answer", "variant")
            is_object = F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False))
            found = F.when(is_object, X.string_value(F.try_variant_get(value, "$.answer.value", "variant"))).otherwise(found)
        out = F.when(F.array_contains(keys, name), F.coalesce(found, F.lit(""))).otherwise(out)
    return out


def predictions(spark: SparkSession, path: str, field: str = "") -> DataFrame:
    """(question_id, prediction, status) of three shapes; the last of an id wins.

    A list of rows or lines; an object with ``items``; an object by id. A row
    without an id raises.
    """
    raw = json_or_jsonl(spark, path)
    shape = F.schema_of_variant("value")
    items = F.try_variant_get("value", "$.items", "map<string,variant>")
    by_id = F.coalesce(items, F.try_variant_get("value", "$", "map<string,variant>"))
    none = F.lit(None).cast("string")
    if path.endswith(".jsonl"):
        rows = raw.select("line", none.alias("k"), F.col("value").alias("v"))
    else:
        lists = raw.where(shape.startswith("ARRAY")).select(F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("line", "v")).select(F.col("line").cast("long").alias("line"), none.alias("k"), "v")
        maps = raw.where(shape.startswith("OBJECT")).select(F.posexplode(F.map_entries(by_id)).alias("line", "e")).select(F.col("line").cast("long").alias("line"), F.col("e.key").alias("k"), F.col("e.value").alias("v"))
        rows = lists.unionByName(maps)
    own = F.coalesce(*[F.nullif(X.stripped(F.try_variant_get("v", f"$.{n}", "string")), F.lit("")) for n in ID_FIELDS])
    key = F.coalesce("k", own)
    key = F.when(F.coalesce(key, F.lit("")) == "", F.raise_error(F.lit("a prediction row has no id"))).otherwise(key)
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    said = F.when(is_object, _first(F.col("v"), (field,) if field else ANSWER_FIELDS)).otherwise(X.string_value(F.col("v")))
    status = F.coalesce(F.nullif(F.try_variant_get("v", "$.status", "string"), F.lit("")), F.lit("success"))
    each = rows.select("line", key.alias("question_id"), said.alias("prediction"), status.alias("status"))
    return each.groupBy("question_id").agg(F.max_by(F.struct("prediction", "status"), "line").alias("r")).select("question_id", "r.*")


def submission_problems(spark: SparkSession, path: str) -> DataFrame:
    """(line, problem) of a strict submission: JSON lines of exactly question_id and
    prediction, ids not blank and unique, predictions text. No rows if it is valid."""
    if not path.endswith(".jsonl"):
        return spark.createDataFrame([(0, "not a .jsonl file")], "line long, problem string")
    rows = numbered_lines(spark, path).where(~X.is_blank(F.col("raw")))
    value = F.try_parse_json(F.trim("raw"))
    keys = F.array_sort(F.json_object_keys("raw"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{k}", "variant"))
    rows = rows.select("line", value.alias("v"), keys.alias("keys"))
    rows = rows.withColumn("id", X.stripped(F.try_variant_get("v", "$.question_id", "string")))
    shape = F.when(F.col("v").isNull(), "not JSON").when(F.col("keys").isNull(), "no object").when(~F.col("keys").eqNullSafe(F.array(F.lit("prediction"), F.lit("question_id"))), "keys")
    problem = shape.when(kind("question_id") != "STRING", "id is no text").when(F.col("id") == "", "id is blank").when(kind("prediction") != "STRING", "prediction is no text")
    judged = rows.select("line", "id", problem.alias("problem"))
    twice = judged.where("problem is null").groupBy("id").agg(F.max("line").alias("line"), F.count(F.lit(1)).alias("n")).where("n > 1").select("line", F.lit("id is there twice").alias("problem"))
    empty = judged.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("line"), F.lit("no rows").alias("problem"))
    return judged.where("problem is not null").select("line", "problem").unionByName(twice).unionByName(empty)


def subset(spark: SparkSession, path: str) -> DataFrame:
    """Names of a subset file: no blanks, no # lines, without a leading ``q:``."""
    rows = spark.read.text(path).select(X.stripped(F.col("value")).alias("name")).where("name <> '' and not startswith(name, '#')")
    return rows.select(F.regexp_replace("name", "^q:", "").alias("name"))


def catalog(rows: DataFrame) -> DataFrame:
    """rows (document_id, url) with problem: blank or repeated id, or a URL that is
    not http(s) with a host; null if there is none."""
    n = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"))
    scheme, host = F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))), F.try_parse_url("url", F.lit("HOST"))
    problem = F.when(X.is_blank(F.col("document_id")), "blank id").when(F.col("_n") > 1, "id is there twice").when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)) | F.coalesce(host, F.lit("")).eqNullSafe(""), "bad url")
    return rows.join(n, "document_id").select(*rows.columns, problem.alias("problem"))


def pdf_problems(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(file, problem, file_hash) of the wanted file names below path: missing or empty
    (the reader lists no empty files), without signature or without end marker."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    tail = F.decode(F.expr("substring(content, greatest(length(content) - 1023, 1), 1024)"), "ISO-8859-1")
    head = F.decode(F.expr("substring(content, 1, 5)"), "ISO-8859-1")
    problem = F.when(head != "%PDF-", "PDF signature is missing").when(~F.contains(tail, F.lit("%%EOF")), "PDF EOF marker is missing")
    found = rows.select(X.basename(F.col("path")).alias("file"), problem.alias("problem"), F.substring(F.sha2("content", 256), 1, 16).alias("file_hash"))
    out = wanted.select("file").join(found, "file", "left")
    return out.withColumn("problem", F.when(F.col("file_hash").isNull(), "PDF is missing or empty").otherwise(F.col("problem")))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of all markdown files below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """One variant a result: of a list, or of an object's ``results``."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = F.coalesce(F.try_variant_get("v", "$.results", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return raw.select(F.posexplode(rows).alias("no", "result"))


def result_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): what a results object says besides its ``results``; nothing of a list."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    return raw.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "value")).where("key <> 'results'")


def manifest(spark: SparkSession, path: str, prepared: DataFrame) -> DataFrame:
    """(place, document) of a manifest's ``documents``; one that is not among prepared
    (document) raises."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = raw.select(F.posexplode(F.try_variant_get("v", "$.documents", "array<string>")).alias("place", "document"))
    missing = [r["document"] for r in rows.join(prepared.select("document"), "document", "left_anti").orderBy("place").head(10)]
    if missing:
        raise ValueError(f"the prepared corpus is incomplete: {', '.join(missing)}")
    return rows


def downloaded(wanted: DataFrame, fetch: Callable[[str], bytes], complete: Callable[[bytes], str | None] = lambda data: None, archived: Callable[[str], str | None] | None = None, attempts: int = 3) -> DataFrame:
    """wanted (document_id, url) with content, problem and attempts.

    The seam for a network: fetch(url) gives the bytes or raises; LookupError means that
    there is no such page, and is followed by archived(url), another place to look, if
    there is one. complete(data) names what is wrong with the bytes, and they are tried
    again. A failure concerns its row only; content is null then.
    """

    def one(url: str) -> tuple[bytes | None, str | None, int]:
        problem = None
        for n in range(1, attempts + 1):
            try:
                data = fetch(url)
                problem = complete(data)
                if problem is None:
                    return data, None, n
            except LookupError as e:
                other = archived(url) if archived else None
                if other is None or other == url:
                    return None, f"not found: {e}", n
                url = other
            except Exception as e:  # any failure of a server is tried again
                problem = f"{type(e).__name__}: {e}"
        return None, problem, attempts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a file may be large
                row = batch.slice(i, 1)
                data, problem, n = one(row.column(1)[0].as_py())
                yield pa.record_batch([row.column(0), row.column(1), pa.array([data], pa.binary()), pa.array([problem], pa.string()), pa.array([n], pa.int32())], names=["document_id", "url", "content", "problem", "attempts"])

    return wanted.select("document_id", "url").mapInArrow(run, "document_id string, url string, content binary, problem string, attempts int")


def pdf_problem(data: bytes) -> str | None:
    """What is wrong with a PDF's bytes."""
    return "PDF is missing or empty" if not data else "PDF signature is missing" if data[:5] != b"%PDF-" else "PDF EOF marker is missing" if b"%%EOF" not in data[-1024:] else None


def unzipped(archives: DataFrame, folder: str) -> DataFrame:
    """(file, content) of the files below a folder of zip archives (content); names that
    lead out of the folder raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for x in z.infolist():
                        name = x.filename.removeprefix(folder.rstrip("/") + "/")
                        if x.is_dir() or name == x.filename:
                            continue
                        if ".." in name.split("/") or name.startswith("/"):
                            raise ValueError(f"unsafe name in an archive: {x.filename}")
                        yield pa.record_batch([pa.array([name]), pa.array([z.read(x)], pa.binary())], names=["file", "content"])

    return archives.select("content").mapInArrow(run, "file string, content binary")


def result_files(spark: SparkSession, path: str, name: str = "final_results.json") -> DataFrame:
    """(file, no, result) of every file of that name below a folder."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("v"))
    return raw.select("file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("no", "result"))
