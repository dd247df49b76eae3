"""Readers and writers of the file formats: JSON lines, JSON arrays, tab-separated judgments, text trees. Schemas are stated, not inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CORPUS = (
    "doc_id string, title string, author string, date string, date_numeric int, collection string, language string, subject array<string>, text string, "
    "ocr_quality double, ocr_quality_tier string, word_count int, page_count int, char_count int, source_files int, source_dir string"
)
QUERIES = "_id string, text string, metadata struct<type: string, difficulty: string, status: string>"
QRELS = "`query-id` string, `corpus-id` string, score string"
ITEM = "doc_id string, ocr_quality double, ocr_quality_tier string, difficulty string, status string, verified_by array<string>, decisions map<string,string>, reviewer_notes array<string>"
QUERY_META = f"query_id string, query string, query_type string, expected_answer string, {ITEM}"
RAG = f"question_id string, question string, answer string, evidence string, answer_type string, notes string, {ITEM}"
REQUIRED = ("doc_id", "text", "ocr_quality", "ocr_quality_tier", "word_count")


def read_jsonl(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_jsonl_checked(spark: SparkSession, path: str, schema: str = CORPUS) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines)."""
    text = spark.read.text(path).where(T.not_blank(F.col("value")))
    rows = text.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select("r.*").drop("_corrupt"), rows.where(bad).select("value")


def validated(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED, schema: str = CORPUS) -> DataFrame:
    """One row: records, empty_text, incomplete (a required field is missing), malformed lines, and whether all is well. Lines are read once."""
    text = spark.read.text(path).where(T.not_blank(F.col("value")))
    rows = text.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = F.col("r._corrupt").isNull()
    gone = F.lit(False)
    for c in required:
        gone = gone | F.col(f"r.{c}").isNull()
    out = rows.agg(F.count_if(good).alias("records"), F.count_if(good & ~T.not_blank(F.col("r.text"))).alias("empty_text"), F.count_if(good & gone).alias("incomplete"), F.count_if(~good).alias("malformed"))
    return out.withColumn("valid", (F.col("empty_text") == 0) & (F.col("incomplete") == 0) & (F.col("malformed") == 0))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, QUERIES).select(F.col("_id").alias("qid"), "text", "metadata")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, rel; lines with fewer than three columns or without a whole number go."""
    rows = spark.read.schema(QRELS).option("sep", "\t").option("header", True).csv(path)
    rel = F.col("score").try_cast("int")
    return rows.where(rel.isNotNull()).select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("doc_id"), rel.alias("rel"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of a file that is one JSON array; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Documents below root/collection/date/title/id: doc_id, collection, date, date_numeric, title, text, source_files.

    id/id.txt alone where it is there, else all of the folder's *.txt by name, joined with an empty line between. Hidden folders and files are
    skipped. Bytes that aren't UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    parts = F.split(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    rows = files.select(at(-1).alias("name"), at(-2).alias("doc_id"), at(-3).alias("folder"), at(-4).alias("date_folder"), at(-5).alias("collection"), decoded(F.col("content")).alias("text"))
    visible = ~F.concat_ws("/", "collection", "date_folder", "folder", "doc_id", "name").rlike(r"(^|/)\.")
    keys = ["collection", "date_folder", "folder", "doc_id"]
    grouped = rows.where(visible).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("f"))  # the files of one document
    own = F.filter("f", lambda x: x["name"] == F.concat("doc_id", F.lit(".txt")))
    used = F.when(F.size(own) > 0, own).otherwise(F.col("f"))
    date, year = T.year_folder(F.col("date_folder"))
    return grouped.withColumn("used", used).select(
        "doc_id", "collection", date.alias("date"), year.alias("date_numeric"), T.clean_title(F.col("folder")).alias("title"),
        T.text_norm(T.join_parts(F.col("used.text"))).alias("text"), F.size("used").alias("source_files"),
    )


def decoded(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def corpus(rows: DataFrame, least_words: int = 10) -> DataFrame:
    """Corpus records of documents (doc_id, collection, date, date_numeric, title, text, source_files, pdf_bytes): short ones go before any quality is computed."""
    words = T.word_count(F.col("text"))
    kept = rows.withColumn("word_count", words).where(F.col("word_count") >= least_words)
    quality = T.ocr_quality(F.col("text"))
    pages = T.page_estimate(F.col("pdf_bytes")) if "pdf_bytes" in rows.columns else F.lit(None).cast("int")
    out = kept.withColumn("ocr_quality", quality).withColumn("ocr_quality_tier", T.tier(F.col("ocr_quality")))
    return out.withColumns({"author": F.lit(""), "language": F.lit(""), "subject": F.array().cast("array<string>"), "page_count": pages, "char_count": F.length("text")})


def file_kind(path: Column, head: Column) -> Column:
    """alto, mets, text, image or other by name, and for unclear XML by the first 500 bytes."""
    name, h = F.lower(F.element_at(F.split(path, "/"), -1)), F.lower(F.substring(head, 1, 500))
    xml = F.when(name.contains("alto") | name.startswith("0"), "alto").when(name.contains("mets"), "mets").when(h.contains("alto"), "alto").when(h.contains("mets"), "mets").otherwise("other")
    return F.when(name.endswith(".xml"), xml).when(name.endswith(".txt"), "text").when(name.rlike(r"\.(jpg|jpeg|png|tif|tiff)$"), "image").otherwise("other")


def scan(files: DataFrame) -> DataFrame:
    """kind, files, size_mb of files (path, length, head)."""
    return files.groupBy(file_kind(F.col("path"), F.col("head")).alias("kind")).agg(F.count(F.lit(1)).alias("files"), (F.sum("length") / (1024 * 1024)).alias("size_mb"))


def scan_path(spark: SparkSession, root: str) -> DataFrame:
    """scan of every file below root. Only XML files are opened."""
    all_files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    xml = F.lower("path").endswith(".xml")
    names = all_files.where(~xml).select("path", "length", F.lit("").alias("head"))  # content isn't read where it isn't selected
    heads = all_files.where(xml).select("path", "length", decoded(F.substring("content", 1, 500)).alias("head"))
    return scan(names.unionByName(heads))


def find_mets(files: DataFrame) -> DataFrame:
    """dir, path of each folder's METS file among files (path, head): by name first, else by the first 1000 characters."""
    name, dir_ = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    h = F.substring("head", 1, 1000)
    order = F.when(name.rlike("(METS|mets).*\\.xml$"), 0).when(name.endswith(".xml") & (h.contains("METS") | h.contains("mets")), 1)
    return files.select(dir_.alias("dir"), "path", order.alias("o")).where("o is not null").groupBy("dir").agg(F.min(F.struct("o", "path")).alias("m")).select("dir", "m.path")


def by_first_folder(paths: DataFrame) -> DataFrame:
    """collection, files of a listing (path) of archives."""
    return paths.where(F.lower("path").endswith(".rar")).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("collection")).agg(F.count(F.lit(1)).alias("files"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def write_beir(queries: DataFrame, qrels: DataFrame, path: str) -> None:
    """queries (JSON lines), qrels (tab-separated, with header) below path."""
    write_jsonl(queries, f"{path}/queries")
    qrels.select(F.col("qid").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("rel").alias("score")).write.option("sep", "\t").option("header", True).csv(f"{path}/qrels")


def write_export(items: DataFrame, path: str, id_column: str = "query_id") -> None:
    """The items that both reviewers accept, and their judgments."""
    both = items.where("class = 'both_accept'")
    write_jsonl(both.drop("d1", "d2", "class"), f"{path}/verified")
    both.select(F.col(id_column).alias("query-id"), F.col("doc_id").alias("corpus-id"), F.lit(1).alias("score")).write.option("sep", "\t").option("header", True).csv(f"{path}/qrels_verified")


def latex_table(rows: list, columns: list[str], digits: int = 3) -> str:
    """Rows of a small result as a LaTeX tabular."""
    show = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = [" & ".join(show(r[c]) for c in columns) + r" \\" for r in rows]
    head = " & ".join(c.replace("_", r"\_") for c in columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
