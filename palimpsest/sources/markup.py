"""ALTO pages and METS metadata from XML strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ALTO_SCHEMA = (
    "struct<Layout: struct<Page: array<struct<_ID: string, _WIDTH: string, _HEIGHT: string, PrintSpace: struct<TextBlock: array<struct<TextLine: array<struct<"
    "String: array<struct<_CONTENT: string, _WC: string, _CC: string>>>>>>>>>>>"
)
OPTIONS = {"attributePrefix": "_", "mode": "PERMISSIVE", "ignoreNamespace": "true"}


def alto(xml: Column) -> Column:
    """array<struct<page_id, width, height, words: array<struct<content, wc, cc>>>>; malformed XML gives no pages."""
    from pyspark.sql.types import _parse_datatype_string

    doc = F.from_xml(xml, _parse_datatype_string(ALTO_SCHEMA), OPTIONS)
    pages = F.coalesce(doc["Layout"]["Page"], F.expr(f"cast(array() as {_page_type()})"))

    def words(p: Column) -> Column:
        lines = F.flatten(F.transform(F.coalesce(p["PrintSpace"]["TextBlock"], F.array()), lambda b: F.coalesce(b["TextLine"], F.array())))
        strings = F.flatten(F.transform(lines, lambda x: F.coalesce(x["String"], F.array())))
        return F.transform(strings, lambda s: F.struct(F.coalesce(s["_CONTENT"], F.lit("")).alias("content"), s["_WC"].try_cast("double").alias("wc"), s["_CC"].alias("cc")))

    return F.transform(pages, lambda p: F.struct(p["_ID"].alias("page_id"), p["_WIDTH"].try_cast("int").alias("width"), p["_HEIGHT"].try_cast("int").alias("height"), words(p).alias("words")))


def _page_type() -> str:
    inner = ALTO_SCHEMA.removeprefix("struct<Layout: struct<Page: ")
    return inner[: -2]


def read_alto(files: DataFrame) -> DataFrame:
    """doc_id, pages, text, confidences of files (doc_id, name, xml): pages in the order of names."""
    parsed = files.select("doc_id", "name", alto(F.col("xml")).alias("p"))
    grouped = parsed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "p"))).alias("f"))
    pages = grouped.select("doc_id", F.flatten("f.p").alias("pages"))
    return pages.withColumn("text", T.alto_text(F.transform("pages", lambda p: p["words"]["content"])))


def confidences(docs: DataFrame, *by: str) -> DataFrame:
    """Number of words, mean and median recorded confidence and tier over all words, of docs (doc_id, pages)."""
    words = docs.select("doc_id", F.posexplode("pages").alias("page", "p")).select("doc_id", "page", F.explode("p.words").alias("w"))
    keys = by or ("doc_id",)
    out = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("word_count"), F.avg("w.wc").alias("mean_wc"), F.median("w.wc").alias("median_wc"))
    return out.withColumn("tier", T.tier(F.col("mean_wc"), T.ALTO_TIERS))


def _first(xml: Column, *paths: str) -> Column:
    """The first non-empty text of the paths, by local names."""
    return F.coalesce(*(F.nullif(T.strip(F.xpath_string(xml, F.lit(p))), F.lit("")) for p in paths))


def _path(*names: str, tail: str = "") -> str:
    return "".join(f"//*[local-name()='{n}']" if i == 0 else f"/*[local-name()='{n}']" for i, n in enumerate(names)) + tail


def mets(xml: Column) -> Column:
    """title, author, date, year, publisher, place, language, identifier, extent, subjects, alto/image/text files and page_count of a METS document with MODS metadata."""
    date = _first(xml, _path("originInfo", "dateIssued"), _path("originInfo", "dateCreated"), _path("date"))
    texts = lambda p: F.filter(F.transform(F.xpath(xml, F.lit(p + "/text()")), T.strip), lambda x: x != "")
    hrefs = F.xpath(xml, F.lit("//*[local-name()='FLocat']/@*[local-name()='href']"))
    uses = F.xpath(xml, F.lit("//*[local-name()='FLocat'][@*[local-name()='href']]/ancestor::*[local-name()='fileGrp'][1]/@USE"))
    # USE can be missing on a group; with as many as hrefs they pair up, else names decide alone
    one_each = F.size(uses) == F.size(hrefs)
    kinds = F.transform(hrefs, lambda h, i: F.struct(h.alias("href"), T.href_class(F.when(one_each, F.get(uses, i)), h).alias("kind")))
    of = lambda kind: F.transform(F.filter(kinds, lambda x: x["kind"] == kind), lambda x: x["href"])
    divs = F.size(F.xpath(xml, F.lit("//*[local-name()='div'][@TYPE='page' or @TYPE='Page']/@TYPE")))
    return F.struct(
        _first(xml, _path("titleInfo", "title"), _path("title")).alias("title"), _first(xml, _path("name", "namePart"), _path("creator")).alias("author"),
        date.alias("date"), T.year_text(F.coalesce(date, F.lit(""))).alias("year"), _first(xml, _path("originInfo", "publisher"), _path("publisher")).alias("publisher"),
        _first(xml, _path("originInfo", "place", "placeTerm")).alias("place"), _first(xml, _path("language", "languageTerm"), _path("language")).alias("language"),
        _first(xml, _path("identifier")).alias("identifier"), _first(xml, _path("physicalDescription", "extent")).alias("extent"), texts(_path("subject", "topic")).alias("subjects"),
        of("alto").alias("alto_files"), of("image").alias("image_files"), of("text").alias("text_files"),
        F.when(divs > 0, divs).otherwise(F.size(of("alto"))).alias("page_count"),
    )
