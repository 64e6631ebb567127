"""PAGE documents: nested tables of regions, lines and words from XML, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.operators.page import update_texts

_TEXT = "TextEquiv: array<struct<_conf: double, Unicode: string>>"
_WORD = f"struct<_id: string, _language: string, Coords: struct<_points: string>, {_TEXT}, TextStyle: struct<_fontFamily: string, _fontSize: double>>"
_LINE = f"struct<_id: string, Coords: struct<_points: string>, Word: array<{_WORD}>, {_TEXT}>"
_REGION = f"struct<_id: string, Coords: struct<_points: string>, TextLine: array<{_LINE}>, {_TEXT}>"
_ORDER = "struct<OrderedGroup: struct<RegionRefIndexed: array<struct<_index: int, _regionRef: string>>>>"
PAGE = f"`_pcGtsId` string, Page struct<_imageFilename: string, ReadingOrder: {_ORDER}, TextRegion: array<{_REGION}>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id (its file's path), _pcGtsId, Page: a row per document."""
    rows = spark.read.format("xml").option("rowTag", "PcGts").option("ignoreNamespace", "true").schema(PAGE).load(path)
    return rows.select(F.col("_metadata.file_path").alias("page_id"), "_pcGtsId", "Page")


def reading_order(page: Column) -> Column:
    """Text regions in the document's reading order, those it does not name after the others as they stand."""
    refs = F.coalesce(page["ReadingOrder"]["OrderedGroup"]["RegionRefIndexed"], F.array().cast("array<struct<_index:int,_regionRef:string>>"))
    last = F.lit(2**31 - 1)
    place = lambda r: F.coalesce(F.array_min(F.transform(F.filter(refs, lambda x: x["_regionRef"] == r["_id"]), lambda x: x["_index"])), last)
    ranked = F.transform(page["TextRegion"], lambda r, i: F.struct(place(r).alias("place"), i.alias("i"), r.alias("r")))
    return F.transform(F.sort_array(ranked), lambda x: x["r"])


def text_lines(pages: DataFrame) -> DataFrame:
    """page_id, line_no, line_id, words: all text lines of each page in reading order, numbered from 0."""
    lines = F.flatten(F.transform(F.filter(reading_order(F.col("Page")), lambda r: r["TextLine"].isNotNull()), lambda r: r["TextLine"]))
    rows = pages.select("page_id", F.posexplode(lines).alias("line_no", "line"))
    return rows.select("page_id", "line_no", F.col("line._id").alias("line_id"), F.col("line.Word").alias("words"))


def empty_parts(pages: DataFrame) -> DataFrame:
    """page_id, problem: pages without text regions, regions without lines, lines without words, words without text."""
    none = lambda c: c.isNull() | (F.size(c) == 0)
    regions = pages.select("page_id", F.explode_outer("Page.TextRegion").alias("r"))
    lines = regions.where(~none(F.col("r.TextLine"))).select("page_id", F.explode("r.TextLine").alias("l"))
    words = lines.where(~none(F.col("l.Word"))).select("page_id", F.explode("l.Word").alias("w"))
    found = [
        regions.where("r is null").select("page_id", F.lit("page without text regions").alias("problem")),
        regions.where(F.col("r").isNotNull() & none(F.col("r.TextLine"))).select("page_id", F.concat(F.lit("region without lines: "), "r._id")),
        lines.where(none(F.col("l.Word"))).select("page_id", F.concat(F.lit("line without words: "), "l._id")),
        words.where(none(F.col("w.TextEquiv")) | (F.coalesce(F.get("w.TextEquiv", F.lit(0))["Unicode"], F.lit("")) == "")).select("page_id", F.concat(F.lit("word without text: "), "w._id")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def with_words(pages: DataFrame, words: DataFrame) -> DataFrame:
    """pages whose lines have the words of words (line_id, word (a struct as in a line), place), and texts made from these."""
    own = words.groupBy("page_id", "line_id").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    own = own.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("line_id", F.transform("w", lambda x: x["word"]).alias("w")))).alias("new"))
    rows = pages.join(own, "page_id", "left")
    line = lambda x: x.withField("Word", F.coalesce(F.try_element_at("new", x["_id"]), F.expr("cast(null as array<" + _WORD + ">)")))
    regions = F.transform("Page.TextRegion", lambda r: r.withField("TextLine", F.transform(r["TextLine"], line)))
    page = F.col("Page").withField("TextRegion", update_texts(regions))
    return rows.select("page_id", "_pcGtsId", page.alias("Page"))


def write_pages(pages: DataFrame, path: str) -> None:
    """XML files of PcGts elements."""
    pages.select("_pcGtsId", "Page").write.format("xml").option("rowTag", "PcGts").option("rootTag", "Pages").save(path)
