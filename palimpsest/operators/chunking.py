"""Chunks of long documents, coverage, and samples by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking

SIZE, OVERLAP, MOST_WORDS = 512, 50, 8192


def fixed_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (text, start_word, end_word): windows of `size` words every size - overlap, as long as one begins before the end."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(F.array_join(F.slice(words, s + 1, size), " ").alias("text"), s.alias("start_word"), F.least(s + size, n).alias("end_word")))

    return T.once(T.tok_ws(text), cut)


def semantic_chunks(text: Column, most: int = SIZE) -> Column:
    """Array of (text, n_paragraphs): paragraphs packed in order up to `most` words; a longer one stands alone."""
    parts = F.filter(F.transform(F.split(text, r"\n[\t-\r ]*\n"), T.strip), lambda p: p != "")
    chunk = "struct<p:array<string>,w:int>"
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.array().cast("array<string>").alias("p"), F.lit(0).alias("w"))

    def step(a: Column, p: Column) -> Column:
        w = F.size(T.tok_ws(p))
        held = F.struct(a["p"].alias("p"), a["w"].alias("w"))
        flushed = F.when(F.size(a["p"]) > 0, F.array_append(a["done"], held)).otherwise(a["done"])
        alone = F.struct(F.array_append(flushed, F.struct(F.array(p).alias("p"), w.alias("w"))).alias("done"), F.array().cast("array<string>").alias("p"), F.lit(0).alias("w"))
        new = F.struct(flushed.alias("done"), F.array(p).alias("p"), w.alias("w"))
        more = F.struct(a["done"].alias("done"), F.array_append(a["p"], p).alias("p"), (a["w"] + w).alias("w"))
        return F.when(w > most, alone).when(a["w"] + w > most, new).otherwise(more)

    def finish(a: Column) -> Column:
        held = F.struct(a["p"].alias("p"), a["w"].alias("w"))
        return F.when(F.size(a["p"]) > 0, F.array_append(a["done"], held)).otherwise(a["done"])

    packed = F.aggregate(parts, start, step, finish)
    return F.transform(packed, lambda c: F.struct(F.array_join(c["p"], "\n\n").alias("text"), F.size(c["p"]).alias("n_paragraphs")))


def chunk_index(docs: DataFrame, chunks: Column) -> DataFrame:
    """doc_id, chunk_id, position and fields of every chunk of documents that aren't blank."""
    rows = docs.where(T.not_blank(F.col("text"))).select("doc_id", *[c for c in docs.columns if c not in ("doc_id", "text")], F.posexplode(chunks).alias("chunk_no", "c"))
    return rows.select("*", "c.*", F.format_string("%s_chunk_%d", F.col("doc_id").cast("string"), F.col("chunk_no")).alias("chunk_id")).drop("c")


def n_chunks(words: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    return F.ceil(words / (size - overlap)).cast("int")


def coverage(words: Column, k: int, size: int = SIZE) -> Column:
    return F.when(words > 0, F.least(F.lit(1.0), k * size / words))


def truncation(words: Column, most: int = MOST_WORDS) -> tuple[Column, Column, Column]:
    """(coverage, truncated, words lost) of a model that reads `most` words."""
    return F.when(words > 0, F.least(words, F.lit(most)) / words).otherwise(0.0), words > most, F.greatest(F.lit(0), words - most)


def split_sentences(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """How many chunk borders lie inside a sentence's first occurrence; text between full stops is a sentence.

    Words, the places of borders in the words joined by spaces, and sentences' spans are made once for a text; a border's place is the
    one before it and the lengths of the words between.
    """
    sentences = F.array_distinct(F.split(text, r"\."))
    spans = F.transform(sentences, lambda s: F.struct((F.instr(text, s) - 1).alias("a"), F.length(s).alias("n")))

    def borders(sizes: Column) -> Column:
        n = F.size(sizes)
        starts = F.when(n > size - overlap, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        # all chunks' ends but the last one's
        ends = F.transform(F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda s: F.least(s + size, n))
        start = F.struct(F.array().cast("array<long>").alias("at"), F.lit(0).alias("end"), F.lit(-1).cast("long").alias("place"))

        def step(a: Column, end: Column) -> Column:
            more = F.aggregate(F.slice(sizes, a["end"] + 1, end - a["end"]), F.lit(0).cast("long"), lambda x, y: x + y + 1)
            return T.once(a["place"] + more, lambda p: F.struct(F.array_append(a["at"], p).alias("at"), end.alias("end"), p.alias("place")))

        return F.aggregate(ends, start, step, lambda a: a["at"])

    at = T.once(F.transform(T.tok_ws(text), lambda w: F.length(w)), borders)
    # in an array of one, so that spans are made once and not for every border
    inside = lambda m: F.size(F.filter(m["at"], lambda p: F.exists(m["spans"], lambda s: (s["a"] < p) & (p < s["a"] + s["n"]))))
    return T.once(F.struct(spans.alias("spans"), at.alias("at")), inside)


def percentile_windows(docs: DataFrame, value: str, percents: list[int], n: int = 5) -> DataFrame:
    """percent, doc_id, value: n rows around each percentile's index in the order of value.

    Global ranks without one large window: counts of distinct values give each value's first rank, and only values around the
    percentiles are ranked within.
    """
    upto = ranking.before(docs.select(F.col(value).alias("v")), "v").select("v", F.col("n").alias("c"), "before")
    total = upto.agg(F.sum("c").alias("total"))
    asked = docs.sparkSession.createDataFrame([(p,) for p in percents], "percent int").join(F.broadcast(total), how="cross")
    centre = F.least(F.floor(F.col("total") * F.col("percent") / 100), F.col("total") - 1)
    asked = asked.withColumn("lo", F.greatest(F.lit(0), centre - n // 2)).withColumn("hi", F.least(F.col("total"), F.col("lo") + n))
    near = upto.join(F.broadcast(asked), (F.col("before") < F.col("hi")) & (F.col("before") + F.col("c") > F.col("lo")))
    rows = docs.select("doc_id", F.col(value).alias("v")).join(F.broadcast(near.select("v", "before").distinct()), "v")  # a few values for each percentile
    rows = rows.withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("v").orderBy("doc_id")) - 1)
    hit = rows.join(F.broadcast(asked), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    return hit.select("percent", "doc_id", F.col("v").alias(value))


def stratified_sample(docs: DataFrame, size: int, tier: str, year: str) -> DataFrame:
    """The evenly spaced rows of each tier in the order of year (missing years count as 1900): its share of `size`, one at least.

    Rows aren't ranked over a whole tier: counts of (tier, year) tell which year a wanted place falls in and how far, and only rows of
    such years are ranked, each year on its own. docs are read several times: give a written table of what is needed.
    """
    dated = docs.withColumn("y", F.coalesce(F.nullif(F.col(year), F.lit(0)), F.lit(1900)))
    counts = dated.groupBy(tier, "y").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(tier).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy(tier).agg(F.sum("c").alias("nt"))
    totals = totals.join(F.broadcast(totals.agg(F.sum("nt").alias("all"))), how="cross")  # one row; a few tiers
    n = F.least(F.greatest(F.lit(1), F.floor(F.lit(size) * F.col("nt") / F.col("all"))), F.col("nt"))
    wanted = totals.withColumn("n", n).select(tier, F.explode(F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.floor(i * F.col("nt") / F.col("n")))).alias("place"))
    spans = counts.withColumn("before", before)
    hits = wanted.join(spans, tier).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c")))
    hits = hits.select(tier, "y", (F.col("place") - F.col("before") + 1).alias("nth"))  # at most `size` rows and one a tier
    years = hits.select(tier, "y").distinct()
    nth = F.row_number().over(Window.partitionBy(tier, "y").orderBy("doc_id"))
    return dated.join(years, [tier, "y"], "left_semi").withColumn("nth", nth).join(hits, [tier, "y", "nth"], "left_semi").select(*docs.columns)


def query_sample(docs: DataFrame, n: int, tier: str, least_words: int = 100) -> tuple[DataFrame, DataFrame]:
    """(retrieval sample, documents used before it was topped up): an equal number of each tier, topped up to n from the rest. Order: doc_id instead of a seeded shuffle.

    The number of tiers is counted first, so that the rank filter has a constant bound and each task keeps that many rows only.
    """
    viable = docs.where(F.col("word_count") >= least_words)
    share = max(1, n // max(1, viable.select(tier).distinct().count()))
    nth = F.row_number().over(Window.partitionBy(tier).orderBy("doc_id"))
    used = viable.withColumn("nth", nth).where(F.col("nth") <= share).drop("nth")
    rest = viable.join(used.select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(n)
    both = used.withColumn("late", F.lit(0)).unionByName(rest.withColumn("late", F.lit(1)))
    return both.orderBy("late", "doc_id").limit(n).drop("late"), used


def rag_candidates(docs: DataFrame, used: DataFrame, n: int, least_words: int = 100) -> DataFrame:
    """The n best documents by quality times length (5000 words at most) that aren't used."""
    score = F.round(F.coalesce("ocr_quality", F.lit(0.0)) * F.least("word_count", F.lit(5000)), 6)
    free = docs.where(F.col("word_count") >= least_words).join(used.select("doc_id"), "doc_id", "left_anti")
    return free.withColumn("score", score).orderBy(F.col("score").desc(), "doc_id").limit(n)
