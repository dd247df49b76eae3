"""Queries of text functions, filters and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..shared import table
from .base import corpus, docs, measures, query

W = "list_filter(string_split_regex(text, '@WS@'), lambda x: x <> '')"
WL = "list_filter(string_split_regex(lower(text), '@WS@'), lambda x: x <> '')"


@query("tok_ws", f"SELECT doc_id, CAST(len({WL}) AS INTEGER) AS n, md5(array_to_string({WL}, ' ')) AS words FROM documents")
def _(spark, d):
    words = T.tok_ws(F.col("text"), lower=True)
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("words"))


@query("tok_regex", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '@TOKEN@')) AS INTEGER) AS n, md5(array_to_string(regexp_extract_all(lower(text), '@TOKEN@'), ' ')) AS words FROM documents")
def _(spark, d):
    words = T.tok_regex(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("words"))


@query("word_count", f"SELECT doc_id, CAST(len({W}) AS INTEGER) AS word_count FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("word_count"))


@query("ocr_quality", "WITH @CORPUS@ SELECT doc_id, quality AS ocr_quality FROM corpus")
def _(spark, d):
    return corpus(spark, d).select("doc_id", "ocr_quality")


@query("ocr_tier", "WITH @CORPUS@ SELECT doc_id, tier FROM corpus")
def _(spark, d):
    return corpus(spark, d).select("doc_id", "tier")


@query("alto_tier", "WITH @CORPUS@ SELECT doc_id, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality >= 0.9 THEN 'high' WHEN quality >= 0.7 THEN 'medium' ELSE 'low' END AS tier FROM corpus")
def _(spark, d):
    return corpus(spark, d).select("doc_id", T.tier(F.col("ocr_quality"), T.ALTO_TIERS).alias("tier"))


@query("era", "WITH @DOCS@ SELECT doc_id, year, era FROM docs")
def _(spark, d):
    return docs(spark, d).select("doc_id", "year", "era")


@query("decade", "WITH @DOCS@ SELECT doc_id, CAST(year // 10 * 10 AS VARCHAR) || 's' AS decade FROM docs")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.decade(F.col("year")).alias("decade"))


FOLDER = "CASE doc_id % 3 WHEN 0 THEN CAST(year AS VARCHAR) WHEN 1 THEN concat(CAST(year AS VARCHAR), '-', CAST(year + 8 AS VARCHAR)) ELSE concat('undated ', source) END"


@query("year_folder", f"WITH @DOCS@, f AS (SELECT doc_id, {FOLDER} AS folder FROM docs), g AS (SELECT *, regexp_extract(folder, '^(\\d{{4}})(?:-(\\d{{4}}))?', 0) AS m FROM f) SELECT doc_id, CASE WHEN m <> '' THEN m ELSE folder END AS date, CAST(nullif(substr(m, 1, 4), '') AS INTEGER) AS date_numeric FROM g")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", F.expr(FOLDER.replace("VARCHAR", "STRING")).alias("folder"))
    date, year = T.year_folder(F.col("folder"))
    return rows.select("doc_id", date.alias("date"), year.alias("date_numeric"))


@query("year_text", "SELECT page_id, TRY_CAST(nullif(regexp_extract(concat(url, ' ', html), '\\b(1[0-9]{3}|20[0-2][0-9])\\b', 1), '') AS INTEGER) AS year FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.year_text(F.concat("url", F.lit(" "), "html")).alias("year"))


@query("clean_title", "SELECT doc_id, regexp_replace(replace(concat('_', source, '_', lang, '_'), '_', ' '), '^@WS@|@WS@$', '', 'g') AS title FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_title(F.concat(F.lit("_"), "source", F.lit("_"), "lang", F.lit("_"))).alias("title"))


@query("text_norm", "SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(10), chr(13) || chr(10)), '\\A@WS@|@WS@\\z', '', 'g'), '\\r\\n?', chr(10), 'g')) AS text_md5 FROM documents")
def _(spark, d):
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.text_norm(crlf).cast("binary")).alias("text_md5"))


@query("page_estimate", "SELECT doc_id, greatest(1, CAST(n_chars * 37 // 50000 AS INTEGER)) AS page_count FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.page_estimate(F.col("n_chars") * 37).alias("page_count"))


@query("txt_prefix", "SELECT doc_id, substr(text, 1, 300) AS p300, md5(substr(text, 1, 8192)) AS p8192 FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("p300"), F.md5(F.substring("text", 1, 8192).cast("binary")).alias("p8192"))


@query("alto_text", f"WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: array_to_string({W.replace('text', 's')}, ' ')) AS pages FROM documents) SELECT doc_id, md5(array_to_string(list_filter(pages, lambda s: s <> ''), chr(10) || chr(10))) AS text_md5 FROM p")
def _(spark, d):
    pages = F.transform(F.split("text", "\n"), lambda s: F.split(s, T.WS))
    return table(spark, d, "documents").select("doc_id", F.md5(T.alto_text(pages).cast("binary")).alias("text_md5"))


REPLY = """CASE conv_id % 3 WHEN 0 THEN concat('```json', chr(10), '{"answer": "', word, '", "confidence": ', CAST(turn AS VARCHAR), '}', chr(10), '```')
  WHEN 1 THEN concat('Well: "answer": "', word, '", "confidence": ', CAST(turn AS VARCHAR), ' and more') ELSE concat('plain ', word) END"""
WORD = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"


@query(
    "json_llm_parse",
    f"WITH w AS (SELECT conv_id, turn, {WORD} AS word FROM conversations) SELECT conv_id, turn, CASE WHEN conv_id % 3 = 2 THEN substr(concat('plain ', word), 1, 200) ELSE word END AS answer, CAST(CASE WHEN conv_id % 3 = 2 THEN 50 ELSE turn END AS INTEGER) AS confidence FROM w",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z ]", "").alias("word"))
    answer, confidence = T.llm_answer(F.col("reply"))
    return rows.withColumn("reply", F.expr(REPLY.replace("VARCHAR", "STRING").replace("chr(10)", "'\\n'"))).select("conv_id", "turn", answer.alias("answer"), confidence.alias("confidence"))


@query("id_format", "SELECT doc_id, format('Q{:03d}', doc_id) AS query_id, format('RAG{:03d}', doc_id) AS question_id, concat(doc_id, '_chunk_', n_chars) AS chunk_id FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.format_string("Q%03d", "doc_id").alias("query_id"), F.format_string("RAG%03d", "doc_id").alias("question_id"), F.format_string("%s_chunk_%d", F.col("doc_id").cast("string"), "n_chars").alias("chunk_id"))


HREF = "concat(url, CASE page_id % 5 WHEN 0 THEN '/f.XML' WHEN 1 THEN '/f.jpg' WHEN 2 THEN '/f.txt' WHEN 3 THEN '/f.TIF' ELSE '/f' END)"
USE = "CASE page_id % 7 WHEN 0 THEN 'ALTO' WHEN 1 THEN 'image' ELSE NULL END"


@query(
    "href_class",
    f"""WITH h AS (SELECT page_id, lower({HREF}) AS h, lower(coalesce({USE}, '')) AS u FROM pages)
    SELECT page_id, CASE WHEN contains(u, 'alto') OR contains(u, 'xml') OR ends_with(h, '.xml') THEN 'alto' WHEN regexp_matches(h, '\\.(jpg|jpeg|tif|tiff|png)') THEN 'image' WHEN ends_with(h, '.txt') THEN 'text' ELSE 'other' END AS kind FROM h""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.href_class(F.expr(USE), F.expr(HREF)).alias("kind"))


# filters


@query("flt_minwords10", f"SELECT doc_id FROM documents WHERE len({W}) >= 10")
def _(spark, d):
    return table(spark, d, "documents").where(T.word_count(F.col("text")) >= 10).select("doc_id")


@query("flt_viable", f"SELECT doc_id FROM documents WHERE len({W}) >= 100")
def _(spark, d):
    return table(spark, d, "documents").where(T.word_count(F.col("text")) >= 100).select("doc_id")


@query("flt_nonblank", f"SELECT doc_id FROM documents WHERE len({W}) > 0")
def _(spark, d):
    return table(spark, d, "documents").where(T.not_blank(F.col("text"))).select("doc_id")


@query("flt_era_known", "WITH @DOCS@ SELECT doc_id, era FROM docs WHERE era <> 'unknown'")
def _(spark, d):
    return docs(spark, d).where("era <> 'unknown'").select("doc_id", "era")


@query(
    "flt_high",
    "WITH @CORPUS@, h AS (SELECT *, count(*) FILTER (tier = 'high') OVER () AS n, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) AS r FROM corpus) SELECT doc_id, quality AS ocr_quality FROM h WHERE CASE WHEN n >= 10 THEN tier = 'high' ELSE r <= 50 END",
)
def _(spark, d):
    return high_docs(measures(spark, d)).select("doc_id", "ocr_quality")


def high_docs(rows, least: int = 10, fallback: int = 50):
    """Documents of the high tier, or the best ones if there are fewer than `least`."""
    high = rows.where("tier = 'high'")
    return high if high.limit(least).count() >= least else rows.orderBy(F.col("ocr_quality").desc_nulls_last(), "doc_id").limit(fallback)


@query(
    "flt_stop_len",
    "WITH @DOCS@, @TOKENS@ SELECT term, count(*) AS c FROM tokens WHERE length(term) >= 4 AND term NOT IN (@STOP_SHORT@) GROUP BY term",
)
def _(spark, d):
    from ..operators import postings, stats

    return postings.tokens(docs(spark, d)).where((F.length("term") >= 4) & ~F.col("term").isin(stats.STOPWORDS_SHORT)).groupBy("term").agg(F.count(F.lit(1)).alias("c"))


@query("flt_required", "SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (text IS NULL) AS text, count(*) FILTER (lang IS NULL) AS lang, count(*) FILTER (n_chars IS NULL) AS n_chars FROM documents")
def _(spark, d):
    rows = table(spark, d, "documents")
    return rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in ("doc_id", "text", "lang", "n_chars")))


# chunks

CHUNKS = f"""w AS (SELECT doc_id, text, lang, {W} AS ws FROM documents),
  k AS (SELECT doc_id, lang, ws, unnest(generate_series(0, len(ws) - 1, 462)) AS s FROM w WHERE len(ws) > 0),
  chunks AS (SELECT doc_id, lang, CAST(s AS INTEGER) AS start_word, CAST(least(s + 512, len(ws)) AS INTEGER) AS end_word, array_to_string(ws[s + 1 : s + 512], ' ') AS text FROM k)"""


@query("chunk_fixed", f"WITH {CHUNKS} SELECT doc_id, start_word, end_word, md5(text) AS text_md5 FROM chunks")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(C.fixed_chunks(F.col("text"))).alias("c"))
    return rows.select("doc_id", "c.start_word", "c.end_word", F.md5(F.col("c.text").cast("binary")).alias("text_md5"))


@query("chunk_index", f"WITH {CHUNKS} SELECT doc_id, concat(doc_id, '_chunk_', start_word // 462) AS chunk_id, lang, start_word, end_word FROM chunks")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    return C.chunk_index(rows, C.fixed_chunks(F.col("text"))).select("doc_id", "chunk_id", "lang", "start_word", "end_word")


@query(
    "chunk_semantic",
    f"""WITH RECURSIVE s0 AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n[\\t-\\r ]*\\n'), lambda x: regexp_replace(x, '\\A@WS@|@WS@\\z', '', 'g')), lambda x: x <> '') AS ps FROM documents),
    pa AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM s0), pw AS (SELECT doc_id, p, i, len({W.replace('text', 'p')}) AS w FROM pa),
    r(doc_id, i, c, h, open) AS (SELECT doc_id, 0::BIGINT, -1::BIGINT, 0::BIGINT, FALSE FROM s0 UNION ALL
      SELECT r.doc_id, pw.i, CASE WHEN pw.w <= 512 AND r.open AND r.h + pw.w <= 512 THEN r.c ELSE r.c + 1 END, CASE WHEN pw.w > 512 THEN 0 WHEN r.open AND r.h + pw.w <= 512 THEN r.h + pw.w ELSE pw.w END, pw.w <= 512
      FROM r JOIN pw ON pw.doc_id = r.doc_id AND pw.i = r.i + 1)
    SELECT doc_id, CAST(c AS INTEGER) AS n, CAST(count(*) AS INTEGER) AS n_paragraphs, md5(string_agg(p, chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM r JOIN pw USING (doc_id, i) GROUP BY doc_id, c""",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    out = rows.select("doc_id", F.posexplode(C.semantic_chunks(F.col("text"))).alias("n", "c"))
    return out.select("doc_id", "n", "c.n_paragraphs", F.md5(F.col("c.text").cast("binary")).alias("text_md5"))


@query(
    "chunk_coverage",
    f"WITH w AS (SELECT doc_id, len({W}) AS n FROM documents) SELECT doc_id, CAST(ceil(n / 462) AS INTEGER) AS n_chunks, round(n / ceil(n / 462), 6) AS avg_length, "
    + ", ".join(f"round(least(1.0, {k} * 512 / n), 6) AS cov_{k}" for k in (1, 3, 5, 10)).replace("1.0,", "CAST(1 AS DOUBLE),")
    + " FROM w WHERE n > 0",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n")).where("n > 0")
    return rows.select("doc_id", C.n_chunks(F.col("n")).alias("n_chunks"), F.round(F.col("n") / C.n_chunks(F.col("n")), 6).alias("avg_length"), *(F.round(C.coverage(F.col("n"), k), 6).alias(f"cov_{k}") for k in (1, 3, 5, 10)))


@query(
    "chunk_splits",
    f"""WITH w AS (SELECT doc_id, text, {W} AS ws FROM documents),
    b AS (SELECT doc_id, s, length(array_to_string(ws[1:least(s + 512, len(ws))], ' ')) AS p FROM (SELECT doc_id, ws, unnest(generate_series(0, (CAST(ceil(len(ws) / 462) AS BIGINT) - 2) * 462, 462)) AS s FROM w WHERE len(ws) > 462)),
    st AS (SELECT doc_id, instr(text, x) - 1 AS a, length(x) AS n FROM (SELECT doc_id, text, unnest(list_distinct(string_split(text, '.'))) AS x FROM w WHERE doc_id IN (SELECT doc_id FROM b))),
    h AS (SELECT DISTINCT b.doc_id, b.s FROM b JOIN st ON b.doc_id = st.doc_id AND a < p AND p < a + n)
    SELECT w.doc_id, CAST(count(h.s) AS INTEGER) AS splits FROM w LEFT JOIN h ON h.doc_id = w.doc_id GROUP BY w.doc_id""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", C.split_sentences(F.col("text")).alias("splits"))


@query("doc_truncation", f"WITH w AS (SELECT doc_id, CAST(len({W}) AS INTEGER) AS n FROM documents) SELECT doc_id, CASE WHEN n > 0 THEN round(least(n, 8192) / n, 6) ELSE 0.0 END AS coverage, n > 8192 AS truncated, greatest(0, n - 8192) AS words_lost FROM w")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))
    c, t, lost = C.truncation(F.col("n"))
    return rows.select("doc_id", F.round(c, 6).alias("coverage"), t.alias("truncated"), lost.alias("words_lost"))


@query(
    "agg_length_strategy",
    f"WITH w AS (SELECT doc_id, lang, len({W}) AS n FROM documents) SELECT lang, round(avg(least(n, 8192) / n), 6) AS coverage, round(avg(CAST(n > 8192 AS DOUBLE)), 6) AS truncated, round(avg(ceil(n / 462)), 6) AS n_chunks, round(avg(least(CAST(1 AS DOUBLE), 5 * 512 / n)), 6) AS coverage_at_5 FROM w WHERE n > 0 GROUP BY lang",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("lang", T.word_count(F.col("text")).alias("n")).where("n > 0")
    c, t, _ = C.truncation(F.col("n"))
    mean = lambda x, name: F.round(F.avg(x), 6).alias(name)
    return rows.groupBy("lang").agg(mean(c, "coverage"), mean(t.cast("double"), "truncated"), mean(C.n_chunks(F.col("n")), "n_chunks"), mean(C.coverage(F.col("n"), 5), "coverage_at_5"))


@query(
    "topk_percentile_window",
    f"""WITH w AS (SELECT doc_id, CAST(len({W}) AS INTEGER) AS word_count FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY word_count, doc_id) - 1 AS pos, count(*) OVER () AS n FROM w),
    p AS (SELECT percent, n, least(n * percent // 100, n - 1) AS c FROM (SELECT unnest([25, 50, 90, 99]) AS percent) CROSS JOIN (SELECT count(*) AS n FROM documents))
    SELECT CAST(percent AS INTEGER) AS percent, doc_id, word_count FROM r JOIN p ON pos >= greatest(0, c - 2) AND pos < least(p.n, greatest(0, c - 2) + 5)""",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("word_count"))
    return C.percentile_windows(rows, "word_count", [25, 50, 90, 99])


@query(
    "smp_stratified",
    """WITH @CORPUS@, c AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY year, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tier) AS nt, count(*) OVER () AS n FROM corpus),
    s AS (SELECT *, least(greatest(1, 100 * nt // n), nt) AS k FROM c),
    i AS (SELECT DISTINCT tier, x * nt // k AS pos FROM (SELECT DISTINCT tier, nt, k, unnest(generate_series(0, k - 1)) AS x FROM s))
    SELECT doc_id, tier, year FROM s JOIN i USING (tier, pos)""",
)
def _(spark, d):
    return C.stratified_sample(measures(spark, d), 100, "tier", "year").select("doc_id", "tier", "year")


@query(
    "smp_queries",
    """WITH @CORPUS@, v AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY doc_id) AS nth FROM corpus WHERE wc >= 100),
    u AS (SELECT doc_id, tier, 0 AS late FROM v WHERE nth <= greatest(1, 50 // greatest(1, (SELECT count(DISTINCT tier) FROM v)))),
    a AS (SELECT * FROM u UNION ALL SELECT doc_id, tier, 1 FROM v WHERE doc_id NOT IN (SELECT doc_id FROM u))
    SELECT doc_id, tier FROM a ORDER BY late, doc_id LIMIT 50""",
)
def _(spark, d):
    return C.query_sample(measures(spark, d), 50, "tier")[0].select("doc_id", "tier")


@query(
    "limit_rag_docs",
    """WITH @CORPUS@, v AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY doc_id) AS nth FROM corpus WHERE wc >= 100),
    u AS (SELECT doc_id FROM v WHERE nth <= greatest(1, 50 // greatest(1, (SELECT count(DISTINCT tier) FROM v))))
    SELECT doc_id, round(coalesce(quality, 0) * least(wc, 5000), 6) AS score FROM v WHERE doc_id NOT IN (SELECT doc_id FROM u) ORDER BY score DESC, doc_id LIMIT 30""",
)
def _(spark, d):
    rows = measures(spark, d)
    return C.rag_candidates(rows, C.query_sample(rows, 50, "tier")[1], 30).select("doc_id", "score")


@query(
    "join_used_anti",
    """WITH @CORPUS@, v AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY doc_id) AS nth FROM corpus WHERE wc >= 100),
    u AS (SELECT doc_id FROM v WHERE nth <= greatest(1, 50 // greatest(1, (SELECT count(DISTINCT tier) FROM v)))) SELECT doc_id FROM v WHERE doc_id NOT IN (SELECT doc_id FROM u)""",
)
def _(spark, d):
    rows = measures(spark, d)
    used = C.query_sample(rows, 50, "tier")[1].select("doc_id")
    return rows.where("word_count >= 100").join(used, "doc_id", "left_anti").select("doc_id")
