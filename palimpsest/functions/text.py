"""Column functions over text; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One run of Unicode white space.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: A token: letters with at most one inner apostrophe part.
TOKEN = "[a-z]+(?:'[a-z]+)?"
#: Punctuation that counts as clean, short words that are real, weights of the quality score.
PUNCTUATION = ".,;:!?'-\"()[]"
NOT_CLEAN = r"[^\p{L} \n\t.,;:!?'\-\"()\[\]]"
SHORT_WORDS = "a i o an am as at be by do go he if in is it me my no of on or so to up us we & mr st dr ms".split()
WEIGHTS = (0.50, 0.30, 0.20)
#: Lower bounds of the tiers high and medium, of estimated and of recorded quality.
CORPUS_TIERS, ALTO_TIERS = (0.98, 0.95), (0.90, 0.70)
ERAS = (("pre-1700", 1700), ("1700-1799", 1800), ("1800-1849", 1850), ("1850-1899", 1900))
ERA_ORDER = [*(name for name, _ in ERAS), "1900+"]


def once(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use() names it."""
    return F.get(F.transform(F.array(value), use), 0)


def tok_ws(text: Column, lower: bool = False) -> Column:
    return F.filter(F.split(F.lower(text) if lower else text, WS), lambda x: x != "")


def tok_regex(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(tok_ws(text))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"\A{WS}|{WS}\z", "")


def not_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) != ""


def _quality(text: Column, words: Column) -> Column:
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    letters = lambda s: F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    dense = lambda s: (F.length(s) > 2) & (letters(s) / F.length(s) < 0.5)
    vowelless = lambda s: (F.length(s) > 3) & ~s.rlike("[aeiouAEIOU]")
    garbage = lambda ws: F.size(F.filter(ws, lambda s: (s != "") & (dense(s) | vowelless(s))))
    short = lambda ws: F.size(F.filter(ws, lambda s: (s != "") & (F.length(s) <= 2) & ~F.lower(s).isin(SHORT_WORDS)))
    clean = F.length(F.regexp_replace(text, NOT_CLEAN, "")) / F.length(text)
    n = F.size(words)
    score = once(bare, lambda ws: WEIGHTS[0] * clean + WEIGHTS[1] * (1 - garbage(ws) / n) + WEIGHTS[2] * (1 - short(ws) / n))
    return once(score, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def measured(text: Column) -> Column:
    """struct(word_count, ocr_quality) of a text, which is cut into words once; no quality without words.

    The quality: 0.5 share of clean characters + 0.3 (1 - share of garbage words) + 0.2 (1 - share of odd short words).
    """

    def use(words: Column) -> Column:
        n = F.size(words)
        return F.struct(n.alias("word_count"), F.when(n > 0, _quality(text, words)).alias("ocr_quality"))

    return once(tok_ws(text), use)


def ocr_quality(text: Column) -> Column:
    return measured(text)["ocr_quality"]


def tier(score: Column, bounds: tuple[float, float] = CORPUS_TIERS) -> Column:
    return once(score, lambda s: F.when(s.isNull(), "unknown").when(s >= bounds[0], "high").when(s >= bounds[1], "medium").otherwise("low"))


def era(year: Column) -> Column:
    out = F.when(year.isNull(), "unknown")
    for name, end in ERAS:
        out = out.when(year < end, name)
    return out.otherwise("1900+")


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def year_folder(name: Column) -> tuple[Column, Column]:
    """(date, first year) of a folder named by a year or a range of years; (name, null) of any other."""
    found = F.regexp_extract(name, r"^(\d{4})(?:-(\d{4}))?", 0)
    return F.when(found != "", found).otherwise(name), F.nullif(F.substring(found, 1, 4), F.lit("")).cast("int")


def year_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(1[0-9]{3}|20[0-2][0-9])\b", 1), F.lit("")).cast("int")


def clean_title(name: Column) -> Column:
    return strip(F.replace(name, F.lit("_"), F.lit(" ")))


def text_norm(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\r\n?", "\n")


def join_parts(parts: Column) -> Column:
    """Files of one document: each stripped, blank ones dropped, with an empty line between."""
    return F.array_join(F.filter(F.transform(parts, strip), lambda x: x != ""), "\n\n")


def page_estimate(size: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(size / 50000).cast("int"))


def alto_text(pages: Column) -> Column:
    """Text of pages, an array of arrays of words."""
    page = lambda ws: F.array_join(F.filter(ws, lambda w: not_blank(w)), " ")
    return F.array_join(F.filter(F.transform(pages, page), lambda p: not_blank(p)), "\n\n")


def llm_answer(content: Column) -> tuple[Column, Column]:
    """(answer, confidence) of a model's reply: fenced or bare JSON, else the fields by pattern, else the first 200 characters and 50."""
    body = F.when(content.contains("```"), F.get(F.split(content, "```"), 1)).otherwise(content)
    body = F.when(body.startswith("json"), F.substring(body, 5, 1 << 30)).otherwise(body)
    # a tolerant reader takes the first JSON value and ignores what follows: ask for an object to the very end
    whole = F.regexp_like(body, F.lit(r"(?s)\A\s*\{.*\}\s*\z"))
    parsed = F.when(whole, F.from_json(body, "answer string, confidence int"))
    answer, confidence = F.regexp_extract(body, r'"answer"\s*:\s*"([^"]*)"', 1), F.regexp_extract(body, r'"confidence"\s*:\s*(\d+)', 1)
    has = lambda pattern: F.regexp_like(body, F.lit(pattern))
    return (
        F.coalesce(parsed["answer"], F.when(has(r'"answer"\s*:\s*"([^"]*)"'), answer).otherwise(F.substring(body, 1, 200))),
        F.coalesce(parsed["confidence"], F.when(has(r'"confidence"\s*:\s*(\d+)'), confidence.cast("int")).otherwise(F.lit(50))),
    )


def href_class(use: Column, href: Column) -> Column:
    """alto, image, text or other of a file reference with its group's use, in this order of preference."""
    u, h = F.lower(F.coalesce(use, F.lit(""))), F.lower(href)
    return (
        F.when(u.contains("alto") | u.contains("xml") | h.endswith(".xml"), "alto")
        .when(h.rlike(r"\.(jpg|jpeg|tif|tiff|png)"), "image")
        .when(h.endswith(".txt"), "text")
        .otherwise("other")
    )
