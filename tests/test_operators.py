"""Hand-computed values of single operators."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import agreement, bm25, chunking, dense, metrics, noise, rag, ranking, robustness, stats
from palimpsest.plans import steps
from palimpsest.sources import files, markup


def one(df):
    (row,) = df.collect()
    return row


def value(spark, column):
    return one(spark.range(1).select(column.alias("v")))["v"]


def test_tokens_and_tiers(spark):
    assert value(spark, T.tok_ws(F.lit(" a b\tc "))) == ["a", "b", "c"]
    assert value(spark, T.tok_regex(F.lit("Don't stop, O'"))) == ["don't", "stop", "o"]
    assert value(spark, T.ocr_quality(F.lit("  "))) is None
    assert [value(spark, T.tier(F.lit(x).cast("double"))) for x in (0.98, 0.95, 0.9499, None)] == ["high", "medium", "low", "unknown"]
    eras = [value(spark, T.era(F.lit(y).cast("int"))) for y in (None, 1699, 1700, 1800, 1850, 1900)]
    assert eras == ["unknown", "pre-1700", "1700-1799", "1800-1849", "1850-1899", "1900+"]


def test_ocr_quality_by_hand(spark):
    # words: "xqz" short of vowels but not over 3 letters, "brrr" garbage, "zz" odd, "12a4" mostly digits, "the" fine, "--" empty after stripping
    t = "xqz brrr zz 12a4 the --"
    clean = sum(c.isalpha() or c in " \n\t.,;:!?'-\"()[]" for c in t) / len(t)
    assert value(spark, T.ocr_quality(F.lit(t))) == pytest.approx(0.5 * clean + 0.3 * (1 - 2 / 6) + 0.2 * (1 - 1 / 6))


def test_year_folder(spark):
    for name, want in (("1767", ("1767", 1767)), ("1782-1790", ("1782-1790", 1782)), ("undated", ("undated", None))):
        a, b = T.year_folder(F.lit(name))
        assert (value(spark, a), value(spark, b)) == want


def test_llm_replies(spark):
    for reply, want in (
        ('```json\n{"answer": "x", "confidence": 7}\n```', ("x", 7)),
        ('so "answer": "y" and "confidence": 12', ("y", 12)),
        ("z" * 300, ("z" * 200, 50)),
    ):
        a, c = T.llm_answer(F.lit(reply))
        assert (value(spark, a), value(spark, c)) == want


def test_metrics_of_one_hit_at_rank_two(spark):
    run = spark.createDataFrame([("q", i, 1.0 / i, i) for i in range(1, 11)], "qid string, doc_id long, score double, rank int")
    qrels = spark.createDataFrame([("q", 2, 1), ("empty", 5, 1)], "qid string, doc_id long, rel int")
    rows = {r["qid"]: r for r in metrics.per_query(run, qrels).collect()}
    assert rows["q"]["ndcg"] == pytest.approx(1 / math.log2(3)) and rows["q"]["mrr"] == 0.5 and rows["q"]["recall"] == 1
    assert (rows["empty"]["ndcg"], rows["empty"]["mrr"], rows["empty"]["recall"]) == (0, 0, 0)


def test_paired_tests(spark):
    a, b = [0.9, 0.4, 0.8, 0.3, 0.7], [0.5, 0.6, 0.5, 0.3, 0.2]
    pairs = spark.createDataFrame(list(zip(a, b, strict=True)), "a double, b double")
    d = [x - y for x, y in zip(a, b, strict=True)]
    mean = sum(d) / 5
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / 4)
    t = one(metrics.paired_t(pairs))
    assert t["t"] == pytest.approx(mean / (sd / math.sqrt(5))) and t["mean_diff"] == pytest.approx(mean)
    w = one(metrics.wilcoxon(pairs))
    assert (w["n"], w["w"]) == (4, 1.0)  # |d| ranks: .2 -> 1 (minus), .3, .4, .5
    assert metrics.t_p_value(-2.432, 50) == pytest.approx(0.0187, abs=2e-4)
    assert one(metrics.paired_t(pairs.limit(2)))["t"] is None


def test_answers(spark):
    rows = spark.createDataFrame([("", "1831"), ("in 1831", "1831"), ("Not enough here", "x"), ("wrong", "1831")], "prediction string, answer string")
    r = metrics.answers(rows).collect()
    assert not r[0]["exact_match"] and r[0]["contains_match"] and r[0]["token_f1"] == 0 and not r[0]["is_hallucination"]
    assert r[1]["contains_match"] and (r[1]["token_precision"], r[1]["token_recall"]) == (0.5, 1) and r[1]["token_f1"] == pytest.approx(2 / 3)
    assert r[2]["is_abstained"] and r[3]["is_hallucination"]


def test_kappa(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 0, 0], [1, 0, 0, 0], strict=True)), "a int, b int")
    r = one(agreement.kappa(rows, "a", "b"))
    assert (r["n"], r["agreement"], r["kappa"], r["band"]) == (4, 0.75, 0.5, "Moderate agreement")
    assert one(agreement.kappa(rows.where("a > 5"), "a", "b"))["kappa"] == 0


def test_chunks(spark):
    sizes = {n: len(value(spark, chunking.fixed_chunks(F.lit(" ".join(["w"] * n))))) for n in (0, 1, 462, 463, 512, 1000)}
    assert sizes == {0: 0, 1: 1, 462: 1, 463: 2, 512: 2, 1000: 3}
    text = "a b\n\nc d e\n \n" + " ".join(["x"] * 6) + "\n\nf"
    got = [(c["text"], c["n_paragraphs"]) for c in value(spark, chunking.semantic_chunks(F.lit(text), 5))]
    assert got == [("a b\n\nc d e", 2), ("x x x x x x", 1), ("f", 1)]
    assert value(spark, chunking.semantic_chunks(F.lit(" \n\n "), 5)) == []


def test_split_sentences(spark):
    text = " ".join(["ab"] * 6) + ". " + " ".join(["cd"] * 4) + "."
    words, borders = text.split(), []
    at = 0
    while at < len(words):
        borders.append(min(at + 4, len(words)))
        at += 3
    want = 0
    for e in borders[:-1]:
        p = len(" ".join(words[:e]))
        want += any(text.find(s) < p < text.find(s) + len(s) for s in text.split("."))
    assert value(spark, chunking.split_sentences(F.lit(text), 4, 1)) == want


def test_percentiles_by_index(spark):
    rows = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "v int")
    assert one(stats.percentiles_by_index(rows, "v", [90]))["value"] == 40


def test_stratified_sample(spark):
    rows = spark.createDataFrame([(1, "high", 1800), (2, "high", 1700), (3, "high", None), (4, "low", 1750)], "doc_id long, tier string, year int")
    got = sorted((r["tier"], r["doc_id"]) for r in chunking.stratified_sample(rows, 2, "tier", "year").collect())
    assert got == [("high", 2), ("low", 4)]


def test_bm25_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(i, "cat" if i == 3 else "dog") for i in range(6)] + [(9, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat cat"), (2, "bird")], "qid long, text string")
    got = [(r["qid"], r["doc_id"], r["score"] > 0) for r in bm25.smooth(docs, queries, 4).orderBy("qid", "rank").collect()]
    assert got == [(1, 3, True), (1, 0, False), (1, 1, False), (1, 2, False), (2, 0, False), (2, 1, False), (2, 2, False), (2, 3, False)]


def test_dense_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vec array<double>")
    q = spark.createDataFrame([(i, [1.0, float(-i)]) for i in range(7)], "qid long, vec array<double>")
    want = sorted(map(tuple, dense.top_k(rows, q, 3).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, dense.top_k(rows, q, 3).collect())) == want and len(want) == 21


def test_noise_is_reproducible(spark):
    text = "The quick brown fox jumps over the lazy dog. " * 5
    a, cer = noise.noisy(text, 0.1, 42)
    assert noise.noisy(text, 0.1, 42) == (a, cer) and 0 < cer <= 0.1 and a != text
    assert noise.noisy("", 0.5, 1) == ("", 0.0)
    r = one(spark.createDataFrame([(text,)], "t string").select(noise.inject(F.col("t"), F.lit(0.1), F.lit(42)).alias("x")).select("x.*"))
    assert (r["text"], r["cer"]) == (a, cer)
    random.seed(0)  # the operator has its own generator
    assert noise.noisy(text, 0.3, 7)[0] == noise.noisy(text, 0.3, 7)[0]


def test_overlap_and_degradation(spark):
    schema = "qid long, doc_id long, score double, rank int"
    base = spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 1.0, 2), (2, 1, 0.0, 1)], schema)
    other = spark.createDataFrame([(1, 2, 1.0, 1), (1, 3, 0.5, 2), (2, 1, 3.0, 1)], schema)
    assert one(robustness.overlap(base, other))["overlap"] == 0.75
    assert one(robustness.degradation(base, other))["degradation"] == 0.5


def test_conflicts(spark):
    lines = ["a", "=======", "<<<<<<< HEAD", "b", "=======", "c", ">>>>>>> main", "d"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string")
    assert [r["line"] for r in agreement.without_conflicts(df).orderBy("n").collect()] == ["a", "=======", "b", "d"]


def test_provider_errors_become_answers(spark):
    def broken(prompt):
        raise RuntimeError("down")

    rows = rag.read_replies(rag.ask(spark.createDataFrame([("p",)], "prompt string"), broken))
    assert tuple(one(rows.select("prediction", "confidence"))) == ("ERROR: down", 0)


WORDS = [("The", 0.95), ("Union", 0.88), ("of", 0.99), ("Crowns", 0.75), ("was", 0.92), ("signed", 0.85), ("in", 0.98), ("1603", 0.65), ("Scot1and", 0.45), ("and", 0.98), ("Eng1and", 0.42)]


def alto(words, ns=' xmlns="http://www.loc.gov/standards/alto/ns-v2#"', width=2400, height=3200):
    strings = "<SP/>".join(f'<String CONTENT="{w}" WC="{c}"/>' for w, c in words)
    return f'<?xml version="1.0"?><alto{ns}><Layout><Page ID="P1" WIDTH="{width}" HEIGHT="{height}"><PrintSpace><TextBlock><TextLine>{strings}</TextLine></TextBlock></PrintSpace></Page></Layout></alto>'


def test_alto_pages(spark):
    rows = [("a", "1.xml", alto(WORDS)), ("a", "2.xml", alto([("Hello", 0.99), ("World", 0.90)], "", 1200, 1600)), ("b", "1.xml", "<alto><broken>not closed")]
    docs = markup.read_alto(spark.createDataFrame(rows, "doc_id string, name string, xml string"))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert got["a"]["text"] == "The Union of Crowns was signed in 1603 Scot1and and Eng1and\n\nHello World"
    assert [(p["width"], p["height"], len(p["words"])) for p in got["a"]["pages"]] == [(2400, 3200, 11), (1200, 1600, 2)]
    assert got["b"]["pages"] == [] and got["b"]["text"] == ""
    c = {r["doc_id"]: r for r in markup.confidences(docs).collect()}["a"]
    assert c["word_count"] == 13 and c["mean_wc"] == pytest.approx(10.71 / 13) and c["tier"] == "medium"
    first = one(markup.confidences(docs, "doc_id", "page").where("doc_id = 'a' and page = 0"))
    assert first["mean_wc"] == pytest.approx(8.82 / 11) and first["median_wc"] == 0.88


def test_mets(spark):
    xml = (
        '<mets xmlns="http://www.loc.gov/METS/" xmlns:xlink="http://www.w3.org/1999/xlink"><mods xmlns="http://www.loc.gov/mods/v3"><titleInfo><title> T </title></titleInfo><originInfo><dateCreated>c. 1767</dateCreated></originInfo></mods>'
        '<fileSec><fileGrp USE="ALTO"><file><FLocat xlink:href="1.dat"/></file></fileGrp><fileGrp USE="img"><file><FLocat xlink:href="1.TIF"/></file></fileGrp></fileSec></mets>'
    )
    m = value(spark, markup.mets(F.lit(xml)))
    assert (m["title"], m["year"], m["alto_files"], m["image_files"], m["page_count"]) == ("T", 1767, ["1.dat"], ["1.TIF"], 1)


def test_tree(spark, tmp_path):
    d = tmp_path / "india" / "1767-1770" / "A_title" / "55"
    d.mkdir(parents=True)
    (d / "55.txt").write_bytes(b" one \r\ntwo\xff ")
    (d / "z.txt").write_text("ignored")
    e = tmp_path / "india" / "undated" / "Other" / "56"
    e.mkdir(parents=True)
    (e / "b.txt").write_text("second")
    (e / "a.txt").write_text("first ")
    (e / "c.txt").write_text("  ")
    rows = {r["doc_id"]: r for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert rows["55"]["text"] == "one \ntwo�" and rows["55"]["date_numeric"] == 1767 and rows["55"]["title"] == "A title" and rows["55"]["source_files"] == 1
    assert rows["56"]["text"] == "first\n\nsecond" and rows["56"]["date"] == "undated" and rows["56"]["date_numeric"] is None


def test_missing_array_is_empty(spark, tmp_path):
    assert files.read_json_array(spark, str(tmp_path / "none.json"), files.RAG).count() == 0


def test_latex():
    assert r"a & 1.000 \\" in files.latex_table([{"t": "a", "v": 1.0}], ["t", "v"])


def test_steps(spark, tmp_path, tiny, capsys):
    assert all(ok for *_, ok in steps.dry_run())
    assert [s.number for s in steps.chosen(first=9)] == [9, 10, 11] and [s.number for s in steps.chosen(only=[2])] == [2]
    assert steps.main([tiny, str(tmp_path), "--dry-run"]) == 0
    assert not steps.run(spark, "/nowhere", str(tmp_path), steps.chosen(only=[2]))


def test_places_and_percentiles_from_counts(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.round(rng.normal(size=400), 1), np.full(200, 0.5)])
    df = spark.createDataFrame([(float(v), 1) for v in values] + [(None, 1)], "v double, one int").repartition(5)
    got = {r["v"]: (r["n"], r["before"], r["one"]) for r in ranking.before(df, "v", "one").collect()}
    assert got == {v: ((values == v).sum(), (values < v).sum(), (values == v).sum()) for v in set(values.tolist())}
    shares = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}
    assert np.allclose(ranking.at_shares(df, "v", shares).first(), np.quantile(values, list(shares.values())))
    assert ranking.at_shares(df.where("v > 99"), "v", shares).first() == (None,) * 4
    one = stats.describe(df, "v").first()
    assert one["n"] == 600 and abs(one["median"] - np.median(values)) < 1e-12 and abs(one["std"] - values.std(ddof=1)) < 1e-9


def test_split_sentences_by_hand(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "a.", "word.", "End", "of", "it's\n", "x. y."]) for _ in range(n)) for n in (0, 1, 5, 30, 31, 60, 300)] + [None, "  "]

    def count(text, size=12, overlap=3):
        words = (text or "").split()
        starts = list(range(0, len(words), size - overlap))
        places = [len(" ".join(words[: min(s + size, len(words))])) for s in starts[:-1]]
        spans = [(text.find(s), len(s)) for s in dict.fromkeys(text.split("."))] if text else []
        return sum(any(a < p < a + n for a, n in spans) for p in places)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", chunking.split_sentences(F.col("text"), 12, 3)).collect()}
    assert [got[i] or 0 for i in range(len(texts))] == [count(t) for t in texts]


def test_fixed_chunks_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([("word " * n,)], "text string")
        best = 99.0
        for _ in range(3):
            began = time.time()
            assert df.select(F.size(chunking.fixed_chunks(F.col("text"), 64, 8)).alias("n")).first()["n"] == -(-n // 56)
            best = min(best, time.time() - began)
        return best

    seconds(1000)
    assert seconds(40_000) < 8 * max(seconds(10_000), 0.1)


def test_judgments_of_short_items(spark, tmp_path):
    from palimpsest.plans import base

    docs = ["foo bar. one two three four five six seven", "xfoo bary and Z", "foo", "", None, "漢字 is here"]
    items = ["foo", "foo bar", "Z", "two three four five", "ne two three four five six sev", "", "字", "no such thing at all here"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["qid"], r["doc_id"]) for r in base.judgments(spark, str(tmp_path)).collect())
    assert got == sorted((q, k) for q, t in enumerate(items) for k, d in enumerate(docs) if t and d and t in d)


def test_dense_blocks_give_the_same(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(np.round(rng.normal(size=(200, 6)), 3))], "id long, vec array<double>, label int")
    queries = rows.where("id < 23").select(F.col("id").alias("qid"), "vec")
    for group in (None, "label"):
        keys = ["qid"] + ([group] if group else [])
        best = lambda df: sorted(tuple(r) for r in bm25.ranked(df, 5, keys, "id").select(*keys, "id", "score", "rank").collect())  # noqa: B023, E731
        assert best(dense.scores(rows, queries, 5, group)) == best(dense.scores(rows, queries, 5, group, query_block=7, row_block=30))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from palimpsest import shared

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError):
        shared.scratch(session("spark://host:7077"), "x")
    with pytest.raises(ValueError):
        shared.scratch(session("local-cluster[2,1,1024]"), "x")
    assert shared.scratch(session("yarn", "hdfs:///tmp"), "x").startswith("hdfs:///tmp/x-") and shared.scratch(session("local[4]"), "x")
