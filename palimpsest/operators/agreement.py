"""Reviewers' decisions, their agreement, and merging of conflicting files.

Items have: status string, verified_by array<string>, decisions map<string,string>, reviewer_notes array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ((0.8, "Almost perfect agreement"), (0.6, "Substantial agreement"), (0.4, "Moderate agreement"), (0.2, "Fair agreement"))


def _names(items_column: str = "verified_by") -> Column:
    return F.coalesce(items_column, F.array().cast("array<string>"))


def reviewers(items: DataFrame) -> DataFrame:
    """The distinct names, sorted, in one row; as many as there are people."""
    return items.select(F.explode("verified_by").alias("name")).agg(F.array_sort(F.collect_set("name")).alias("reviewers"))


def decision(reviewer: Column) -> Column:
    """accept, reject or null of one reviewer: the recorded decision, else a note of theirs, else what the status and others' notes say."""
    names, notes = _names(), F.coalesce("reviewer_notes", F.array().cast("array<string>"))
    noted = lambda who: F.exists(notes, lambda n: F.startswith(n, F.concat(who, F.lit(":"))))
    other_noted = F.exists(names, lambda o: (o != reviewer) & noted(o))
    explicit = F.try_element_at("decisions", reviewer)
    return (
        F.when(~F.array_contains(names, reviewer), F.lit(None).cast("string"))
        .when(explicit.isNotNull(), explicit)
        .when(noted(reviewer), "reject")
        .when(F.col("status") != "rejected", "accept")
        .when(F.col("status").isNull(), "accept")
        .when(F.size(names) == 1, "reject")
        .when(other_noted, "accept")
        .otherwise("reject")
    )


def decided(items: DataFrame) -> DataFrame:
    """items with d1, d2 of the first two reviewers by name, and class: both_accept, both_reject, disagree or incomplete."""
    both = items.join(F.broadcast(reviewers(items)), how="cross")  # one row
    rows = both.withColumn("d1", decision(F.try_element_at("reviewers", F.lit(1)))).withColumn("d2", decision(F.try_element_at("reviewers", F.lit(2))))
    label = (
        F.when(F.col("d1").isNull() | F.col("d2").isNull(), "incomplete")
        .when((F.col("d1") == "accept") & (F.col("d2") == "accept"), "both_accept")
        .when((F.col("d1") == "reject") & (F.col("d2") == "reject"), "both_reject")
        .otherwise("disagree")
    )
    return rows.withColumn("class", label).drop("reviewers")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa, band of two label columns; 0 without rows, 1 if chance agreement is 1. Counted by pairs of labels."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    total = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))), F.lit(0)).alias("same"))
    rows = cells.groupBy("a").agg(F.sum("c").alias("ca")).join(cells.groupBy("b").agg(F.sum("c").alias("cb")), F.col("a") == F.col("b"))
    chance = rows.agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("chance"))
    n = F.col("n").cast("double")
    p_o, p_e = F.col("same") / n, F.col("chance") / (n * n)
    value = F.when(n == 0, 0.0).when(p_e == 1, 1.0).otherwise((p_o - p_e) / (1 - p_e))
    out = total.join(F.broadcast(chance), how="cross").select("n", F.when(n > 0, p_o).otherwise(0.0).alias("agreement"), value.alias("kappa"))
    band = F.lit("Slight agreement")
    for least, name in reversed(BANDS):
        band = F.when(F.col("kappa") > least, name).otherwise(band)
    return out.withColumn("band", band)


def status_after(action: Column, reviewer: Column) -> dict[str, Column]:
    """verified_by, decisions and status of an item after a reviewer's accept or reject."""
    names = F.array_append(_names(), reviewer)
    kept = F.map_filter(F.coalesce("decisions", F.create_map().cast("map<string,string>")), lambda k, _: k != reviewer)
    decisions = F.map_concat(kept, F.create_map(reviewer, action))
    fine = F.forall(F.map_values(decisions), lambda d: d == "accept")
    status = F.when(action == "reject", "rejected").when(~fine, "disputed").when(F.size(names) >= 2, "verified").otherwise("partially_verified")
    return {"verified_by": names, "decisions": decisions, "status": status}


def without_conflicts(lines: DataFrame) -> DataFrame:
    """Lines (file, n, line) without conflict markers, of a conflict only its first side.

    A line's side follows from the last marker before it in its file.
    """
    bare = F.trim("line")
    mark = F.when(bare.startswith("<<<<<<< "), "head").when(bare.startswith(">>>>>>> "), "out").when(bare == "=======", "mid")
    upto = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    # a line of equals signs is a marker only inside a conflict
    strong = F.when(mark.isin("head", "out"), mark)
    rows = lines.withColumn("mark", mark).withColumn("last", F.last(strong, ignorenulls=True).over(upto))
    rows = rows.withColumn("mark", F.when((F.col("mark") == "mid") & (F.coalesce("last", F.lit("out")) != "head"), None).otherwise(F.col("mark")))
    rows = rows.withColumn("side", F.coalesce(F.last("mark", ignorenulls=True).over(upto), F.lit("out")))
    return rows.where(F.col("mark").isNull() & (F.col("side") != "mid")).select("file", "n", "line")


def merged(items: DataFrame, others: DataFrame) -> DataFrame:
    """items (doc_id, ...) with the reviewers of others (doc_id, names) added, and the status that their number gives unless rejected."""
    rows = items.join(others, "doc_id", "left")
    union = F.array_sort(F.array_union(_names(), F.coalesce("names", F.array().cast("array<string>"))))
    status = F.when(F.col("names").isNull() | (F.col("status") == "rejected") | (F.size(union) == 0), F.col("status")).when(F.size(union) >= 2, "verified").otherwise("partially_verified")
    return rows.select("doc_id", F.when(F.col("names").isNull(), F.col("verified_by")).otherwise(union).alias("verified_by"), status.alias("status"))
