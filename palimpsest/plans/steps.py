"""The pipeline's steps in order, each a list of registered queries; run in full, from a step, or some of them."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Step:
    number: int
    name: str
    queries: tuple[str, ...]


STEPS = (
    Step(1, "listing", ("src_hub", "src_scan")),
    Step(2, "corpus", ("snk_jsonl", "agg_tier_counts", "smp_stratified")),
    Step(3, "queries", ("smp_queries", "limit_rag_docs", "snk_beir")),
    Step(4, "retrieval", ("bm25_okapi", "dense_topk", "agg_metric_mean", "st_ttest", "st_wilcoxon", "topk_failures")),
    Step(5, "answers", ("chunk_index", "rag_experiment")),
    Step(6, "length", ("agg_describe", "agg_pct_index", "chunk_coverage", "agg_length_strategy")),
    Step(7, "time", ("set_jaccard_era", "set_drift", "bm25_by_era", "dense_by_group", "agg_retr_matrix")),
    Step(8, "collections", ("set_overlap_col", "agg_ocr_compare", "agg_mean_sim")),
    Step(9, "noise", ("noise_experiment",)),
    Step(10, "statistics", ("agg_vocab", "agg_zipf", "agg_tfidf", "agg_temporal", "agg_collection", "agg_corr_bug")),
    Step(11, "reports", ("rep_table1", "rep_drop", "rep_covdrop", "rep_halluc_inc", "rep_summary", "snk_latex")),
)


def chosen(first: int | None = None, only: list[int] | None = None) -> list[Step]:
    return [s for s in STEPS if (only is None or s.number in only) and (first is None or s.number >= first)]


def dry_run(steps: list[Step] | None = None) -> list[tuple[int, str, bool]]:
    """(step, query, whether it is registered), without running anything."""
    from .registry import QUERIES

    return [(s.number, q, q in QUERIES) for s in steps or STEPS for q in s.queries]


def run(spark: SparkSession, sf_dir: str, out: str, steps: list[Step]) -> bool:
    """Write every query of the steps as JSON below out; stops at the first failure."""
    from .registry import QUERIES

    for step in steps:
        for name in step.queries:
            began = time.time()
            try:
                QUERIES[name](spark, sf_dir).write.mode("overwrite").json(f"{out}/step{step.number:02d}/{name}")
            except Exception as e:  # noqa: BLE001  reported, and ends the run
                print(f"step {step.number} {step.name}: {name} failed: {e}", file=sys.stderr)
                return False
            print(f"step {step.number} {step.name}: {name} {time.time() - began:.1f} s")
    return True


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("sf_dir")
    p.add_argument("out")
    p.add_argument("--from-step", type=int)
    p.add_argument("--steps", type=int, nargs="*")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    steps = chosen(a.from_step, a.steps)
    if a.dry_run:
        found = dry_run(steps)
        print("\n".join(f"step {n}: {q}{'' if ok else ' is missing'}" for n, q, ok in found))
        return int(not all(ok for *_, ok in found))
    return int(not run(SparkSession.builder.getOrCreate(), a.sf_dir, a.out, steps))


if __name__ == "__main__":
    sys.exit(main())
