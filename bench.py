"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores. Each query is run to the end
(its rows are written to the noop sink) after a warm-up that compiles nothing of its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from scriptorium import catalogue
from scriptorium.session import get_spark

HEADLINE = [
    "quality_profile", "top_ngram_share", "duplicate_blocks_topk", "word_counts", "dict_hit_rate", "char_histogram", "char_conservation_diff", "ledger_reason_totals", "ledger_replay", "budget_check",
    "conservation_unaccounted", "invariant_overlap", "masked_line_keys", "benchmark_needles", "furniture_repetition", "folio_constants", "continuity_rate", "doc_lexicon", "dehyphen_decisions", "style_clusters",
    "caption_nearest", "note_links", "pack_260k", "page_blocks", "page_class", "wilson_by_source", "mcnemar_by_lang", "risk_coverage", "prf_by_source", "kendall_tau", "session_windows", "windowed_counts", "repair_plan", "escalation_verdicts",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        try:
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # a failed query must not hide the others
            print(f"{name}: {str(e)[:200]}", file=sys.stderr)
            continue
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
