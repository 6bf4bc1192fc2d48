"""Headline timings: the two pipeline stages on all documents, and the main queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from newsgraph.operators.ingest import map_articles  # noqa: E402
from newsgraph.operators.rdf import write_triples  # noqa: E402
from newsgraph.operators.sinks import write_documents  # noqa: E402
from newsgraph.operators.snapshot import append_articles, latest_snapshot, read_articles  # noqa: E402
from newsgraph.operators.triples import article_documents, article_triples  # noqa: E402
from newsgraph.plans import tables  # noqa: E402
from newsgraph.plans.queries import QUERIES  # noqa: E402
from newsgraph.session import build_session, clean_scratch, scratch_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "latest_snapshot_join",
    "latest_snapshot_window",
    "clean_parse",
    "clean_reject_reasons",
    "triples_article",
    "triples_custom",
    "triples_url_centric",
    "turtle_documents",
    "bgp_domain_label",
    "bgp_domain_url_body_label",
    "ner_rule_entities",
    "ner_gazetteer",
    "triples_ner",
    "label_summary",
    "reused_bodies",
    "domain_multi_label_flag",
    "reconcile_stores",
    "profile_columns",
    "bench_summary",
    "bench_ols",
    "sample_fixed_size",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = scratch_dir(spark, "bench")

    def stage_1() -> None:
        """Source rows -> standard articles with hashes, appended to the article table."""
        accepted, _ = map_articles(tables.raw_articles(spark, SF_DIR), tables.CONFIG, tables.FIRST_LOAD)
        append_articles(accepted, f"{out}/articles", "1")

    def stage_2_documents() -> None:
        """Article table -> latest snapshot -> one document per article, written."""
        rows = read_articles(spark, f"{out}/articles")
        unique = latest_snapshot(rows, unique=True)
        write_documents(article_documents(unique), f"{out}/documents")

    def stage_2_triples() -> None:
        """Article table -> latest snapshot -> triples table, written."""
        rows = latest_snapshot(read_articles(spark, f"{out}/articles"))
        write_triples(article_triples(rows, with_custom=True), f"{out}/triples")

    times = {
        "stage_1_ingest": timed(stage_1),
        "stage_2_documents": timed(stage_2_documents),
        "stage_2_triples": timed(stage_2_triples),
    }
    for name in HEADLINE:
        times[name] = timed(lambda name=name: run(QUERIES[name](spark, SF_DIR)))
    result = {
        "metric": "total time of the pipeline stages and headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }
    clean_scratch(spark)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
