"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from vitrina.checks.queries import REGISTRY  # noqa: E402
from vitrina.session import drop_working_tables, local_session  # noqa: E402

# Work per query whose result is large is measured by an aggregate over every value.
HEADLINES = (
    "normalize_v4",
    "word_counts",
    "ngrams_3",
    "vocab_words",
    "vocab_3gram",
    "vocab_per_category",
    "assembled_vector",
    "chisq_select",
    "percentile_global",
    "trim_parent_5_95",
    "trim_rank_ties",
    "nb_predict",
    "nb_predict_multinomial",
    "nb_hier_model",
    "nb_cascade",
    "holdout_by_group",
    "minmax_embeddings",
    "logreg",
)


def consume(df: DataFrame) -> int:
    """Compute every column of every row and return the number of rows."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).alias("hash"),
    ).first()
    return row["rows"]


def timed(spark: SparkSession, sf_dir: str, fn: Callable[[SparkSession, str], DataFrame]) -> float:
    start = time.perf_counter()
    consume(fn(spark, sf_dir))
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the JVM's worker threads
    wanted = sys.argv[1:] or HEADLINES
    seconds = {name: timed(spark, sf_dir, REGISTRY[name]) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    drop_working_tables(spark)
    spark.stop()


if __name__ == "__main__":
    main()
