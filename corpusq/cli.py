"""spark-submit corpusq/cli.py --input reviews.json --output scored --min-score 70"""

from __future__ import annotations

import argparse
import importlib.util
import logging
import time
from logging.handlers import RotatingFileHandler

from pyspark.sql import SparkSession

from corpusq.functions.score import CLI
from corpusq.plans.pipeline import scored
from corpusq.sources.readers import read_json

log = logging.getLogger("corpusq")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Score documents and keep those that are ready for an index.")
    p.add_argument("--input", required=True, help="JSON lines or a JSON array")
    p.add_argument("--output", required=True, help="Parquet folder to write")
    p.add_argument("--min-score", type=float, default=70)
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    p.add_argument("--log-file")
    return p.parse_args(argv)


def set_up_log(level: str, path: str | None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(RotatingFileHandler(path, maxBytes=10 << 20, backupCount=5))
    logging.basicConfig(level=level, handlers=handlers, format="%(asctime)s | %(levelname)-8s | %(message)s", force=True)


def preflight(spark: SparkSession, source: str, target: str, packages: tuple[str, ...] = ("numpy", "pandas", "pyarrow", "regex")) -> list[tuple[str, bool]]:
    """(check, passed): packages, the input's existence, whether the output's parent can be written."""
    out = [(f"package {p}", importlib.util.find_spec(p) is not None) for p in packages]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(source)
    out.append((f"input {source}", path.getFileSystem(conf).exists(path)))
    probe = jvm.org.apache.hadoop.fs.Path(target + ".probe")
    fs = probe.getFileSystem(conf)
    try:
        fs.create(probe, True).close()
        out.append((f"output {target}", fs.delete(probe, False)))
    except Exception:
        out.append((f"output {target}", False))
    return out


def run(spark: SparkSession, source: str, target: str, min_score: float = 70) -> int:
    """Score the input, write what reaches min_score and return how many rows that is."""
    failed = [name for name, ok in preflight(spark, source, target) if not ok]
    if failed:
        raise FileNotFoundError("; ".join(failed))
    began = time.time()
    df = scored(read_json(spark, source), type(CLI)(**{**CLI.__dict__, "min_score": min_score}))
    df.write.mode("overwrite").parquet(target)
    n = spark.read.parquet(target).count()
    log.info("kept %s rows in %.1f s", f"{n:,}", time.time() - began)
    return n


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    set_up_log(a.log_level, a.log_file)
    spark = SparkSession.builder.appName("corpusq").getOrCreate()
    try:
        run(spark, a.input, a.output, a.min_score)
    except Exception:
        log.exception("the run failed")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
