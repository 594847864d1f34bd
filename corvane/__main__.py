"""Command line: python -m corvane COMMAND."""

from __future__ import annotations

import argparse
import datetime
import os
import sys

from corvane.logs import get_logger


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    make = commands.add_parser("makedataset", help="turn a folder of documents into chunk files")
    make.add_argument("source")
    make.add_argument("dest", nargs="?", default="output_json")
    make.add_argument("--limit", type=int, default=1200)
    make.add_argument("--cleaner", choices=("none", "rules", "model"), default="none")
    train = commands.add_parser("trainset", help="turn chunk files into a split training table")
    train.add_argument("model", help="an alias of the registry")
    train.add_argument("source")
    train.add_argument("dest")
    train.add_argument("--tag", default="")
    train.add_argument("--eos", default="</s>")
    train.add_argument("--test-size", type=float, default=0.1)
    commands.add_parser("health", help="versions of what is installed")
    for name in ("search", "dload", "run"):
        scrape = commands.add_parser(name, help={"search": "list catalogue pages", "dload": "download a list's files", "run": "both"}[name])
        scrape.add_argument("base_url")
        scrape.add_argument("--pages", type=int, default=1)
        scrape.add_argument("--files", type=int, default=5)
        scrape.add_argument("--template", help="URL of listing pages with %%d for the page; default <base>/books?page=%%d")
        scrape.add_argument("--list", help="a stored list, for dload")
        scrape.add_argument("--results", default="results")
    return top


def makedataset(spark, a) -> int:
    from pyspark.sql import functions as F

    from corvane.functions import text as X
    from corvane.operators import model
    from corvane.plans import makedataset as plan
    from corvane.sources import files, sinks

    if not os.path.isdir(a.source):
        raise ValueError(f"no folder {a.source}")
    source, dest = os.path.abspath(a.source), os.path.abspath(a.dest)
    # the full relative path names the output, suffix included, so that x.pdf and x.txt don't meet
    finished = None
    if os.path.isdir(dest):
        own = files.scan_folder(spark, f"file://{dest}", "*.json").filter("length > 2").select("path")
        finished = own.select(F.concat(F.lit(f"file:{source}"), F.regexp_replace(F.expr(f"substring(path, {len('file:' + dest) + 1})"), r"\.json$", "")).alias("path"))
    chunks, rejected = plan.make_dataset(spark, source, finished, a.cleaner, model.HttpBackend() if a.cleaner == "model" else None, a.limit)
    local = F.regexp_replace("path", "^file:", "")
    written = sinks.export_json(chunks.withColumn("out_path", F.concat(F.lit(dest), F.substring(local, len(source) + 1, 1 << 30), F.lit(".json"))))
    log = get_logger()
    log.info("%s files written to %s", written.count(), dest)
    for row in rejected.select(X.basename(F.col("path")).alias("name"), "error").distinct().toLocalIterator():
        log.error("%s: %s", row["name"], row["error"])
    return 0


def trainset(spark, a) -> int:
    from pyspark.sql import functions as F

    from corvane.operators import runs
    from corvane.plans import makedataset as plan
    from corvane.session import frozen
    from corvane.sources import files

    checkpoint = runs.checkpoint_of(a.model)
    # equal texts are rows of their own: the frozen number tells them apart
    numbered = frozen(files.read_json_dataset(spark, a.source).withColumn("row", F.monotonically_increasing_id()), "training-rows")
    rows = numbered.withColumn("key", F.concat_ws("|", F.sha2(F.coalesce("text", F.lit("")), 256), F.col("row").cast("string"))).drop("row")
    out = plan.training_table(rows, "key", a.eos, a.test_size)
    out.write.mode("overwrite").partitionBy("split").parquet(os.path.join(a.dest, "table"))
    name = (f"{a.tag}-" if a.tag else "") + "CPT-" + checkpoint.split("/")[-1]
    runs.log_run(spark, os.path.join(a.dest, "runs"), name, f"{name}-{datetime.datetime.now():%Y-%m-%d-%H-%M-%S}", {"checkpoint": checkpoint, "source": a.source, "test_size": a.test_size})
    return 0


def scrape(spark, a) -> int:
    from corvane.operators import catalogue, dataset
    from corvane.session import frozen
    from corvane.sources import files, sinks

    results = os.path.join(a.results, f"{datetime.datetime.now():%Y%m%d_%H%M%S}")
    stored = a.list
    if a.command in ("search", "run"):
        pages = frozen(catalogue.fetch_pages(spark, a.template or a.base_url.rstrip("/") + "/books?page=%d", a.pages), "listing-pages")  # each page is asked for once
        books = catalogue.listing(pages.filter("error IS NULL"), a.base_url).orderBy("page", "idx")
        stored = sinks.write_catalogue(books.drop("page", "idx"), os.path.join(results, "books"))
        get_logger().info("list saved at %s", stored)
    if a.command in ("dload", "run"):
        from pyspark.sql import functions as F

        books = files.read_catalogue(spark, stored).withColumn("__at", F.monotonically_increasing_id())
        got = catalogue.download(dataset.head(books, a.files, "__at"), os.path.abspath(os.path.join(results, "downloads")), a.base_url)
        for row in got.toLocalIterator():
            get_logger().info("%s: %s", row["url"], row["status"])
    return 0


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "health":
        from corvane.operators.runs import health

        for name, version in health().items():
            print(f"{name}: {version or 'not installed'}")
        return 0
    from pyspark.sql import SparkSession

    from corvane.session import ship

    spark = ship(SparkSession.builder.appName("corvane").getOrCreate())
    return {"makedataset": makedataset, "trainset": trainset}.get(a.command, scrape)(spark, a)


if __name__ == "__main__":
    sys.exit(main())
