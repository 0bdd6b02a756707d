"""Commands: `python -m corpusloom.plans.commands NAME …`, or through spark-submit. The exit status is part of each."""

from __future__ import annotations

import argparse
import json
import os
import pathlib
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import cleaning, dedup, evidence, generation, manifest, retrieval, splits, stress, validation
from ..sources import files

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "split", "question", "answer", "context", "evidence_span", "evidence_unit_id", "doc_id", "section", "source_sha256", "qtype", "difficulty")]
    + [T.StructField(n, T.IntegerType()) for n in ("context_start", "context_end", "evidence_start", "evidence_end")]
)


def _spark() -> SparkSession:
    return SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _save(path: str, text: str) -> None:
    pathlib.Path(path).parent.mkdir(parents=True, exist_ok=True)
    pathlib.Path(path).write_text(text + "\n", encoding="utf-8")


def preprocess_markdown(a) -> int:
    raw = files.read_markdown(_spark(), a.input).select(F.col("stem").alias("doc_id"), "text").persist()
    cleaned = cleaning.clean_documents(raw).persist()
    files.write_markdown(cleaned.withColumnRenamed("doc_id", "stem"), a.output)
    counts = {r.action: r.n for r in cleaning.rule_counts(raw).collect()}
    report = json.loads(files.report_json(cleaning.cleaning_report(raw, cleaned))) | {"rules": counts}
    if a.report:
        _save(a.report, json.dumps(report, indent=2))
    print(json.dumps(report))
    return 0


def build_source_manifest(a) -> int:
    spark = _spark()
    m = manifest.build_manifest(files.read_markdown(spark, a.raw_dir), files.read_markdown(spark, a.cleaned_dir, cleaned_only=True)).orderBy("doc_id").persist()
    files.write_jsonl(m, a.output, "overwrite")
    print(json.dumps([r.asDict() for r in manifest.manifest_summary(m).collect()]))
    return 0


def build_evidence_corpus(a) -> int:
    docs = files.read_markdown(_spark(), a.cleaned_dir, cleaned_only=True).select(files.doc_id(F.col("stem")).alias("doc_id"), "text")
    corpus = evidence.evidence_corpus(docs, a.min_chars, a.max_chars).persist()
    files.write_jsonl(corpus, a.output, "overwrite")
    print(json.dumps(evidence.evidence_summary(corpus).first().asDict()))
    return 0


def services(a, env: dict[str, str]) -> tuple[dict, dict, dict]:
    """Settings of the generator and of the verifier, and options for both. The verifier's model: the flag's, else LOOM_VERIFIER_MODEL, else the generator's."""
    generator = generation.model_settings(env, "LOOM")
    if a.temperature >= 0:
        generator["temperature"] = a.temperature
    model = a.verifier_model or env.get("LOOM_VERIFIER_MODEL")
    verifier = {**generator, "model": model, "temperature": generator.get("temperature", 0.0)} if model else generator
    # Labels are made without a hidden budget for reasoning, so that a reply is all that the model put out.
    return generator, verifier, generation.reasoning_options("none", env.get("LOOM_EXTRA_BODY"))


def saver(folder: str):
    """Keeps what was paid for in tables of a folder; a run that is repeated there goes on from what it has."""
    count = iter(range(1 << 30))

    def save(df: DataFrame) -> DataFrame:
        path = f"{folder}/step-{next(count)}"
        spark = df.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def make_dataset(docs: DataFrame, config: generation.Config, run_id: str, generator=None, verifier=None, names: tuple[str, str] = ("offline", "offline"), save=None, options: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Records with ord and outcome, the funnel of stages, and the use of tokens, of documents by providers; without them by the offline generator, which uses none."""
    units = evidence.evidence_units(docs, config.min_chars, config.max_chars)
    used = None
    if generator:
        checked, calls = generation.generate(units, generator, verifier, config, save or (lambda df: df.persist()))
        used = generation.usage(calls)
    else:
        checked = generation.check_candidates(generation.offline_candidates(units), config.grounding)
        if config.verify:
            checked = generation.verified(checked, generation.offline_verdict())
        if config.round_trip:
            checked = generation.round_trip(checked, F.col("reply"), config.round_trip_f1)
    checked = checked.persist()
    hashed = docs.select("doc_id", tx.sha256_text(F.col("text")).alias("sha"))
    made = generation.records(checked.join(hashed, "doc_id"), F.col("sha"), generation.provenance(config, run_id, *names, options))
    ordered = made.withColumn("ord", F.struct("doc_id", "context_start", "evidence_start", "qtype"))
    return dedup.deduplicate(_numbered(ordered), config.jaccard), generation.funnel(checked).unionByName(units.agg(F.count("*").alias("n")).select(F.lit("evidence_units").alias("stage"), "n")), used


def _numbered(ordered: DataFrame) -> DataFrame:
    """`ord` as a number that keeps the order of documents and places: counted within range partitions."""
    from pyspark.sql import Window

    ranged = ordered.repartitionByRange("ord").withColumn("part", F.spark_partition_id()).persist()
    sizes = ranged.groupBy("part").agg(F.count("*").alias("c"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")  # a row for each partition
    within = F.row_number().over(Window.partitionBy("part").orderBy("ord")) - 1
    return ranged.withColumn("within", within).join(F.broadcast(starts), "part").withColumn("ord", F.col("start") + F.col("within")).drop("part", "start", "within")


def generate_qac(a) -> int:
    spark = _spark()
    docs = files.read_markdown(spark, a.input, limit=a.limit).select(files.doc_id(F.col("stem"), "anywhere").alias("doc_id"), "text").persist()
    if docs.limit(1).count() == 0:
        print("no input", file=sys.stderr)
        return 1
    config = generation.Config(min_chars=a.min_chars, max_chars=a.max_chars, per_unit=a.per_unit, verify=not a.no_verify, round_trip=not a.no_roundtrip, seed=a.seed, pace=a.pace)
    run_id = a.run_id or time.strftime("%Y%m%d-%H%M%S")
    if a.dry_run:
        outcome, stages, used = make_dataset(docs, config, run_id)
        names = ("offline", "offline")
    else:
        asked, checks, options = services(a, dict(os.environ))
        names = (asked.get("model", "default"), checks.get("model", "default"))
        # A verdict is structured; the answer to a question again isn't, so its provider asks for no format.
        providers = generation.http_provider(asked, options), generation.http_provider(checks, options, structured=False)
        outcome, stages, used = make_dataset(docs, config, run_id, *providers, names=names, save=saver(os.path.join(a.output, f"calls-{run_id}")), options=options)
    outcome = outcome.persist()
    stages = stages.unionByName(outcome.where("outcome <> 'kept'").groupBy(F.col("outcome").alias("stage")).agg(F.count("*").alias("n")))
    kept = splits.ordered(splits.split_by_document(outcome.where("outcome = 'kept'").drop("outcome"), config.train, config.dev, config.seed)).drop("ord", "turn").withColumnRenamed("place", "ord").persist()
    files.write_splits(kept, a.output)
    report = splits.build_report(kept.withColumn("ord", F.xxhash64("split", "ord")), stages, generation.asdict(config), {"generator": names[0], "verifier": names[1]})
    text = files.report_json(report)
    if used is not None:
        text = json.dumps(json.loads(text) | {"usage": used.first().asDict()}, indent=2, ensure_ascii=False)
    _save(os.path.join(a.output, "qac_report.json"), text)
    return 0


def validate_qac(a) -> int:
    spark = _spark()
    docs = files.read_markdown(spark, a.cleaned_dir, cleaned_only=True).select(files.doc_id(F.col("stem")).alias("doc_id"), "text")
    report = validation.validation_report(validation.validate_dataset(files.read_jsonl_tolerant(spark, a.qac_jsonl, RECORD), docs))
    text = files.report_json(report)
    if a.report:
        _save(a.report, text)
    print(text)
    return int(json.loads(text)["invalid"] > 0)


def build_stress_set(a) -> int:
    rows = files.read_jsonl(_spark(), a.qac_jsonl, RECORD).withColumn("ord", F.monotonically_increasing_id())  # of one read, whose order it keeps
    fixtures = stress.build_fixtures(rows.persist()).persist()
    files.write_jsonl(fixtures, a.output, "overwrite")
    print(json.dumps({r.fixture_type: r.n for r in stress.fixture_counts(fixtures).collect()}))
    return 0


def parse_batch(a) -> int:
    """Files through a parser, named as module:function from (path, content) to Markdown; those that fail are logged. 1 if any did."""
    import importlib

    module, _, function = a.parser.partition(":")
    parsed = files.parse_files(_spark(), a.input, getattr(importlib.import_module(module), function), a.glob).persist()
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    files.write_markdown(parsed.where("error IS NULL").select(stem.alias("stem"), F.col("markdown").alias("text")), a.output, "")
    bad = files.failed(parsed)
    files.write_jsonl(bad, os.path.join(a.output, "failed"), "overwrite")
    return int(bad.limit(1).count() > 0)


def evaluate_bm25(a) -> int:
    spark = _spark()

    def read(path):
        rows = files.read_jsonl(spark, path, RECORD).withColumn("ord", F.monotonically_increasing_id())
        return rows.select("ord", F.col("ord").alias("query_id"), F.col("evidence_unit_id").alias("unit_id"), F.col("question").alias("text"), "context").persist()

    corpus = read(a.corpus).select("unit_id", F.col("context").alias("text"), "ord") if a.corpus else None
    report = retrieval.evaluate(read(a.qac_jsonl), corpus, "ord")
    _save(a.report, files.report_json(report))
    return 0


def preflight_experiment(a) -> int:
    errors = validation.preflight(dict(os.environ), a.qac, a.corpus, a.run_id, a.budget_usd)
    _save(a.report, json.dumps({"ready": not errors, "errors": errors}, indent=2))
    return 2 if errors else 0


COMMANDS = {
    "preprocess_markdown": (preprocess_markdown, [("-i", "--input", "data/markdown"), ("-o", "--output", "data/cleaned"), ("--report", None)]),
    "build_source_manifest": (build_source_manifest, [("--raw-dir", "data/markdown"), ("--cleaned-dir", "data/cleaned"), ("--output", "outputs/source_manifest.jsonl")]),
    "build_evidence_corpus": (build_evidence_corpus, [("--cleaned-dir", "data/cleaned"), ("--output", "outputs/evidence_corpus.jsonl"), ("--min-chars", 200), ("--max-chars", 1500)]),
    "generate_qac": (
        generate_qac,
        [("-i", "--input", "data/cleaned"), ("-o", "--output", "outputs/qac"), ("--limit", 0), ("--per-unit", 3), ("--min-chars", 200), ("--max-chars", 1500), ("--no-verify", False), ("--no-roundtrip", False), ("--verifier-model", None), ("--seed", 42), ("--pace", 0.0), ("--temperature", -1.0), ("--dry-run", False), ("--run-id", None)],
    ),
    "validate_qac": (validate_qac, [("qac_jsonl",), ("--cleaned-dir", "data/cleaned"), ("--report", None)]),
    "build_stress_set": (build_stress_set, [("qac_jsonl",), ("--output", ...)]),
    "parse_batch": (parse_batch, [("-i", "--input", "data/files"), ("-o", "--output", "data/markdown"), ("--parser", ...), ("--glob", "*")]),
    "evaluate_bm25": (evaluate_bm25, [("qac_jsonl",), ("--corpus", None), ("--report", ...)]),
    "preflight_experiment": (preflight_experiment, [("--qac", ...), ("--corpus", ...), ("--run-id", ...), ("--report", ...), ("--budget-usd", 0.0)]),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom")
    names = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        p = names.add_parser(name)
        for o in options:
            if len(o) == 1:
                p.add_argument(o[0])
            elif o[-1] is ...:
                p.add_argument(*o[:-1], required=True)
            elif o[-1] is False:
                p.add_argument(*o[:-1], action="store_true")
            else:
                p.add_argument(*o[:-1], default=o[-1], type=str if o[-1] is None else type(o[-1]))
    a = parser.parse_args(argv)
    return COMMANDS[a.command][0](a)


if __name__ == "__main__":
    sys.exit(main())
