"""quillon TTL... [--metrics NAME... | all] [--questions FILE --domain-prefixes P...] [--mds-ontodesigncheck]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.runner import run_assessment


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description="Assesses ontologies in Turtle files.")
    p.add_argument("ttl_files", nargs="+", help="Turtle files")
    p.add_argument("--metrics", nargs="+", help="metric names, or all")
    p.add_argument("--questions", help="competency questions, .json or .md")
    p.add_argument("--domain-prefixes", nargs="+", help="prefixes of domain terms in the questions")
    p.add_argument("--domain-ns-fragments", nargs="+", help="parts of IRIs that mark domain terms")
    p.add_argument("--search-term", help="for searchClass")
    p.add_argument("--mds-ontodesigncheck", action="store_true", help="the preset of six design metrics")
    p.add_argument("--log-file", default="assessment.log")
    p.add_argument("--csv-file", default="assessment_scores.csv")
    return p


def problem(a: argparse.Namespace) -> str:
    if not (a.metrics or a.questions or a.mds_ontodesigncheck):
        return "one of --metrics, --questions and --mds-ontodesigncheck is needed"
    if a.questions and not a.domain_prefixes:
        return "--questions needs --domain-prefixes"
    return ""


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if why := problem(a):
        print(f"error: {why}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    names = "all" if a.metrics and "all" in a.metrics else a.metrics
    run_assessment(spark, a.ttl_files, names, a.questions, a.domain_prefixes, a.domain_ns_fragments, a.search_term, a.mds_ontodesigncheck, a.log_file, a.csv_file)
    return 0
