"""Sinks: the result CSV, the log and its summary, templates for what is missing. Small, so written by the driver."""

from __future__ import annotations

import csv
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("quillon")


def _csv(df: DataFrame, columns: dict[str, str], order: list[str], path: str) -> None:
    rows = df.orderBy(*order).select(*[F.col(c).alias(n) for n, c in columns.items()]).toLocalIterator()
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(columns)
        w.writerows(rows)


def missing_labels_csv(classes: DataFrame, path: str) -> None:
    _csv(classes.withColumn("missing", F.lit("MISSING")), {"class_uri": "s", "class_name": "qname", "rdfs_label": "missing"}, ["s"], path)


def capital_csv(classes: DataFrame, path: str) -> None:
    _csv(classes, {"class_uri": "s", "class_name": "qname", "local_name": "local_name"}, ["s"], path)


def space_csv(errors: DataFrame, path: str) -> None:
    _csv(errors, {"class_name": "class_name", "line_number": "line_number", "line_text": "line_text"}, ["line_number"], path)


def altlabel_template(classes: DataFrame, path: str) -> None:
    """Turtle with a place for each missing alternative label, by prefixed name; the preferred label where it differs, on one line."""
    one_line = F.regexp_replace("preferred", r"[\r\n\x0b\x0c\x85\u2028\u2029]+", " ")
    label = F.when(F.col("preferred") != F.col("qname"), F.concat(F.lit("# Current label: "), one_line, F.lit("\n"))).otherwise(F.lit(""))
    text = classes.orderBy("qname").select(F.concat(F.lit("# Class: "), F.col("qname"), F.lit("\n"), label, F.col("qname"), F.lit(' skos:altLabel "ADD_ALTERNATIVE_LABEL_HERE" .\n')).alias("t"))
    with open(path, "w", encoding="utf-8") as f:
        f.write("# Classes without a skos:altLabel: put a label in each place.\n\n")
        f.write("@prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n\n")
        for r in text.toLocalIterator():
            f.write(r.t + "\n")


def results_csv(rows: list[dict], path: str) -> None:
    """Metric, Score, Status; an error of the file system is logged, not raised."""
    try:
        with open(path, "w", newline="", encoding="utf-8") as f:
            w = csv.DictWriter(f, ["Metric", "Score", "Status"], extrasaction="ignore")
            w.writeheader()
            w.writerows([{k: "" if v is None else v for k, v in r.items()} for r in rows])
    except OSError as e:
        log.error("results not written to %s: %s", path, e)


def results_frame(spark, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r.get("graph_id"), r["Metric"], None if r["Score"] is None else str(r["Score"]), r["Status"]) for r in rows], "graph_id string, metric string, score string, status string")


def prepend_summary(rows: list[dict], files: list[str], path: str) -> None:
    """A summary of a design run before the log's text."""
    failed = [r for r in rows if str(r["Status"]).startswith("Error")]
    skipped = [r for r in rows if str(r["Status"]).startswith("Skipped")]
    text = ["=" * 60, "Ontology design check: " + ", ".join(files), "=" * 60]
    text += [f"{r['Metric']:<24}{r['Status'] if r in failed or r in skipped else 'PASS' if r['Score'] in (None, '') else r['Score']}" for r in rows]
    text += ["-" * 60, f"  Passed: {len(rows) - len(failed) - len(skipped)}  |  Failed: {len(failed)}  |  Skipped: {len(skipped)}", ""]
    try:
        p = Path(path)
        old = p.read_text(encoding="utf-8") if p.exists() else ""
        p.write_text("\n".join(text) + "\n" + old, encoding="utf-8")
    except OSError:
        pass


class LogFile:
    """Messages to a file that starts empty, and to the console, while it is open."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> LogFile:
        self.handlers = [logging.FileHandler(self.path, mode="w", encoding="utf-8"), logging.StreamHandler()]
        for h in self.handlers:
            h.setFormatter(logging.Formatter("%(levelname)s %(message)s"))
            log.addHandler(h)
        log.setLevel(logging.INFO)
        return self

    def __exit__(self, *error) -> None:
        for h in self.handlers:
            h.close()
            log.removeHandler(h)


def log_details(name: str, details: dict[str, DataFrame]) -> None:
    """Whole detail tables into the log."""
    for part, df in details.items():
        log.info("%s: %s", name, part)
        for r in df.toLocalIterator():
            log.info("  %s", json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))
