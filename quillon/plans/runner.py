"""The unified run: task-based rows first, then each file's metrics, isolated from each other's failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, task
from ..sources import text
from . import report
from .kg import KnowledgeGraph

DESIGN_CHECK = ["checkLabel", "definitionCheck", "semanticConnection", "classCapitalCheck", "classSpaceCheck", "duplicateLabels"]
SKIPPED = {"Score": "N/A", "Status": "Skipped (--search-term not provided)"}


def task_based(spark: SparkSession, ttl_files, questions, domain_prefixes: list[str], domain_ns_fragments: list[str] | None = None) -> dict:
    """Relevance and accuracy of the files as one graph, with counts and the missing and unused terms."""
    files = [ttl_files] if not isinstance(ttl_files, (list, tuple)) else list(ttl_files)
    kg = KnowledgeGraph.read(spark, files, merged=True)
    broken = kg.errors.first()
    if broken:
        raise ValueError(f"{broken.graph_id}: {broken.error}")
    have, need = task.ontology_terms(kg.triples, domain_ns_fragments), task.task_terms(text.questions(spark, questions), list(domain_prefixes))
    x = task.compare(have, need).persist()
    s = task.relevance_accuracy(have, need).first()
    side = lambda name: {r.term for r in x.where(F.col("side") == name).select("term").toLocalIterator()}
    return {"relevance": s.relevance, "accuracy": s.accuracy, "T_o_count": s.t_o, "T_a_count": s.t_a, "intersection": s.common, "missing_from_onto": side("missing"), "unused_in_onto": side("unused")}


def task_rows(result: dict) -> list[dict]:
    values = (("Relevance", f"{result['relevance']:.4f}"), ("Accuracy", f"{result['accuracy']:.4f}"), ("T_o_count", result["T_o_count"]), ("T_a_count", result["T_a_count"]), ("Intersection", result["intersection_count"]))
    return [{"Metric": m, "Score": s, "Status": "Success"} for m, s in values]


def run_metrics(kg: KnowledgeGraph, names: list[str], search_term: str | None = None, options: dict[str, dict] | None = None, details: bool = False) -> list[dict]:
    """Rows (graph_id, Metric, Score, Status), graph by graph; a metric is one plan over all graphs."""
    graphs = [r.graph_id for r in kg.graphs.toLocalIterator()]
    broken = {r.graph_id: r.error for r in kg.errors.toLocalIterator()}
    rows: dict[tuple, dict] = {}
    known = []
    for name in names:
        if name not in metrics.METRICS:
            report.log.warning("unknown metric %s is left out", name)
            continue
        known.append(name)
        if name == "searchClass" and search_term is None:
            report.log.warning("searchClass is left out: --search-term is not given")
            rows |= {(g, name): dict(SKIPPED) for g in graphs}
            continue
        kwargs = dict((options or {}).get(name, {}))
        if name == "searchClass":
            kwargs["search_term"] = search_term
        try:
            r = metrics.METRICS[name](kg, **kwargs)
            if r is None:  # an option that the metric has logged as invalid
                continue
            failed = {x.graph_id: x.error for x in r.failed.toLocalIterator()} if r.failed is not None else {}
            for x in r.score.toLocalIterator():
                rows[x.graph_id, name] = {"Score": "N/A", "Status": f"Error: {failed[x.graph_id]}"} if x.graph_id in failed else {"Score": x.score, "Status": "Success"}
            if details:
                report.log_details(name, r.details)
        except Exception as e:
            rows |= {(g, name): {"Score": "N/A", "Status": f"Error: {e}"} for g in graphs}
        for g, why in broken.items():
            rows[g, name] = {"Score": None, "Status": "Success"} if name in metrics.LENIENT else {"Score": "N/A", "Status": f"Error: {why}"}
    return [{"graph_id": g, "Metric": n, **rows.get((g, n), {"Score": None, "Status": "Success"})} for g in graphs for n in known]


def run_assessment(spark: SparkSession, ttl_files, metrics_wanted=None, questions=None, domain_prefixes=None, domain_ns_fragments=None, search_term=None, mds_design_check: bool = False, log_file: str = "assessment.log", csv_file: str = "assessment_scores.csv", options: dict | None = None, details: bool = True) -> dict:
    """Runs what is asked and writes the log and the CSV. Returns the task-based result (or None) and all rows."""
    files = [str(f) for f in (ttl_files if isinstance(ttl_files, (list, tuple)) else [ttl_files])]
    names = list(metrics.METRICS) if metrics_wanted == "all" or metrics_wanted == ["all"] else metrics_wanted if isinstance(metrics_wanted, (list, tuple)) else []
    if mds_design_check:
        names = DESIGN_CHECK
    rows, result = [], None
    with report.LogFile(log_file):
        if questions is not None:
            result = task_based(spark, files, questions, domain_prefixes, domain_ns_fragments)
            report.log.info("relevance %.4f, accuracy %.4f, T_o %d, T_a %d; missing: %s; unused: %d", result["relevance"], result["accuracy"], result["T_o_count"], result["T_a_count"], ", ".join(sorted(result["missing_from_onto"])) or "none", len(result["unused_in_onto"]))
            rows += task_rows(result)
        if names:
            rows += run_metrics(KnowledgeGraph.read(spark, files), list(names), search_term, options, details)
        report.results_csv(rows, csv_file)
    if mds_design_check:
        report.prepend_summary(rows, files, log_file)
    return {"task_based": result, "rows": rows}


def results(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return report.results_frame(spark, rows)
