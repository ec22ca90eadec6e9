import csv
import json
import os
import time

import pytest

from quillon import cli
from quillon.functions import text as X
from quillon.functions.terms import MDS, SKOS
from quillon.operators import metrics, task
from quillon.plans import questions, report, runner
from quillon.plans.kg import KnowledgeGraph
from quillon.sources import text as raw
from quillon.streaming.rescore import assess_stream

TTL = f"""@prefix mds: <{MDS}> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
mds:Laser a owl:Class ; rdfs:label "laser" . mds:Power a owl:Class . <http://other/Power> rdfs:label "x" . owl:Thing rdfs:label "thing" . mds:p rdfs:domain mds:Laser .
"""


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "good.ttl").write_text(TTL)
    (tmp_path / "bad.ttl").write_text("@prefix : <http://x/> . :a :b")
    (tmp_path / "q.json").write_text(json.dumps([{"qid": 1, "sparql_query": "xmds:Laser mds:Lamp-x"}, {"qid": 2}, {"sparql_query": ""}]))
    (tmp_path / "q.md").write_text("1\n```sparql\nmds:Laser\n```\n*Expected: 1*\n```sparql\nmds:Power ?x\n```\n")
    return tmp_path


def test_questions(spark, files):
    assert raw.questions(spark, str(files / "q.json")).count() == 1 and raw.questions(spark, files / "q.md").count() == 2
    terms = task.task_terms(raw.questions(spark, str(files / "q.json")), ["mds"])
    assert sorted(r.term for r in terms.collect()) == ["Lamp", "Laser"]
    for wrong in ("q.txt", ("a",), 3):
        with pytest.raises(ValueError):
            raw.questions(spark, wrong)


def test_task_based(spark, files):
    r = runner.task_based(spark, str(files / "good.ttl"), ["?x a mds:Laser ; mds:Lamp ?y"], ["mds"])
    assert (r["T_o_count"], r["T_a_count"], r["intersection"]) == (3, 2, 1) and r["missing_from_onto"] == {"Lamp"} and r["unused_in_onto"] == {"Power", "p"}
    assert r["relevance"] * r["T_a_count"] == r["accuracy"] * r["T_o_count"] == 1
    assert runner.task_based(spark, [str(files / "good.ttl")], [], ["mds"], [MDS[8:14]])["relevance"] == 0.0


def test_run(spark, files):
    out = runner.run_assessment(spark, [files / "good.ttl", files / "bad.ttl"], ["checkLabel", "duplicateLabels", "nonsense", "searchClass", "isolatedElements"], log_file=str(files / "l.log"), csv_file=str(files / "s.csv"))
    got = {(os.path.basename(r["graph_id"]), r["Metric"]): r["Status"] for r in out["rows"]}
    assert got["good.ttl", "duplicateLabels"] == "Success" and got["bad.ttl", "duplicateLabels"].startswith("Error") and got["bad.ttl", "checkLabel"] == "Success"
    assert got["good.ttl", "searchClass"] == "Skipped (--search-term not provided)" and {r["Score"] for r in out["rows"] if r["Metric"] == "searchClass"} == {"N/A"} and got["good.ttl", "isolatedElements"] == "Error: division by zero" and len(got) == 8
    rows = list(csv.reader(open(files / "s.csv")))
    assert rows[0] == ["Metric", "Score", "Status"] and len(rows) == 9 and (files / "l.log").read_text()
    assert runner.run_assessment(spark, files / "good.ttl", "checkLabel", log_file=str(files / "l.log"), csv_file=str(files / "s.csv"))["rows"] == []


def test_preset_and_templates(spark, files):
    log = files / "d.log"
    out = runner.run_assessment(spark, files / "good.ttl", "all", mds_design_check=True, log_file=str(log), csv_file=str(files / "s.csv"), options={"checkLabel": {"export_template": str(files / "missing.csv")}, "altLabelCheck": {"export_template": str(files / "alt.ttl")}, "classCapitalCheck": {"export_template": str(files / "none.csv")}})
    assert [r["Metric"] for r in out["rows"]] == ["checkLabel", "definitionCheck", "semanticConnection", "classCapitalCheck", "classSpaceCheck", "duplicateLabels"]
    assert "Passed: 6  |  Failed: 0  |  Skipped: 0" in log.read_text()
    assert "mds:Power" in (files / "missing.csv").read_text() and not (files / "none.csv").exists()  # nothing to export
    kg = KnowledgeGraph.from_text(spark, TTL + 'mds:Two rdfs:subClassOf mds:Laser ; rdfs:label "two\\nlines" .')
    metrics.check_altlabel(kg, export_template=str(files / "alt.ttl"))
    alt = (files / "alt.ttl").read_text()
    assert '# Class: mds:Two\n# Current label: two lines\nmds:Two skos:altLabel "ADD_ALTERNATIVE_LABEL_HERE" .' in alt
    assert KnowledgeGraph.from_text(spark, f"@prefix mds: <{MDS}> .\n" + alt).values(SKOS + "altLabel").count() == 3  # Turtle that reads
    report.results_csv([], "/nonexistent/x.csv")


def test_cli(files, capsys):
    assert cli.main([str(files / "good.ttl")]) == 1 and cli.main([str(files / "good.ttl"), "--questions", "q.json"]) == 1
    assert cli.problem(cli.parser().parse_args(["a.ttl", "--metrics", "all"])) == ""


def test_question_builder(spark, tmp_path):
    (tmp_path / "q.txt").write_text("\nWhich lasers (high-power) are used with optical fibers and for AND?\n  \nof the\n", encoding="utf-8")
    questions.build_question_json(spark, str(tmp_path / "q.txt"), str(tmp_path / "deep/er/q.json"))
    a, b = json.loads((tmp_path / "deep/er/q.json").read_text())
    assert a["qid"] == 1000000 and [n["id"] for n in a["graph_query"]["nodes"]] == ["mds:LasersHighPower", "mds:OpticalFibers"]
    assert a["graph_query"]["edges"] == [{"start": 1, "end": 0, "relation": "rdfs:subClassOf", "friendly_name": "subclass of"}] and a["commonness"] is None and a["answer"] == []
    assert "SELECT ?lasersHighPower ?opticalFibers\nWHERE {\n  ?lasersHighPower a mds:LasersHighPower ." in a["sparql_query"]
    assert b["num_node"] == 0 and "?concept a mds:Concept ." in b["sparql_query"] and b["graph_query"]["edges"] == []


def test_text_functions(spark):
    from pyspark.sql import functions as F

    x = spark.createDataFrame([('a "x # y" # z', "Tests for Éand x-ray"), ('<i#j> "\\" # k', "")], "l string, q string")
    assert [r[0] for r in x.select(X.strip_comment(F.col("l"))).collect()] == ['a "x # y" ', "<i"]
    assert [r[0] for r in x.select(X.phrases(F.col("q"))).collect()] == [["tests", "éand ray"], []]
    long = spark.createDataFrame([("x" * 50_000 + '"' * 10_001,)], "l string")
    assert long.select(F.length(X.strip_comment(F.col("l")))).first()[0] == 60_001


def test_stream(spark, files):
    (files / "in").mkdir()
    (files / "in/good.ttl").write_text(TTL)
    q = assess_stream(spark, str(files / "in"), str(files / "out"), str(files / "ck"), ["duplicateLabels"])
    q.awaitTermination(120)
    assert q.exception() is None and spark.read.parquet(str(files / "out")).count() == 1


def test_merging_halves_keeps_the_terms(spark, files):
    parts = TTL.split("mds:Power")
    head = TTL.split("mds:Laser")[0]
    (files / "h1.ttl").write_text(parts[0]), (files / "h2.ttl").write_text(head + "mds:Power" + parts[1])
    one = task.ontology_terms(KnowledgeGraph.read(spark, str(files / "good.ttl")).triples)
    two = task.ontology_terms(KnowledgeGraph.read(spark, [str(files / "h1.ttl"), str(files / "h2.ttl")], merged=True).triples)
    assert sorted(one.collect()) == sorted(two.collect())


def test_log_holds_whole_details(spark, tmp_path):
    with report.LogFile(str(tmp_path / "a.log")):
        report.log_details("leafNodeCheck", {"leaves": spark.range(1500)})
    assert len((tmp_path / "a.log").read_text().splitlines()) == 1501


def test_an_empty_search_term_is_one(spark, files):
    kg = KnowledgeGraph.read(spark, [files / "good.ttl"])
    assert [r["Status"] for r in runner.run_metrics(kg, ["searchClass"], "")] == ["Success"]
    assert runner.run_metrics(kg, ["checkLabel"], options={"checkLabel": {"show": "some"}})[0]["Score"] is None


def test_grounding_uses_the_bound_prefixes(spark):
    """A root in the current cco namespace is grounded where the file doesn't bind it; one in the old namespace isn't."""
    head = "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix : <http://x/> . "
    kg = KnowledgeGraph.from_text(spark, head + ":a rdfs:subClassOf <https://www.commoncoreontologies.org/ont00000995> . :b rdfs:subClassOf <http://www.ontologyrepository.com/CommonCoreOntologies/Agent> . :c rdfs:subClassOf <http://purl.obolibrary.org/obo/BFO_0000001> . :d rdfs:subClassOf <" + MDS + "Top> .")
    got = {r.qname: r.connected for r in metrics.semantic_connection(kg, tree=False).details["roots"].collect()}
    assert got == {"cco:ont00000995": True, "<http://www.ontologyrepository.com/CommonCoreOntologies/Agent>": False, "obo:BFO_0000001": True, "mds:Top": False}
