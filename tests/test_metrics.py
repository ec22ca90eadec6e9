import pytest
from pyspark.sql import functions as F

from quillon.functions import terms as T
from quillon.operators import fixpoint, metrics as M
from quillon.plans.kg import KnowledgeGraph
from quillon.sources import probe

HEAD = """@prefix : <http://ex/#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix cco: <https://www.commoncoreontologies.org/> . @prefix dcat: <http://www.w3.org/ns/dcat#> .
"""


def kg(spark, text):
    return KnowledgeGraph.from_text(spark, HEAD + text)


def names(df, column="s"):
    return sorted(r[0].rpartition("#")[2] for r in df.select(column).collect())


def score(result):
    return result.score.first().score


def test_named_classes_and_coverage(spark):
    g = kg(spark, ''':A a owl:Class ; rdfs:label "a"@en ; skos:definition " " ; skos:altLabel " ", "x" . :B rdfs:subClassOf :A ; rdfs:label " " ; skos:definition "" . :c a rdfs:Class .
    [ a owl:Class ] rdfs:subClassOf :D .''')
    assert names(g.named_classes) == ["A", "B", "D", "c"]
    assert names(M.check_label(g).details["with"]) == ["A"] and M.check_label(g).details["with"].first().labels == ['"a"@en']
    assert names(M.check_definition(g).details["with"]) == ["A"]  # a blank definition is present, an empty one isn't
    alt = M.check_altlabel(g).details
    assert alt["with"].first().altlabels == ["x"] and alt["summary"].first().grade == "Low"
    assert names(M.check_capital(g).details["without"]) == ["c"]
    assert M.check_label(g, show="some") is None  # logged, not raised
    assert set(M.check_label(g, show="without").details) == {"without", "summary"}


def test_leaf_broader_counts_only_when_asked(spark):
    g = kg(spark, ":A a owl:Class . :B a owl:Class ; skos:broader :A . [] a owl:Class ; owl:unionOf (:A :B) .")
    leaves = M.leaf_nodes(g).details["leaves"]
    assert leaves.count() == 3 and leaves.where("s_kind = 'bnode'").count() == 1
    assert M.leaf_nodes(g, include_broader=True).details["leaves"].count() == 2


def test_duplicates_count_label_triples(spark):
    g = kg(spark, ':A a owl:Class ; rdfs:label "Same", "other" . :B a owl:Class ; rdfs:label " " . :C a owl:Class ; rdfs:label "" . :D rdfs:label "same" .')
    r = M.duplicate_labels(g)
    assert score(r) == "2" and {(x.label, x.n) for x in r.details["duplicates"].collect()} == {("same", 2), ("", 2)}


def test_components(spark):
    g = kg(spark, ":A a owl:Class . :B a owl:Class ; rdfs:subClassOf :A . :C a owl:Class ; skos:broader :B . :D a owl:Class . :E a owl:Class ; rdfs:subClassOf :A, [ a owl:Restriction ] . :F a rdfs:Class ; rdfs:subClassOf :A .")
    assert score(M.class_components(g)) == "2"


def test_isolated(spark):
    g = kg(spark, """:A a owl:Class . :B a owl:Class ; rdfs:subClassOf :Undeclared . :C a owl:Class ; rdfs:subClassOf [ owl:unionOf ( :A ) ] .
    :D a owl:Class ; rdfs:subClassOf [ a owl:Restriction ] . :E a owl:Class . :p a owl:ObjectProperty ; rdfs:domain :E . :q a owl:DatatypeProperty ; skos:broader :p . :r a owl:ObjectProperty .""")
    r = M.isolated_elements(g)
    assert names(r.details["classes"]) == ["A", "B"]  # C is tied through the expression, A inside it isn't
    assert names(r.details["properties"]) == ["r"] and r.failed.isEmpty()
    assert M.isolated_elements(kg(spark, ":A a owl:Class .")).failed.first().error == "division by zero"


def test_hierarchy(spark):
    g = kg(spark, "cco:Top a owl:Class . :B rdfs:subClassOf cco:Top . :C rdfs:subClassOf cco:Top . :D rdfs:subClassOf :C, :B . :X rdfs:subClassOf :Y . :Y rdfs:subClassOf :X . :Z rdfs:subClassOf :Lone .")
    d = M.semantic_connection(g).details
    s = d["statistics"].first()
    assert (s.edges, s.parents, s.roots, s.grounded) == (7, 6, 2, 1)
    tree = [r.node.rpartition("#")[2].rpartition("/")[2] for r in d["tree"].collect()]
    assert tree == [":Lone", ":Z", "Top", "B", "D", "C"] or tree == ["Lone", "Z", "Top", "B", "D", "C"]  # the diamond's end once, under B
    assert M.semantic_connection(kg(spark, ":A a owl:Class ."), tree=False).details["statistics"].isEmpty()


def test_domain_range_and_design(spark):
    g = kg(spark, ":p a owl:ObjectProperty ; rdfs:domain :A . :q a owl:DatatypeProperty .")
    c = M.missing_domain_range(g).details["counts"].first()
    assert (c.properties, c.missing_domain, c.missing_range) == (2, 1, 2)
    m = T.MDS
    r = M.design_check(kg(spark, f':A a owl:Class ; <{m}inDomain> "x" ; <{m}hasStudyStage> "y" . :B a owl:Class ; <{m}inDomain> " ", "z" . [] a owl:Class .'))
    assert r.details["counts"].first().valid == 1 and r.details["counts"].first().total == 3
    assert {x.predicate.rpartition("/")[2]: x.n for x in r.details["missing"].collect()} == {"inDomain": 1, "hasStudyStage": 2}
    assert float(score(M.design_check(kg(spark, "")))) == 0


def test_space_check(spark):
    text = ''':A b a owl:Class . :Good a owl:Class ; rdfs:label "has a owl:Class . inside" .
:X rdfs:label "x" ;
   a owl:Class .
<http://x#y> a owl:Class .
:last a owl:Class ; rdfs:label "never ends"'''
    g = KnowledgeGraph(spark.createDataFrame([], "graph_id string, seq long, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string"), texts=spark.createDataFrame([("g", text)], "graph_id string, text string"), graphs=spark.createDataFrame([("g",)], "graph_id string"))
    e = M.check_space(g).details["errors"].orderBy("line_number").collect()
    assert [(r.class_name, r.line_number) for r in e] == [(":A b", 1), (':X rdfs:label "" ;', 2), ("<http://x :last", 4)]  # the '#' of an IRI cuts its line, so the next one joins it


def test_licence_lives_in_the_raw_text(spark):
    assert score(M.human_license(kg(spark, ":A rdfs:comment 'MIT' ."))) == "0"
    assert score(M.human_license(kg(spark, "@prefix dcterms: <http://purl.org/dc/terms/> . :A dcterms:license :x ."))) == "1"


def test_links_and_probes(spark):
    g = kg(spark, ':A rdfs:seeAlso <http://ex/#B>, <http://other/> . :B dcat:accessURL <http://o/dump.TTL.gz>, <http://o/q> . :C dcat:downloadURL <http://o/dump.TTL.gz> .')
    assert float(score(M.external_links(g, "http://ex/#"))) == pytest.approx(1 / 3)
    assert float(score(M.external_links(g))) == pytest.approx(1 / 3)  # the '' prefix is the base
    assert score(M.external_links(g, "")) == "0.0"
    status = probe.known(spark.createDataFrame([("http://o/dump.TTL.gz", 200), ("http://o/q", 404)], "url string, status int"))
    assert score(M.rdf_dump(g, status)) == "1.0" and score(M.sparql_endpoint(g, status)) == "0.5"
    assert score(M.rdf_dump(kg(spark, ":A a owl:Class ."), status)) == "0"


def test_spelling(spark):
    words = spark.createDataFrame([("laser", 9), ("power", 5), ("pattern", 1), ("lacer", 2)], "word string, freq long")
    r = M.spell_check(kg(spark, ":A rdfs:label 'LaserPower XRD patern BFO', 'laser_power' ."), words)
    c = r.details["counts"].first()
    assert c.checked == 6 and c.errors == 2  # XRD vanishes mid-text, BFO at the end is a word
    assert {x.token: x.correction for x in r.details["corrections"].collect()} == {"patern": "pattern"}


def test_search_uses_the_whole_fragment(spark):
    g = KnowledgeGraph.from_text(spark, "@prefix m: <http://a#https://b/mds/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . m:Foo a owl:Class .")
    assert M.class_search(g, "MDS/f").details["classes"].first().class_name == "https://b/mds/Foo"
    assert names(M.check_capital(g).details["without"]) == ["https://b/mds/Foo"]


def test_lists_and_terms(spark):
    g = kg(spark, ":l0 :p () . :l1 :p ( :a ) . :l3 :p ( :a :b :c ) .")
    heads = g.triples.where("p = 'http://ex/#p'").select("graph_id", F.col("o").alias("head"))
    items = fixpoint.list_items(heads, g.triples, T.RDF)
    assert sorted((r.i, r.item[-1]) for r in items.collect()) == [(0, "a"), (0, "a"), (1, "b"), (2, "c")]
    x = spark.createDataFrame([("http://a#b/c",), ("http://a/b",), ("c",), ("http://a#",)], "u string")
    assert [r[0] for r in x.select(T.task_local(F.col("u"))).collect()] == ["c", "b", "c", ""]
    assert [r[0] for r in x.select(T.naming_local(F.col("u"))).collect()] == ["b/c", "b", "c", ""]


def test_lists_that_run_into_themselves(spark):
    g = kg(spark, ":a rdf:first :x ; rdf:rest :b . :b rdf:first :y ; rdf:rest :c . :c rdf:first :z ; rdf:rest :b .".replace("rdf:", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#").replace("#first", "#first>").replace("#rest", "#rest>"))
    heads = spark.createDataFrame([(g.triples.first().graph_id, "http://ex/#a")], "graph_id string, head string")
    assert sorted((r.i, r.item[-1]) for r in fixpoint.list_items(heads, g.triples, T.RDF).collect()) == [(0, "x"), (1, "y"), (2, "z")]


def test_empty_ontology(spark):
    g = kg(spark, "")
    for name in ("checkLabel", "classConnections", "leafNodeCheck", "semanticConnection", "duplicateLabels", "missingDomainRange", "externalLinks"):
        M.METRICS[name](g).score.collect()
