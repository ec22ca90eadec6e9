import pytest

from quillon.functions.terms import RDF, XSD
from quillon.sources import turtle


def triples(text):
    return [(s[1], p, o[1]) for s, p, o in turtle.Parser(text).parse().triples]


def test_forms_of_terms():
    p = turtle.Parser('''@prefix : <http://x/> . PREFIX q: <http://q#>
    @base <http://b/d/> .
    :a a q:C ; q:p "one"@en-GB , 'two'^^q:t , """three "q" lines""" , 4 , 4.5 , 4e1 , true , <rel> , q:with-dash ;; .
    [] q:p [ q:p ( 1 :b ) ] . [ q:p :z ] .
    q: q:p "esc \\"x\\" \\u00e9" . :a.b q:p () .''').parse()
    literals = [o[1:] for _, _, o in p.triples if o[0] == "literal"]
    assert literals[:7] == [("one", "en-GB", None), ("two", None, "http://q#t"), ('three "q" lines', None, None), ("4", None, XSD + "integer"), ("4.5", None, XSD + "decimal"), ("4e1", None, XSD + "double"), ("true", None, XSD + "boolean")]
    flat = [(s[1], pred, o[1]) for s, pred, o in p.triples]
    assert ("http://x/a", "http://q#p", "http://b/d/rel") in flat and ("http://x/a", "http://q#p", "http://q#with-dash") in flat
    assert ('http://q#', "http://q#p", 'esc "x" é') in flat
    assert ("http://x/a.b", "http://q#p", RDF + "nil") in flat
    assert sum(pred == RDF + "first" for _, pred, _ in flat) == 2


def test_prefix_bound_again_holds_from_there_on():
    assert triples("@prefix m: <http://1#> . m:a m:p m:b . @prefix m: <http://2#> . m:a m:p m:b .") == [("http://1#a", "http://1#p", "http://1#b"), ("http://2#a", "http://2#p", "http://2#b")]


@pytest.mark.parametrize("text", ["@prefix : <http://x/> . :a :b", ":a :b :c .", "@prefix : <http://x/> . :a :b ( :c .", '@prefix : <http://x/> . :a :b "open .'])
def test_malformed_text_is_an_error_row(text):
    assert [r[1] for r in turtle.rows(text, "g")] == ["error"]


def test_empty_document_has_no_rows():
    assert list(turtle.rows("", "g")) == [] and list(turtle.rows("# only a comment", "g")) == []


def test_data_source(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.ttl").write_text(f"@prefix : <http://{n}/> . :x a :C . :x a :C .")
    spark.dataSource.register(turtle.TurtleSource)
    df = spark.read.format("turtle").option("paths", f"{tmp_path}/a.ttl;{tmp_path}/b.ttl").load()
    assert turtle.triples(df).count() == 2 and turtle.triples(df, merged=True).select("graph_id").distinct().count() == 1
    assert turtle.prefixes(turtle.parse_files(spark, [str(tmp_path / "a.ttl")])).first().ns == "http://a/"
