"""Registered queries of the assessment's operators over the tables, and SQL that states each independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import terms as T
from .functions import text as X
from .operators import fixpoint, metrics, task
from .plans import questions as builder
from .plans.kg import KnowledgeGraph
from .sources import probe, tables
from .sources import text as raw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BASE = tables.BASE
NAMED = f"""named AS (SELECT DISTINCT s FROM (SELECT s FROM t WHERE s_kind = 'iri' AND ((p = '{T.TYPE}' AND o IN ('{T.OWL}Class', '{T.RDFS}Class')) OR p = '{T.SUBCLASS}')
 UNION ALL SELECT o AS s FROM t WHERE o_kind = 'iri' AND p = '{T.SUBCLASS}') x)"""
QNAME = f"CASE WHEN starts_with(s, '{BASE}') THEN concat('ex:', substr(s, {len(BASE) + 1})) ELSE concat('<', s, '>') END"


def query(oracle: str | None = None, ctes: tuple = (), triples: str = tables.TRIPLES):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            rec = "RECURSIVE " if "UNION\n" in oracle or any("UNION\n" in c for c in ctes) else ""
            ORACLES[f.__name__] = f"WITH {rec}t AS ({triples})" + "".join(f", {c}" for c in ctes) + "\n" + oracle
        return f

    return add


def _summary(df: DataFrame) -> DataFrame:
    return df.select("total", F.col("with").alias("n_with"), F.col("without").alias("n_without"), F.round("percent", 1).alias("percent"), "grade")


def _coverage_sql(has: str) -> str:
    pct = "(CASE WHEN total > 0 THEN n_with * 100.0 / total ELSE 0 END)"
    return f"""SELECT total, n_with, total - n_with AS n_without, round(CAST({pct} AS DOUBLE), 1) AS percent,
 CASE WHEN {pct} >= 90 THEN 'Excellent' WHEN {pct} >= 75 THEN 'Good' WHEN {pct} >= 50 THEN 'Moderate' WHEN {pct} >= 25 THEN 'Low' ELSE 'Very low' END AS grade
 FROM (SELECT count(*) AS total, count(h.s) AS n_with FROM named n LEFT JOIN (SELECT DISTINCT s FROM {has}) h ON n.s = h.s) c"""


@query("SELECT s FROM named", (NAMED,))
def named_classes(spark, d):
    return tables.graph(spark, d).named_classes.select("s")


@query(_coverage_sql(f"t WHERE p = '{T.LABEL}' AND trim(o) <> ''"), (NAMED,))
def label_coverage(spark, d):
    return _summary(metrics.check_label(tables.graph(spark, d)).details["summary"])


@query(_coverage_sql(f"t WHERE p = '{T.SKOS}altLabel' AND trim(o) <> ''"), (NAMED,))
def altlabel_coverage(spark, d):
    return _summary(metrics.check_altlabel(tables.graph(spark, d)).details["summary"])


@query(_coverage_sql(f"t WHERE p = '{T.SKOS}definition' AND o <> ''"), (NAMED,))
def definition_coverage(spark, d):
    return _summary(metrics.check_definition(tables.graph(spark, d)).details["summary"])


@query(_coverage_sql(f"named WHERE substr(s, {len(BASE) + 1}, 1) BETWEEN 'A' AND 'Z'"), (NAMED,))
def capital_check(spark, d):
    return _summary(metrics.check_capital(tables.graph(spark, d)).details["summary"])


@query(f"SELECT n.s, coalesce(l.o, {QNAME.replace('(s', '(n.s').replace(' s,', ' n.s,')}) AS preferred FROM named n LEFT JOIN (SELECT s, o FROM t WHERE p = '{T.LABEL}' AND seq = 1 AND o <> '') l ON n.s = l.s", (NAMED,))
def preferred_label(spark, d):
    kg = tables.graph(spark, d)
    return kg.labels(kg.named_classes).select("s", "preferred")


@query(f"SELECT DISTINCT s, s_kind FROM t WHERE p = '{T.TYPE}' AND o IN ('{T.OWL}Class', '{T.RDFS}Class') AND s NOT IN (SELECT o FROM t WHERE p = '{T.SUBCLASS}')")
def leaf_nodes(spark, d):
    return metrics.leaf_nodes(tables.graph(spark, d)).details["leaves"].select("s", "s_kind")


ROOTS = f"roots AS (SELECT s FROM named WHERE s NOT IN (SELECT s FROM t WHERE p = '{T.SUBCLASS}' AND s_kind = 'iri' AND o_kind = 'iri'))"


@query("SELECT s FROM roots", (NAMED, ROOTS))
def root_classes(spark, d):
    return tables.graph(spark, d).roots.select("s")


@query(f"SELECT e.edges, e.parents, r.roots, CAST(0 AS BIGINT) AS grounded, CAST(0 AS DOUBLE) AS ratio FROM (SELECT count(*) AS edges, count(DISTINCT o) AS parents FROM t WHERE p = '{T.SUBCLASS}' AND s_kind = 'iri' AND o_kind = 'iri') e, (SELECT count(*) AS roots FROM roots) r", (NAMED, ROOTS))
def hierarchy_stats(spark, d):
    x = metrics.semantic_connection(tables.graph(spark, d), tree=False).details["statistics"]
    return x.select("edges", "parents", "roots", "grounded", F.col("ratio").cast("double").alias("ratio"))


@query("SELECT root, node, level FROM walk", (NAMED, ROOTS, f"walk AS (SELECT s AS root, s AS node, 0 AS level FROM roots UNION\n SELECT w.root, t.s, w.level + 1 FROM walk w JOIN t ON t.o = w.node WHERE t.p = '{T.SUBCLASS}' AND t.s_kind = 'iri')"))
def hierarchy_levels(spark, d):
    return metrics.semantic_connection(tables.graph(spark, d, keep=True)).details["tree"].select("root", "node", "level")


@query("SELECT s, false AS connected FROM roots", (NAMED, ROOTS))
def semantic_roots(spark, d):
    return metrics.semantic_connection(tables.graph(spark, d), tree=False).details["roots"].select("s", "connected")


LINKS = f"p IN ('{T.SUBCLASS}', '{T.OWL}equivalentClass', '{T.OWL}disjointWith', '{T.SKOS}broader')"
NODES = f"nodes AS (SELECT DISTINCT s FROM t WHERE p = '{T.TYPE}' AND o = '{T.OWL}Class' AND s_kind = 'iri' AND s NOT IN (SELECT s FROM t WHERE o_kind = 'bnode' AND {LINKS}))"
LINKED = f"e AS (SELECT s AS a, o AS b FROM t WHERE {LINKS} AND s IN (SELECT s FROM nodes) AND o IN (SELECT s FROM nodes))"
REACH = "reach AS (SELECT s, s AS x FROM nodes UNION\n SELECT r.s, y.b FROM reach r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) y ON y.a = r.x)"


@query("SELECT count(DISTINCT low) AS components, count(*) AS nodes FROM (SELECT s, min(x) AS low FROM reach GROUP BY s) m", (NODES, LINKED, REACH))
def class_components(spark, d):
    return metrics.class_components(tables.graph(spark, d, keep=True)).details["counts"].select("components", "nodes")


ATOMIC = f"atomic AS (SELECT DISTINCT s FROM t WHERE p = '{T.TYPE}' AND o = '{T.OWL}Class' AND s NOT IN (SELECT s FROM t WHERE p = '{T.SUBCLASS}' AND o IN (SELECT s FROM t WHERE p = '{T.TYPE}' AND o = '{T.OWL}Restriction')))"
#: in this mapping the only expressions are restrictions of a part, whose class isn't atomic
TIED = f"""tied AS (SELECT s AS x FROM t WHERE p = '{T.SUBCLASS}' AND s IN (SELECT s FROM atomic) AND o IN (SELECT s FROM atomic)
 UNION ALL SELECT o AS x FROM t WHERE p = '{T.SUBCLASS}' AND s IN (SELECT s FROM atomic) AND o IN (SELECT s FROM atomic)
 UNION ALL SELECT o AS x FROM t WHERE p IN ('{T.RDFS}domain', '{T.RDFS}range') AND o IN (SELECT s FROM atomic))"""


@query("SELECT s FROM atomic WHERE s NOT IN (SELECT x FROM tied)", (ATOMIC, TIED))
def isolated_classes(spark, d):
    return metrics.isolated_elements(tables.graph(spark, d, keep=True)).details["classes"].select("s")


@query(f"SELECT DISTINCT s FROM t WHERE p = '{T.TYPE}' AND o = '{T.OWL}ObjectProperty' AND s NOT IN (SELECT s FROM t WHERE p = '{T.RDFS}subPropertyOf' UNION ALL SELECT s FROM t WHERE p = '{T.SKOS}broader' UNION ALL SELECT o FROM t WHERE p IN ('{T.RDFS}subPropertyOf', '{T.SKOS}broader'))")
def isolated_properties(spark, d):
    return metrics.isolated_elements(tables.graph(spark, d, keep=True)).details["properties"].select("s")


PROPS = f"props AS (SELECT DISTINCT s FROM t WHERE p = '{T.TYPE}' AND o IN ('{T.OWL}ObjectProperty', '{T.OWL}DatatypeProperty'))"


@query(f"SELECT count(*) AS properties, count(*) FILTER (WHERE s NOT IN (SELECT s FROM t WHERE p = '{T.RDFS}domain')) AS missing_domain, count(*) FILTER (WHERE s NOT IN (SELECT s FROM t WHERE p = '{T.RDFS}range')) AS missing_range FROM props", (PROPS,))
def missing_domain_range(spark, d):
    return metrics.missing_domain_range(tables.graph(spark, d)).details["counts"].drop("graph_id")


@query(f"""SELECT lower(trim(f.o)) AS label, count(*) AS n FROM t l JOIN (SELECT s, o FROM t WHERE p = '{T.LABEL}' AND seq = 1) f ON l.s = f.s
 WHERE l.p = '{T.LABEL}' AND l.s IN (SELECT s FROM t WHERE p = '{T.TYPE}' AND o IN ('{T.OWL}Class', '{T.OWL}ObjectProperty', '{T.OWL}DatatypeProperty')) GROUP BY 1 HAVING count(*) > 1""")
def duplicate_labels(spark, d):
    return metrics.duplicate_labels(tables.graph(spark, d)).details["duplicates"].select("label", "n")


@query(f"SELECT DISTINCT substr(s, {len(BASE) + 1}) AS class_name, s AS uri FROM t WHERE p = '{T.TYPE}' AND o IN ('{T.OWL}Class', '{T.RDFS}Class') AND s_kind = 'iri' AND contains(lower(substr(s, {len(BASE) + 1})), 'n1')")
def class_search(spark, d):
    return metrics.class_search(tables.graph(spark, d), "N1").details["classes"].select("class_name", "uri")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return raw.lines(docs.select(F.col("doc_id").cast("string").alias("graph_id"), "text"))


@query(r"""SELECT graph_id, block, CAST(min(line_no) AS BIGINT) AS first_line, CAST(count(*) AS BIGINT) AS n_lines FROM (
 SELECT graph_id, line_no, CAST(coalesce(sum(ends) OVER (PARTITION BY graph_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block FROM (
 SELECT graph_id, line_no, CASE WHEN contains(regexp_replace(bare, '"[^"]*"', '""', 'g'), '.') THEN 1 ELSE 0 END AS ends FROM (
 SELECT graph_id, line_no, regexp_extract(line, '^((?:[^"#]|"[^"]*(?:"|$))*)', 1) AS bare FROM (
 SELECT CAST(doc_id AS VARCHAR) AS graph_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) a) b WHERE regexp_matches(bare, '\S')) c) e GROUP BY graph_id, block""")
def space_check_blocks(spark, d):
    b = metrics.blocks(document_lines(spark, d))
    return b.select("graph_id", "block", F.col("first_line").cast("long").alias("first_line"), "n_lines")


@query(f"SELECT CASE WHEN count(*) > 0 THEN '1' ELSE '0' END AS score FROM t WHERE o_kind = 'literal' AND regexp_matches(lower(o), '{metrics.LICENCE}')")
def license_check(spark, d):
    return metrics.human_license(tables.graph(spark, d)).score.select("score")


@query(f"SELECT count(*) AS entities, CAST(sum(y) AS BIGINT) AS linked FROM (SELECT s, max(CASE WHEN p IN ({', '.join(repr(x) for x in metrics.LINKING)}) AND o_kind = 'iri' AND NOT starts_with(o, '{BASE}') THEN 1 ELSE 0 END) AS y FROM t WHERE s_kind = 'iri' GROUP BY s) x")
def external_links(spark, d):
    return metrics.external_links(tables.graph(spark, d), BASE).details["counts"].select("entities", "linked")


@query(f"SELECT o AS url FROM t WHERE p = '{T.DCAT}downloadURL' AND regexp_matches(lower(o), '[.](rdf|ttl|nt|n3|owl|jsonld)')")
def dump_url_candidates(spark, d):
    return metrics.dump_urls(tables.graph(spark, d)).select("url")


@query(f"SELECT o AS url FROM t WHERE p IN ('{T.VOID}sparqlEndpoint', '{T.DCAT}accessURL', '{T.SD}endpoint') AND o_kind = 'iri'")
def endpoint_candidates(spark, d):
    return metrics.endpoint_urls(tables.graph(spark, d)).select("url")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE s IN (SELECT s FROM t WHERE p = '{T.LABEL}') AND s IN (SELECT s FROM t WHERE p = '{T.SKOS}broader')) AS valid FROM (SELECT DISTINCT s FROM t WHERE p = '{T.TYPE}' AND o IN ('{T.OWL}Class', '{T.RDFS}Class')) c")
def design_check(spark, d):
    return metrics.design_check(tables.graph(spark, d), (T.LABEL, T.SKOS + "broader")).details["counts"].select("total", "valid")


TOKENS = f"tokens AS (SELECT s, unnest(regexp_extract_all(translate(o, '_-', '  '), '[a-z]+')) AS token FROM t WHERE p IN ('{T.LABEL}', '{T.SKOS}definition', '{T.RDFS}comment'))"


@query("SELECT token, count(*) AS n FROM tokens WHERE length(token) > 1 GROUP BY token", (TOKENS,))
def spell_token_counts(spark, d):
    return metrics.spell_tokens(tables.graph(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS checked, count(*) FILTER (WHERE token NOT IN (SELECT unnest(string_split(lower(p_name), ' ')) FROM part)) AS errors FROM tokens WHERE length(token) > 1", (TOKENS,))
def spell_errors(spark, d):
    words = tables.views(spark, d, ("part",))["part"].select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"), F.lit(1).alias("freq"))
    return metrics.spell_check(tables.graph(spark, d), words, corrections=False).details["counts"].select("checked", "errors")


HAVE = f"have AS (SELECT DISTINCT substr(s, {len(BASE) + 1}) AS term FROM t WHERE s_kind = 'iri' AND ((p = '{T.TYPE}' AND o IN ('{T.OWL}Class', '{T.RDFS}Class', '{T.OWL}ObjectProperty', '{T.OWL}DatatypeProperty', '{T.RDF}Property')) OR p IN ('{T.LABEL}', '{T.RDFS}domain', '{T.RDFS}range')))"
NEED = f"need AS (SELECT DISTINCT unnest(regexp_extract_all(sparql, 'ex:([A-Za-z_][A-Za-z0-9_]*)', 1)) AS term FROM ({tables.QUESTIONS}) q)"


def _terms(spark, d) -> tuple[DataFrame, DataFrame]:
    return task.ontology_terms(tables.graph(spark, d).triples), task.task_terms(tables.questions(spark, d), ["ex"])


@query("SELECT term FROM have", (HAVE,))
def ontology_terms(spark, d):
    return _terms(spark, d)[0]


@query("SELECT term FROM need", (NEED,))
def task_terms(spark, d):
    return _terms(spark, d)[1]


@query("SELECT CAST(c AS DOUBLE) / a AS relevance, CAST(c AS DOUBLE) / h AS accuracy, h AS t_o, a AS t_a, c AS common FROM (SELECT (SELECT count(*) FROM have) AS h, (SELECT count(*) FROM need) AS a, (SELECT count(*) FROM need WHERE term IN (SELECT term FROM have)) AS c) x", (HAVE, NEED))
def relevance_accuracy(spark, d):
    return task.relevance_accuracy(*_terms(spark, d))


@query("SELECT term FROM need WHERE term NOT IN (SELECT term FROM have)", (HAVE, NEED))
def missing_terms(spark, d):
    return task.compare(*_terms(spark, d)).where("side = 'missing'").select("term")


@query("SELECT term FROM have WHERE term NOT IN (SELECT term FROM need)", (HAVE, NEED))
def unused_terms(spark, d):
    return task.compare(*_terms(spark, d)).where("side = 'unused'").select("term")


def _turns(spark, d) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.coalesce("text", F.lit("")).alias("question"))


@query()
def question_phrases(spark, d):
    return _turns(spark, d).select("idx", X.phrases(F.col("question")).alias("phrases"))


@query()
def question_json(spark, d):
    return builder.records(_turns(spark, d)).select("qid", "num_node", "num_edge", "sparql_query")


@query("SELECT unnest(regexp_extract_all(concat('Text. ```sparql', chr(10), sparql, '``` *Expected: one*'), '(?s)```sparql\\s*(.*?)```', 1)) AS sparql FROM (" + tables.QUESTIONS + ") q")
def sparql_block_extract(spark, d):
    md = tables.questions(spark, d).select(F.concat(F.lit("Text. ```sparql\n"), "sparql", F.lit("``` *Expected: one*")).alias("md"))
    return raw.fenced_queries(md.select("md"))


@query(f"""SELECT 'duplicateLabels' AS metric, CAST(count(*) AS VARCHAR) AS score FROM (SELECT lower(trim(f.o)) AS label FROM t l JOIN (SELECT s, o FROM t WHERE p = '{T.LABEL}' AND seq = 1) f ON l.s = f.s
 WHERE l.p = '{T.LABEL}' AND l.s IN (SELECT s FROM t WHERE p = '{T.TYPE}' AND o = '{T.OWL}Class') GROUP BY 1 HAVING count(*) > 1) x
 UNION ALL SELECT 'mdsDesignCheck', '0.0' UNION ALL SELECT 'sparqlEndpoint', '0.0' UNION ALL SELECT 'humanLicense', CASE WHEN count(*) > 0 THEN '1' ELSE '0' END FROM t WHERE o_kind = 'literal' AND regexp_matches(lower(o), '{metrics.LICENCE}')""")
def assessment_report(spark, d):
    kg = tables.graph(spark, d)
    none = lambda urls, kind: urls.select("url").distinct().withColumn("ok", F.lit(False))
    parts = (("duplicateLabels", metrics.duplicate_labels(kg)), ("mdsDesignCheck", metrics.design_check(kg)), ("sparqlEndpoint", metrics.sparql_endpoint(kg, none)), ("humanLicense", metrics.human_license(kg)))
    out = None
    for name, r in parts:
        x = r.score.select(F.lit(name).alias("metric"), F.col("score").cast("string").alias("score"))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"SELECT head, i, item FROM (SELECT concat('_:l', cast(n_regionkey as varchar(20))) AS head, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS i, concat('{BASE}Nation', cast(n_nationkey as varchar(20))) AS item FROM nation) x")
def list_items(spark, d):
    """Each region's nations as an RDF list, expanded again."""
    cells = tables.sql(spark, d, f"""SELECT 'tables' AS graph_id, n_regionkey AS r, concat('{BASE}Nation', cast(n_nationkey as varchar(20))) AS item, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation""", ("nation",))
    name = lambda i: F.when(i == 1, F.concat(F.lit("_:l"), F.col("r").cast("string"))).otherwise(F.concat(F.lit("_:l"), F.col("r").cast("string"), F.lit("x"), i.cast("string")))
    rest = F.when(F.col("i") == F.col("n"), F.lit(T.RDF + "nil")).otherwise(name(F.col("i") + 1))
    t = cells.select("graph_id", F.col("i").cast("long").alias("seq"), name(F.col("i")).alias("s"), F.explode(F.create_map(F.lit(T.RDF + "first"), F.col("item"), F.lit(T.RDF + "rest"), rest)).alias("p", "o"))
    heads = cells.where("i = 1").select("graph_id", name(F.lit(1)).alias("head"))
    return fixpoint.list_items(heads, t, T.RDF).select("head", "i", "item")


GROUNDED = f"(starts_with(s, 'https://www.commoncoreontologies.org/') OR starts_with(s, 'http://purl.obolibrary.org/obo/BFO_'))"


@query(f"SELECT s, {GROUNDED} AS connected FROM roots", (NAMED, ROOTS), tables.RICH)
def grounded_roots(spark, d):
    """Roots in the current upper ontologies are grounded, those in an old namespace or the graph's own aren't."""
    return metrics.semantic_connection(tables.graph(spark, d, text=tables.RICH), tree=False).details["roots"].select("s", "connected")


@query(f"SELECT e.edges, e.parents, r.roots, r.grounded, CAST(r.grounded AS DOUBLE) / r.roots AS ratio FROM (SELECT count(*) AS edges, count(DISTINCT o) AS parents FROM t WHERE p = '{T.SUBCLASS}' AND s_kind = 'iri' AND o_kind = 'iri') e, (SELECT count(*) AS roots, count(*) FILTER (WHERE {GROUNDED}) AS grounded FROM roots) r", (NAMED, ROOTS), tables.RICH)
def grounding_stats(spark, d):
    x = metrics.semantic_connection(tables.graph(spark, d, text=tables.RICH), tree=False).details["statistics"]
    return x.select("edges", "parents", "roots", "grounded", F.col("ratio").cast("double").alias("ratio"))


DECLARED = f"s_kind = 'iri' AND ((p = '{T.TYPE}' AND o IN ('{T.OWL}Class', '{T.RDFS}Class', '{T.OWL}ObjectProperty', '{T.OWL}DatatypeProperty', '{T.RDF}Property')) OR p IN ('{T.LABEL}', '{T.RDFS}domain', '{T.RDFS}range'))"


@query(f"SELECT DISTINCT regexp_extract(s, '[^#/]*$') AS term FROM t WHERE {DECLARED} AND NOT starts_with(s, '{T.SKOS}') AND regexp_extract(s, '[^#/]*$') <> ''", (), tables.RICH)
def foreign_terms(spark, d):
    """Terms of all namespaces but the foundational ones, without blank names."""
    return task.ontology_terms(tables.graph(spark, d, text=tables.RICH).triples)


@query(f"SELECT DISTINCT regexp_extract(s, '[^#/]*$') AS term FROM t WHERE {DECLARED} AND contains(s, 'other.org/x')", (), tables.RICH)
def fragment_terms(spark, d):
    return task.ontology_terms(tables.graph(spark, d, text=tables.RICH).triples, ["other.org/x", "nowhere"])


OPERANDS = f"'{T.OWL}unionOf', '{T.OWL}intersectionOf', '{T.OWL}complementOf'"
ATOMS = f"""atoms AS (SELECT DISTINCT s, s_kind FROM t WHERE p = '{T.TYPE}' AND o = '{T.OWL}Class' AND s NOT IN (SELECT s FROM t WHERE p IN ({OPERANDS}))
 AND s NOT IN (SELECT s FROM t WHERE p IN ('{T.SUBCLASS}', '{T.OWL}equivalentClass') AND o IN (SELECT s FROM t WHERE p = '{T.TYPE}' AND o = '{T.OWL}Restriction')))"""
LEADS = f"leads AS (SELECT s FROM atoms WHERE s_kind = 'iri' UNION\n SELECT x.s FROM leads l JOIN t x ON x.o = l.s WHERE x.o_kind <> 'literal' AND (x.s_kind = 'bnode' OR x.p IN ({OPERANDS})))"
JOINED = f"""joined AS (SELECT s, o, s_kind, o_kind, s IN (SELECT s FROM atoms) AS sa, o IN (SELECT s FROM atoms) AS oa, s IN (SELECT s FROM leads) AS sl, o IN (SELECT s FROM leads) AS ol
 FROM t WHERE p IN ('{T.SUBCLASS}', '{T.OWL}equivalentClass', '{T.OWL}disjointWith'))"""


@query(f"""SELECT s FROM atoms WHERE s NOT IN (SELECT s FROM joined WHERE sa AND (oa OR (ol AND s_kind = 'iri'))) AND s NOT IN (SELECT o FROM joined WHERE oa AND (sa OR (sl AND o_kind = 'iri')))
 AND s NOT IN (SELECT o FROM t WHERE p IN ('{T.RDFS}domain', '{T.RDFS}range') AND o_kind = 'iri' AND o IN (SELECT s FROM leads) AND s IN (SELECT s FROM t WHERE p = '{T.TYPE}' AND o IN ('{T.OWL}ObjectProperty', '{T.OWL}DatatypeProperty')))""", (ATOMS, LEADS, JOINED), tables.RICH)
def isolated_with_expressions(spark, d):
    """Isolated classes where unions of classes tie some of them through blank nodes and list cells."""
    return metrics.isolated_elements(tables.graph(spark, d, True, tables.RICH)).details["classes"].select("s")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE page_id % 2 = 0) AS reached, CAST(CAST(count(*) FILTER (WHERE page_id % 2 = 0) AS DOUBLE) / count(*) AS VARCHAR) AS score FROM pages WHERE url IS NOT NULL AND page_id % 11 = 0")
def reached_endpoints(spark, d):
    """The ratio of endpoints that answer, by a table of known answers of each page, as pages may share a URL."""
    page = F.concat(F.lit(f"{BASE}page"), F.col("page_id").cast("string"))
    answers = tables.views(spark, d, ("pages",))["pages"].where("url is not null").select(page.alias("s"), F.concat("url", F.lit("/sparql")).alias("url"), F.when(F.col("page_id") % 2 == 0, 200).otherwise(404).alias("status"))
    r = metrics.sparql_endpoint(tables.graph(spark, d), probe.known(answers))
    return r.details["counts"].join(r.score, "graph_id").select("total", "reached", "score")


PART_TEXT = """SELECT cast(p_partkey as varchar(20)) AS graph_id, concat('# a owl:Class .', chr(10), CASE WHEN p_size % 3 = 0 THEN concat('ex:Part ', cast(p_partkey as varchar(20)), ' a owl:Class .') WHEN p_size % 3 = 1
 THEN concat('ex:Part', cast(p_partkey as varchar(20)), ' a owl:Class ; rdfs:label "x y . z" .') ELSE concat('ex:Part ', cast(p_partkey as varchar(20)), ' ex:says "it is a owl:Class" .') END) AS text FROM part"""


@query("SELECT cast(p_partkey as varchar(20)) AS graph_id, concat('ex:Part ', cast(p_partkey as varchar(20))) AS class_name, CAST(2 AS BIGINT) AS line_number, concat('ex:Part ', cast(p_partkey as varchar(20)), ' a owl:Class .') AS line_text FROM part WHERE p_size % 3 = 0")
def space_errors(spark, d):
    """Declarations whose subject has a space; comments and literals don't count."""
    texts = tables.sql(spark, d, PART_TEXT, ("part",))
    kg = KnowledgeGraph(tables.graph(spark, d).triples, texts=texts, graphs=texts.select("graph_id"))
    return metrics.check_space(kg).details["errors"].withColumn("line_number", F.col("line_number").cast("long"))


CLEAN = r"regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\x00-\x7F]', ' ', 'g'), '[?.,;:!()-]', ' ', 'g')"
CONTENT = "list_aggregate(list_filter(string_split_regex(trim({}), '[ \t\n\x0B\f\r]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOPWORDS) + "], w)), 'string_agg', ' ')"


@query(rf"""SELECT idx, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '|') ELSE coalesce(whole, '') END AS phrases FROM (SELECT idx,
 list_filter(list_transform(string_split_regex(clean, '\b(?:and|or|with|for)\b'), lambda p: coalesce({CONTENT.format("p")}, '')), lambda p: p <> '') AS parts, {CONTENT.format("clean")} AS whole
 FROM (SELECT conv_id * 1000 + turn AS idx, {CLEAN} AS clean FROM conversations WHERE role = 'user') a) b""")
def question_phrases_ascii(spark, d):
    """Phrases of all questions with letters beyond ASCII taken out, where word boundaries mean the same in both engines."""
    x = _turns(spark, d).withColumn("question", F.regexp_replace("question", r"[^\x00-\x7F]", " "))
    return x.select("idx", F.array_join(X.phrases(F.col("question")), "|").alias("phrases"))


def _numbered(df: DataFrame) -> DataFrame:
    """df with the place of each row in its own order: the place in its partition after the rows of those before it."""
    x = fixpoint.cut(df.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    sizes = x.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")  # one row for each partition
    x = x.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return x.withColumn("place", (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_id", "_part", "_before")


@query(f"SELECT s, CAST(row_number() OVER (ORDER BY CASE WHEN s_kind = 'bnode' THEN 0 ELSE 1 END, s) AS INTEGER) AS place FROM (SELECT DISTINCT s, s_kind FROM t WHERE p = '{T.TYPE}' AND o IN ('{T.OWL}Class', '{T.RDFS}Class') AND s NOT IN (SELECT o FROM t WHERE p = '{T.SUBCLASS}')) x", (), tables.RICH)
def leaf_order(spark, d):
    """The order in which leaves are listed: blank nodes, then IRIs."""
    return _numbered(metrics.leaf_nodes(tables.graph(spark, d, text=tables.RICH)).details["leaves"].select("s"))


CHAIN = "CASE WHEN starts_with(s, 'https://www.commoncoreontologies.org/') THEN concat('cco:', substr(s, 38)) WHEN starts_with(s, 'http://purl.obolibrary.org/obo/') THEN concat('obo:', substr(s, 32)) WHEN starts_with(s, '" + T.SKOS + "') THEN concat('skos:', substr(s, " + str(len(T.SKOS) + 1) + ")) ELSE " + QNAME + " END"


@query(f"SELECT qname, CAST(row_number() OVER (ORDER BY connected DESC, qname) AS INTEGER) AS place FROM (SELECT {CHAIN} AS qname, {GROUNDED} AS connected FROM roots) x", (NAMED, ROOTS), tables.RICH)
def chain_order(spark, d):
    """Prefixed names of roots: connected chains first, by name."""
    return _numbered(metrics.semantic_connection(tables.graph(spark, d, text=tables.RICH), tree=False).details["chains"].select("qname"))


@query("SELECT node, level, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS place FROM walk", (NAMED, ROOTS, f"walk AS (SELECT s AS node, 0 AS level, [{QNAME}] AS path FROM roots UNION\n SELECT c.s, w.level + 1, list_append(w.path, {QNAME.replace('(s', '(c.s').replace(' s,', ' c.s,')}) FROM walk w JOIN (SELECT s, o FROM t WHERE p = '{T.SUBCLASS}' AND s_kind = 'iri') c ON c.o = w.node)"))
def tree_order(spark, d):
    """The lines of the hierarchy's walk from each root, children by name."""
    return _numbered(metrics.semantic_connection(tables.graph(spark, d, keep=True)).details["tree"].select("node", "level"))
