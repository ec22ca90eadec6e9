"""The assessment's metrics: each maps a KnowledgeGraph to scores by graph and to detail tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions import text as X
from ..plans.kg import KnowledgeGraph
from ..sources import probe
from ..sources import text as raw
from . import fixpoint

log = logging.getLogger("quillon")
KEY = ["graph_id", "s"]
SHOW = ("all", "with", "without", "summary")


@dataclass
class MetricResult:
    """score(graph_id, score): null where a metric only reports. details: named tables. failed: (graph_id, error) rows."""

    score: DataFrame
    details: dict[str, DataFrame] = field(default_factory=dict)
    failed: DataFrame | None = None


def _report(kg: KnowledgeGraph, details: dict[str, DataFrame]) -> MetricResult:
    return MetricResult(kg.graphs.select("graph_id", F.lit(None).cast("string").alias("score")), details)


def _per_graph(kg: KnowledgeGraph, counts: DataFrame, **default) -> DataFrame:
    x = kg.graphs.join(counts, "graph_id", "left")
    return x.select("graph_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in default.items()])


def _coverage(kg: KnowledgeGraph, has: DataFrame) -> dict[str, DataFrame]:
    """with, without and summary of the named classes; has(graph_id, s, ...)."""
    named = kg.named_classes
    covered, missing = named.join(has, KEY), named.join(has.select(*KEY), KEY, "left_anti")
    flags = named.join(has.select(*KEY, F.lit(1).alias("yes")).distinct(), KEY, "left").groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"), F.count("yes").alias("with"))
    x = _per_graph(kg, flags, total=0, **{"with": 0}).withColumn("without", F.col("total") - F.col("with"))
    pct = T.percent(F.col("with"), F.col("total"))
    return {"with": covered, "without": missing, "summary": x.withColumn("percent", F.round(pct, 1)).withColumn("grade", T.grade(pct))}


def _valid(show: str) -> bool:
    """Whether show is known; if not, that is logged, and the metric gives None."""
    if show not in SHOW:
        log.error("show must be one of %s, not %s", ", ".join(SHOW), show)
    return show in SHOW


def _shown(details: dict[str, DataFrame], show: str) -> dict[str, DataFrame]:
    return details if show == "all" else {k: v for k, v in details.items() if k == show or show in ("with", "without") and k == "summary"}


def check_label(kg: KnowledgeGraph, show: str = "all", export_template: str | None = None) -> MetricResult | None:
    if not _valid(show):
        return None
    filled = kg.values(T.LABEL).where(T.nonblank(F.col("o"))).select(*KEY).distinct()
    shown = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit('"'), "o", F.lit('"@'), "o_lang")).otherwise(F.concat(F.lit('"'), "o", F.lit('"')))
    every = kg.values(T.LABEL).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", shown.alias("l")))), lambda v: v["l"]).alias("labels"))
    d = _coverage(kg, filled.join(every, KEY))
    d["with"], d["without"] = kg.qnames(d["with"]), kg.qnames(d["without"])
    if export_template and not d["without"].isEmpty():
        from ..plans import report

        report.missing_labels_csv(d["without"], export_template)
    return _report(kg, _shown(d, show))


def check_altlabel(kg: KnowledgeGraph, show: str = "all", export_template: str | None = None) -> MetricResult | None:
    if not _valid(show):
        return None
    alts = kg.values(T.SKOS + "altLabel").groupBy(*KEY).agg(
        F.transform(F.filter(F.array_sort(F.collect_list(F.struct("seq", "o"))), lambda v: T.nonblank(v["o"])), lambda v: v["o"]).alias("altlabels"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "o"))), lambda v: v["o"]).alias("all_altlabels"),
    )
    d = _coverage(kg, alts.where(F.size("altlabels") > 0).withColumn("n", F.size("altlabels")))
    d["with"], d["without"] = kg.labels(d["with"]), kg.labels(d["without"])
    if export_template and not d["without"].isEmpty():
        from ..plans import report

        report.altlabel_template(d["without"], export_template)
    return _report(kg, _shown(d, show))


def check_definition(kg: KnowledgeGraph, show: str = "all", full_definitions: bool = False) -> MetricResult | None:
    if not _valid(show):
        return None
    ok = T.truthy(F.col("o_kind"), F.col("o"), F.col("o_dtype"))
    first = kg.values(T.SKOS + "definition").groupBy(*KEY).agg(F.min_by(F.struct("o", ok.alias("ok")), "seq").alias("d")).where("d.ok")
    d = _coverage(kg, first.select(*KEY, F.col("d.o").alias("full")))
    text = F.col("full") if full_definitions else T.shorten(F.col("full"))
    cut_off = F.when(F.length("full") > F.length(text), F.length("full"))
    d["with"] = kg.labels(d["with"]).withColumn("definition", text).withColumn("full_length", cut_off).drop("full")
    d["without"] = kg.labels(d["without"])
    return _report(kg, _shown(d, show))


def check_capital(kg: KnowledgeGraph, show: str = "all", export_template: str | None = None) -> MetricResult | None:
    if not _valid(show):
        return None
    local = T.naming_local(F.col("s"))
    good = kg.named_classes.where(T.capitalised(local)).withColumn("local_name", local)
    d = _coverage(kg, good)
    d["with"], d["without"] = kg.qnames(d["with"]), kg.qnames(d["without"].withColumn("local_name", local))
    if export_template and not d["without"].isEmpty():
        from ..plans import report

        report.capital_csv(d["without"], export_template)
    return _report(kg, _shown(d, show))


def blocks(lines: DataFrame) -> DataFrame:
    """lines(graph_id, line_no, text) as blocks that end with a line that has a full stop outside literals:
    (graph_id, block, first_line, n_lines, raw, text), comments, literals' contents and extra space taken out."""
    x = lines.withColumn("bare", X.strip_comment(F.col("text"))).where(T.nonblank(F.col("bare")))
    w = Window.partitionBy("graph_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    ends = X.empty_literals(F.col("bare")).contains(".").cast("int")
    x = x.withColumn("block", F.coalesce(F.sum(ends).over(w), F.lit(0)))
    g = x.groupBy("graph_id", "block").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "bare"))), lambda v: v["bare"]), " ").alias("raw"))
    return g.withColumn("text", X.one_space(X.empty_literals(F.col("raw"))))


def check_space(kg: KnowledgeGraph, export_template: str | None = None) -> MetricResult:
    b = blocks(raw.lines(kg.texts))
    declared = b.where(F.col("text").contains(" a owl:Class") | F.col("text").contains(" a rdfs:Class"))
    subject = F.trim(F.element_at(F.split("text", " a ", 2), 1))
    bad = declared.withColumn("class_name", subject).where(F.col("class_name").contains(" "))
    bad = bad.select("graph_id", "class_name", F.col("first_line").alias("line_number"), F.col("text").alias("line_text"))
    n = _per_graph(kg, b.groupBy("graph_id").agg(F.count(F.lit(1)).alias("blocks")), blocks=0)
    if export_template and not bad.isEmpty():
        from ..plans import report

        report.space_csv(bad, export_template)
    return _report(kg, {"errors": bad, "summary": n.join(bad.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")), "graph_id", "left").select("graph_id", "blocks", F.coalesce("n", F.lit(0)).alias("errors"))})


def restricted(kg: KnowledgeGraph) -> DataFrame:
    ends = kg.triples.where((F.col("p") == T.TYPE) & (F.col("o") == T.OWL + "Restriction")).select("graph_id", F.col("s").alias("o")).distinct()
    return kg.pattern(T.OWL + "equivalentClass", T.SUBCLASS).join(ends, ["graph_id", "o"], "left_semi").select(*KEY).distinct()


def expression_edges(kg: KnowledgeGraph) -> DataFrame:
    """(graph_id, a, b): a named node leads to its operands, a blank one to all that it points at."""
    operands = F.col("p").isin(T.OWL + "unionOf", T.OWL + "intersectionOf", T.OWL + "complementOf")
    return kg.triples.where("o_kind <> 'literal'").where((F.col("s_kind") == "bnode") | operands).select("graph_id", F.col("s").alias("a"), F.col("o").alias("b"))


def atomic_classes(kg: KnowledgeGraph) -> DataFrame:
    built = kg.pattern(T.OWL + "unionOf", T.OWL + "intersectionOf", T.OWL + "complementOf").select(*KEY).distinct()
    return kg.typed(T.OWL + "Class").join(built, KEY, "left_anti").join(restricted(kg), KEY, "left_anti")


def isolated_elements(kg: KnowledgeGraph) -> MetricResult:
    atomic = fixpoint.cut(atomic_classes(kg))
    iri = atomic.where("s_kind = 'iri'").select(*KEY)
    reach = fixpoint.backward_closure(iri, expression_edges(kg)).withColumn("has", F.lit(True))
    flag = atomic.select("graph_id", "s", "s_kind", F.lit(True).alias("atomic"))
    links = kg.pattern(T.SUBCLASS, T.OWL + "equivalentClass", T.OWL + "disjointWith").select("graph_id", "s", "o", "s_kind", "o_kind")
    side = lambda c: flag.select("graph_id", F.col("s").alias(c), F.col("atomic").alias(f"{c}_atomic"))
    has = lambda c: reach.select("graph_id", F.col("s").alias(c), F.col("has").alias(f"{c}_has"))
    x = links
    for c in ("s", "o"):
        x = x.join(side(c), ["graph_id", c], "left").join(has(c), ["graph_id", c], "left")
    both = F.col("s_atomic").isNotNull() & F.col("o_atomic").isNotNull()
    one = lambda me, other: F.col(f"{me}_atomic").isNotNull() & (both | (F.col(f"{other}_has").isNotNull() & (F.col(f"{me}_kind") == "iri")))
    ends = x.where(one("s", "o")).select(*KEY).unionByName(x.where(one("o", "s")).select("graph_id", F.col("o").alias("s")))
    used = kg.pattern(T.RDFS + "domain", T.RDFS + "range").join(kg.properties.select(*KEY), KEY, "left_semi").where("o_kind = 'iri'").select("graph_id", F.col("o").alias("s")).join(reach.select(*KEY), KEY, "left_semi")
    lone = atomic.join(ends.unionByName(used).distinct(), KEY, "left_anti")
    rel = kg.pattern(T.RDFS + "subPropertyOf", T.OWL + "inverseOf", T.OWL + "propertyDisjointWith", T.OWL + "equivalentProperty", T.SKOS + "broader")
    tied = rel.where("s_kind = 'iri'").select(*KEY).unionByName(rel.where("o_kind = 'iri'").select("graph_id", F.col("o").alias("s"))).distinct()
    props = kg.properties
    lone_props = props.join(tied, KEY, "left_anti")
    count = lambda d, n: d.groupBy("graph_id").agg(F.count(F.lit(1)).alias(n))
    c = kg.graphs
    for d, n in ((atomic, "atomic"), (lone, "isolated_classes"), (props, "properties"), (lone_props, "isolated_properties")):
        c = c.join(count(d, n), "graph_id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    failed = c.where("atomic = 0 or properties = 0").select("graph_id", F.lit("division by zero").alias("error"))
    c = c.withColumn("class_ratio", F.when(F.col("atomic") > 0, F.col("isolated_classes") / F.col("atomic"))).withColumn("property_ratio", F.when(F.col("properties") > 0, F.col("isolated_properties") / F.col("properties")))
    score = c.select("graph_id", F.to_json(F.struct("isolated_classes", "class_ratio", "isolated_properties", "property_ratio")).alias("score"))
    return MetricResult(score, {"counts": c, "classes": lone, "properties": lone_props}, failed)


def class_graph(kg: KnowledgeGraph) -> tuple[DataFrame, DataFrame]:
    p = [T.SUBCLASS, T.OWL + "equivalentClass", T.OWL + "disjointWith", T.SKOS + "broader"]
    blank = kg.pattern(*p).where("o_kind = 'bnode'").select(*KEY).distinct()
    nodes = kg.typed(T.OWL + "Class").where("s_kind = 'iri'").select(*KEY).join(blank, KEY, "left_anti")
    nodes = fixpoint.cut(nodes)  # read three times below
    e = kg.pattern(*p).where("s_kind = 'iri' and o_kind = 'iri'").select("graph_id", "s", "o")
    e = e.join(nodes, KEY, "left_semi").join(nodes.select("graph_id", F.col("s").alias("o")), ["graph_id", "o"], "left_semi")
    return nodes, e.select("graph_id", F.col("s").alias("a"), F.col("o").alias("b"))


def class_components(kg: KnowledgeGraph) -> MetricResult:
    nodes, e = class_graph(kg)
    x = fixpoint.components(nodes, e)
    n = _per_graph(kg, x.groupBy("graph_id").agg(F.countDistinct("label").alias("components"), F.count(F.lit(1)).alias("nodes")), components=0, nodes=0)
    return MetricResult(n.select("graph_id", F.col("components").cast("string").alias("score")), {"counts": n, "members": x})


def missing_domain_range(kg: KnowledgeGraph) -> MetricResult:
    props = kg.properties.select(*KEY)
    without = lambda p: props.join(kg.values(p).select(*KEY).distinct(), KEY, "left_anti")
    dom, ran = without(T.RDFS + "domain"), without(T.RDFS + "range")
    x = kg.graphs
    for d, n in ((props, "properties"), (dom, "missing_domain"), (ran, "missing_range")):
        x = x.join(d.groupBy("graph_id").agg(F.count(F.lit(1)).alias(n)), "graph_id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    score = F.to_json(F.struct("properties", "missing_domain", "missing_range"))
    return MetricResult(x.select("graph_id", score.alias("score")), {"counts": x, "missing_domain": dom, "missing_range": ran})


def leaf_nodes(kg: KnowledgeGraph, include_broader: bool = False) -> MetricResult:
    parents = kg.pattern(T.SUBCLASS, *[T.SKOS + "broader"] * include_broader).select("graph_id", F.col("o").alias("s")).distinct()
    leaves = kg.typed(T.OWL + "Class", T.RDFS + "Class").join(parents, KEY, "left_anti")
    return _report(kg, {"leaves": kg.qnames(leaves).orderBy(F.when(F.col("s_kind") == "bnode", 0).otherwise(1), "s")})


def semantic_connection(kg: KnowledgeGraph, tree: bool = True) -> MetricResult:
    roots = kg.qnames(kg.roots)
    roots = roots.withColumn("connected", T.grounded(F.col("qname")))
    stats = kg.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("parent").alias("parents"))
    r = roots.join(stats.select("graph_id"), "graph_id", "left_semi").groupBy("graph_id").agg(F.count(F.lit(1)).alias("roots"), F.count_if("connected").alias("grounded"))
    x = stats.join(r, "graph_id", "left")
    d = {"roots": roots, "statistics": x.withColumn("ratio", T.ratio(F.col("grounded"), F.col("roots")))}
    d["chains"] = roots.select("graph_id", "connected", "qname").orderBy("graph_id", F.desc("connected"), "qname")
    if tree:
        children = kg.qnames(kg.edges, "child")
        d["tree"] = fixpoint.first_paths(roots, children).select("graph_id", "root", "node", "path", (F.size("path") - 1).alias("level")).orderBy("graph_id", "path")
    return _report(kg, d)


def design_check(kg: KnowledgeGraph, required: tuple = (T.MDS + "inDomain", T.MDS + "hasStudyStage")) -> MetricResult:
    classes = kg.typed(T.OWL + "Class", T.RDFS + "Class").select(*KEY)
    filled = kg.pattern(*required).where(T.nonblank(F.col("o"))).groupBy(*KEY).agg(F.collect_set("p").alias("have"))
    x = classes.join(filled, KEY, "left").withColumn("lack", F.array_except(F.array(*[F.lit(p) for p in required]), F.coalesce("have", F.array().cast("array<string>"))))
    c = _per_graph(kg, x.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("lack") == 0).alias("valid")), total=0, valid=0)
    c = c.withColumn("score", T.ratio(F.col("valid"), F.col("total")))
    lack = x.select("graph_id", F.explode("lack").alias("predicate"), "s")
    n = lack.groupBy("graph_id", "predicate").agg(F.count(F.lit(1)).alias("n"))
    return MetricResult(c.select("graph_id", F.col("score").cast("string").alias("score")), {"counts": c, "missing": n, "missing_classes": lack.orderBy("graph_id", "predicate", "s")})


def _probed(kg: KnowledgeGraph, found: DataFrame, prober: probe.Prober, kind: str) -> MetricResult:
    """found(graph_id, s, url): each occurrence counts; a URL is asked once, unless the answers are by subject too."""
    answers = prober(found, kind)
    x = found.join(answers, [c for c in answers.columns if c != "ok"], "left")
    c = _per_graph(kg, x.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("reached")), total=0, reached=0)
    score = F.when(F.col("total") > 0, (F.col("reached") / F.col("total")).cast("string")).otherwise(F.lit("0"))
    return MetricResult(c.select("graph_id", score.alias("score")), {"counts": c, "urls": x})


def dump_urls(kg: KnowledgeGraph) -> DataFrame:
    p = [T.VOID + "dataDump", T.DCAT + "downloadURL", T.DCAT + "accessURL", T.FOAF + "homepage"]
    return kg.pattern(*p).where("o_kind = 'iri'").where(F.lower("o").rlike(r"\.(?:rdf|ttl|nt|n3|owl|jsonld)")).select("graph_id", "s", F.col("o").alias("url"))


def endpoint_urls(kg: KnowledgeGraph) -> DataFrame:
    return kg.pattern(T.VOID + "sparqlEndpoint", T.DCAT + "accessURL", T.SD + "endpoint").where("o_kind = 'iri'").select("graph_id", "s", F.col("o").alias("url"))


def rdf_dump(kg: KnowledgeGraph, prober: probe.Prober = probe.http) -> MetricResult:
    return _probed(kg, dump_urls(kg), prober, "head")


def sparql_endpoint(kg: KnowledgeGraph, prober: probe.Prober = probe.http) -> MetricResult:
    return _probed(kg, endpoint_urls(kg), prober, "sparql")


LICENCE = "license|licence|copyright|terms of use|creative commons"


def human_license(kg: KnowledgeGraph) -> MetricResult:
    hit = lambda c: F.lower(c).rlike(LICENCE)
    marks = kg.triples.where("o_kind = 'literal'").where(hit(F.col("o"))).select("graph_id")
    if kg.texts is not None:
        marks = marks.unionByName(kg.texts.where(hit(F.col("text"))).select("graph_id"))
    x = kg.graphs.join(marks.distinct().withColumn("y", F.lit(1)), "graph_id", "left")
    return MetricResult(x.select("graph_id", F.coalesce("y", F.lit(0)).cast("string").alias("score")))


LINKING = [T.OWL + "sameAs", T.RDFS + "seeAlso", *[T.SKOS + m + "Match" for m in ("exact", "close", "related", "broad", "narrow")], T.OWL + "equivalentClass", T.OWL + "equivalentProperty", T.DCTERMS + "source", T.FOAF + "isPrimaryTopicOf"]
PROVIDERS = r"bnf\.fr|dbpedia\.org|freebase\.com|geonames\.org|getty\.edu|loc\.gov|schema\.org|viaf\.org|wikidata\.org|yago-knowledge\.org"


def linked_entities(kg: KnowledgeGraph, base_namespace: str | None = None) -> DataFrame:
    """(graph_id, s, linked): IRI subjects, and whether a linking predicate leads out of the base namespace.

    base_namespace None: the graph's '' or 'base' prefix, else its first bound one; '' : the known providers' hosts."""
    x = kg.triples.where("s_kind = 'iri'")
    if base_namespace is None:
        rank = F.struct(F.when(F.col("prefix").isin("", "base"), 0).otherwise(1), "seq", "prefix")
        x = x.join(kg.bound.groupBy("graph_id").agg(F.min_by("ns", rank).alias("base")), "graph_id", "left")
    else:
        x = x.withColumn("base", F.lit(base_namespace or None).cast("string"))
    outside = F.when(F.col("base").isNotNull(), ~F.startswith("o", "base")).otherwise(F.lower("o").rlike(PROVIDERS))
    return x.groupBy(*KEY).agg(F.bool_or(F.col("p").isin(*LINKING) & (F.col("o_kind") == "iri") & outside).alias("linked"))


def external_links(kg: KnowledgeGraph, base_namespace: str | None = None) -> MetricResult:
    x = linked_entities(kg, base_namespace)
    c = _per_graph(kg, x.groupBy("graph_id").agg(F.count(F.lit(1)).alias("entities"), F.count_if("linked").alias("linked")), entities=0, linked=0)
    score = F.when(F.col("entities") > 0, (F.col("linked") / F.col("entities")).cast("string")).otherwise(F.lit("0"))
    return MetricResult(c.select("graph_id", score.alias("score")), {"counts": c, "entities": x})


def spell_tokens(kg: KnowledgeGraph) -> DataFrame:
    x = kg.pattern(T.LABEL, T.SKOS + "definition", T.RDFS + "comment")
    return x.select("graph_id", "s", F.translate("o", "_-", "  ").alias("text"), F.posexplode(X.identifier_words(F.col("o"))).alias("i", "token"))


def spell_check(kg: KnowledgeGraph, dictionary: DataFrame | None = None, corrections: bool = True) -> MetricResult:
    """dictionary(word, freq) is an input; without one no word is known to be wrong and the rate is 0."""
    if dictionary is None:
        dictionary = kg.spark.createDataFrame([], "word string, freq long")
        tokens = spell_tokens(kg).withColumn("wrong", F.lit(False))
    else:
        words = dictionary.select(F.lower("word").alias("lower"), F.lit(False).alias("wrong")).distinct()
        tokens = spell_tokens(kg).withColumn("lower", F.lower("token")).join(words, "lower", "left").withColumn("wrong", F.coalesce("wrong", F.lit(True))).drop("lower")
    c = _per_graph(kg, tokens.groupBy("graph_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if("wrong").alias("errors")), checked=0, errors=0)
    d = {"counts": c, "subjects": tokens.groupBy("graph_id", "s", "text").agg(F.count(F.lit(1)).alias("checked"), F.count_if("wrong").alias("errors"), F.array_sort(F.collect_set(F.when(F.col("wrong"), F.col("token")))).alias("wrong")).where("errors > 0")}
    if corrections:
        d["corrections"] = best_corrections(tokens.where("wrong").select(F.lower("token").alias("token")).distinct(), dictionary)
    return MetricResult(c.select("graph_id", T.ratio(F.col("errors"), F.col("checked")).cast("string").alias("score")), d)


def best_corrections(wrong: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, correction): the nearest word within two edits, the more frequent first. Words meet by
    deletion neighbourhoods, so a token is compared with words that share a form with up to two letters less."""
    cuts = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    forms = lambda w: F.array_distinct(F.concat(F.array(w), cuts(w), F.flatten(F.transform(cuts(w), cuts))))
    t = wrong.select("token", F.explode(forms(F.col("token"))).alias("form"))
    d = dictionary.select(F.lower("word").alias("word"), "freq").select("word", "freq", F.explode(forms(F.col("word"))).alias("form"))
    x = t.join(d, "form").select("token", "word", "freq").distinct().withColumn("e", F.levenshtein("token", "word")).where("e <= 2")
    return x.groupBy("token").agg(F.min_by("word", F.struct("e", -F.col("freq"), "word")).alias("correction"))


def duplicate_labels(kg: KnowledgeGraph) -> MetricResult:
    kinds = kg.typed(T.OWL + "Class", T.OWL + "ObjectProperty", T.OWL + "DatatypeProperty").select(*KEY).distinct()
    first = kg.first(T.LABEL, "first")
    x = kg.values(T.LABEL).join(kinds, KEY, "left_semi").select(*KEY).join(first, KEY)
    g = x.groupBy("graph_id", F.lower(T.strip(F.col("first"))).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("s")).alias("entities")).where("n > 1")
    n = _per_graph(kg, g.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")), n=0)
    return MetricResult(n.select("graph_id", F.col("n").cast("string").alias("score")), {"duplicates": g})


def class_search(kg: KnowledgeGraph, search_term: str) -> MetricResult:
    local = T.naming_local(F.col("s"))
    x = kg.typed(T.OWL + "Class", T.RDFS + "Class").where("s_kind = 'iri'").select("graph_id", local.alias("class_name"), F.col("s").alias("uri"))
    x = x.where(F.contains(F.lower("class_name"), F.lower(F.lit(search_term))))
    found = x.groupBy("graph_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("class_name", "uri")))).alias("score"))
    return MetricResult(_per_graph(kg, found, score="[]"), {"classes": x})


METRICS = {
    "checkLabel": check_label, "altLabelCheck": check_altlabel, "definitionCheck": check_definition, "isolatedElements": isolated_elements,
    "classConnections": class_components, "missingDomainRange": missing_domain_range, "leafNodeCheck": leaf_nodes, "semanticConnection": semantic_connection,
    "mdsDesignCheck": design_check, "sparqlEndpoint": sparql_endpoint, "rdfDump": rdf_dump, "humanLicense": human_license, "externalLinks": external_links,
    "classCapitalCheck": check_capital, "classSpaceCheck": check_space, "spellCheck": spell_check, "duplicateLabels": duplicate_labels, "searchClass": class_search,
}
#: These only log a parse failure, so that their row says Success.
LENIENT = {"checkLabel", "altLabelCheck", "definitionCheck", "classCapitalCheck", "leafNodeCheck", "semanticConnection"}
