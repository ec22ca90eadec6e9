"""Column expressions over RDF terms, and the vocabularies they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCTERMS = "http://purl.org/dc/terms/"
FOAF = "http://xmlns.com/foaf/0.1/"
VOID = "http://rdfs.org/ns/void#"
DCAT = "http://www.w3.org/ns/dcat#"
SD = "http://www.w3.org/ns/sparql-service-description#"
MDS = "https://cwrusdle.bitbucket.io/mds/"
TYPE = RDF + "type"
SUBCLASS = RDFS + "subClassOf"
LABEL = RDFS + "label"
BOUND = {"mds": MDS, "cco": "https://www.commoncoreontologies.org/", "obo": "http://purl.obolibrary.org/obo/", "owl": OWL, "rdf": RDF, "rdfs": RDFS, "skos": SKOS}
FOUNDATIONAL = sorted([RDF, RDFS, OWL, XSD, SKOS, DCTERMS, "http://qudt.org/vocab/unit/", "http://qudt.org/schema/qudt/", "http://www.w3.org/XML/1998/namespace"])


def task_local(uri: Column) -> Column:
    """What follows the later of the last '#' and the last '/'."""
    return F.regexp_extract(uri, "([^#/]*)$", 1)


def naming_local(uri: Column) -> Column:
    """The fragment whole, if there is one, else what follows the last '/'."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def nonblank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def truthy(kind: Column, text: Column, dtype: Column) -> Column:
    """Whether a term counts as present where blanks aren't stripped: empty text, false and zero don't."""
    number = dtype.rlike("#(integer|decimal|double|float|int|long|short|byte|nonNegativeInteger|positiveInteger)$")
    zero = number & text.rlike(r"^\s*[+-]?0*\.?0*(?:[eE][+-]?\d+)?\s*$") & text.rlike("0")
    false = dtype.endswith("#boolean") & text.isin("false", "0")
    return (kind != "literal") | ((text != "") & ~F.coalesce(zero | false, F.lit(False)))


def foundational(uri: Column) -> Column:
    return uri.rlike("^(?:" + "|".join("\\Q" + ns + "\\E" for ns in FOUNDATIONAL) + ")")


def any_fragment(uri: Column, fragments: list[str] | None) -> Column:
    if not fragments:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(f) for f in fragments]), lambda f: F.contains(uri, f))


def capitalised(local: Column) -> Column:
    return local.rlike(r"^\p{IsUppercase}")


#: Tasks that share the nodes of one namespace where the prefixes are too many to go to each task.
SHARES = 32


def with_qname(nodes: DataFrame, prefixes: DataFrame, column: str = "s", name: str = "qname", few: bool = False) -> DataFrame:
    """nodes(graph_id, column) plus prefix:local where the namespace is bound in the graph, else <uri>.

    Most nodes of a graph have one namespace, so few prefixes go to every task, and others are repeated for shares of the nodes."""
    split = r"^(.*?)([\p{L}_][\p{L}\p{N}_.\-]*)?$"
    ns = F.regexp_extract(column, split, 1)
    x = nodes.withColumn("_ns", ns).withColumn("_local", F.regexp_extract(column, split, 2))
    bound = prefixes.groupBy("graph_id", F.col("ns").alias("_ns")).agg(F.max_by("prefix", "seq").alias("_prefix"))
    if few:
        x = x.join(F.broadcast(bound), ["graph_id", "_ns"], "left")
    else:
        x = x.withColumn("_share", F.pmod(F.xxhash64(column), F.lit(SHARES)).cast("int"))
        bound = bound.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        x = x.join(bound, ["graph_id", "_ns", "_share"], "left").drop("_share")
    text = F.when(F.col("_prefix").isNotNull() & (F.col("_local") != ""), F.concat("_prefix", F.lit(":"), "_local")).otherwise(F.concat(F.lit("<"), F.col(column), F.lit(">")))
    return x.withColumn(name, text).drop("_ns", "_local", "_prefix")


def grounded(qname: Column) -> Column:
    return F.lower(qname).rlike("^(?:cco:|bfo:|obo:bfo)")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def grade(pct: Column) -> Column:
    out = F.lit("Very low")
    for least, word in ((25, "Low"), (50, "Moderate"), (75, "Good"), (90, "Excellent")):
        out = F.when(pct >= least, F.lit(word)).otherwise(out)
    return out


def shorten(text: Column, most: int = 150) -> Column:
    return F.when(F.length(text) > most, F.concat(strip(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)
