"""Column expressions over raw text: Turtle lines, identifiers, questions, competency queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = "[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|$)|[a-z]+"
FILLERS = sorted(set("another available classified component components level number part setup specified system test tested testing type types under used using value".split()))
STOPWORDS = sorted(set("""
a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by
can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has
hasn hasn't have haven haven't having he her here hers herself him himself his how i if in into is isn isn't it it's its itself just ll
m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on once only or other our ours ourselves
out over own re s same shan shan't she she's should should've shouldn shouldn't so some such t than that that'll the their theirs them
themselves then there these they this those through to too until up ve very was wasn wasn't we were weren weren't what when where which
while who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself yourselves
""".split()) | set(FILLERS))


def strip_comment(line: Column) -> Column:
    """Up to the first '#' outside double quotes; an escaped quote toggles too, as does one in an IRI."""
    return F.regexp_extract(line, '^([^"#]*+(?:"[^"]*+"?+[^"#]*+)*+)', 1)


def empty_literals(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', '""')


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def identifier_words(text: Column) -> Column:
    """Words of an identifier or label that a dictionary can judge: longer than one letter, no digit."""
    found = F.regexp_extract_all(F.translate(text, "_-", "  "), F.lit(WORDS), F.lit(0))
    return F.filter(found, lambda w: F.length(w) > 1)


def prefixed_terms(query: Column, prefixes: list[str]) -> Column:
    """Names after each prefix in a query's text; no word boundary before the prefix."""
    each = [F.regexp_extract_all(query, F.lit("\\Q" + p.replace("\\E", "") + "\\E:([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)) for p in prefixes]
    return F.array_distinct(F.flatten(F.array(*each)))


def _content(words: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def phrases(question: Column) -> Column:
    """A question's concepts: its parts between and, or, with, for, without stop words."""
    clean = F.regexp_replace(F.lower(question), "[?.,;:!\u2014\u2013\\-()]", " ")
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " ")
    parts = F.split(clean, r"(?U)\band\b|\bor\b|\bwith\b|\bfor\b")
    found = F.filter(F.transform(parts, lambda c: F.array_join(_content(words(c)), " ")), lambda p: p != "")
    whole = F.array_join(_content(words(clean)), " ")
    return F.when(F.size(found) > 0, found).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def pascal(phrase: Column) -> Column:
    kept = F.regexp_replace(phrase, r"[^a-zA-Z0-9\s]", "")
    return F.regexp_replace(F.initcap(kept), r"\s+", "")


def camel(phrase: Column) -> Column:
    p = pascal(phrase)
    return F.when(p == "", F.lit("variable")).otherwise(F.concat(F.lower(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
