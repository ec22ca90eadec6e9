"""Main text of web pages by a site style tree.

The DOMs of a host are merged by path (tags and classes, numbers in them generalised, ids left out, and the
weight of the tags). A node that holds text counts its pages and the distribution of its contents over
pages, an inner node the distribution of its presentations, which are the sequences of its children. A
text node's importance joins the normalised entropy of its contents (the same text on every page: 0) with
that of its parent's presentations; an inner node's joins the entropy of its presentations with the mean
importance of the text nodes in its branch, weighted by pages. A branch goes with all it holds if its own
importance is low and no node in it that enough pages have is above. A block of a
node has an importance of its own, 1 - log(pages with that text in the node) / log(pages with the node).
HTML's semantics are a feature of a node, its weight: what an article or main element holds counts
for more, forms and classes or ids that are names of furniture for less; navigation, asides, hidden elements and the like for
nothing, with all they hold. Wherever they are, branches, nodes and blocks whose weighted importance is below
`least` leave the pages of hosts on which they are in at least `min_pages` pages; elsewhere there is
nothing to compare, so importance is 1 and the weight decides. Copies of one page are one page.

The trees' low branches, nodes and blocks are few for a host: up to `small` bytes in all, by a sum over the written
table, they are broadcast and html is not shuffled; beyond it html is joined by host, where adaptive execution splits hot hosts.

Defined cases: null or empty html is an empty text; a null url is a host of its own; repeated rows
each give a row; unclosed tags, comments and cut-off pages are read as far as they go.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gives_back, slices, small_batches

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button canvas audio video xmp noembed noframes".split())
BOILER = frozenset("nav footer aside head menu dialog".split())
NAMES = frozenset("nav navbar navigation menu masthead footer sidebar ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent comment comments disqus replies breadcrumb breadcrumbs newsletter subscribe subscription popup modal login signup pagination pager".split())
VAGUE = frozenset("header aside promotion notice notices alert reply respond share sharing social related recommended overlay search toolbar widget widgets copyright legal skip".split())  # of sections and subjects too
TALK = frozenset("comment comments disqus reply replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SPACE, DIGITS = re.compile(r"\s+"), re.compile(r"\d+")
KEEP, UNSURE, HALF, LOW, DROP = 125, 100, 50, 15, 0  # weights in percent
SHOWN = -1  # in place of a weight, for presentations


def hint(names: str) -> int:
    """Weight by classes and ids. Only whole ones count (ad, ad-2, cookie-notice), no words in others such as has-sidebar or legal-history."""
    weight = UNSURE
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+|\d+$", name) if x]
        if parts and all(x in NAMES or x in VAGUE for x in parts):
            weight = min(weight, LOW if any(x in NAMES for x in parts) else HALF)
    return weight



def blocks(page: str, shown: list | None = None) -> list[tuple[str, int, str]]:
    """(path, weight, text) of every block of a page, in order. shown: gets (path, weight, names of the children) of every element but inline ones."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, str, int, bool, list]] = [("", "", UNSURE, False, [])]  # tag, path, weight, in an article, children
    text: list[str] = []

    def flush() -> None:
        if text:
            s = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if s:
                out.append((stack[-1][1], stack[-1][2], s))

    def close(i: int) -> None:
        if shown is not None:
            shown.extend((x[1], x[2], x[4]) for x in stack[i:] if x[4])
        del stack[i:]

    def leave(tag: str, within: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                if tag not in INLINE:
                    flush()
                close(i)
                return
            if stack[i][0] in within:
                return

    at = 0
    while m := TOKEN.match(page, at):
        at, token, tag = m.end(), m.group(), m.group(2)
        if tag is None:
            if token[0] != "<" or token == "<":
                text.append(token)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br" or tag == "p" and not any(x[0] == "p" for x in stack):
                text.append(" ")
            else:
                leave(tag)
            continue
        if tag in RAW:
            if not m.group(3).rstrip().endswith("/"):  # to its end tag, whatever is between
                end = re.compile("</" + re.escape(tag) + r"[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                leave("p", frozenset(("article", "main", "body", "td", "th", "div", "section", "li")))
            elif tag == "li":
                leave("li", frozenset(("ul", "ol", "menu")))
            elif tag in ("dt", "dd"):
                leave("dt", frozenset(("dl",)))
                leave("dd", frozenset(("dl",)))
            elif tag in ("td", "th", "tr"):
                for t in ("td", "th") + ("tr",) * (tag == "tr"):
                    leave(t, frozenset(("table",)))
        _, path, weight, inside, children = stack[-1]
        attributes = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(m.group(3))} if m.group(3) else {}
        classes = attributes.get("class", "")
        names = classes + " " + attributes.get("id", "") if attributes else ""
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
        if hidden or tag in BOILER or tag == "header" and not inside or attributes.get("role") in ROLES:
            weight = DROP
        elif tag in ("article", "main") and not inside and TALK.isdisjoint(names.lower().split()):
            weight, inside = weight and KEEP, True
        elif tag == "form":
            weight = min(weight, LOW)
        elif names.strip() and tag not in ("html", "body") and tag not in HEADINGS and not (inside and "header" in names.lower()):
            weight = min(weight, hint(names))
        name = DIGITS.sub("#", ".".join([tag, *classes.split()])) if classes else tag
        if tag not in INLINE and children[-1:] != [name]:  # a run of like children counts as one
            children.append(name)
        stack.append((tag, f"{path}/{name}", weight, inside, []))
    flush()
    close(1)
    return out


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def style_tree(pages: DataFrame, *, least: float = 0.2, min_pages: int = 5, depth_share: float = 0.25) -> DataFrame:
    """(host, branches, low, repeats): of each host of pages(host, html) its branches and nodes of low importance, and digests of blocks of low importance in other nodes.

    depth_share: what presentations count for in an importance, contents (or the branch) for the rest."""

    def nodes(batches):
        for b in slices(batches):
            host, path, weight, content, pages, body = [], [], [], [], [], []

            def add(i, p, w, d, n):
                host.append(i), path.append(p), weight.append(w), content.append(d), pages.append(n), body.append(whole)

            for i, page in enumerate(b.column(1).to_pylist()):
                merged: dict[tuple[str, int], list[str]] = {}
                styles: dict[str, list[str]] = {}
                shown: list = []
                found = blocks(page or "", shown)
                whole = digest(*(s for _, w, s in found if w))
                for p, w, s in found:
                    merged.setdefault((p, w), []).append(s)
                for p, w, children in shown:
                    if w:
                        styles.setdefault(p, []).append(" ".join(children))
                for (p, w), texts in merged.items():
                    rows = {digest(f"{p}@{w}", s): 1 for s in texts} if w else {}
                    whole_node = digest(f"{p}@{w}", " ".join(texts))
                    rows[whole_node] = rows.get(whole_node, 0) + (1 << 32)
                    for d, n in rows.items():
                        add(i, p, w, d, n)
                for p, children in styles.items():
                    add(i, p, SHOWN, digest(*sorted(set(children))), 1 << 32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(host, pa.int64())), pa.array(path, pa.string()), *(pa.array(x, pa.int64()) for x in (weight, content, pages, body))], names=["host", "path", "weight", "content", "pages", "body"])

    found = pages.select("host", "html").mapInArrow(gives_back(nodes), "host string, path string, weight long, content long, pages long, body long")  # pages: as a node's whole content times 2^32, and as a block
    seen = found.groupBy("host", "path", "weight", "content").agg(F.sum("pages").alias("pages"), F.min("body").alias("b0"), F.max("body").alias("b1"))
    once = lambda n: F.when(F.col("b0") == F.col("b1"), F.least(n, F.lit(1))).otherwise(n)  # noqa: E731  # copies of one page
    seen = seen.select("host", "path", "weight", "content", once(F.shiftright("pages", 32)).alias("n"), once(F.col("pages").bitwiseAND(F.lit((1 << 32) - 1))).alias("k"))
    share = 1 - least * 100 / F.col("weight")  # a block is low where log k / log m is above; m is at least min_pages, so k above fewest
    fewest = F.when(F.col("weight") > 0, F.pow(F.lit(float(min_pages)), share))
    often = F.collect_list(F.when(F.col("k") > F.greatest(fewest * 0.999, F.lit(1.0)), F.struct("content", "k")))
    node = seen.groupBy("host", "path", "weight").agg(F.sum("n").alias("m"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log("n"))).alias("nlogn"), often.alias("often"))
    m, nlogn = F.col("m"), F.col("nlogn")
    entropy = F.when(m > 1, (F.log(m) - nlogn / m) / F.log(m)).otherwise(F.lit(1.0))
    node = cut(node.withColumn("entropy", entropy).drop("nlogn"))
    shown = node.where(F.col("weight") == SHOWN).select("host", "path", F.col("m").alias("shows"), F.col("entropy").alias("style"))
    text = node.where(F.col("weight") >= 0).withColumn("parent", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    text = text.join(shown.select("host", F.col("path").alias("parent"), "style"), ["host", "parent"], "left")
    style = F.coalesce("style", F.lit(1.0))
    text = text.withColumn("importance", (1 - depth_share) * F.col("entropy") + depth_share * F.least("entropy", style))
    weighted = lambda x: x * F.col("weight") / 100 < least
    rated = text.where((m >= min_pages) & (F.col("weight") > 0)).withColumn("is_low", weighted(F.col("importance")))
    again = F.transform(F.filter("often", lambda x: ~F.col("is_low") & weighted(1 - F.log(x.k) / F.log("m"))), lambda x: x.content)
    low = rated.select("host", F.when(F.col("is_low"), F.concat_ws("@", "path", "weight")).alias("node"), again.alias("again"))
    # branches: the text nodes below each inner node
    ups = F.transform(F.sequence(F.lit(2), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    below = text.where((F.col("weight") > 0) & (F.size(F.split("path", "/")) > 2)).select("host", F.explode(ups).alias("path"), "m", (F.col("importance") * F.col("weight") / 100).alias("i"))
    branch = below.groupBy("host", "path").agg((F.sum(m * F.col("i")) / F.sum("m")).alias("mean"), F.max(F.when(m >= min_pages, F.col("i"))).alias("most")).join(shown, ["host", "path"])
    branch = branch.where((F.col("shows") >= min_pages) & (F.col("most") < least) & ((1 - depth_share) * F.col("mean") + depth_share * F.least("mean", "style") < least))
    rows = low.where("node is not null or size(again) > 0").unionByName(branch.select("host", F.col("path").alias("branch")), allowMissingColumns=True)
    return rows.groupBy("host").agg(F.collect_list("branch").alias("branches"), F.collect_list("node").alias("low"), F.flatten(F.collect_list("again")).alias("repeats"))  # templates, so few for a host


def extract(pages: DataFrame, *, least: float = 0.2, min_pages: int = 5, small: int = 16 << 20) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, text, n_chars)."""
    small_batches(pages.sparkSession)
    hosted = pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))
    low = cut(style_tree(hosted, least=least, min_pages=min_pages))
    size = low.agg(F.sum(F.length("host") + 9 * F.size("repeats") + sum(F.length(F.array_join(c, " ")) + 9 * F.size(c) for c in ("branches", "low")))).first()[0] or 0
    low = F.broadcast(low) if size <= small else low

    def texts(batches):
        for b in slices(batches):
            out = []
            for page, branches, low, repeats in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                weak, again, gone = set(low or ()), set(repeats or ()), tuple(x + "/" for x in branches or ())
                keep = lambda p, w, s: w >= least * 100 and (node := f"{p}@{w}") not in weak and not (gone and p.startswith(gone)) and not (again and digest(node, s) in again)
                out.append("\n".join(s for p, w, s in blocks(page or "") if keep(p, w, s)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = hosted.join(low, "host", "left").select("page_id", "url", "html", "branches", "low", "repeats")
    return joined.mapInArrow(gives_back(texts), f"page_id {kind}, url string, text string, n_chars long")
