"""WARC files of pages, and a Merkle fixity audit of replicas.

`write_files` lays records out by id in gzip WARC files, one member for each record; `read_files` finds the members
again, with their offsets. Each record's bytes (header block, payload, end) give a leaf
hash, and ordered offset ranges of `fanout` children give the nodes above, to one root for each file. An
audit joins the roots of two replicas, and per level only the children of mismatching nodes,
down to the places that differ or lack; the records at these places are then matched by their ids, so that
a lost record is told from those that only moved up. Trees and audits are DataFrame expressions; records are
hashed before any shuffle, and a node's children are `fanout` rows at most, so no group grows with the data.

Defined cases: null url or html are empty in the record; null ids come first; repeated rows are
records each, in order of their bytes; an empty table has no files; a member cut off or unreadable ends its
file's records, and the audit names the rest as missing.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, gives_back, slices, small_batches

DATE = "2026-01-01T00:00:00Z"


def uid(page_id: Column, url: Column, html: Column) -> Column:
    return F.md5(F.concat_ws("|", page_id.cast("string"), url, F.coalesce(html, F.lit(""))))


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record as text; Content-Length counts the payload's UTF-8 bytes."""
    body, u = F.coalesce(html, F.lit("")), uid(page_id, url, html)
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(u, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    head = ["WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: ", urn, f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: ", F.coalesce(url, F.lit("")), "\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Payload-Digest: sha256:", F.sha2(body, 256), "\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n", body, "\r\n\r\n"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head])


def placed(rows: DataFrame) -> DataFrame:
    """rows(file, page_id, digest, length, ...) plus n and offset, in order of page_id and digest in each file."""
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    x = rows.withColumn("n", F.row_number().over(order).cast("long") - 1)
    return x.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def n_files(pages: DataFrame, per_file: int) -> int:
    return max(1, -(-pages.count() // per_file))


def hashed(pages: DataFrame, files: int) -> DataFrame:
    """(file, page_id, uid, digest, length, bytes, data): records with their file, a hash of id and digest; bytes: of the html."""
    x = pages.select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"), uid(F.col("page_id"), F.col("url"), F.col("html")).alias("uid"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("data"))
    x = x.withColumn("digest", F.sha2("data", 256)).withColumn("length", F.octet_length("data").cast("long"))
    return x.withColumn("file", F.pmod(F.xxhash64("page_id", "digest"), F.lit(files)))


def write_files(pages: DataFrame, folder: str, *, per_file: int = 1024, level: int = 6) -> DataFrame:
    """Writes pages' records to folder/part-N.warc.gz and returns (file, path, n, page_id, offset, length) of the members.

    A task writes whole files, one after another; a file appears under its name when it is whole, so a task may run again."""
    small_batches(pages.sparkSession)
    os.makedirs(folder, exist_ok=True)
    x = hashed(pages, n_files(pages, per_file)).select("file", "page_id", "digest", F.col("data").cast("binary").alias("data"))

    def run(batches):
        out, path, name, n, at = None, None, None, 0, 0
        for b in slices(batches):
            found = []
            for file, page_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if file != name:
                    if out:
                        out.close(), os.replace(path + ".part", path)
                    name, n, at, path = file, 0, 0, f"{folder}/part-{file:06d}.warc.gz"
                    out = open(path + ".part", "wb")
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = c.compress(data) + c.flush()
                out.write(member)
                found.append((file, path, n, page_id, at, len(member)))
                n, at = n + 1, at + len(member)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*found)], names=["file", "path", "n", "page_id", "offset", "length"])
        if out:
            out.close(), os.replace(path + ".part", path)

    grouped = x.repartition("file").sortWithinPartitions("file", "page_id", "digest")
    return cut(grouped.mapInArrow(gives_back(run), "file long, path string, n long, page_id long, offset long, length long"))


HEAD = re.compile(rb"WARC/1\.\d\r\n(?:.+\r\n)*?\r\n")
FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)


def members(path: str, chunk: int = 1 << 20):
    """(offset, length, data) of each gzip member of a file; what can't be read ends it."""
    with open(path, "rb") as f:
        at, size, data, d, rest = 0, 0, [], zlib.decompressobj(31), b""
        while block := rest or f.read(chunk):
            try:
                data.append(d.decompress(block))
            except zlib.error:
                return
            rest = d.unused_data
            size += len(block) - len(rest)
            if d.eof:
                yield at, size, b"".join(data)
                at, size, data, d = at + size, 0, [], zlib.decompressobj(31)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n, offset, length, record_id, uri, sha256, sound): the records of a folder's files. sound: the payload has the length and the digest that its header says."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                path, found = re.sub("^file:/*", "/", path), []
                number = int(re.search(r"(\d+)\.warc\.gz$", path).group(1))
                for n, (at, size, data) in enumerate(members(path)):
                    head = HEAD.match(data)
                    fields = {k.lower(): v for k, v in FIELD.findall(head.group())} if head else {}
                    body = data[head.end() : -4] if head else b""
                    sound = fields.get(b"content-length") == str(len(body)).encode() and fields.get(b"warc-payload-digest", b"").endswith(hashlib.sha256(body).hexdigest().encode())
                    found.append((number, n, at, size, fields.get(b"warc-record-id", b"").decode(errors="replace"), fields.get(b"warc-target-uri", b"").decode(errors="replace"), hashlib.sha256(data).hexdigest(), sound))
                    if len(found) == 4096:
                        yield _batch(found)
                        found = []
                if found:
                    yield _batch(found)

    return paths.mapInArrow(gives_back(run), "file long, n long, offset long, length long, record_id string, uri string, sha256 string, sound boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], names=["file", "n", "offset", "length", "record_id", "uri", "sha256", "sound"])


def tree(leaf: DataFrame, *, fanout: int = 16, levels: int = 3) -> DataFrame:
    """All nodes (file, level, n, hash, offset, stop); the highest level has one node for a file, if its leaves are at most fanout ** levels."""
    out = x = leaf
    for k in range(1, levels + 1):
        g = x.groupBy("file", F.floor(F.col("n") / fanout).alias("p")).agg(F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("c"), F.min("offset").alias("offset"), F.max("stop").alias("stop"))
        x = g.select("file", F.lit(k).alias("level"), F.col("p").alias("n"), F.sha2(F.concat(F.lit("node:"), F.array_join("c.hash", "")), 256).alias("hash"), "offset", "stop")
        x = cut(x) if k == 1 else x  # those above have a fanout-th of the rows each
        out = out.unionByName(x)
    return out


def height(leaf: DataFrame, fanout: int) -> int:
    """Levels above the leaves until a file has one node."""
    most, levels = (leaf.agg(F.max("n")).first()[0] or 0) + 1, 1
    while fanout**levels < most:
        levels += 1
    return levels


def audit(a: DataFrame, b: DataFrame, *, fanout: int = 16, levels: int = 3) -> DataFrame:
    """(file, n, offset, stop): leaves that differ between two replicas' trees, found from the roots down."""
    bad = None
    for level in range(levels, -1, -1):
        x, y = (t.where(F.col("level") == level).select("file", "n", F.col("hash").alias(h), F.struct("offset", "stop").alias(s)) for t, h, s in ((a, "ha", "sa"), (b, "hb", "sb")))
        if bad is not None:
            parents = bad.select("file", F.explode(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda i: F.col("n") * fanout + i)).alias("n"))
            x, y = x.join(parents, ["file", "n"], "left_semi"), y.join(parents, ["file", "n"], "left_semi")
        bad = cut(x.join(y, ["file", "n"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "n", F.coalesce("sa", "sb").alias("span")))
    return bad.select("file", "n", "span.offset", "span.stop")


def compare(a: DataFrame, b: DataFrame, *, fanout: int = 16) -> DataFrame:
    """(file, n, uid, status) of the records that two replicas don't share: changed, missing from b, or added in b.

    a, b(file, n, uid, hash, offset, stop). Only records at places that the audit finds are matched, by uid and hash."""
    leaf = lambda x: x.select("file", F.lit(0).alias("level"), "n", "hash", "offset", "stop")
    levels = max(height(a, fanout), height(b, fanout))
    bad = audit(tree(leaf(a), fanout=fanout, levels=levels), tree(leaf(b), fanout=fanout, levels=levels), fanout=fanout, levels=levels).select("file", "n")
    x, y = (t.join(bad, ["file", "n"], "left_semi").select("file", "n", "uid", "hash") for t in (a, b))
    # repeated records are told apart by their number among their like
    number = lambda t: t.withColumn("i", F.row_number().over(Window.partitionBy("file", "uid", "hash").orderBy("n")))
    x, y = number(x), number(y)
    same = ["file", "uid", "hash", "i"]
    lost, new = x.join(y, same, "left_anti"), y.join(x, same, "left_anti")
    of = lambda t: t.groupBy("file", "uid").agg(F.count(F.lit(1)).alias("others"))
    lost = lost.join(of(new), ["file", "uid"], "left").select("file", "n", "uid", F.when(F.col("others").isNull(), "missing").otherwise("changed").alias("status"))
    known = of(x)
    return lost.unionByName(new.join(known, ["file", "uid"], "left_anti").select("file", "n", "uid", F.lit("added").alias("status")))


def damaged(base: DataFrame) -> DataFrame:
    """A second replica's records, as a store with faults holds them, by the bytes of their html: one letter of a record is lost
    where they leave 5 divided by 97; records that leave 7 divided by 991 are lost."""
    cut_off = F.concat(F.substring("data", 1, 40), F.expr("substring(data, 42)"))
    data = F.when(F.col("bytes") % 97 == 5, cut_off).otherwise(F.col("data"))
    return base.where(F.col("bytes") % 991 != 7).withColumn("data", data)


def fixity(pages: DataFrame, *, fanout: int = 16, per_file: int = 1024, damage=damaged) -> DataFrame:
    """Audits pages' records against a replica with planted faults: (page_id, file, record, offset, length, sha256, status, corrupt)."""
    x = hashed(pages, n_files(pages, per_file))
    narrow = lambda t: t.select("file", "page_id", "uid", "digest", F.sha2("data", 256).alias("hash"), F.octet_length("data").cast("long").alias("length"))
    sides = [cut(placed(narrow(t))).withColumn("stop", F.col("offset") + F.col("length")) for t in (x, damage(x))]
    found = compare(*sides, fanout=fanout).where("status <> 'added'")
    r = sides[0].join(found.select("file", "n", "status"), ["file", "n"], "left")
    status = F.coalesce("status", F.lit("same"))
    return r.select("page_id", F.col("file").cast("long").alias("file"), F.col("n").alias("record"), "offset", "length", F.col("hash").alias("sha256"), status.alias("status"), (status != "same").alias("corrupt"))
