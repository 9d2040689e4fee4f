"""WARC records and their fixity audit by Merkle trees over ordered offset ranges.

Pages become response records, and records of neighbouring page_ids a WARC file, one after another. A leaf hashes a record's digest
with its offset and length; a node hashes its children in order, FANOUT of them; a file's root stands for all its bytes. Two
replicas are compared root by root, and only below differing nodes level by level, so an audit moves a few hashes for
every damaged record and none below sound roots. Leaves and nodes are DataFrame expressions; records are never gathered.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Records of a file: a span of page_ids, a power of two; children of a node. Levels: leaves (0), nodes of 16, of 256 (the root of a full file).
PAGES_PER_FILE, FANOUT = 256, 16


def record(url: Column, page_id: Column, html: Column) -> Column:
    """A WARC/1.1 response record's bytes. Null url or html count as empty; a null page_id as -."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def records(pages: DataFrame) -> DataFrame:
    """(file, page_id, record): file is page_id div 256; pages without page_id are dealt to files of negative numbers by content."""
    page, url, html = F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    file = F.coalesce(F.shiftright(page, PAGES_PER_FILE.bit_length() - 1), -(1 << 62) + F.pmod(F.xxhash64(url, html), F.lit(1 << 40)))
    return pages.select(file.alias("file"), page.alias("page_id"), record(url, page, html).alias("record"))


def manifest(recs: DataFrame) -> DataFrame:
    """(file, page_id, place, offset, length, digest, leaf) of every record. Only digests and lengths are shuffled.

    A file's records are in the order of page_id, repeated ones in that of their digests, and offset is where a record starts.
    Equal records are counted before they are placed, and those of a page_id are placed within parts, by the first two signs of their
    digests, so no task orders all records of a file in which a page_id, or a null one, stands for very many.
    """
    own = recs.select("file", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    alike = own.groupBy("file", "page_id", "digest", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.lit(" "), F.substring("digest", 1, 2)))

    def before(window, n, size):
        up_to = window.rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(n).over(up_to) - F.col(n), F.sum(size).over(up_to) - F.col(size)

    parts = alike.groupBy("file", "page_id", "part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("size"))
    place, offset = before(Window.partitionBy("file").orderBy("page_id", "part"), "n", "size")
    parts = parts.select("file", "part", place.alias("part_place"), offset.alias("part_offset"))
    place, offset = before(Window.partitionBy("file", "part").orderBy("digest"), "n", "size")
    inside = alike.withColumn("size", F.col("n") * F.col("length")).withColumns({"place": place, "offset": offset}).join(parts, ["file", "part"])
    copies = inside.withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)")))
    placed = copies.withColumns({"place": F.col("part_place") + F.col("place") + F.col("copy"), "offset": F.col("part_offset") + F.col("offset") + F.col("copy") * F.col("length")})
    leaf = F.sha2(F.concat_ws("|", "digest", F.col("offset").cast("string"), F.col("length").cast("string")), 256)
    return placed.select("file", "page_id", "place", "offset", "length", "digest", leaf.alias("leaf"))


def parents(nodes: DataFrame) -> DataFrame:
    """(file, place, hash) one level up; a group of children is at most FANOUT hashes."""
    children = F.array_sort(F.collect_list(F.struct("place", "hash")))
    up = nodes.groupBy("file", F.floor(F.col("place") / FANOUT).alias("place")).agg(children.alias("c"))
    return up.select("file", "place", F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), "|"), 256).alias("hash"))


def tree(held: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels (file, place, hash) from leaves up to one node a file. Files of more than 256 records get more levels."""
    levels = [held.select("file", "place", F.col("leaf").alias("hash"))]
    most = held.agg(F.max("place")).first()[0] or 0
    while most or len(levels) < 2:
        levels.append(scratch.write(parents(levels[-1]), f"{name}{len(levels)}"))
        most //= FANOUT
    return levels


def differing(good: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """(file, place) of the leaves that differ, found from the roots down: a level is only looked at below nodes that differ."""
    while len(good) < len(other):
        good = [*good, parents(good[-1])]
    while len(other) < len(good):
        other = [*other, parents(other[-1])]
    below = None
    for a, b in zip(reversed(good), reversed(other), strict=True):
        a, b = a.withColumnRenamed("hash", "ha"), b.withColumnRenamed("hash", "hb")
        if below is not None:
            a, b = (x.join(below, [x.file == below.f, F.floor(x.place / FANOUT) == below.p], "left_semi") for x in (a, b))
        odd = a.join(b, ["file", "place"], "full").where(~F.col("ha").eqNullSafe(F.col("hb")))
        below = odd.select(F.col("file").alias("f"), F.col("place").alias("p"))
    return below.select(F.col("f").alias("file"), F.col("p").alias("place"))


def audit(recs: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, place, page_id, offset, length, digest, status) of every record of recs and every additional one of the replica.

    status: sound; damaged: other bytes at this place; moved: its own bytes, but at another offset, as after a damage that
    changed a length; missing: the replica's file ends before; extra: the replica has a record where recs has none. Both are tables
    (file, page_id, record). Empty tables give no rows.
    """
    scratch = Scratch(recs.sparkSession)
    a, b = scratch.write(manifest(recs), "good"), scratch.write(manifest(replica), "other")
    odd = scratch.write(differing(tree(a, scratch, "ta"), tree(b, scratch, "tb")), "odd")
    seen = b.join(odd, ["file", "place"], "left_semi").select("file", "place", *(F.col(c).alias(f"b_{c}") for c in ("page_id", "offset", "length", "digest")))
    at_odds = odd.join(a, ["file", "place"], "left").join(seen, ["file", "place"], "left")
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("b_digest").isNull(), "missing").when(F.col("digest") == F.col("b_digest"), "moved").otherwise("damaged")
    own = [F.when(F.col("digest").isNull(), F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in ("page_id", "offset", "length", "digest")]
    told = at_odds.select("file", "place", *own, status.alias("status"))
    sound = a.join(odd, ["file", "place"], "left_anti").select("file", "place", "page_id", "offset", "length", "digest", F.lit("sound").alias("status"))
    return sound.unionByName(told)


def damaged(recs: DataFrame, one_in: int = 97) -> DataFrame:
    """A replica as worn media would leave it: of the records whose page_id is a multiple of one_in, the byte before the last four is
    another one. All records stay."""
    n = F.octet_length("record")
    worn = F.concat(F.substring("record", 1, 1), F.expr("substring(record, 2, octet_length(record) - 6)"), F.encode(F.lit("\x00"), "UTF-8"), F.expr("substring(record, octet_length(record) - 3, 4)"))
    return recs.withColumn("record", F.when((F.col("page_id") % one_in == 0) & (n > 6), worn).otherwise(F.col("record")))


def files(recs: DataFrame) -> DataFrame:
    """(file, name, bytes): each file's records after one another; a file is at most 256 records."""
    order = F.array_sort(F.collect_list(F.struct(F.col("page_id"), F.sha2("record", 256).alias("digest"), F.col("record"))))
    joined = F.aggregate(F.col("r"), F.encode(F.lit(""), "UTF-8"), lambda acc, x: F.concat(acc, x["record"]))
    return recs.groupBy("file").agg(order.alias("r")).select("file", F.concat(F.lit("pages-"), F.col("file").cast("string"), F.lit(".warc")).alias("name"), joined.alias("bytes"))


def parse(data: bytes) -> list[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of every record of a WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start, n = end + 4, int(fields["Content-Length"])
        out.append((at, fields, data[start : start + n]))
        at = start + n + 4
    return out


def root_of(leaves: list[str]) -> str:
    """A file's root from its leaves, without Spark."""
    level = leaves
    first = True
    while first or len(level) > 1:
        level = [hashlib.sha256("|".join(level[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]
        first = False
    return level[0]
