"""Merkle fixity audit of WARC records.

Records lie in files at ordered offsets. A record's digest is the SHA-256 of its bytes. A leaf covers a range of
offsets of one file, the records of LEAF_IDS consecutive ids, and hashes their ids, lengths and digests; a node hashes up
to FAN_OUT children, first within a file, then over files. Ranges are cut at records, not at byte counts, so that a
record that was lost, added or changed its length moves the offsets of those that follow, but leaves their hashes as they
are. Two replicas are compared from the roots: only below nodes that differ are children compared, and only in leaves
that differ are records.

Files take FILE_IDS consecutive record ids each, so offsets are sums within a file. Text never leaves the scan: what is
shuffled is a record's id, length and digest, and rows that are the same in these count as one with `copies`. A leaf's hash is
taken from sums of its records' hashes, so it is aggregated before the shuffle, however many records share an id.

Defined results: a null url or html counts as empty; records without an id lie in files and leaves that follow from their digest, so a
changed one is one that is missing and an extra one; repeated rows follow each other; of rows of one id that differ, as many as can be are paired
as corrupt, in the order of their digests; equal replicas, two empty ones among them, give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm._shared import cut, join_checked

FILE_IDS = 1000
LEAF_IDS = 16
FAN_OUT = 16
#: Leaves of a file of records without an id, by two hex digits of their digest.
NULL_LEAVES = 256


def record(page_id, url, html) -> F.Column:
    """The WARC 1.1 resource record of a page, as a string."""
    body = F.coalesce(html, F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of the records of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body = data[end + 4 : end + 4 + int(headers["Content-Length"])]
        yield at, headers, body
        at = end + 8 + len(body)


def _file(page_id, digest, file_ids: int) -> F.Column:
    by_digest = -1 - F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")
    return F.coalesce(F.floor(page_id / F.lit(file_ids)).cast("long") + 1, by_digest)


def manifest(pages: DataFrame, file_ids: int = FILE_IDS) -> DataFrame:
    """file, offset, length, page_id, digest and copies of the records of pages (page_id, url, html)."""
    raw = record(F.col("page_id"), F.col("url"), F.col("html"))
    sized = pages.select("page_id", raw.alias("_raw")).select("page_id", F.octet_length("_raw").cast("long").alias("length"), F.sha2(F.col("_raw").cast("binary"), 256).alias("digest"))
    alike = sized.groupBy("page_id", "length", "digest").agg(F.count(F.lit(1)).alias("copies")).withColumn("file", _file(F.col("page_id"), F.col("digest"), file_ids))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0))
    return alike.select("file", offset.alias("offset"), "length", "page_id", "digest", "copies")


def files(pages: DataFrame, file_ids: int = FILE_IDS) -> DataFrame:
    """file, data: the WARC files themselves, each of at most file_ids pages."""
    one = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).withColumn("d", F.sha2(F.col("r").cast("binary"), 256))
    held = F.array_sort(F.collect_list(F.struct("page_id", "d", "r")))
    return one.groupBy(_file(F.col("page_id"), F.col("d"), file_ids).alias("file")).agg(F.array_join(F.transform(held, lambda x: x["r"]), "").cast("binary").alias("data"))


def _leaf(page_id, digest, file_ids: int, leaf_ids: int) -> F.Column:
    by_digest = F.conv(F.substring(digest, 5, 2), 16, 10).cast("long")
    return F.coalesce(F.floor(F.pmod(page_id, F.lit(file_ids)) / F.lit(leaf_ids)).cast("long"), by_digest)


def _leaves(records: DataFrame, file_ids: int, leaf_ids: int) -> DataFrame:
    """file, place, hash and the range of offsets that a leaf covers in its replica."""
    told = F.sha2(F.concat_ws(":", F.col("page_id"), F.col("length"), F.col("digest"), F.col("copies")), 256)
    quarter = lambda k: F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    held = records.withColumn("_h", told).groupBy("file", _leaf(F.col("page_id"), F.col("digest"), file_ids, leaf_ids).alias("place"))
    sums = [F.sum(quarter(k)) for k in range(4)]
    return held.agg(
        F.sha2(F.concat_ws(":", F.count(F.lit(1)), *sums), 256).alias("hash"), F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length") * F.col("copies")).alias("stop")
    )


def _node(children: DataFrame, file, place, order: str) -> DataFrame:
    """Nodes over up to FAN_OUT children each, in their order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("hash").alias("h"))))
    told = F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["at"], x["h"])), ",")
    return children.groupBy(file.alias("file"), place.alias("place")).agg(F.sha2(told, 256).alias("hash"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def tree(records: DataFrame, levels: tuple[int, int], file_ids: int = FILE_IDS, leaf_ids: int = LEAF_IDS, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """The levels from the leaves up; levels: how many lie above the leaves within a file, and above the files."""
    found = [cut(_leaves(records, file_ids, leaf_ids), "leaves")]
    for _ in range(levels[0]):
        found.append(cut(_node(found[-1], F.col("file"), F.floor(F.col("place") / fan_out), "place"), "inner"))
    for _ in range(levels[1]):
        found.append(cut(_node(found[-1], F.floor(F.col("file") / fan_out), F.col("place"), "file"), "outer"))
    return found


def _heights(records: list[DataFrame], file_ids: int, leaf_ids: int, fan_out: int) -> tuple[int, int]:
    file = 0
    for r in records:
        row = r.agg(F.max("file").alias("high"), F.min("file").alias("low")).first()
        if row["high"] is not None:
            file = max(file, row["high"], -row["low"] - 1)
    heights = []
    for top in (max(NULL_LEAVES - 1, (file_ids - 1) // leaf_ids), file):
        n = 0
        while top:
            top //= fan_out
            n += 1
        heights.append(n)
    return heights[0], heights[1]


def audit(primary: DataFrame, replica: DataFrame, *, file_ids: int = FILE_IDS, leaf_ids: int = LEAF_IDS, fan_out: int = FAN_OUT) -> DataFrame:
    """file, offset, length, page_id, copies, status of the records that differ between two manifests.

    status: corrupt (other bytes in the replica), missing (not in the replica) or extra (only there). Offset, length and copies
    are the primary's, an extra record's the replica's. A record that only moved is no difference.
    """
    columns = ["file", "offset", "length", "page_id", "digest", "copies"]
    sides = [cut(x.select(*columns), "manifest") for x in (primary, replica)]
    levels = _heights(sides, file_ids, leaf_ids, fan_out)
    ours, theirs = (tree(x, levels, file_ids, leaf_ids, fan_out) for x in sides)
    bad = None
    for level in range(len(ours) - 1, -1, -1):
        a, b = (x[level].select("file", "place", "hash") for x in (ours, theirs))
        if bad is not None:  # the children of what differs
            over_files = level >= levels[0]
            parent = [(F.floor(F.col("file") / fan_out) if over_files else F.col("file")).alias("file"), (F.col("place") if over_files else F.floor(F.col("place") / fan_out)).alias("place")]
            a, b = (join_checked(x.select(*parent, F.col("file").alias("f"), F.col("place").alias("p"), "hash"), bad, ["file", "place"], "left_semi").select(F.col("f").alias("file"), F.col("p").alias("place"), "hash") for x in (a, b))
        both = a.withColumnRenamed("hash", "ours").join(b.withColumnRenamed("hash", "theirs"), ["file", "place"], "full_outer")
        bad = cut(both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "place"), "differ")
    held = []
    for x, name in zip(sides, ("ours", "theirs"), strict=True):
        x = x.withColumn("place", _leaf(F.col("page_id"), F.col("digest"), file_ids, leaf_ids))
        x = join_checked(x, bad, ["file", "place"], "left_semi")
        key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id")
        held.append(x.select("file", key, "digest", F.struct("offset", "length", "page_id", "copies").alias(name)))
    both = held[0].join(held[1], ["file", "id", "digest"], "full_outer")
    more = F.coalesce("ours.copies", F.lit(0)) - F.coalesce("theirs.copies", F.lit(0))
    differ = cut(both.withColumn("more", more).where("more <> 0"), "records")
    number = F.row_number().over(Window.partitionBy("file", "id").orderBy("digest"))
    lost = differ.where("more > 0").select("file", "id", number.alias("k"), F.col("ours"), F.col("more").alias("n_lost"))
    found = differ.where("more < 0").select("file", "id", number.alias("k"), F.col("theirs"), (-F.col("more")).alias("n_found"))
    pairs = lost.join(found, ["file", "id", "k"], "full_outer")
    status = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("corrupt")
    known = F.coalesce("ours", "theirs")
    return pairs.select("file", known["offset"].alias("offset"), known["length"].alias("length"), known["page_id"].alias("page_id"), F.coalesce("n_lost", "n_found").alias("copies"), status.alias("status"))
