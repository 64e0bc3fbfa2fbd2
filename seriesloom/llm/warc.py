"""Merkle fixity audit of WARC files.

A record's leaf is the hash of its place (offset and length) and its bytes. Leaves are put together by ranges of the file:
a node of level 1 covers ``RANGE`` bytes of offsets, a node of each level above covers ``FANOUT`` nodes of the one below,
up to one root per file. A node's hash is taken over its children in order of offset, so lost, added, moved or changed
records all change it. As ranges are fixed in the file, a lost record does not shift the nodes after it.

The audit compares roots of two replicas by file, then only the children of nodes that differ, level by level, down to the
records. The table of each level is a fraction of the one below; the leaves are hashed once and written.

Null bytes are no bytes; a null file or offset is a place like others (offset null sorts first, in range 0). Rows that repeat a
place with the same bytes are one record; different bytes at one place are records in order of their hash. Extra columns are not
read. Empty replicas give no rows, or all records of the other as missing or extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tables import stored

RANGE = 1 << 16
FANOUT = 16


def response_record(record_id: Column, url: Column, payload: Column) -> Column:
    """The bytes of a WARC response record for a page, as text."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def placed(records: DataFrame, order: list[str], files: int) -> DataFrame:
    """Deal records (with a column ``record``) into files and give each its byte offset: adds file, offset, length.

    The file is a hash of the whole row, so no key gathers in one; within a file records stand in order of ``order``.
    """
    rows = records.withColumn("file", F.pmod(F.xxhash64(*order, "record"), F.lit(files)).cast("string"))
    rows = rows.withColumn("length", F.octet_length("record").cast("long"))
    before = Window.partitionBy("file").orderBy(*order, "record").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def leaves(records: DataFrame) -> DataFrame:
    """``file, offset, length, hash`` of ``records`` (file, offset, record: binary or text)."""
    data = F.coalesce(F.col("record").cast("binary"), F.lit(b""))
    length = F.octet_length(data).cast("long")
    name = F.concat_ws(":", F.lit("leaf"), F.coalesce(F.col("offset").cast("string"), F.lit("-")), length.cast("string"))
    rows = records.select("file", "offset", length.alias("length"), F.sha2(F.concat_ws(":", name, F.sha2(data, 256)), 256).alias("hash"))
    return rows.distinct()


def tree(leaf: DataFrame, width: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of all files' trees, from ranges up to roots: ``file, node, hash``. Node k covers its k-th range."""
    size = leaf.agg(F.max("offset")).first()[0] or 0
    node = F.coalesce(F.floor(F.col("offset") / width), F.lit(0)).cast("long")
    child = F.struct("offset", "length", "hash")
    text = F.transform(F.array_sort(F.collect_list(child)), lambda c: c["hash"])
    at = leaf.withColumn("node", node).groupBy("file", "node").agg(F.sha2(F.array_join(text, "\n"), 256).alias("hash"))
    levels, nodes = [stored(at, "range-hashes")], size // width + 1
    while nodes > 1:
        up = levels[-1].withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / fanout).cast("long"))
        text = F.transform(
            F.array_sort(F.collect_list(F.struct("child", "hash"))), lambda c: F.concat_ws(":", c["child"].cast("string"), c["hash"])
        )
        up = up.groupBy("file", "node").agg(F.sha2(F.array_join(text, "\n"), 256).alias("hash"))
        levels.append(stored(up, "node-hashes"))
        nodes = -(-nodes // fanout)
    return levels


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that only one side has."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("hash").alias("_hash"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = a.join(b, same, "full_outer").where(~F.col("hash").eqNullSafe(F.col("_hash")))
    return both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys])


def audit(primary: DataFrame, replica: DataFrame, width: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """``file, offset, status`` of the records in which two replicas differ: ``changed``, ``missing`` or ``extra``.

    ``changed``: other bytes at a place; ``missing``: a place only the primary has; ``extra``: one only the replica has.
    """
    leaf = [stored(leaves(r), "leaves") for r in (primary, replica)]
    trees = [tree(x, width, fanout) for x in leaf]
    top = max(map(len, trees))
    trees = [_raised(t, top, fanout) for t in trees]
    bad = stored(_differ(trees[0][-1], trees[1][-1], ["file", "node"]), "differing")
    for level in range(top - 2, -1, -1):
        if bad.isEmpty():
            break
        up = F.floor(F.col("node") / fanout).cast("long")
        below = [_inside(t[level].withColumn("up", up), bad) for t in trees]
        bad = stored(_differ(below[0], below[1], ["file", "node"]), "differing")
    ranged = [_inside(x.withColumn("up", F.coalesce(F.floor(F.col("offset") / width), F.lit(0)).cast("long")), bad) for x in leaf]
    place = ["file", "offset"]
    sides = [
        x.groupBy(*place).agg(F.array_join(F.array_sort(F.collect_list("hash")), ",").alias("hash")) for x in ranged
    ]
    b = sides[1].select(F.col("file").alias("_file"), F.col("offset").alias("_offset"), F.col("hash").alias("_hash"))
    same = F.col("file").eqNullSafe(F.col("_file")) & F.col("offset").eqNullSafe(F.col("_offset"))
    status = F.when(F.col("_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    both = sides[0].join(b, same, "full_outer").where(~F.col("hash").eqNullSafe(F.col("_hash")))
    file = F.when(F.col("hash").isNull(), F.col("_file")).otherwise(F.col("file"))
    offset = F.when(F.col("hash").isNull(), F.col("_offset")).otherwise(F.col("offset"))
    return both.select(file.alias("file"), offset.alias("offset"), status.alias("status"))


def _inside(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows whose parent ``up`` is among the differing nodes."""
    b = bad.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
    return rows.join(b, F.col("file").eqNullSafe(F.col("_file")) & (F.col("up") == F.col("_node")), "left_semi").drop("up")


def _raised(levels: list[DataFrame], top: int, fanout: int) -> list[DataFrame]:
    """A lower tree with levels of one node on top, so that both trees have equally many."""
    while len(levels) < top:
        up = levels[-1].withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / fanout).cast("long"))
        text = F.transform(
            F.array_sort(F.collect_list(F.struct("child", "hash"))), lambda c: F.concat_ws(":", c["child"].cast("string"), c["hash"])
        )
        levels = [*levels, up.groupBy("file", "node").agg(F.sha2(F.array_join(text, "\n"), 256).alias("hash"))]
    return levels
