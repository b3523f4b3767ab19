"""Merkle fixity audit of WARC replicas.

Every record is hashed (SHA-256 of its bytes) where it is scanned; only hashes travel.  A tree is
built over ordered offset ranges of each archive: a level-1 node covers ``RANGE`` bytes of offsets and
hashes its records' (offset, hash) pairs in order, and each node above covers ``FANOUT`` nodes
below, up to one root per archive.  Ranges are fixed by offset, so building needs no running position.
``audit`` compares the roots of two replicas, then joins only the children of nodes that differ,
level by level, and ends with the records that are altered, missing or added.  A node holds
at most FANOUT children; a level-1 node as many records as start in RANGE bytes.

Defined results: null payloads hash as empty ones; a record present twice at one offset counts
once if equal and as two conflicting entries otherwise; null archive or offset rows are refused
by neither side but form archive '' at offset -1; empty replicas have no roots, so all records of the
other are missing or added; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelq.llm.common import materialize, read

RANGE = 1 << 16
FANOUT = 16
LEVELS = 6
#: Page ids per archive in the registered query.
ARCHIVE_PAGES = 512


def warc_record(url: Column, payload: Column) -> Column:
    """Bytes of one WARC/1.0 response record (as a string column)."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """``archive, offset, hash`` of records (archive, offset, content)."""
    return records.select(F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"),
                          F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
                          F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256).alias("hash"))


def tree(leaf: DataFrame) -> DataFrame:
    """All nodes ``archive, level, node, hash`` above ``leaf``; the root is node 0 (or -1 and 0) of the top level,
    where LEVELS levels cover RANGE * FANOUT ** (LEVELS - 1) bytes of offsets; longer archives have several tops."""
    def node_hash(order: str) -> Column:
        pair = F.struct(F.col(order).alias("o"), F.col("hash").alias("h"))
        listed = F.transform(F.array_sort(F.collect_set(pair)), lambda x: F.concat_ws(":", x["o"].cast("string"), x["h"]))
        return F.sha2(F.array_join(listed, ";"), 256).alias("hash")

    level = leaf.groupBy("archive", F.floor(F.col("offset") / RANGE).alias("node")).agg(node_hash("offset"))
    level = materialize(level, "fixity")
    nodes = [level.withColumn("level", F.lit(1))]
    for k in range(2, LEVELS + 1):
        level = level.select("archive", F.col("node").alias("_child"), F.floor(F.col("node") / FANOUT).alias("node"), "hash") \
            .groupBy("archive", "node").agg(node_hash("_child"))
        nodes.append(level.withColumn("level", F.lit(k)))
    out = nodes[0]
    for x in nodes[1:]:
        out = out.unionByName(x)
    return out.select("archive", "level", "node", "hash")


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    both = a.withColumnRenamed("hash", "_a").join(b.withColumnRenamed("hash", "_b"), keys, "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b")))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ between two replicas' ``leaves``: archive, offset, primary_hash,
    replica_hash, status ('altered', 'missing', 'added' in the replica)."""
    ta, tb = materialize(tree(primary), "fixity-tree"), materialize(tree(replica), "fixity-tree")

    def at(t: DataFrame, k: int) -> DataFrame:
        return t.where(F.col("level") == k).select("archive", "node", "hash")

    bad = _differing(at(ta, LEVELS), at(tb, LEVELS), ["archive", "node"]).select("archive", F.col("node").alias("_parent"))
    for k in range(LEVELS - 1, 0, -1):
        def below(t: DataFrame, k: int = k, bad: DataFrame = bad) -> DataFrame:
            return at(t, k).withColumn("_parent", F.floor(F.col("node") / FANOUT)).join(bad, ["archive", "_parent"], "left_semi") \
                .select("archive", "node", "hash")
        bad = _differing(below(ta), below(tb), ["archive", "node"]).select("archive", F.col("node").alias("_parent"))
    bad = materialize(bad, "fixity-bad")

    def records(leaf: DataFrame) -> DataFrame:
        ranged = leaf.distinct().withColumn("_parent", F.floor(F.col("offset") / RANGE))
        return ranged.join(bad, ["archive", "_parent"], "left_semi").select("archive", "offset", "hash")

    a, b = records(primary), records(replica)
    only_a = a.join(b, ["archive", "offset", "hash"], "left_anti").groupBy("archive", "offset").agg(F.min("hash").alias("primary_hash"))
    only_b = b.join(a, ["archive", "offset", "hash"], "left_anti").groupBy("archive", "offset").agg(F.min("hash").alias("replica_hash"))
    both = only_a.join(only_b, ["archive", "offset"], "full")
    status = F.when(F.col("replica_hash").isNull(), "missing").when(F.col("primary_hash").isNull(), "added").otherwise("altered")
    return both.withColumn("status", status)


def page_records(pages: DataFrame) -> DataFrame:
    """Pages as WARC records: archive (ARCHIVE_PAGES ids each), offset (bytes of the records before it by page_id), content."""
    rows = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / ARCHIVE_PAGES).cast("string"),
                                              F.concat(F.lit("x"), F.pmod(F.xxhash64("url", "html"), F.lit(4096)))).alias("archive"),
                        warc_record(F.col("url"), F.col("html")).alias("content"))
    return rows.withColumn("n_bytes", F.octet_length("content").cast("long"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity of every page's record against a replica in which the records with
    an md5 of page_id below '03' have one byte changed: page_id, archive, offset, n_bytes, sha256, status."""
    rows = page_records(read(spark, sf_dir, "pages"))
    damaged = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2) < "03"
    other = F.when(F.substring("content", 1, 1) == "W", "w").otherwise("W")
    hurt = F.when(damaged, F.sha2(F.overlay("content", other, F.lit(1)), 256)).otherwise(F.sha2("content", 256))
    narrow = rows.select("page_id", "archive", "n_bytes", F.sha2("content", 256).alias("hash"), hurt.alias("other"))
    by = Window.partitionBy("archive").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    narrow = materialize(narrow.withColumn("offset", F.coalesce(F.sum("n_bytes").over(by), F.lit(0))), "fixity-records")
    found = audit(narrow.select("archive", "offset", "hash"), narrow.select("archive", "offset", F.col("other").alias("hash")))
    out = narrow.join(found.select("archive", "offset", "status"), ["archive", "offset"], "left")
    return out.select("page_id", "archive", "offset", "n_bytes", F.col("hash").alias("sha256"),
                      F.coalesce("status", F.lit("intact")).alias("status"))


_CONTENT = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

_ORACLE = f"""
WITH r AS (SELECT page_id, (page_id // {ARCHIVE_PAGES})::varchar AS archive, {_CONTENT} AS content FROM pages),
n AS (SELECT page_id, archive, strlen(content) AS n_bytes, sha256(content) AS sha256 FROM r)
SELECT page_id, archive, coalesce(sum(n_bytes) OVER (PARTITION BY archive ORDER BY page_id, sha256
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset", n_bytes, sha256,
  CASE WHEN substr(md5(page_id::varchar), 1, 2) < '03' THEN 'altered' ELSE 'intact' END AS status
FROM n"""

QUERIES = {"op5_warc_fixity": op5_warc_fixity}
ORACLE_SQL = {"op5_warc_fixity": _ORACLE}
