"""Merkle fixity audit of replicated WARC files.

A record is a WARC response record made of a page. A file holds the records of one range
of ids, in the order of the ids, one behind the other; a replica is stored as rows of
file, start (the record's offset) and record (its bytes) in the shared folder. An audit
hashes what is read back from there.

Address: a file and an offset, each a long of its own. A leaf is the SHA-256 of a record's
offset, length and bytes' digest. The nodes above are those of ordered ranges of offsets,
first of 2^LEAF_BITS bytes, then FAN times as long at each level, up to whole files, then
ranges of files, up to the roots (one for negative ids, one for the others): a node's digest
is that of its children's places and digests, in their order. A record has more than a hundred
bytes, so a node has few children, however the records are distributed.

The audit compares the roots, then the children of nodes that differ only, level by level:
each step is a join of a level with the nodes that differ above it, so undamaged branches
are left out at the top. What is reported are records: changed, missing, extra, or moved
(there with the same bytes, at another offset).

Only digests are shuffled, by nodes, and folded where they are read; offsets come from one
window a file, whose rows are sorted by Spark and may spill. Column functions throughout.

Defined results: a null url or html is an empty one; a null page_id belongs to no
file and is left out; pages that repeat a page_id are records one behind the other, in the
order of their bytes' digests; an empty table has no root and no findings; several records stored at one offset are one leaf, of all
their digests, and are reported together; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm._shared import table, written

FILE_BITS = 10  # 2^10 ids a file
LEAF_BITS = 12
FAN_BITS = 6
CRLF = "\r\n"


def record_of(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC response record."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), page_id.cast("string"),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head.cast("binary"), body, F.lit(CRLF * 2).cast("binary"))


def stored(pages: DataFrame) -> DataFrame:
    """file, start, page_id, record: a replica of the pages, as it is read back from the shared folder."""
    read = pages.filter("page_id IS NOT NULL").select(
        F.col("page_id").cast("long").alias("page_id"), record_of(F.col("page_id"), F.col("url"), F.col("html")).alias("record")
    )
    filed = read.select(F.shiftright("page_id", FILE_BITS).alias("file"), "page_id", "record")
    before = Window.partitionBy("file").orderBy("page_id", F.sha2("record", 256)).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("record")).over(before), F.lit(0)).cast("long")
    return written(filed.select("file", start.alias("start"), "page_id", "record"), "warc")


def leaves_of(replica: DataFrame) -> DataFrame:
    """file, start, digest, sha256, n_bytes, page_id of each record that the replica holds."""
    sha = F.sha2("record", 256)
    size = F.octet_length("record").cast("long")
    digest = F.sha2(F.concat_ws(":", "start", size, sha), 256)
    return written(replica.select("file", "start", digest.alias("digest"), sha.alias("sha256"), size.alias("n_bytes"), "page_id"), "fixity-leaves")


def levels_for(*leaves: DataFrame) -> list[tuple[int, int]]:
    """By how many bits file and offset are shifted at each level above the records."""
    ends = [rows.agg(F.min("file"), F.max("file"), F.max("start")).first() for rows in leaves]
    bits = lambda *columns: max([int(r[c]).bit_length() for r in ends for c in columns if r[c] is not None], default=0)
    steps = lambda first, top: [*range(first, top, FAN_BITS), max(first, top)]
    in_file = steps(LEAF_BITS, bits(2))
    return [(0, shift) for shift in in_file] + [(shift, in_file[-1]) for shift in steps(FAN_BITS, bits(0, 1))]


def tree_of(leaves: DataFrame, levels: list[tuple[int, int]]) -> DataFrame:
    """level, file, node, digest: level 0 are the records' places, level k those shifted by levels[k - 1]."""
    together = F.array_join(F.sort_array(F.collect_list("digest")), ",")
    level = leaves.groupBy("file", F.col("start").alias("node")).agg(together.alias("digest"))
    tree, before = [level.select(F.lit(0).alias("level"), "file", "node", "digest")], (0, 0)
    for k, now in enumerate(levels, 1):
        if k % 2:
            level = written(level, "fixity-level")
        children = F.sort_array(F.collect_list(F.struct("file", "node", "digest")))
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["file"], c["node"], c["digest"])), ",")
        up = [F.shiftright(c, n - b).alias(f"up_{c}") for c, n, b in zip(("file", "node"), now, before)]
        level = level.groupBy(*up).agg(F.sha2(text, 256).alias("digest")).select(F.col("up_file").alias("file"), F.col("up_node").alias("node"), "digest")
        tree.append(level.select(F.lit(k).alias("level"), "file", "node", "digest"))
        before = now
    whole = tree[0]
    for part in tree[1:]:
        whole = whole.unionByName(part)
    return written(whole, "fixity-tree")


def differing(mine: DataFrame, theirs: DataFrame, levels: list[tuple[int, int]]) -> DataFrame:
    """file, node, mine, theirs: the places of records that differ, found from the roots down."""
    bits = [(0, 0), *levels]

    def compared(level: int, under: DataFrame | None) -> DataFrame:
        sides = []
        for tree, name in ((mine, "mine"), (theirs, "theirs")):
            side = tree.filter(F.col("level") == level).select("file", "node", F.col("digest").alias(name))
            if under is not None:
                up = [F.shiftright(c, n - b).alias(f"up_{c}") for c, n, b in zip(("file", "node"), bits[level + 1], bits[level])]
                side = side.select("*", *up).join(under, ["up_file", "up_node"], "left_semi").drop("up_file", "up_node")
            sides.append(side)
        both = sides[0].join(sides[1], ["file", "node"], "full_outer")
        return both.filter(~F.col("mine").eqNullSafe(F.col("theirs")))

    found = compared(len(levels), None)
    for level in range(len(levels) - 1, -1, -1):
        found = compared(level, written(found.select(F.col("file").alias("up_file"), F.col("node").alias("up_node")), "fixity-differing"))
    return found


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, file, start, n_bytes, status of each record in which two stored replicas differ.

    status is changed, missing (from the replica), moved (in the replica at another offset of
    the file) or extra (there alone; its offsets are then those of the replica)."""
    mine, theirs = leaves_of(original), leaves_of(replica)
    levels = levels_for(mine, theirs)
    found = differing(tree_of(mine, levels), tree_of(theirs, levels), levels)
    found = written(found.select("file", F.col("node").alias("start"), "mine", "theirs"), "fixity-found")
    columns = ("page_id", "file", "start", "n_bytes", "sha256")
    at = lambda leaves, which: found.filter(which).join(leaves, ["file", "start"]).select(*columns)
    changed = at(mine, "mine IS NOT NULL AND theirs IS NOT NULL").withColumn("status", F.lit("changed"))
    # equal records of a file are paired in their order
    place = F.row_number().over(Window.partitionBy("file", "page_id", "sha256").orderBy("start"))
    gone, new = (at(leaves, f"{which} IS NULL").withColumn("place", place) for leaves, which in ((mine, "theirs"), (theirs, "mine")))
    keys = ["file", "page_id", "sha256", "place"]
    both = gone.join(new.select(*keys, F.col("start").alias("there"), F.col("n_bytes").alias("size")), keys, "full_outer")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("start").isNull(), "extra").otherwise("moved")
    rest = both.select("page_id", "file", F.coalesce("start", "there").alias("start"), F.coalesce("n_bytes", "size").alias("n_bytes"), status.alias("status"))
    return changed.drop("sha256").unionByName(rest)


def damaged(replica: DataFrame) -> DataFrame:
    """A stored copy of a stored replica, with damage by rule to the bytes of every third file, the first included.

    Of its records those whose page_id leaves 3 when divided by 17 have another first byte,
    of 8 are lost, of 11 come once more behind the file's end, and of 14 are there alone."""
    kind, hit = F.pmod(F.col("page_id"), F.lit(17)), F.pmod(F.col("file"), F.lit(3)) == 0
    flipped = F.concat(F.lit("w").cast("binary"), F.expr("substring(record, 2)"))
    record = F.when(hit & (kind == 3), flipped).otherwise(F.col("record"))
    kept = replica.filter(~(hit & kind.isin(8, 14))).select("file", "start", "page_id", record.alias("record"))
    ends = replica.groupBy("file").agg(F.max(F.col("start") + F.octet_length("record")).alias("end"))
    behind = replica.filter(hit & kind.isin(11, 14)).join(ends, "file").select("file", (F.col("end") + F.col("start")).alias("start"), "page_id", "record")
    return written(kept.unionByName(behind), "warc-replica")


def query(spark, sf_dir):
    original = stored(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return audit(original, damaged(original))


#: both replicas as records with digests, compared place by place
ORACLE = f"""
WITH recorded AS (
  SELECT page_id, page_id >> {FILE_BITS} AS file, page_id % 17 AS kind, (page_id >> {FILE_BITS}) % 3 = 0 AS hit,
    replace('WARC/1.1||WARC-Type: response||WARC-Record-ID: <urn:page:' || page_id || '>||WARC-Target-URI: ', '||', chr(13) || chr(10)) || coalesce(url, '')
      || replace('||Content-Type: text/html||Content-Length: ' || strlen(coalesce(html, '')) || '||||', '||', chr(13) || chr(10))
      || coalesce(html, '') || repeat(chr(13) || chr(10), 2) AS record
  FROM pages WHERE page_id IS NOT NULL),
placed AS (
  SELECT *, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(sum(strlen(record)) OVER (PARTITION BY file) AS BIGINT) AS file_end
  FROM recorded),
mine AS (SELECT file, start, page_id, strlen(record) AS n_bytes, sha256(record) AS digest FROM placed),
theirs AS (
  SELECT file, start, page_id, strlen(record) AS n_bytes, sha256(CASE WHEN hit AND kind = 3 THEN 'w' || substr(record, 2) ELSE record END) AS digest
  FROM placed WHERE NOT (hit AND kind IN (8, 14))
  UNION ALL
  SELECT file, file_end + start, page_id, strlen(record), sha256(record) FROM placed WHERE hit AND kind IN (11, 14)),
gone AS (SELECT * FROM mine ANTI JOIN theirs USING (file, start)),
new AS (SELECT * FROM theirs ANTI JOIN mine USING (file, start))
SELECT m.page_id, m.file, m.start, m.n_bytes, 'changed' AS status FROM mine m JOIN theirs t USING (file, start) WHERE m.digest <> t.digest
UNION ALL
SELECT coalesce(g.page_id, n.page_id), coalesce(g.file, n.file), coalesce(g.start, n.start), coalesce(g.n_bytes, n.n_bytes),
  CASE WHEN n.start IS NULL THEN 'missing' WHEN g.start IS NULL THEN 'extra' ELSE 'moved' END
FROM gone g FULL JOIN new n ON g.file = n.file AND g.page_id = n.page_id AND g.digest = n.digest
"""
