import hashlib

from pyspark.sql import functions as F

from claimloom.llm import warc_fixity as wf
from claimloom.llm._shared import written
from tests.oracle import compare


def rows(df):
    return sorted(map(tuple, df.collect()))


def pages(spark, data):
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    return df.withColumns({"file": F.lit("clash"), "start": F.lit(-1), "record": F.lit("clash")})


def rewritten(replica, change):
    """A copy of a replica's files, change applied to each (file, start, page_id, record)."""
    data = [out for r in replica.collect() for out in change(r["file"], r["start"], r["page_id"], bytes(r["record"]))]
    return written(replica.sparkSession.createDataFrame(data, replica.schema).repartition(3), "test-replica")


def test_damage_at_rest_is_found_where_it_is(spark):
    data = [(i, f"http://x/{i}", "é" * (i % 7)) for i in range(0, 5000, 3)] + [(None, "u", "h"), (-5, None, None), (7, "a", "b")]
    mine = wf.stored(pages(spark, data).repartition(4))
    at = {(r["file"], r["page_id"]): (r["start"], len(r["record"])) for r in mine.collect()}
    assert len(at) == len(data) - 1 and at[(-1, -5)][0] == 0
    for file in {f for f, _ in at}:
        end = 0
        for start, size in sorted(v for (f, _), v in at.items() if f == file):
            assert start == end
            end = start + size
    assert rows(wf.audit(mine, wf.damaged(mine.filter("file % 3 != 0")).unionByName(mine.filter("file % 3 = 0")))) == []

    def change(file, start, page_id, record):
        if page_id == 300:
            return []
        if page_id in (0, 4998, -5):
            return [(file, start, page_id, record[:-1] + b"!")]
        if page_id == 1500:
            return [(file, start, page_id, record), (file, 10**9, page_id, record)]
        return [(file, start + (2 if file == 3 else 0), page_id, record)]

    got = rows(wf.audit(mine, rewritten(mine, change)))
    want = [(p, 0 if p >= 0 else -1, *at[(0 if p >= 0 else -1, p)], "changed") for p in (-5, 0)] + [(300, 0, *at[(0, 300)], "missing")]
    want += [(4998, 4, *at[(4, 4998)], "changed"), (1500, 1, 10**9, at[(1, 1500)][1], "extra")]
    want += [(p, 3, *v, "moved") for (f, p), v in at.items() if f == 3]
    assert got == sorted(want)


def test_sound_branches_are_left_out(spark):
    mine = wf.stored(pages(spark, [(i, "u", "h" * 300) for i in range(8000)]))
    theirs = rewritten(mine, lambda f, s, p, r: [(f, s, p, r if p != 4321 else r[::-1])])
    leaves = [wf.leaves_of(x) for x in (mine, theirs)]
    shifts = wf.levels_for(*leaves)
    trees = [wf.tree_of(x, shifts) for x in leaves]
    assert [t.filter(F.col("level") == len(shifts)).count() for t in trees] == [1, 1]
    both = trees[0].alias("a").join(trees[1].alias("b"), ["level", "file", "node"]).filter("a.digest != b.digest")
    assert both.groupBy("level").count().filter("count != 1").count() == 0 and both.count() == len(shifts) + 1
    assert wf.differing(*trees, shifts).count() == 1


def test_digests_are_those_of_the_rule(spark):
    (leaf,) = wf.leaves_of(wf.stored(pages(spark, [(2, "u", "é")]))).collect()
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:2>\r\nWARC-Target-URI: u\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\né\r\n\r\n".encode()
    sha = hashlib.sha256(record).hexdigest()
    assert leaf["sha256"] == sha and leaf["digest"] == hashlib.sha256(f"0:{len(record)}:{sha}".encode()).hexdigest()


def test_repeats_long_records_and_empty_table(spark):
    df = pages(spark, [(4, "u", "h"), (4, "u", "h"), (4, "u", "g"), (5, "u", "x" * 3_000_000), (6, "u", "y")])
    mine = wf.stored(df)
    assert rows(wf.audit(mine, wf.stored(df.repartition(3)))) == []
    once = rows(wf.audit(mine, wf.stored(df.dropDuplicates())))
    assert sorted(r[4] for r in once).count("missing") == 1
    none = wf.stored(df.limit(0))
    assert rows(wf.audit(none, none)) == []
    assert {r[4] for r in rows(wf.audit(none, mine))} == {"extra"} and {r[4] for r in rows(wf.audit(mine, none))} == {"missing"}


def test_far_ids_and_offsets(spark):
    """Damage to one record is found there alone, however large ids and offsets are."""
    ids = [0, 1 << 38, (1 << 38) + 1, -(1 << 38), (1 << 62) + 5, -(1 << 62), 9]
    mine = wf.stored(pages(spark, [(i, "u", f"h{i}") for i in ids]))
    far = rewritten(mine, lambda f, s, p, r: [(f, s + (1 << 40) if p == 9 else s, p, r)])
    for replica in (mine, far):
        for damaged in ids:
            theirs = rewritten(replica, lambda f, s, p, r, d=damaged: [(f, s, p, r[:-1] + b"?" if p == d else r)])
            got = wf.audit(replica, theirs).collect()
            assert [(r["page_id"], r["status"]) for r in got] == [(damaged, "changed")]
        if replica is mine:
            ids = [9, 1 << 38]
    assert [r["status"] for r in wf.audit(mine, far).collect()] == ["moved"]


def test_records_at_one_offset_are_told_together(spark):
    mine = wf.stored(pages(spark, [(1, "u", "a"), (2, "u", "b"), (3, "u", "c")]))
    pile = rewritten(mine, lambda f, s, p, r: [(f, 0 if p == 2 else s, p, r)])
    assert rows(wf.audit(pile, pile)) == []
    less = rewritten(pile, lambda f, s, p, r: [(f, s, p, r)] if p != 2 else [])
    assert {(r["page_id"], r["status"]) for r in wf.audit(pile, less).collect()} == {(1, "changed"), (2, "changed")}


def test_query(spark, sf):
    assert compare(spark, sf, wf.query, wf.ORACLE) is None
    assert {r["status"] for r in wf.query(spark, sf).collect()} == {"changed", "missing", "moved", "extra"}
