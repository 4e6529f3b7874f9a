from claimloom.operators import scope


def shuffled(spark, run):
    """Rows that run() writes to shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store = sc._jsc.sc().statusStore()
    stages = lambda: store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    written = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (x.apply(i) for x in [stages()] for i in range(x.size()))}
    before = written()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n - before.get(k, 0) for k, n in written().items())


def by_hand(drafts, bundles, documents, fallback):
    out = set()
    for d in {r[0] for r in drafts}:
        held = set()
        for _, matter, bundle in (r for r in drafts if r[0] == d):
            if bundle is not None:
                held |= {x for b, x in bundles if b == bundle}
            elif fallback:
                held |= {x for x, m, _, _ in documents if m == matter}
        rows = sorted((at, name, x) for x, _, at, name in documents if x in held)
        out |= {(d, x, i) for i, (_, _, x) in enumerate(rows, 1)}
    return out


def tables(spark, drafts, bundles, documents):
    return (
        spark.createDataFrame(drafts, "draft_id long, matter string, bundle long"),
        spark.createDataFrame(bundles, "bundle long, doc_id long"),
        spark.createDataFrame(documents, "doc_id long, matter string, created_at long, name string"),
    )


def test_order_of_documents_by_hand(spark):
    """Drafts of a bundle, of a matter, of none, with a repeated row, and with several scopes that overlap."""
    documents = [(i, f"m{i % 3}", i * 7 % 4, f"n{i % 2}") for i in range(20)]
    bundles = [(i % 4, i) for i in range(18)] + [(1, 1), (1, 99)]
    drafts = [(1, "m0", 1), (2, "m1", None), (3, "m9", None), (4, "m2", 9), (5, "m0", 2), (5, "m0", 2), (6, "m0", 1), (6, "m1", None), (6, "m0", 3), (7, None, None), (8, "m1", 2), (8, "m2", 2)]
    for fallback in (True, False):
        got = [tuple(r) for r in scope.ordered_documents(*tables(spark, drafts, bundles, documents), fallback).collect()]
        assert len(got) == len(set(got)) and set(got) == by_hand(drafts, bundles, documents, fallback)


def test_rows_of_drafts_and_documents_go_into_no_shuffle(spark):
    documents = [(i, "m", i % 5, "n") for i in range(300)]
    given = tables(spark, [(i, "m", i % 2 or None) for i in range(1000)], [(1, i) for i in range(300)], documents)
    found = []
    n = shuffled(spark, lambda: found.append(scope.ordered_documents(*given).agg({"place": "sum"}).first()[0]))
    assert found == [1000 * 300 * 301 // 2] and n < 100_000


def test_rows_come_document_by_document(spark, monkeypatch):
    """Where tables are too large to broadcast, each document is told with its stretch's drafts, in one order, so that files of the rows stay small."""
    monkeypatch.setattr(scope, "SPREAD", 2)
    monkeypatch.setattr(scope, "STRETCH", 16, raising=False)
    given = tables(spark, [(i, "m", None) for i in range(64)], [], [(i, "m", i % 5, "n") for i in range(300)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(r["doc_id"], r["draft_id"]) for r in scope.ordered_documents(*given).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs = []
    for doc, draft in rows:
        if not runs or runs[-1][0] != doc or draft in runs[-1][1]:
            runs.append((doc, []))
        runs[-1][1].append(draft)
    assert len(rows) == len(set(rows)) == 64 * 300
    assert len(runs) <= 300 * 6 and len({tuple(told) for _, told in runs}) <= 16
