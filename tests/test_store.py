import pytest

from spanloom.streaming.store import ANNOTATIONS, Conflict, Store


def docs(spark, ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "doc long, text string")


def ids(snapshot):
    return sorted(r.doc for r in snapshot.docs().collect())


def test_transactions(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/s")
    assert ids(st.snapshot()) == []
    t = st.begin().append(docs(spark, [1, 2]))
    assert ids(st.snapshot()) == [] and t.ready()
    with pytest.raises(RuntimeError):
        t.append(docs(spark, [9]))
    assert t.commit() == 1
    before = st.snapshot()
    a, b = st.begin().append(docs(spark, [3])), st.begin().append(docs(spark, [4]))  # two writers from the same version
    assert (a.commit(), b.commit()) == (2, 3)
    st.begin().append(docs(spark, [5])).abort()
    assert ids(before) == [1, 2] and ids(st.snapshot()) == [1, 2, 3, 4] and ids(st.snapshot(2)) == [1, 2, 3]
    st.begin().erase(2, 3).erase(3, 3).commit()
    st.begin().append(docs(spark, [3])).commit()  # later than the erasure
    assert ids(st.snapshot()) == [1, 3, 4]
    reopened = Store(spark, f"file://{tmp_path}/s")
    reopened.compact()
    assert ids(reopened.snapshot()) == [1, 3, 4] and ids(st.snapshot(3)) == [1, 2, 3, 4]
    assert reopened.vacuum() == 0 and reopened.vacuum(older_than=0) > 0 and ids(reopened.snapshot()) == [1, 3, 4]


def test_compaction_does_not_lose_a_commit(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/s")
    st.begin().append(docs(spark, [1])).commit()
    stale = st.begin()
    stale.append(docs(spark, [1]))
    stale.base, stale.replaces = {"version": 1, "files": [], "streams": {}}, True  # as compact() does
    st.begin().append(docs(spark, [2])).commit()
    with pytest.raises(Conflict):
        stale.commit()
    assert ids(st.snapshot()) == [1, 2]


def test_annotations_and_collection(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("tag:", 1, 0, 1, 0.0, 7), ("bad:", 1, 2, 1, 0.0, 0), ("", 1, 0, 0, 0.0, 0), ("low:", 1, -1, 0, 0.0, 0)], ANNOTATIONS)
    st.begin().append(docs(spark, [1])).annotate(rows).commit()
    c = st.snapshot().collection()
    assert [(r.p, r.q, r.n) for r in c.gcl("(>> tag: text)").collect()] == [(0, 1, 7)]
    assert st.snapshot().annotations().count() == 1


def test_stream_commits_once(spark, tmp_path):
    from spanloom.streaming.store import commit_batches

    st = Store(spark, f"file://{tmp_path}/s")
    sink = commit_batches(st)
    for number in (0, 1, 1):  # the last is a replay
        sink(docs(spark, [10 * number, 10 * number + 1]), number)
    assert ids(st.snapshot()) == [0, 1, 10, 11]


def test_streams_are_told_apart(spark, tmp_path):
    from spanloom.streaming.store import commit_batches

    st = Store(spark, f"file://{tmp_path}/s")
    one, two = commit_batches(st, "one"), commit_batches(st, "two")
    one(docs(spark, [1]), 0)
    two(docs(spark, [2]), 0)
    two(docs(spark, [2]), 0)
    one(docs(spark, [3]), 1)
    assert ids(st.snapshot()) == [1, 2, 3]
    assert "batch" not in str(st.snapshot().collection().counts().collect()) and st.manifest()["streams"] == {"one": 1, "two": 0}


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/s")
    st.begin().append(docs(spark, [1])).commit()
    st._fs.create(st._p(f"versions/{2:012d}.claim"), False).close()
    with pytest.raises(Conflict):
        st.begin().append(docs(spark, [2])).commit(retries=2)  # it may be alive still
    assert st.begin().append(docs(spark, [3])).commit(dead_after=0) == 2
    assert ids(st.snapshot()) == [1, 3]
    left = st.begin().append(docs(spark, [9]))
    assert st.sanitize() == 0 and st._fs.exists(st._p(left.files[0][1]))  # an open writer's data stays
    assert left.commit() == 3 and ids(st.snapshot()) == [1, 3, 9]
    st._fs.create(st._p(f"versions/{4:012d}.claim"), False).close()
    assert st.sanitize(older_than=0) >= 1 and st.begin().erase(3, 3).commit(retries=1) == 4


def test_compaction_policy(spark, tmp_path, monkeypatch):
    from spanloom.streaming import store

    st = Store(spark, f"file://{tmp_path}/s")
    for i in range(5):
        st.begin().append(docs(spark, [i])).commit()
    st.begin().erase(2, 2).commit()
    assert len(st.plan_compaction()) == 5
    assert st.compact_by_policy() == 1 and st.plan_compaction() is None
    assert ids(st.snapshot()) == [0, 1, 3, 4] and ids(st.snapshot(5)) == [0, 1, 2, 3, 4]
    st.begin().append(docs(spark, [2])).commit()  # later than the erasure, which stays in force for older commits only
    assert ids(st.snapshot()) == [0, 1, 2, 3, 4]
    assert len(st.plan_compaction()) == 2
    monkeypatch.setattr(store, "LARGE", 1)
    assert st.plan_compaction() is None
    big = {"files": [["docs", "a", 1, 10], ["docs", "b", 2, 90 << 20], ["docs", "c", 3, 20 << 20], ["docs", "d", 4, 30 << 20]]}
    monkeypatch.setattr(store, "LARGE", 1 << 30)
    assert [f[1] for f in st.plan_compaction(big)] == ["c", "d"]


def test_foragers(spark, tmp_path):
    from spanloom.streaming import store as V

    st = Store(spark, f"file://{tmp_path}/s")
    st.begin().append(docs(spark, [1, 2])).commit()
    assert V.forage_once(st, "text", "tf-idf", "t") == 2 and V.forage_once(st, "text", "tf-idf", "t") is None
    got = {(r.feature, r.doc, r.n) for r in st.snapshot().annotations().collect()}
    assert got == {("t:tf:text", 1, 1), ("t:tf:text", 2, 1), ("t:df:text", 1, 2)}
    assert V.forage_once(st, "text", "null", "", {"a": "b"}) == 3
    assert sorted((r.name, r.tag) for r in st.snapshot().foragers().collect()) == [("null", ""), ("tf-idf", "t")]
    assert V.read_forager(V.forager_json("x", "y", {"k": 'q"'})) == ("x", "y", {"k": 'q"'}) and V.read_forager('{"name": "x"}') == ("x", "", {})
    for bad in ("{", "[]", "{}", '{"name": 1}', '{"name": "x", "other": 1}', '{"name": "x", "parameters": {"k": 1}}'):
        with pytest.raises(ValueError):
            V.read_forager(bad)
    for bad in (("nobody", "", {}), ("null", "a:b", {}), ("null", "", {"k": 1})):
        with pytest.raises(ValueError):
            V.check_forager(*bad)


def test_index_of_a_version(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/s")
    st.begin().append(docs(spark, [1, 2])).commit()
    st.begin().erase(1, 1).commit()
    c = st.snapshot().collection(index=True)
    assert [(r.doc, r.p) for r in c.term("text").collect()] == [(2, 0)] and c.index.totals().first().items == 1
    again = st.snapshot().collection(index=True)
    assert again.index.path == c.index.path and again.count_of(["text", "2", "none"]) == {"text": 1, "2": 1}


def test_many_erased_ranges(spark, tmp_path, monkeypatch):
    from spanloom.streaming import store

    monkeypatch.setattr(store, "FEW_RANGES", 1)
    monkeypatch.setattr(store, "RUN_BITS", 2)
    st = Store(spark, f"file://{tmp_path}/s")
    st.begin().append(docs(spark, range(30))).commit()
    t = st.begin()
    for lo, hi in ((2, 11), (5, 6), (20, 20)):
        t.erase(lo, hi)
    t.commit()
    assert ids(st.snapshot()) == [i for i in range(30) if not (2 <= i <= 11 or i == 20)]
