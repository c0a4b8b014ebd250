import pytest

from scenelake import Catalog, ForeignKey
from scenelake.operators import integrity
from scenelake.operators import upserts as U

STORED = "uid BIGINT, k1 INT, k2 STRING, v STRING, other STRING"
BATCH = "k1 INT, k2 STRING, v STRING, seq BIGINT"


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([(5, 1, "a", "old", "keep"), (9, 2, "a", "old", None)], STORED)


@pytest.fixture(scope="module")
def batch(spark):
    return spark.createDataFrame(
        [(1, "a", "first", 1), (1, "a", None, 2), (3, "b", "x", 3), (3, "b", "y", 4), (2, "b", "z", 5)], BATCH
    )


def as_dict(df):
    return {(r.k1, r.k2): (r.uid, r.v) for r in df.collect()}


def test_first_write_wins(stored, batch):
    out = U.insert_first(stored, batch, ["k1", "k2"], "seq", "uid")
    assert as_dict(out) == {(1, "a"): (5, "old"), (2, "a"): (9, "old"), (2, "b"): (10, "z"), (3, "b"): (11, "x")}


def test_last_write_wins_even_when_null(stored, batch):
    out = U.upsert_last(stored, batch, ["k1", "k2"], "seq", ["v"], "uid")
    assert as_dict(out) == {(1, "a"): (5, None), (2, "a"): (9, "old"), (2, "b"): (10, "z"), (3, "b"): (11, "y")}
    assert {r.other for r in out.where("uid = 5").collect()} == {"keep"}


@pytest.mark.parametrize("last", [True, False])
def test_twice_is_once(stored, batch, last):
    def apply(table):
        if last:
            return U.upsert_last(table, batch, ["k1", "k2"], "seq", ["v"], "uid")
        return U.insert_first(table, batch, ["k1", "k2"], "seq", "uid")

    once = apply(stored)
    assert as_dict(apply(once)) == as_dict(once)


def test_first_rows_of_an_empty_table(spark, batch):
    empty = spark.createDataFrame([], STORED)
    out = U.insert_first(empty, batch, ["k1", "k2"], "seq", "uid")
    assert sorted(r.uid for r in out.collect()) == [1, 2, 3]


def test_absent_payloads_are_skipped(spark):
    text = spark.createDataFrame([(1, None), (2, ""), (3, "[]"), (4, '""')], "uid INT, p STRING")
    assert sorted(r.uid for r in U.present(text, "p").collect()) == [3, 4]
    binary = spark.createDataFrame([(1, None), (2, b""), (3, b"x")], "uid INT, p BINARY")
    assert [r.uid for r in U.present(binary, "p").collect()] == [3]
    arrays = spark.createDataFrame([(1, None), (2, [])], "uid INT, p ARRAY<INT>")
    assert [r.uid for r in U.present(arrays, "p").collect()] == [2]


def test_label_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "uid INT, p STRING")
    new = spark.createDataFrame([(1, "", 1), (2, "c", 2), (3, "d", 3)], "uid INT, p STRING, seq INT")
    assert dict(map(tuple, U.upsert_labels(old, new, "uid", "p", "seq").collect())) == {1: "a", 2: "c", 3: "d"}


def test_update_column(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "uid INT, split STRING")
    out = U.update_column(table, spark.createDataFrame([(2, None)], "uid INT, split STRING"), "uid", "split")
    assert dict(map(tuple, out.collect())) == {1: "a", 2: None}


@pytest.fixture(scope="module")
def tree(spark):
    a = spark.createDataFrame([(1,), (2,)], "a INT")
    b = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 7), (14, None)], "b INT, a INT")
    c = spark.createDataFrame([(100, 10), (101, 12), (102, 12)], "c INT, b INT")
    fks = [ForeignKey("b", ("a",), "a", ("a",)), ForeignKey("c", ("b",), "b", ("b",))]
    return Catalog({"a": a, "b": b, "c": c}, {"a": ["a"], "b": ["b"], "c": ["c"]}, fks)


def test_cascade(spark, tree):
    left = integrity.cascade_delete(tree, "a", spark.createDataFrame([(2,)], "a INT"))
    assert {t: sorted(r[0] for r in df.collect()) for t, df in left.items()} == {
        "a": [1],
        "b": [10, 11, 13, 14],
        "c": [100],
    }


def test_violations(spark, tree):
    assert [tuple(r) for r in integrity.orphans(tree, tree.foreign_keys[0]).collect()] == [(7, 1)]
    report = {r.child: (r.n_rows, r.n_orphans) for r in integrity.reference_report(tree).collect()}
    assert report == {"b": (5, 1), "c": (3, 0)}
    assert [tuple(r) for r in integrity.null_counts(tree.table("b"), ["b", "a"]).collect()] == [("a", 1)]
    assert [tuple(r) for r in integrity.duplicate_keys(tree.table("b"), ["a"]).collect()] == [(1, 2)]




def test_exactly_one_row_per_key(spark):
    rows = [(1, 5, "b", b"x"), (1, 5, "a", b"y"), (1, 5, "a", b"y"), (2, 1, "c", None), (2, None, "z", None)]
    batch = spark.createDataFrame(rows, "k INT, seq INT, v STRING, blob BINARY")
    last = {r.k: (r.seq, r.v) for r in U.last_write(batch, ["k"], "seq").collect()}
    assert last == {1: (5, "a"), 2: (1, "c")}
    assert U.last_write(batch, ["k"], "seq").count() == U.first_write(batch, ["k"], "seq").count() == 2
    stored = spark.createDataFrame([(7, 1, "old")], "uid LONG, k INT, v STRING")
    got = U.upsert_last(stored, batch, ["k"], "seq", ["v"], uid="uid")
    assert sorted(map(tuple, got.collect())) == [(7, 1, "a"), (8, 2, "c")]


def test_cascade_through_self_references(spark):
    node = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (5, 6), (6, 5), (7, None)], "id INT, up INT")
    leaf = spark.createDataFrame([(1, 3), (2, 4), (3, 7), (4, None)], "leaf INT, id INT")
    fks = [ForeignKey("node", ("up",), "node", ("id",)), ForeignKey("leaf", ("id",), "node", ("id",))]
    catalog = Catalog({"node": node, "leaf": leaf}, {"node": ["id"], "leaf": ["leaf"]}, fks)
    doomed = spark.createDataFrame([(1,), (4,), (5,)], "id INT")
    left = integrity.cascade_delete(catalog, "node", doomed)
    assert [r.id for r in left["node"].collect()] == [7]
    assert sorted(r.leaf for r in left["leaf"].collect()) == [3, 4]
    moved = integrity.cascade_update(catalog, "node", spark.createDataFrame([(1, 10), (3, 30)], "id INT, new_id INT"))
    assert sorted((r.id, r.up) for r in moved["node"].collect() if r.id < 40 and r.up) == [(2, 10), (4, 4), (5, 6), (6, 5), (30, 2)]
    assert sorted((r.leaf, r.id) for r in moved["leaf"].collect() if r.id) == [(1, 30), (2, 4), (3, 7)]


def test_rings_of_tables(spark):
    a = spark.createDataFrame([(1, 1)], "x INT, y INT")
    fks = [ForeignKey("a", ("x",), "b", ("y",)), ForeignKey("b", ("x",), "a", ("y",))]
    with pytest.raises(ValueError, match="ring"):
        integrity.cascade_delete(Catalog({"a": a, "b": a}, {"a": ["y"], "b": ["y"]}, fks), "a", a.select("y"))
