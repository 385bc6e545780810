"""Rows without a doc_id, and rows that share one, in near dedup."""

from textloom.llm import minhash_circulant


def text(k):
    return " ".join(f"t{k}w{i}" for i in range(40))


ROWS = [(5, text(1)), (7, text(2)), (None, text(1)), (None, text(2)), (None, text(3)), (None, text(3) + " more"), (None, text(3)), (None, text(4)), (None, ""), (None, None),
        (9, text(5)), (9, text(5)), (9, text(6)), (11, text(6)), (12, text(7))]


def test_groups_of_rows_without_ids(spark):
    df = spark.createDataFrame(ROWS[:10], "doc_id long, text string").repartition(3)
    got = {}
    for (i, t), r in ((k, r) for r in minhash_circulant.near_dedup(df).collect() for k in [(r["doc_id"], r["n_shingles"])]):
        got.setdefault(i, []).append((t, r["component_id"], r["kept"]))
    assert got[5] == [(38, 5, True)] and got[7] == [(38, 7, True)]
    assert sorted(x for x in got[None] if x[1] is not None) == [(38, 5, False), (38, 7, False)]
    alone = [x for x in got[None] if x[1] is None]
    assert len(alone) == 6 and all(k for n, _, k in alone if n == 0)
    assert sum(k for n, _, k in alone if n) in (2, 3)  # text 4, and text 3 (in one row or in two equal ones) or its near copy


def test_one_row_of_each_group_stays(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in minhash_circulant.representatives(df).collect()), key=str)
    third = [r for r in got if r[0] is None and (r[1] or "").startswith("t3")]
    assert len(third) == 1
    want = [(5, text(1)), (7, text(2)), (9, text(5)), (9, text(6)), (12, text(7)), (None, text(4)), (None, ""), (None, None), *third]
    assert got == sorted(want, key=str)


def test_whole_ids_are_as_before(spark):
    rows = [(3, text(1)), (1, text(1)), (2, text(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in minhash_circulant.representatives(df).collect()} == {(1, text(1)), (2, text(2))}
