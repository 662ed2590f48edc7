import pytest
from pyspark.sql import functions as F

from answerloom.operators import batches as bt, training_metrics as tm


def _rows(spark, sizes):
    rows = [(f"file{f}", i, f * 1000 + i) for f, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "file string, row_index long, key long")


def test_every_epoch_is_a_permutation_with_full_batches(spark):
    rows = _rows(spark, [100, 7, 64])
    out = bt.plan_batches(rows, 8, 4, epochs=3, drop_last=True, min_row_batch=32, devices=4).collect()
    per_epoch = {e: [r for r in out if r.epoch == e] for e in range(3)}
    # 100 -> 3 row batches of 32 and one of 4 (dropped); 7 -> dropped; 64 -> 2 row batches
    assert [len(per_epoch[e]) for e in range(3)] == [160] * 3
    orders = []
    for group in per_epoch.values():
        assert len({r.key for r in group}) == 160
        ids = sorted({r.batch_id for r in group})
        assert ids == list(range(20))
        for b in ids:
            members = sorted(r.pos for r in group if r.batch_id == b)
            assert members == list(range(8))
            assert len({(r.file, r.row_batch) for r in group if r.batch_id == b}) == 1
        assert all(r.device_id == r.pos // 2 for r in group)
        orders.append([r.key for r in sorted(group, key=lambda r: (r.batch_id, r.pos))])
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])


def test_same_seed_same_plan(spark):
    rows = _rows(spark, [40, 40])
    plan = lambda seed: sorted(tuple(r) for r in bt.plan_batches(rows, 8, min_row_batch=16, seed=seed).collect())
    assert plan(1) == plan(1) != plan(2)


def test_unshuffled_order_keeps_short_pieces(spark):
    out = bt.plan_batches(
        _rows(spark, [10, 5]), 4, 2, shuffle_files=False, shuffle_rows=False, drop_last=False, min_row_batch=8
    )
    got = [r.key for r in bt.read_order(out, 2).collect()]
    assert sorted(got) == [*range(10), *range(1000, 1005)]
    sizes = {r.batch_id: r["count"] for r in out.groupBy("batch_id").count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 2, 3: 4, 4: 1}
    assert {r.key for r in bt.first_batches(out, 1).collect()} == {0, 1, 2, 3}


def test_device_rules(spark):
    rows = _rows(spark, [8])
    with pytest.raises(ValueError):
        bt.plan_batches(rows, 8, devices=3)
    with pytest.raises(ValueError):
        bt.plan_batches(rows, 8, devices=2, drop_last=False)


def test_large_file_is_listed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bt, "BLOCK", 3)
    out = bt.plan_batches(_rows(spark, [100]), 4, min_row_batch=8, multiplier=1)
    assert out.count() == 100
    assert out.select("batch_id").distinct().count() == 25


def test_row_numbers_across_ranges(spark):
    df = spark.createDataFrame([("a", i) for i in (5, 1, 99, 250, 251, 1000)] + [("b", 42)], "g string, o long")
    got = {(r.g, r.o): r.row_index for r in bt.index_rows(df, "g", "o", range_size=100).collect()}
    assert got == {("a", 1): 0, ("a", 5): 1, ("a", 99): 2, ("a", 250): 3, ("a", 251): 4, ("a", 1000): 5, ("b", 42): 0}


def test_loss_reductions(spark):
    losses = spark.createDataFrame([("r", s, float(s)) for s in range(1, 12)], "run_id string, step long, loss double")
    got = [(r.step, r.train_loss) for r in tm.logged_losses(losses, 4).orderBy("step").collect()]
    assert got == [(4, 2.5), (8, 6.5)]
    empty = losses.where("false").withColumn("batch_id", F.lit(0))
    assert tuple(tm.mean_perplexity(empty).first()) == (0.0, 1.0)
    tokens = spark.createDataFrame([(1, 5, 2.0), (1, 0, 9.0), (2, 0, 9.0)], "batch_id int, label int, loss double")
    assert {tuple(r) for r in tm.masked_means(tokens, "batch_id").collect()} == {(1, 2.0, 1), (2, 0.0, 0)}
