"""Tables in the shared folder, and the layout of small ones."""

from lexweave.functions import workers
from lexweave.sources import shared


def test_small_tables_are_dealt_out(spark, sf_dir):
    docs = shared.table(spark, sf_dir, "documents")
    assert shared.spread(docs, small=0) is docs
    dealt = shared.spread(docs)
    assert 1 < dealt.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(dealt.collect()) == sorted(docs.collect())


def test_completed_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    kept = shared.written(spark.range(3), "kept")

    def make():
        inner = shared.completed(lambda: shared.written(kept.selectExpr("id + 1 AS id"), "first").selectExpr("id * 2 AS id"), "inner")
        return shared.written(inner, "second").where("id > 2")

    out = shared.completed(make, "out")
    assert sorted(r.id for r in out.collect()) == [4, 6]
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["kept", "out"]
    shared.release(out)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"] and kept.count() == 3


def test_workers_hold_a_few_models():
    made = []
    factories = [workers.once(lambda i=i: made.append(i) or i) for i in range(6)]
    assert [f() for f in factories] == list(range(6)) and [factories[5]() for _ in range(3)] == [5] * 3
    assert made == list(range(6)) and factories[0]() == 0 and made[-1] == 0
