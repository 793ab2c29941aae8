"""Near duplicates shuffle the texts and bands that can matter, not all of them; no row that is wanted is passed over."""

import numpy as np

from flowgauge.llm import common, minhash

from .test_llm import brute_groups


def shuffled_rows(df):
    """The rows that the exchanges of ``df`` write."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, rows = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "ShuffleExchangeExec":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return rows


def some_texts():
    """300 texts alone, ten with a near copy and ten with an exact one."""
    rng = np.random.default_rng(3)
    texts = {i: " ".join(f"w{k}" for k in rng.integers(0, 100_000, size=40)) for i in range(320)}
    texts |= {400 + i: texts[i] + " end" for i in range(10)} | {500 + i: texts[10 + i] for i in range(10)}
    return texts


def test_only_texts_that_share_a_bucket_are_shuffled(spark, monkeypatch):
    texts, rows = some_texts(), {}

    def counted(df, name, *more):
        rows[name] = rows.get(name, 0) + (shuffled_rows(df) if name == "sets" else 0)
        return common.written(df, name, *more)

    monkeypatch.setattr(minhash, "written", counted)
    found = minhash.near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_groups(texts)
    # 20 texts and their 20 sets, minima and ids, some of them twice; not all 340 texts
    assert 0 < rows["sets"] < 200


def test_rows_are_nodes_without_a_join_unless_their_set_has_copies(spark):
    texts = some_texts()
    rows = [*texts.items(), (None, texts[30]), (7, texts[7]), (600, None), (601, " "), (602, "one")]
    made = minhash.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    nodes = made._same_set()
    keys = {r.id: r.buckets for r in made._keys(nodes).collect()}
    assert sorted(keys) == sorted(r.id for r in nodes.select("id").collect()) and len(keys) == 331
    assert all(len(set(x)) == minhash.BANDS for x in keys.values())


def test_marks_lose_nothing(spark):
    rows = spark.range(0, 20_000).selectExpr("if(id = 5, null, id) AS id", "id % 7 AS other")
    wanted = spark.range(0, 20_000, 100).select("id")
    got = common.marked(rows, "id", wanted)
    assert got.columns == ["id", "other", "marked"] and got.count() == 20_000
    kept = {r.id for r in got.where("marked").collect()}
    assert kept >= set(range(0, 20_000, 100)) and len(kept) < 300
    assert common.marked(rows, "id", wanted.limit(0)).where("marked").count() == 0
