from lotwise.operators import evaluation


def test_ranks_come_in_ranges_of_bounded_length(spark, monkeypatch):
    df = spark.createDataFrame([(f"b{i:03d}",) for i in range(60)] + [("c",)] * 7, "block_id string")
    want = sorted(map(tuple, evaluation.group_kfold(df, 4).collect()))
    monkeypatch.setattr(evaluation, "SHARE", 4)
    tables, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **kw: tables.append(data) or make(self, data, *a, **kw))
    assert sorted(map(tuple, evaluation.group_kfold(df, 4).collect())) == want
    assert max(row[-1] for row in tables[-1]) == 4 and sum(row[-1] for row in tables[-1]) == 61
