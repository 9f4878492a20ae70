import os

from sparkodds import session


def test_intermediate_tables_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", [])
    kept = session.materialize(spark.range(5))
    assert kept.count() == 5
    (path,) = session._WRITTEN
    assert os.path.isdir(path.removeprefix("file:"))
    assert session.drop_intermediate(spark) == 1
    assert not os.path.exists(path.removeprefix("file:"))
