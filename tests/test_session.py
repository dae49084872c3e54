"""Tables in the shared folder."""

import os

from seriate import session


def test_free(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", {})
    df = session.materialize(spark.range(10), "some")
    assert df.count() == 10
    path = session._WRITTEN[spark.sparkContext.applicationId][0].removeprefix("file:")
    assert os.path.isdir(path)
    assert session.free(spark) == 1 and not os.path.exists(path) and session.free(spark) == 0
