"""The folder of materialised tables."""

from __future__ import annotations

import types

import pytest

from setlore import session


def test_materialise_writes_to_the_session_folder(spark):
    df = session.materialise(spark.range(5))
    assert df.count() == 5 and session.checkpoint_dir(spark).startswith("file://")
    assert all(f.startswith(session.checkpoint_dir(spark)) for f in df.inputFiles())


def test_a_cluster_without_the_setting_is_refused():
    context = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    fake = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="share"):
        session.checkpoint_dir(fake)
