"""Scratch tables in a session that names no shared folder."""

import pytest

from lexitide import runtime


def test_scratch_without_checkpoint_dir(spark, monkeypatch):
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: default[0] if key == "spark.checkpoint.dir" else get(self, key, *default))
    monkeypatch.setattr(runtime, "_scratch", {})
    scratch = runtime.Scratch(spark, "t")
    saved = scratch.save(spark.range(3), "a")
    assert saved.count() == 3 and "lexitide-" in saved._scratch_path
    scratch.drop(saved)


def test_no_scratch_of_one_machine_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(runtime, "_scratch", {})
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: default[0])
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.scratch_root(spark)
