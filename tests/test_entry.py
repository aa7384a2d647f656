"""The driver's contract, and the folder for intermediate tables."""

import builtins
import sys

import pytest

import __spark_entry__ as entry
from sparkwarden.sources import shared


def test_a_missing_library_costs_no_other_query(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **more):
        if name == "ahocorasick":
            raise ModuleNotFoundError(name)
        return real(name, *args, **more)

    for name in [m for m in sys.modules if m.startswith("sparkwarden.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    found = entry.queries()
    assert len(found) > 150 and set(entry.oracle_sql()) <= set(found)


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Session:
    def __init__(self, **conf):
        self.conf = _Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_shared_path_needs_a_shared_folder_on_a_cluster():
    assert shared.shared_path(_Session(**{"spark.checkpoint.dir": "hdfs://a/b/"}), "t").startswith("hdfs://a/b/t-")
    assert shared.shared_path(_Session(spark_master="local[4]"), "t").startswith("file:///tmp/")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_path(_Session(spark_master="spark://host:7077"), "t")


def test_settled_tables_can_be_forgotten(spark):
    df = shared.settled(spark.range(5).toDF("id"))
    assert df.count() == 5
    files = df.inputFiles()
    shared.forget(df)
    assert files and not spark.read.text(files[0].rsplit("/", 2)[0] + "/*", pathGlobFilter="part-*", wholetext=True).where("value LIKE '%zzz%'").count()
    import os

    assert not os.path.exists(files[0].removeprefix("file:").replace("//", "/", 1))
