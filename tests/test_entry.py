"""The entry point with and without the training-data subpackage."""

import importlib
import sys
from importlib.util import find_spec

import pytest


class Hidden:
    """A finder that makes the subpackage and the pipeline look absent."""

    names = ("qaflow.llm", "corpus_pipeline")

    def find_spec(self, name, path=None, target=None):
        if name.startswith(self.names):
            raise ModuleNotFoundError(f"hidden: {name}", name=name)
        return None


@pytest.fixture
def hidden(monkeypatch):
    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith(Hidden.names)]:
        monkeypatch.delitem(sys.modules, name)
    if "qaflow.llm" in sys.modules or hasattr(sys.modules["qaflow"], "llm"):
        monkeypatch.delattr(sys.modules["qaflow"], "llm", raising=False)
    monkeypatch.setattr(entry, "find_spec", lambda name: None if name == "qaflow.llm" else find_spec(name))
    sys.meta_path.insert(0, finder := Hidden())
    yield entry
    sys.meta_path.remove(finder)


def test_without_the_subpackage(hidden):
    assert not [q for q in hidden.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"]
    assert set(hidden.oracle_sql()) == set(hidden.queries())
    for module in [m for m in sys.modules if m.startswith("qaflow.") and not m.startswith("qaflow.llm")]:
        importlib.import_module(module)


def test_shared_folder_is_required_on_a_cluster(spark):
    from qaflow import shared

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(Session())
    assert shared.shared_root(spark)
