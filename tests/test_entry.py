"""The driver's contract, and that the core stands without the llm package."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
    assert entry.entry(spark).count() > 0


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and all(callable(f) for f in q.values())


def test_core_without_llm():
    code = """
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('sparkfolio.llm'):
            raise ImportError(name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
assert 'bm25_topk' in e.queries() and 'p8_ids' not in e.queries() and 'p1_found' in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=sys.path[0])


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from sparkfolio import session

    class Context:
        master = "spark://host:7077"
        path = None

        def getCheckpointDir(self):
            return self.path

        def getConf(self):
            return {}

        def setCheckpointDir(self, path):
            self.path = path

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="shared|share"):
        session.ensure_checkpoint_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert session.ensure_checkpoint_dir(Session).startswith("file:///")
    Session.conf = {"spark.checkpoint.dir": "hdfs://x"}
    assert session.ensure_checkpoint_dir(Session) == Session.sparkContext.path  # a folder that is set stays


def test_queries_leave_the_session_as_it_is(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    entry.queries()["p3_found"](spark, "/root/testdata/sf0.001").count()
    assert before == {k: spark.conf.get(k) for k in before}
