"""Operators whose tasks run in Python workers that can't import this package."""

import subprocess
import sys
import textwrap

import pytest

from .conftest import SF

CODE = textwrap.dedent("""
    import os, sys, tempfile
    repo = {repo!r}
    sys.path.insert(0, repo)
    from equipledger.session import build_session
    spark = build_session(master="local-cluster[1,2,1500]", extra={{
        "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(), "spark.executor.memory": "1g", "spark.driver.host": "127.0.0.1"}})
    def there(_):
        try:
            import equipledger
            return True
        except ModuleNotFoundError:
            return False
    assert not spark.sparkContext.parallelize([0], 1).map(there).first(), "the workers see the package"
    import equipledger.llm as llm
    for n in {names!r}:
        assert llm.QUERIES[n](spark, {sf!r}).count() > 0
    print("all ran")
""")


@pytest.mark.parametrize("names", [("op6_gru_lm", "op8_sentencepiece"), ("op11_conversation_repair", "op12_periodic_runs", "op13_quality_rules")])
def test_workers_need_no_package(names, tmp_path):
    import os
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo, names=names, sf=SF)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=280)
    assert "all ran" in out.stdout, out.stderr[-3000:]
