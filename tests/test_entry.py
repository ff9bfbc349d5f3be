"""The entry module imports where no Spark jar can be found and no session exists."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without_jars_or_session(tmp_path):
    code = (
        "import glob, os, zipfile\n"
        "real = glob.glob\n"
        "glob.glob = lambda p, **k: [] if 'jars' in str(p) else real(p, **k)\n"
        "import __spark_entry__ as e\n"
        "from pyspark import SparkContext\n"
        "q, s = e.queries(), e.oracle_sql()\n"
        "assert SparkContext._active_spark_context is None\n"
        "assert len(q) >= 60 and set(s) <= set(q)\n"
    )
    env = {**os.environ, "PYTHONPATH": ROOT, "SPARK_HOME": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_stop_list():
    from ticketlens import vocab

    words = vocab.default_stop_words()
    assert len(words) == len(set(words)) == 318
    assert list(words) == sorted(words)
    assert {"amoungst", "fifteen", "system", "un"} <= set(words)
