"""The entry module imports anywhere: other working folder, no Spark jars to read, no package on the workers' path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)


def test_import_without_jars(tmp_path):
    code = f"""
import sys, zipfile, glob
def refuse(*a, **k): raise RuntimeError("no jar lookup at import")
zipfile.ZipFile = refuse; glob.glob = refuse
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""
    r = run(code, tmp_path)
    assert r.returncode == 0, r.stderr[-2000:]


def test_worker_code_needs_no_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from postlens.session import local_session
s = local_session(cores=2, shuffle_partitions=2, driver_memory="2g")
print("rows", e.queries()["cluster_extremes"](s, "/root/testdata/sf0.001").count())
"""
    r = run(code, tmp_path)
    assert r.returncode == 0 and "rows" in r.stdout, r.stderr[-2000:]
