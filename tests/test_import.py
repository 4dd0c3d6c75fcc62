"""The entry module loads anywhere: pyspark out of its zip, no session, no JVM."""
import os
import pathlib
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_loads_from_the_zip_without_a_session():
    home = pathlib.Path(pyspark.__file__).resolve().parent
    zips = [str(p) for p in (home / "python" / "lib").glob("*.zip")]
    env = {k: v for k, v in os.environ.items() if k != "SPARK_HOME"}
    env["PYTHONPATH"] = os.pathsep.join([*zips, ROOT])
    code = ("import __spark_entry__ as e; from pyspark import SparkContext; "
            "assert len(e.queries()) >= 50 and len(e.oracle_sql()) >= 40; "
            "assert SparkContext._active_spark_context is None")
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd="/", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
