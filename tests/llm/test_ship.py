"""The package reaches workers that can't import it."""

import os
import subprocess
import sys

from ..conftest import ROOT, SMALL

JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
from lingualens.llm.queries import QUERIES
from lingualens.session import local_session
spark = local_session(2)
print("rows", len(QUERIES["op8_pii"](spark, {SMALL!r}).collect()))
"""


def test_query_started_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
