"""Workers must get along without a copy of this package."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from millrace.session import build_session
from millrace.llm.queries import QUERIES
spark = build_session("2", 2)
for name in ("p1_found", "p6_found", "p7_ids", "p8_found", "p9_found"):
    assert QUERIES[name](spark, {folder!r}).collect(), name
"""


def test_queries_without_the_package_on_workers(small):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, folder=small)], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
