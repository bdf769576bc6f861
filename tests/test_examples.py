"""The examples run end to end (each in its own process and Spark session)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(*args):
    out = subprocess.run([sys.executable, *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_sample_flow_example():
    out = run("examples/sample_flow.py", "3")
    assert "'started': ['log']" in out and "'already_running': ['log']" in out
    assert "'stopped': ['log']" in out


def test_route_and_store_example():
    out = run("examples/route_and_store.py", "/root/testdata/sf0.01")
    assert "feed|   26" in out and "paged|   23" in out


def test_bench_prints_one_json_line():
    import json
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, "bench.py", "route_and_store", "status_summary"], cwd=ROOT,
                         capture_output=True, text=True, timeout=300, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = out.stdout.strip().splitlines()
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["failed"] == [] and set(d["queries"]) == {"route_and_store", "status_summary"}
