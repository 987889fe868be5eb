"""The job runner's exit codes (a subprocess: the runner stops its own session)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(*args):
    env = dict(os.environ, PYTHONPATH=ROOT)
    return subprocess.run([sys.executable, "-m", "cauce", *args, "--master", "local[2]"], cwd=ROOT, env=env,
                          capture_output=True, text=True, timeout=600)


def test_sales_job_succeeds(sf_small):
    out = tempfile.mkdtemp(prefix="cauce-cli-")
    r = _run("sales", "--sf-dir", sf_small, "--out", out)
    assert r.returncode == 0, r.stderr[-2000:]
    assert "ventas_clean" in r.stdout and os.path.isdir(os.path.join(out, "ventas_clean"))


def test_missing_input_fails_with_1():
    out = tempfile.mkdtemp(prefix="cauce-cli-")
    r = _run("sales", "--sf-dir", os.path.join(out, "no-such-dir"), "--out", out)
    assert r.returncode == 1
