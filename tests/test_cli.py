import os
import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL


def test_cli_report_prints_a_named_query():
    out = subprocess.run([sys.executable, "-m", "revlens", "report", "ratings_overview", "--sf", SF_SMALL],
                         cwd=ROOT, capture_output=True, text=True, timeout=600,
                         env={**os.environ, "PYTHONPATH": ROOT})
    assert out.returncode == 0, out.stderr[-2000:]
    assert "negative_pct" in out.stdout and "AppF" in out.stdout
