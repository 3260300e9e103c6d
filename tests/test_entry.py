import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part():
    code = "import sys; sys.modules['octaspark.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
