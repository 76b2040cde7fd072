"""Query modules stand alone, and what the entry point lists is sound."""

import subprocess
import sys
from pathlib import Path

import pytest

from gridsignal.plans import registry

PLANS = Path(registry.__file__).parent


@pytest.mark.parametrize("module", sorted(p.stem for p in PLANS.glob("*.py") if p.stem != "__init__"))
def test_each_module_imports_alone(module):
    run = subprocess.run([sys.executable, "-c", f"import gridsignal.plans.{module}"], cwd=PLANS.parents[1], capture_output=True, text=True, check=False)
    assert run.returncode == 0, run.stderr


def test_every_sql_has_its_query():
    assert registry.QUERIES and registry.ORACLES.keys() <= registry.QUERIES.keys()
