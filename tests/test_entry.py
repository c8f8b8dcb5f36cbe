from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["xxhash", "sentencepiece", "tokenizers", "public_tokenizers", "corpus_pipeline", "tallyfold.llm"])
def test_analytics_stay_where_a_package_of_the_training_data_part_is_missing(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*e.queries()); assert e.oracle_sql()"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    names = found.stdout.split()
    assert "top_cities_in_month" in names and "m_label_results" in names and len(names) > 200
