"""The driver contract holds with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_training_data_operators():
    code = ("import sys\nsys.modules['probelake.llm'] = sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\n"
            "q = e.queries()\nassert len(q) > 200 and not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q)\nassert set(e.oracle_sql()) <= set(q)\nimport bench")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
