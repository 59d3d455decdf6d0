"""The driver contract holds without the libraries that only the optional subpackage needs."""

import subprocess
import sys
from pathlib import Path

import pytest

from tessera import session

ROOT = Path(__file__).resolve().parent.parent


def test_queries_without_the_automaton_library():
    code = "import sys; sys.modules['ahocorasick'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 60 and 'bm25_search' in q and 'p5_found' in q and 'p1_found' not in q\nassert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))})

        @staticmethod
        def getConf():
            return {}

    sparkContext = Context
    conf = {}


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError):
        session.shared_dir(Elsewhere)
