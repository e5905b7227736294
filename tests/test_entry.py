"""The driver's entry points, with and without the optional subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_entry(spark):
    df = entry.entry(spark)
    assert {"head", "relation", "gold", "id", "score", "pos"} <= set(df.columns) and df.count() > 0


def test_without_the_corpus_operators():
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quarry.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']\n"
        "assert len(e.queries()) > 50\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])
