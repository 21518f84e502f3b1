import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
BLOCKED = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
q = e.queries()
print(len(q), sum(k.startswith("op") for k in q), "pipeline" in q, set(e.oracle_sql()) <= set(q))
"""


def registered(*names):
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(names=names)], cwd=REPO, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_everything_else_is_registered_without_an_optional_package():
    for names in (("xxhash",), ("sentencepiece", "xxhash"), ("siteledger.llm",)):
        n, operators, pipeline, sql = registered(*names)
        assert int(n) > 200 and operators == "0" and pipeline == "False" and sql == "True"


def test_the_pipeline_alone_may_be_missing():
    n, _, pipeline, _ = registered("corpus_pipeline")
    assert int(n) > 200 and pipeline == "False"
