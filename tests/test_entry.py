"""The registered queries do not depend on optional packages."""

import subprocess
import sys

import pytest

from paths import ROOT

COUNT = """
import sys, warnings
warnings.simplefilter("ignore")
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r}:
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
from cohortlens.plans import registry
names = set(entry.queries())
main = {{n for n in names if not n.startswith("op") and n != "pipeline"}}
print(len(main), len(names - main), set(entry.oracle_sql()) <= names)
"""


def registered(blocked):
    out = subprocess.run([sys.executable, "-c", COUNT.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, check=True)
    return out.stdout.split()


@pytest.mark.parametrize("blocked", ["public_tokenizers", "tokenizers", "zstandard"])
def test_main_queries_register_without_packages_of_the_optional_part(blocked):
    everything = registered([])
    assert int(everything[0]) >= 94
    without = registered([blocked])
    assert without[0] == everything[0] and without[2] == "True"
