"""The registered corpus queries: names, twins, and independence of the rest of the library."""

import os
import re

import pytest

import __spark_entry__ as registered
from check_twins import compare, database

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_one_query_per_operator_and_the_pipeline():
    numbers = [int(m[1]) for n in registered.LLM_QUERIES if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in registered.queries()


@pytest.mark.parametrize("name", sorted(registered.LLM_TWINS))
def test_query_matches_twin(spark, name):
    verdict, rows, _ = compare(spark, database(FOLDER), FOLDER, name)
    assert verdict == "ok" and rows > 0


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/vintageline"):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                assert "vintageline.llm" not in open(f"{folder}/{name}", encoding="utf-8").read()
