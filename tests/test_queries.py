"""Queries against their SQL; all of them with REPOATLAS_ALL=1, a spread otherwise."""

import os

import pytest

import __spark_entry__ as contract

from repoatlas.plans.oracles import ORACLES
from repoatlas.plans.queries import QUERIES

from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SPREAD = (
    "scan_source_files glob_match path_filter glob_theta_join change_kinds status_summary "
    "resolve_imports dependency_graph symbol_line_ranges methods_with_nested file_structures "
    "module_docs overview state_load extractor_registry stream_changed_files"
).split()
NAMES = list(QUERIES) if os.environ.get("REPOATLAS_ALL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ours = contract.queries()[name](spark, SF_DIR).toPandas()
    theirs = con.execute(contract.oracle_sql()[name]).df()
    assert difference(ours, theirs) is None


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["repo", "module", "n_dependencies", "n_dependents"]
    assert frame.count() > 0
