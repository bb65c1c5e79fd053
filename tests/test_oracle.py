"""Every registered query with a check statement agrees with DuckDB."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from oracle.statements import STATEMENTS
from stayrate.operators import models
from stayrate.plans import catalogue
from stayrate.plans.catalogue import QUERIES
from tests.compare import difference, duck


# Figures of trained models are not SQL-expressible; test_models checks them.
TRAINED = {"model_lr", "model_dt", "model_gbt", "model_rf_select", "model_comparison",
           "sink_metrics", "feature_importance", "score_model", "model_roundtrip", "whatif_model",
           "score_profiles_model"}


@pytest.fixture(scope="module")
def con(spark, sf_dir):
    # What must hold of trained models holds of a short run as of a whole one.
    catalogue._trained[spark.sparkContext.applicationId, sf_dir] = models.train_and_select(
        catalogue.full_account(spark, sf_dir), rounds=3, configs=[{"trees": 4, "depth": 3, "leaf": 5}])
    return duck(sf_dir)


def test_every_query_is_checked_or_trained():
    assert set(QUERIES) - set(STATEMENTS) == TRAINED
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_agrees_with_duckdb(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, STATEMENTS[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_entry_without_the_training_data_operators(tmp_path):
    """With the optional parts gone, but for a folder of compiled files, the rest is there."""
    root = os.path.dirname(os.path.abspath(contract.__file__))
    for name in ("__spark_entry__.py", "oracle", "stayrate"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    (tmp_path / "stayrate/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.split() == [str(len(QUERIES)), str(len(STATEMENTS))], done.stderr
