"""Every registered query with an oracle, against DuckDB at sf0.001."""
import pytest

import __spark_entry__ as E
from tessera.plans.registry import ORACLE, QUERIES

from .conftest import SF001
from .oracle import compare, duck

SLOW = {"svm_predictions", "svm_ablation", "train_select", "score_saved_model"}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    problems, _ = compare(E.queries()[name](spark, SF001), con, ORACLE[name])
    assert not problems, problems


def test_only_model_fits_lack_an_oracle():
    """Every registered query has an exact oracle except the iterative model fits (tested in test_models)."""
    assert set(QUERIES) - set(ORACLE) == SLOW


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "precision", "recall", "f1_score", "support", "row_order"]
    assert df.count() > 0
