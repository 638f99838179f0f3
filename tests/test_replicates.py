import inspect

from cladeflow.operators import kernels as kn
from cladeflow.plans.models import permuted_migration
from tests.oracle import DATA, needs_data


@needs_data
def test_permuted_migration_uses_all_shuffles(spark):
    """p is a count out of 1001, and the strongest routes go below the 1/51 of 50 shuffles."""
    p = [r["p"] for r in permuted_migration(spark, DATA).collect()]
    assert all(abs(x * 1001 - round(x * 1001)) < 1e-6 for x in p)
    assert min(p) < 1 / 51


def test_bootstrap_draws():
    assert inspect.signature(kn.wild_bootstrap).parameters["times"].default == 2000
