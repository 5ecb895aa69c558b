import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tripwire.session import local_session

    s = local_session(cpus=4, shuffle_partitions=8, app="tripwire-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SMOKE


@pytest.fixture(scope="session")
def duck():
    from tripwire.plans.oracle import duck_connect

    return duck_connect(SMOKE)
