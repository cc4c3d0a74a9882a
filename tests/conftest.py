import pytest

from tabsight.plans.session import local_session

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4")


@pytest.fixture(scope="session")
def sf():
    return TINY
