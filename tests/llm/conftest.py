import pytest


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
