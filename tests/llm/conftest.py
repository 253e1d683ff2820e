import pytest


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
