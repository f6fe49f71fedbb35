import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cuegrain.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, app="tests", spark__driver__memory="4g")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
