import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def pytest_configure(config):
    """Python workers find the modules of the tests and of the library."""
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(here))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, here, os.environ.get("PYTHONPATH", "")])
