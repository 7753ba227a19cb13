import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from fleetlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"),
    )
    yield session
    session.stop()


@pytest.fixture
def fleet_dir(tmp_path):
    """``write("b1", "admin/x.json", text)`` puts a file into a bundle."""

    def write(bundle: str, rel: str, content) -> str:
        path = tmp_path / "fleet" / bundle / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    write.root = str(tmp_path / "fleet")
    return write
