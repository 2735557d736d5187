from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from groundwell.session import local_session

    session = local_session(8, memory="4g", name="tests", shared=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SAMPLE = {
    "config.py": '"""Settings."""\nimport os\n\n\nclass Settings:\n    def load(self):\n        return os.environ\n\n\ndef load_settings():\n    return Settings()\n',
    "service.py": "from .config import load_settings\n\n\nclass TransferService:\n    def transfer(self, amount):\n        if amount <= 0:\n            raise ValueError\n\n    def balance(self):\n        return 0\n",
    "README.md": "# Ledger service\nTransfers money between accounts.\n\n## Setup\nRun make.\n\n## Usage\nCall transfer.\n",
    "pkg/__init__.py": "",
    "pkg/helpers.py": "def slug(text):\n    return text.lower()\n",
    "node_modules/x.js": "import a from 'a'\n",
    "poetry.lock": "x",
    "logo.png": "x",
    "blob.txt": "a\x00b",
}


@pytest.fixture(scope="session")
def repo_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "repo"
    for name, text in SAMPLE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def file_rows(spark, files: dict[str, str], repo: str = "repo_1"):
    rows = [(repo, repo + "-name", "main", None, path, len(text), text) for path, text in files.items()]
    return spark.createDataFrame(
        rows, "repository_id string, repo_name string, branch string, commit_hash string, file_path string, length long, text string")
