import os
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def git(*args):
    if not os.path.isdir(f"{ROOT}/.git"):
        pytest.skip("no git repository")
    return subprocess.run(["git", "-C", ROOT, *args], capture_output=True, check=True).stdout


def test_tracked_files_are_few_and_small():
    names = [x for x in git("ls-files", "-z").decode().split("\0") if x and os.path.exists(f"{ROOT}/{x}")]
    assert not [x for x in names if x.startswith(".tmp/") or x.endswith(".block")]
    assert sum(os.path.getsize(f"{ROOT}/{x}") for x in names) < 20_000_000


def test_queries_can_be_read_from_the_tracked_files_alone(tmp_path):
    for name in (x for x in git("ls-files", "-z").decode().split("\0") if x.endswith(".py")):
        if os.path.exists(f"{ROOT}/{name}"):
            os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
            with open(f"{ROOT}/{name}", "rb") as source, open(tmp_path / name, "wb") as copy:
                copy.write(source.read())
    code = "import __spark_entry__ as e; print('NAMES', *e.queries())"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    names = said.stdout.rpartition("NAMES")[2].split()
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {x.split("_")[0] for x in names}, said.stderr


def test_duckdb_spills_outside_the_repository():
    folder = duckdb.connect().sql("SELECT current_setting('temp_directory')").fetchall()[0][0]
    assert not os.path.abspath(folder).startswith(f"{ROOT}/")
