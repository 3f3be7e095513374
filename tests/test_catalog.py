import json
import os

import pytest
import yaml

from vellum import cli
from vellum.errors import AlreadyExists, InvalidName, NotFound, UnknownApplication
from vellum.operators import sinks
from vellum.plans import registry
from vellum.sources import catalog


def test_round_trip(tmp_path):
    made = catalog.init(str(tmp_path), "/some/where", "Field.Notes")
    assert catalog.load(str(tmp_path), "Field.Notes") == made
    assert made.db == str(tmp_path / "repos/Field.Notes/vellum.db")
    assert yaml.safe_load(open(made.config)) == {"application": "obsidian", "name": "Field.Notes", "directory": "/some/where"}


def test_defaults(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    made = catalog.init(str(tmp_path / "c"), "notes")
    assert (made.name, made.directory) == ("notes", str(tmp_path / "notes"))


def test_errors(tmp_path):
    with pytest.raises(NotFound):
        catalog.load(str(tmp_path), "missing")
    for name in (".", "..", "a/b", "a\\b"):
        with pytest.raises(InvalidName):
            catalog.init(str(tmp_path), "/x", name)
        with pytest.raises(InvalidName):
            catalog.load(str(tmp_path), name)
    catalog.init(str(tmp_path), "/x", "one")
    with pytest.raises(AlreadyExists):
        catalog.init(str(tmp_path), "/y", "one")
    with pytest.raises(UnknownApplication):
        registry.strategy("zettlr")


def test_names_are_sorted_folders_with_a_config(tmp_path):
    assert catalog.names(str(tmp_path)) == []
    for name in ("yarrow", "acorn"):
        catalog.init(str(tmp_path), "/x", name)
    (tmp_path / "repos/file").write_text("")
    (tmp_path / "repos/bare").mkdir()
    os.symlink(tmp_path / "repos/yarrow", tmp_path / "repos/link")
    assert catalog.names(str(tmp_path)) == ["acorn", "yarrow"]


def test_config_dir(monkeypatch):
    for k in ("VELLUM_CONFIG_DIR", "XDG_CONFIG_HOME"):
        monkeypatch.delenv(k, raising=False)
    assert catalog.config_dir() == os.path.expanduser("~/.config/vellum")
    monkeypatch.setenv("XDG_CONFIG_HOME", "relative")
    assert catalog.config_dir() == os.path.expanduser("~/.config/vellum")
    monkeypatch.setenv("XDG_CONFIG_HOME", "/xdg")
    assert catalog.config_dir() == "/xdg/vellum"
    monkeypatch.setenv("VELLUM_CONFIG_DIR", "/own")
    assert catalog.config_dir() == "/own"
    assert catalog.config_dir("/given") == "/given"


@pytest.fixture
def run(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)

    def call(*args):
        code = cli.main(["--config-dir", str(tmp_path), *args])
        said = capsys.readouterr()
        return code, said.out, said.err

    return call


def test_list_empty(run):
    code, out, err = run("list")
    assert (code, out) == (0, "") and "no repos found" in err
    assert run("ls", "--json")[:2] == (0, "[]\n")


def test_list(run, tmp_path):
    assert run("repo", "init", "/vaults/b", "-n", "beta")[0] == 0
    assert run("repo", "init", "/vaults/a", "--name", "acorn", "-a", "zettlr")[0] == 0
    (tmp_path / "repos/broken").mkdir()
    (tmp_path / "repos/broken/config.yaml").write_text("directory: {open")
    code, out, err = run("list", "-j")
    assert code == 0 and "could not load repo" in err
    assert [(r["name"], r["application"]) for r in json.loads(out)] == [("acorn", "zettlr"), ("beta", "obsidian")]
    lines = run("ls")[1].splitlines()
    assert lines[0].split() == ["NAME", "APPLICATION", "DIRECTORY", "CONFIG", "DB"]
    assert len({line.index(x) for line, x in zip(lines, ("APPLICATION", "zettlr", "obsidian"), strict=True)}) == 1
    assert run("repo", "init", "/vaults/a", "-n", "acorn")[0] == 1


def test_index(run, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "a.md").write_text("---\ntitle: A\n---\n# A\n")
    (vault / "b.txt").write_text("x")
    run("repo", "init", str(vault), "-n", "v")
    code, out, err = run("index", "v")
    assert (code, out) == (0, "")
    assert "dirs_skipped=0 docs_skipped=1 docs_prepared=1 docs_failed=0" in err
    assert '"title":"A"' in run("-v", "index", "v")[2].replace("\\", "")
    assert json.loads((tmp_path / "vellum.log").read_text().splitlines()[-1])["msg"]


def test_usage_errors(run, tmp_path):
    assert run("index")[0] == 1
    assert run("index", "missing")[0] == 1
    assert run("list", "extra")[0] == 1
    run("repo", "init", "/x", "-n", "e", "-a", "zettlr")
    code, _, err = run("index", "e")
    assert code == 1 and "unknown application" in err
    assert "init" in run("repo")[1]


def test_repo_json(spark, tmp_path):
    catalog.init(str(tmp_path), "/x", "one")
    row = json.loads(catalog.repos(spark, str(tmp_path)).select(sinks.repo_json().alias("j")).first().j)
    assert list(row) == ["application", "name", "directory", "config", "db"] and row["name"] == "one"


def test_aligned():
    assert sinks.aligned(["A", "BB"], [("xxx", "y")]) == "A    BB\nxxx  y\n"
