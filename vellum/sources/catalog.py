"""The catalog of named repositories: one folder with a config file for each, read on the driver."""

from __future__ import annotations

import os
import sys
from dataclasses import asdict, dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from vellum.errors import AlreadyExists, InvalidName, NotFound
from vellum.logs import Logger

CONFIG_FILE, DATABASE_FILE, REPOS = "config.yaml", "vellum.db", "repos"
DEFAULT_APPLICATION = "obsidian"
SCHEMA = "name string, application string, directory string, config string, db string"


@dataclass(frozen=True)
class Repo:
    name: str
    application: str
    directory: str
    config: str = ""
    db: str = ""


def config_dir(given: str | None = None, spark: SparkSession | None = None) -> str:
    """The given folder, else the session's, the environment's, or the user's usual one."""
    named = given or (spark.conf.get("spark.vellum.config.dir", None) if spark else None) or os.environ.get("VELLUM_CONFIG_DIR")
    if named:
        return named
    if sys.platform == "win32" and os.environ.get("APPDATA"):
        return os.path.join(os.environ["APPDATA"], "vellum")
    base = os.environ.get("XDG_CONFIG_HOME", "")
    return os.path.join(base if os.path.isabs(base) else os.path.expanduser("~/.config"), "vellum")


def check_name(name: str) -> None:
    if name in ("", ".", "..") or "/" in name or "\\" in name:
        raise InvalidName(f"invalid repo name {name!r}")


def names(folder: str) -> list[str]:
    """Sorted names of the folders below repos/ that hold a config file; links do not count."""
    try:
        with os.scandir(os.path.join(folder, REPOS)) as found:
            return sorted((e.name for e in found if e.is_dir(follow_symlinks=False) and os.path.exists(os.path.join(e.path, CONFIG_FILE))), key=os.fsencode)
    except FileNotFoundError:
        return []


def load(folder: str, name: str) -> Repo:
    check_name(name)
    own = os.path.join(folder, REPOS, name)
    path = os.path.join(own, CONFIG_FILE)
    try:
        found = yaml.safe_load(Path(path).read_text("utf-8")) or {}
    except FileNotFoundError:
        raise NotFound(f"repo not found: {name!r} in {os.path.join(folder, REPOS)}") from None
    if not isinstance(found, dict):
        raise yaml.YAMLError(f"parse {path}: not a mapping")
    text = lambda key: "" if found.get(key) is None else str(found[key])
    return Repo(text("name"), text("application"), text("directory"), path, os.path.join(own, DATABASE_FILE))


def init(folder: str, directory: str, name: str = "", application: str = DEFAULT_APPLICATION) -> Repo:
    """Record a repository. The name defaults to the directory's; making its folder is the lock."""
    absolute = os.path.abspath(directory)
    name = name or os.path.basename(absolute)
    check_name(name)
    own = os.path.join(folder, REPOS, name)
    os.makedirs(os.path.join(folder, REPOS), exist_ok=True)
    try:
        os.mkdir(own)
    except FileExistsError:
        raise AlreadyExists(f"repo {name!r} already exists in {os.path.join(folder, REPOS)}") from None
    repo = Repo(name, application, absolute, os.path.join(own, CONFIG_FILE), os.path.join(own, DATABASE_FILE))
    stored = {"application": repo.application, "name": repo.name, "directory": repo.directory}
    Path(repo.config).write_text(yaml.safe_dump(stored, sort_keys=False, allow_unicode=True), "utf-8")
    return repo


def load_all(folder: str, log: Logger) -> list[Repo]:
    """All repositories by name; one that does not load is warned of and left out."""
    out = []
    for name in names(folder):
        try:
            out.append(load(folder, name))
        except (yaml.YAMLError, OSError, UnicodeError) as e:
            log.warning("could not load repo", repo=name, err=str(e))
    return out


def repos(spark: SparkSession, folder: str, log: Logger | None = None) -> DataFrame:
    """The catalog as a table, by name."""
    found = load_all(folder, log or Logger())
    return spark.createDataFrame([tuple(asdict(r).values()) for r in found], SCHEMA).orderBy("name").coalesce(1)
