"""Benchmark data sets: checked, unpacked and kept in a folder that the loaders read."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import sqlite3
import tempfile
import zipfile
from collections.abc import Callable
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path
from urllib.request import urlopen

from assayer.sources.databases import sqlite_connection

META = ".assayer.json"


@dataclass(frozen=True)
class DataSet:
    """What an archive has to be: its digest, its split file with so many cases, its folder of databases (maybe zipped within)."""

    name: str
    url: str
    sha256: str | None
    cases: int
    databases: str
    nested: bool
    license: str = "CC BY-SA 4.0"
    split: str = "dev"


# Public addresses, digests, sizes and layouts of the official archives.
KNOWN = {
    "bird": DataSet("bird", "https://bird-bench.oss-cn-beijing.aliyuncs.com/dev.zip", "cdd6d19faeb45a23970b98d3ef6c40a87987c95459c2cf12076897a60cf5a630", 1534, "dev_databases", True),
    "spider": DataSet("spider", "https://drive.usercontent.google.com/download?id=1403EGqzIDoHMdQF4c9Bkyl7dZLZ5Wt6J&export=download&confirm=t", "00636695dabed6b5f4b8328a16b13e069a2f16591d5efcce57660669c85b121b", 1034, "database", False),
}


def cache_root(cache_dir: str | Path | None = None) -> Path:
    return Path(cache_dir or os.environ.get("ASSAYER_CACHE_DIR") or Path.home() / ".cache" / "assayer")


def cached(dataset: DataSet, cache_dir: str | Path | None = None) -> Path | None:
    """The folder of a complete copy, if there is one."""
    found = sorted((cache_root(cache_dir) / dataset.name).glob(f"*/{META}"))
    return next((m.parent for m in found if (m.parent / f"{dataset.split}.json").is_file()), None)


def download(url: str, to: Path) -> None:
    with urlopen(url, timeout=600) as response, to.open("wb") as out:  # noqa: S310
        shutil.copyfileobj(response, out)


def install(dataset: DataSet, archive: str | Path | None = None, cache_dir: str | Path | None = None, force: bool = False, trust: bool = False, get: Callable[[str, Path], None] = download) -> Path:
    """The data set's folder, installed from `archive` (a local file) or from its address; RuntimeError if it is not what it should be.

    An archive without a known digest is taken only on `trust`. A copy is complete or not there: it is moved into place at the end.
    """
    if not force and (have := cached(dataset, cache_dir)):
        return have
    if dataset.sha256 is None and not trust:
        raise RuntimeError(f"{dataset.name}: its digest is not known; see where it comes from, then trust it")
    parent = cache_root(cache_dir) / dataset.name
    parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=parent) as tmp:
        file = Path(archive) if archive else Path(tmp) / "archive.zip"
        if not archive:
            get(dataset.url, file)
        digest = hashlib.sha256(file.read_bytes()).hexdigest()
        if dataset.sha256 not in (None, digest):
            raise RuntimeError(f"{dataset.name}: digest {digest}, expected {dataset.sha256}")
        if not zipfile.is_zipfile(file):
            raise RuntimeError(f"{dataset.name}: no zip archive; the server may have sent a page instead")
        root = unpack(dataset, file, Path(tmp) / "unpacked")
        check(dataset, root)
        (root / META).write_text(json.dumps({"name": dataset.name, "sha256": digest, "url": dataset.url, "license": dataset.license}), encoding="utf-8")
        to = parent / digest[:16]
        shutil.rmtree(to, ignore_errors=True)
        shutil.move(str(root), str(to))
    return to


def unpack(dataset: DataSet, archive: Path, to: Path) -> Path:
    """The folder with the split file and the databases, wherever the archive has it."""
    with zipfile.ZipFile(archive) as z:
        z.extractall(to)
    found = [p for p in sorted(to.rglob(f"{dataset.split}.json")) if "__MACOSX" not in p.parts]
    if not found:
        raise RuntimeError(f"{dataset.name}: no {dataset.split}.json in the archive")
    root = found[0].parent
    if dataset.nested and (inner := root / f"{dataset.databases}.zip").is_file():
        with zipfile.ZipFile(inner) as z:
            z.extractall(root)
        inner.unlink()
    shutil.rmtree(root / "__MACOSX", ignore_errors=True)
    if not (root / dataset.databases).is_dir():
        raise RuntimeError(f"{dataset.name}: no {dataset.databases} in the archive")
    return root


def check(dataset: DataSet, root: Path) -> None:
    """As many cases as there should be, and databases that are whole."""
    n = len(json.loads((root / f"{dataset.split}.json").read_text(encoding="utf-8")))
    if n != dataset.cases:
        raise RuntimeError(f"{dataset.name}: {n} cases, expected {dataset.cases}")
    for path in sorted((root / dataset.databases).rglob("*.sqlite")):
        try:
            with closing(sqlite_connection(str(path))) as con:
                good = con.execute("PRAGMA integrity_check").fetchone() == ("ok",)
        except sqlite3.DatabaseError:
            good = False
        if not good:
            raise RuntimeError(f"{dataset.name}: {path.name} is damaged")
