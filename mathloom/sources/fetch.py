"""Bringing collections to a folder: files by their address, archives, and whether a collection is whole.

Everything may be repeated: what is there already is neither fetched nor unpacked again, and a file that is cut off
never gets its name.
"""

from __future__ import annotations

import shutil
import tarfile
import urllib.request
import zipfile
from collections.abc import Iterable
from pathlib import Path

# The subjects of math, each with one file a split, and how many single files make a whole collection.
SUBJECTS = ("algebra", "counting_and_probability", "geometry", "intermediate_algebra", "number_theory", "prealgebra", "precalculus")
WHOLE_FILES = 100
_TIMEOUT, _PART = 180, 256 * 1024


def download(url: str, target: str | Path) -> Path:
    """The file of an address (also file:), written beside its name first."""
    target = Path(target)
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")
        with urllib.request.urlopen(url, timeout=_TIMEOUT) as source, part.open("wb") as out:
            shutil.copyfileobj(source, out, _PART)
        part.rename(target)
    return target


def unpack(archive: str | Path, folder: str | Path) -> Path:
    """The content of a zip or tar archive in a folder; paths that lead out of it are refused. A mark beside the
    content says that it is complete."""
    folder, done = Path(folder), Path(folder) / f".{Path(archive).name}.unpacked"
    if not done.exists():
        folder.mkdir(parents=True, exist_ok=True)
        if zipfile.is_zipfile(archive):
            with zipfile.ZipFile(archive) as z:
                z.extractall(folder)
        else:
            with tarfile.open(archive) as t:
                t.extractall(folder, filter="data")
        done.touch()
    return folder


def looks_like_json(path: str | Path) -> bool:
    """Does the file begin with an object or an array?"""
    try:
        with Path(path).open("rb") as f:
            return f.read(1024).lstrip()[:1] in (b"{", b"[")
    except OSError:
        return False


def math_files(folder: str | Path, splits: Iterable[str]) -> list[Path]:
    return [Path(folder) / f"{subject}_{split}.jsonl" for split in splits for subject in SUBJECTS]


def math_is_whole(folder: str | Path, splits: Iterable[str] = ("train", "test")) -> bool:
    """Is every subject there for every split, or, of a collection of one file a question, at least WHOLE_FILES?"""
    folder = Path(folder)
    return folder.is_dir() and (all(map(looks_like_json, math_files(folder, splits))) or sum(1 for _ in zip(range(WHOLE_FILES), folder.rglob("*.json"))) == WHOLE_FILES)


def clear_cut_files(folder: str | Path, splits: Iterable[str] = ("train", "test")) -> list[Path]:
    """Delete the files of math that hold no JSON, as those of a broken transfer."""
    bad = [p for p in math_files(folder, splits) if p.exists() and not looks_like_json(p)]
    for p in bad:
        p.unlink()
    return bad


def fetch(addresses: dict[str, str], folder: str | Path) -> Path:
    """Files by name from their addresses into a folder; archives are unpacked there."""
    for name, url in addresses.items():
        path = download(url, Path(folder) / name)
        if name.endswith((".zip", ".tar", ".tar.gz", ".tgz")):
            unpack(path, folder)
    return Path(folder)
