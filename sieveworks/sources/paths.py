"""Which files a source means: lists, folders, splits by name. These look at names only, on the driver, in any file system that Spark knows."""

from __future__ import annotations

import os
from collections.abc import Sequence

from sieveworks.sources import files


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _stem(path: str) -> str:
    return os.path.splitext(_name(path))[0]


def listed(paths: str, suffixes: Sequence[str] = (".jsonl",), recursive: bool = True) -> list[str]:
    """Files of a comma-separated list of files and folders, once each, sorted; raises where nothing is found."""
    out: set[str] = set()
    for part in (p.strip() for p in paths.split(",")):
        if not part:
            continue
        if files.is_file(part):
            out.add(part)
        elif files.is_folder(part):
            out.update(f for f in files.entries(part, recursive) if f.endswith(tuple(suffixes)))
        else:
            raise FileNotFoundError(part)
    if not out:
        raise FileNotFoundError(f"no {' or '.join(suffixes)} file in {paths}")
    return sorted(out)


def json_then_jsonl(folder: str) -> list[str]:
    """All .json files of a folder, sorted, then all .jsonl files."""
    found = files.entries(folder)
    return [f for suffix in (".json", ".jsonl") for f in found if f.endswith(suffix)]


def for_split(paths: str, split: str) -> list[str]:
    """Files of a split: those named for it where there are any, else all that aren't named for the other one; metadata files never."""
    names = {"train": ("train",), "validation": ("validation", "eval")}
    mine, other = names[split], names["validation" if split == "train" else "train"]
    out: set[str] = set()
    for part in (p.strip() for p in paths.split(",") if p.strip()):
        single = files.is_file(part)
        found = [part] if single else [f for f in files.entries(part) if f.endswith((".json", ".jsonl"))] if files.is_folder(part) else []
        found = [f for f in found if _name(f) != "metadata.json" and not _name(f).endswith("_metadata.json")]
        exact = [f for f in found if _stem(f) in mine]
        out.update(exact or [f for f in found if single or not _stem(f).startswith(other)])
    return sorted(out)


def split_by_name(names: Sequence[str]) -> dict[str, list[str]]:
    """Files by what their name says: validation, valid or eval; test; else train. Without train files all count as train."""
    out: dict[str, list[str]] = {"train": [], "validation": [], "test": []}
    for f in names:
        name = _name(f).lower()
        out["validation" if any(w in name for w in ("validation", "valid", "eval")) else "test" if "test" in name else "train"].append(f)
    if not out["train"]:
        out["train"] = list(names)
    return out


def output_path(source: str, target: str, suffix: str = "") -> str:
    """Where the output of a file goes: into a folder (also one to be made) under its own name, else the file itself as .jsonl."""
    name = f"{_stem(source)}{suffix}.jsonl"
    if files.is_folder(target) or not os.path.splitext(_name(target))[1]:
        return f"{target.rstrip('/')}/{name}"
    return os.path.splitext(target)[0] + ".jsonl"
