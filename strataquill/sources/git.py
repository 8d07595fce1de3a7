"""Facts of a git working tree as one-row tables; read on the driver, where the tree is."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(path: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, timeout=60, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def info(spark: SparkSession, path: str) -> DataFrame:
    """path, is_git_repo, branch, head (12 characters), remote, is_dirty, has_submodules."""
    inside = _git(path, "rev-parse", "--is-inside-work-tree") == "true"
    head = _git(path, "rev-parse", "HEAD") if inside else None
    row = (
        path, inside, _git(path, "rev-parse", "--abbrev-ref", "HEAD") if head else None, head[:12] if head else None, (_git(path, "remote", "get-url", "origin") or None) if inside else None,
        bool(_git(path, "status", "--porcelain")) if inside else None, bool(_git(path, "submodule", "status")) if inside else None,
    )
    return spark.createDataFrame([row], "path string, is_git_repo boolean, branch string, head string, remote string, is_dirty boolean, has_submodules boolean")


def branches(spark: SparkSession, path: str) -> DataFrame:
    """(position, branch): local branches, then remote ones without their remote's name; the first of equals."""
    local = (_git(path, "branch", "--format=%(refname:short)") or "").splitlines()
    remote = [b.split("/", 1)[1] for b in (_git(path, "branch", "-r", "--format=%(refname:short)") or "").splitlines() if "/" in b]
    found = [b for b in dict.fromkeys([*local, *remote]) if b and b != "HEAD"]
    return spark.createDataFrame(list(enumerate(found)), "position long, branch string")
