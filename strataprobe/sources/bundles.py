"""Captured trees on a file system: finding bundles, listing files, case contexts.

Listings carry names and sizes only. Empty and hidden files count, links do not; Spark's own file readers would
drop the former and follow the latter, so directories are walked here.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import CASE_SUFFIXES, artifact_category
from ..functions.records import SEED_TYPES

PARTS = ("cluster", "interval", "server", "client")
CAPTURE_PREFIX = "nomad-debug-"
LISTING = "path string, rel string, length long"


def is_bundle(path: Path) -> bool:
    return all((path / part).is_dir() for part in PARTS)


def find_bundle(root: str | Path) -> Path | None:
    """The root itself, or the only one of its directories that is a bundle; None if there is none, several, or
    the root can't be read."""
    root = Path(root)
    try:
        if is_bundle(root):
            return root
        inner = [p for p in sorted(root.iterdir()) if p.is_dir() and is_bundle(p)]
    except OSError:
        return None
    return inner[0] if len(inner) == 1 else None


def walk(root: str | Path, leave_out: list[str | Path] = ()) -> list[tuple[str, str, int]]:
    """(path, relative path, size) of all files but links, sorted; directories to leave out are not entered."""
    root = Path(root)
    out_of = {Path(p).resolve() for p in leave_out}
    rows = []
    for folder, inner, names in os.walk(root):
        inner[:] = [d for d in inner if (Path(folder) / d).resolve() not in out_of]
        for name in names:
            p = Path(folder) / name
            try:
                if p.is_file() and not p.is_symlink():
                    rows.append((str(p), p.relative_to(root).as_posix(), p.stat().st_size))
            except OSError:
                continue
    return sorted(rows, key=lambda r: r[1])


def listing(spark: SparkSession, root: str | Path, leave_out: list[str | Path] = ()) -> DataFrame:
    return spark.createDataFrame(walk(root, leave_out), LISTING)


def interval_ids(bundle: Path) -> list[str]:
    return sorted(p.name for p in (bundle / "interval").iterdir() if p.is_dir() and p.name.isdigit())


def coverage(bundle: Path | None) -> dict:
    """What a bundle's layout holds, by names alone."""
    if bundle is None:
        return {"detected": False, "bundle_root": None, "interval_ids": [], "interval_artifact_presence": {}, "servers": [], "clients": [], "cluster_artifacts": [], "eventstream_present": False, "index_json_entries": None}
    ids = interval_ids(bundle)
    present: dict[str, int] = {}
    for i in ids:
        for p in (bundle / "interval" / i).iterdir():
            if p.is_file():
                present[p.name] = present.get(p.name, 0) + 1
    dirs = lambda side: sorted(p.name for p in (bundle / side).iterdir() if p.is_dir())
    cluster = sorted(p.name for p in (bundle / "cluster").iterdir() if p.is_file())
    entries = None
    try:
        index = json.loads((bundle / "index.json").read_text("utf-8"))
        entries = len(index) if isinstance(index, (list, dict)) else None
    except (OSError, ValueError):
        pass
    return {
        "detected": True, "bundle_root": str(bundle), "interval_ids": ids, "interval_artifact_presence": dict(sorted(present.items())), "servers": dirs("server"),
        "clients": dirs("client"), "cluster_artifacts": cluster, "eventstream_present": "eventstream.json" in cluster, "index_json_entries": entries,
    }


@dataclass(frozen=True)
class Candidate:
    path: str
    capture_name: str
    interval_count: int
    server_count: int
    client_count: int
    eventstream_present: bool


def discover(case_root: str | Path, leave_out: str | Path | None = None, max_depth: int = 14) -> tuple[list[Candidate], int]:
    """Bundles below a case directory by name and layout, and how many paths could not be read. Links are
    not followed and found bundles are not searched."""
    case_root, skipped, found, unread = Path(case_root), Path(leave_out).resolve() if leave_out else None, [], 0
    for folder, inner, _ in os.walk(case_root, followlinks=False):
        here = Path(folder)
        if len(here.relative_to(case_root).parts) > max_depth:
            inner[:] = []
            continue
        inner[:] = [d for d in sorted(inner) if not (here / d).is_symlink() and (here / d).resolve() != skipped]
        try:
            if here.name.startswith(CAPTURE_PREFIX) and is_bundle(here):
                count = lambda side: sum(p.is_dir() for p in (here / side).iterdir())  # noqa: E731, B023
                found.append(Candidate(str(here), here.name, len(interval_ids(here)), count("server"), count("client"), (here / "cluster/eventstream.json").is_file()))
                inner[:] = []
        except OSError:
            unread += 1
    return sorted(found, key=lambda c: c.path), unread


def case_artifacts(spark: SparkSession, case_root: str | Path, leave_out: list[str | Path], max_depth: int = 14) -> DataFrame:
    """path, category, size_bytes, status of files beside the bundle that look like case material. Names and sizes only."""
    rows = [(rel, rel, size) for _, rel, size in walk(case_root, leave_out) if rel.count("/") <= max_depth]
    files = spark.createDataFrame(rows, LISTING)
    name = F.lower(F.element_at(F.split("rel", "/"), -1))
    known = F.regexp_extract(name, r"(\.[^.]+)$", 1).isin(CASE_SUFFIXES) | F.contains(name, F.lit("log"))
    return files.where(known).select(F.col("rel").alias("path"), artifact_category(F.col("rel")).alias("category"), F.col("length").alias("size_bytes"), F.lit("indexed").alias("status"))


class ContextError(ValueError):
    """The case context is not usable."""


def load_context(path: str | Path) -> dict:
    """A case context: object, schema_version 1, a classification, lists of non-empty seed texts, claims with id and
    claim."""
    try:
        context = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise ContextError(f"case context can't be read: {e}") from e
    if not isinstance(context, dict) or context.get("schema_version") != 1:
        raise ContextError("case context must be an object of schema_version 1")
    if not isinstance(context.get("classification"), str) or not context["classification"].strip():
        raise ContextError("case context needs a classification")
    seeds = context.get("seeds", {})
    if not isinstance(seeds, dict) or set(seeds) - set(SEED_TYPES):
        raise ContextError(f"seeds must be lists under {', '.join(SEED_TYPES)}")
    for name, values in seeds.items():
        if not isinstance(values, list) or not all(isinstance(v, str) and v for v in values):
            raise ContextError(f"seeds.{name} must be a list of texts")
    claims = context.get("claims_to_test", [])
    if not isinstance(claims, list) or not all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("claim"), str) for c in claims):
        raise ContextError("claims_to_test must be a list of objects with id and claim")
    return context


def seeds_of(spark: SparkSession, context: dict) -> DataFrame:
    rows = sorted({(SEED_TYPES[name], v) for name, values in context.get("seeds", {}).items() for v in values})
    return spark.createDataFrame(rows, "seed_type string, seed_value string")


def candidate_rows(found: list[Candidate]) -> list[dict]:
    return [asdict(c) for c in found]
