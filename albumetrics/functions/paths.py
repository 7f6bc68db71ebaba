"""Folder paths: ancestry, whitelist roots and categories, without path-to-path joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_FOLDERS = ("DCIM/Camera",)
CATEGORIES = (
    ("APPS", ("Android/media", "Android/data")),
    ("CAMERA", ("DCIM",)),
    ("COMMON", ("Pictures", "Download", "Downloads")),
)


def trim_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def self_and_ancestors(path: Column) -> Column:
    """``a/b/c`` to ``[a, a/b, a/b/c]``: every folder that covers the path."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def strict_ancestors(path: Column) -> Column:
    chain = self_and_ancestors(path)
    return F.slice(chain, 1, F.size(chain) - 1)


def is_descendant(folder: Column, ancestor: Column) -> Column:
    return F.startswith(folder, F.concat(ancestor, F.lit("/")))


def under(folder: Column, root: str) -> Column:
    return (folder == root) | folder.startswith(root + "/")


def minimal(folders: list[str]) -> list[str]:
    """The same selection without entries that another entry covers."""
    chosen = set(folders)
    return sorted(
        f for f in chosen if not any("/".join(f.split("/")[:n]) in chosen for n in range(1, f.count("/") + 1))
    )


def whitelist_root(rel_path: Column, roots: list[str]) -> Column:
    """The whitelisted root that holds the path, or null. An empty list keeps nothing."""
    chosen = minimal(roots)
    if not chosen:
        return F.lit(None).cast("string")
    hit = F.array_intersect(self_and_ancestors(rel_path), F.array(*[F.lit(r) for r in chosen]))
    return F.get(hit, F.lit(0))


def category(rel_path: Column) -> Column:
    """First category whose folder holds the path, case-sensitive, else OTHER."""
    out = None
    for name, roots in CATEGORIES:
        hit = under(rel_path, roots[0])
        for root in roots[1:]:
            hit = hit | under(rel_path, root)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("OTHER")


def covered(folders: DataFrame, column: str = "folder") -> DataFrame:
    """Folders that have an ancestor in the same table: an equi-join on the ancestor."""
    chains = folders.select(
        F.col(column), F.explode(strict_ancestors(F.col(column))).alias("_ancestor")
    )
    known = folders.select(F.col(column).alias("_ancestor")).distinct()
    return chains.join(known, "_ancestor", "left_semi").select(column).distinct()


def minimise(folders: DataFrame, column: str = "folder") -> DataFrame:
    base = folders.select(column).distinct()
    return base.join(covered(base, column), column, "left_anti")


def select_folder(folders: DataFrame, folder: str, column: str = "folder") -> DataFrame:
    """Add one folder and drop the entries it now covers."""
    kept = folders.select(column).filter(~F.col(column).startswith(folder + "/"))
    added = folders.sparkSession.createDataFrame([(folder,)], f"{column} string")
    return kept.unionByName(added).distinct()


def deselect_folder(folders: DataFrame, folder: str, column: str = "folder") -> DataFrame:
    return folders.select(column).filter(F.col(column) != folder)


def preselect(folders: DataFrame, column: str = "folder") -> DataFrame:
    """Folders under the default roots, or else those naming a camera; then minimal."""
    base = folders.select(column).distinct()
    default = F.lit(False)
    for root in DEFAULT_FOLDERS:
        default = default | under(F.col(column), root)
    by_default = base.filter(default)
    by_name = base.filter(F.contains(F.lower(F.col(column)), F.lit("camera")))
    any_default = by_default.limit(1).select(F.lit(1).alias("_any"))
    # The right side is at most one row by construction.
    fallback = by_name.withColumn("_any", F.lit(1)).join(F.broadcast(any_default), "_any", "left_anti")
    return minimise(by_default.unionByName(fallback.select(column)), column)
