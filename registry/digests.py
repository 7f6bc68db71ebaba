"""Edits seen in every column they can change: full digests, and representatives after each kind of edit."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetrics.functions.quality import blend_quality
from albumetrics.operators import edits
from albumetrics.schema import Library
from registry import register, sql_of
from registry import fixtures as fx
from registry.edits import _POOL, _merges, _name_requests
from registry.fixtures import sql
from registry.vectors import _BASIS_SQL, REP_SQL

_COLUMNS = {
    "photo": {
        "id": "photo_id", "a": "modified_at", "b": "taken_at", "name": "folder", "path": "path", "flag": "pending_xmp_write",
        "code": "CAST(stage AS BIGINT)",
    },
    "person": {"id": "person_id", "name": "name", "a": "representative_face_id"},
    "face": {
        "id": "face_id", "a": "photo_id", "b": "person_id", "name": "name", "flag": "ignored", "failed": "embedding_failed",
        "quality": "round(quality_score, 6)",
    },
}
_TYPES = {
    "id": "bigint", "a": "bigint", "b": "bigint", "name": "string", "path": "string", "flag": "boolean", "code": "bigint",
    "failed": "boolean", "quality": "double", "box": "double", "marks": "double", "vec_n": "bigint", "vec_sum": "double",
}
# One number that changes with each side of the box; one with each landmark; one with each part of the vector.
_BOX = "round({0}x + 10*{0}y + 100*{0}w + 1000*{0}h, 6)"
_SPARK_FACE = {
    "box": _BOX.format("region."),
    "marks": "round(aggregate(transform(region.landmarks, (v, i) -> v * (i + 1)), 0D, (s, v) -> s + v), 6)",
    "vec_n": "CASE WHEN embedding IS NOT NULL THEN CAST(size(embedding) AS BIGINT) END",
    "vec_sum": "round(aggregate(transform(embedding, (v, i) -> v * (i + 1)), 0D, (s, v) -> s + v), 6)",
}
_DUCK_FACE = {
    "box": _BOX.format(""),
    "marks": "round(list_sum(list_transform(landmarks, lambda v, i: v * i)), 6)",
    "vec_n": "len(embedding)",
    "vec_sum": "round(list_sum(list_transform(embedding, lambda v, i: v * i)), 6)",
}


def full_digest(library: Library) -> DataFrame:
    """Every column of the three tables, boxes, landmarks and vectors as weighted sums."""

    def rows(table: DataFrame, kind: str, more: dict[str, str]) -> DataFrame:
        given = _COLUMNS[kind] | more
        return table.selectExpr(
            f"'{kind}' AS tbl", *[f"CAST({given.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _TYPES.items()]
        )

    photos, persons = rows(library.photos, "photo", {}), rows(library.persons, "person", {})
    return photos.unionByName(persons).unionByName(rows(library.faces, "face", _SPARK_FACE))


def full_digest_sql(photos: str, persons: str, faces: str) -> str:
    def rows(table: str, kind: str, more: dict[str, str]) -> str:
        given = _COLUMNS[kind] | more
        types = {c: t.replace("string", "varchar") for c, t in _TYPES.items()}
        return f"SELECT '{kind}' AS tbl, " + ", ".join(f"CAST({given.get(c, 'NULL')} AS {t}) AS {c}" for c, t in types.items()) + f" FROM {table}"

    body = " UNION ALL ".join((rows("np", "photo", {}), rows("nr", "person", {}), rows("nf", "face", _DUCK_FACE)))
    tail = f"np AS ({photos}), nr AS ({persons}), nf AS ({faces})"
    return sql(body, "photos", "persons", "faces", extra=tail)


_PERSONS = "SELECT *, CAST(NULL AS BIGINT) AS representative_face_id FROM persons"


@register(
    "m18_vector_space_columns",
    full_digest_sql(
        "SELECT * FROM photos", f"SELECT * FROM ({_PERSONS}) WHERE false",
        "SELECT * REPLACE (CAST(NULL AS BIGINT) AS person_id, CAST(NULL AS DOUBLE[]) AS embedding, false AS embedding_failed) FROM faces",
    ),
)
def _(spark, sf):
    return full_digest(edits.change_vector_space(fx.library(spark, sf)))


@register("m18_vector_space_kept", full_digest_sql("SELECT * FROM photos", _PERSONS, "SELECT * FROM faces"))
def _(spark, sf):
    return full_digest(edits.change_vector_space(fx.library(spark, sf), "keep"))


@register(
    "m19_all_columns",
    full_digest_sql(
        """SELECT * REPLACE (CASE WHEN photo_id % 2 = 0 THEN modified_at + 5 ELSE modified_at END AS modified_at,
          CASE WHEN photo_id % 5 = 0 THEN NULL WHEN photo_id % 5 = 1 THEN 1000 * photo_id ELSE taken_at END AS taken_at,
          CASE WHEN photo_id % 7 = 0 THEN 'Moved' ELSE folder END AS folder,
          CASE WHEN photo_id % 3 = 0 THEN 2 * (photo_id % 2) ELSE stage END AS stage,
          pending_xmp_write OR photo_id % 11 = 0 AS pending_xmp_write) FROM photos""",
        "SELECT *, CASE WHEN person_id % 2 = 0 THEN person_id * 10 END AS representative_face_id FROM persons",
        """SELECT * REPLACE (CASE WHEN face_id % 10 = 1 THEN NULL ELSE name END AS name,
          CASE WHEN face_id % 10 = 2 THEN w ELSE x END AS x, CASE WHEN face_id % 10 = 2 THEN h ELSE y END AS y,
          CASE WHEN face_id % 10 = 2 THEN x ELSE w END AS w, CASE WHEN face_id % 10 = 2 THEN y ELSE h END AS h,
          CASE WHEN face_id % 10 = 2 THEN NULL ELSE landmarks END AS landmarks,
          embedding_failed OR face_id % 10 = 3 AS embedding_failed,
          CASE WHEN face_id % 10 = 4 THEN coalesce(quality_score, w)*0.667 + w*0.333 ELSE quality_score END AS quality_score,
          CASE WHEN face_id % 10 = 5 THEN list_transform(embedding, lambda v: v / 2) ELSE embedding END AS embedding) FROM faces""",
    ),
)
def _(spark, sf):
    """A point update of each column that has one."""
    lib = fx.library(spark, sf)

    def photos(condition, **values):
        picked = fx.photos(spark, sf).filter(condition)
        return picked.select("photo_id", *[F.expr(v).alias(c) for c, v in values.items()]), list(values)

    for condition, values in (
        ("photo_id % 2 = 0", {"modified_at": "modified_at + 5"}),
        ("photo_id % 5 < 2", {"taken_at": "CASE WHEN photo_id % 5 = 1 THEN 1000 * photo_id END"}),
        ("photo_id % 7 = 0", {"folder": "'Moved'"}),
        ("photo_id % 11 = 0", {"pending_xmp_write": "true"}),
    ):
        lib = edits.patch_photos(lib, *photos(condition, **values))
    lib = edits.set_analysed(lib, fx.photos(spark, sf).filter("photo_id % 3 = 0").selectExpr("photo_id", "photo_id % 2 = 1 AS analysed"))
    old = fx.faces(spark, sf)
    turned = "named_struct('x', region.w, 'y', region.h, 'w', region.x, 'h', region.y, 'landmarks', CAST(NULL AS ARRAY<DOUBLE>)) AS region"
    for digit, value, column in (
        (1, "CAST(NULL AS STRING) AS name", "name"), (2, turned, "region"), (3, "true AS embedding_failed", "embedding_failed"),
        (5, "transform(embedding, v -> v / 2) AS embedding", "embedding"),
    ):
        lib = edits.patch_faces(lib, old.filter(f"face_id % 10 = {digit}").selectExpr("face_id", value), [column])
    better = old.filter("face_id % 10 = 4").select("face_id", blend_quality(F.col("quality_score"), F.col("region.w")).alias("quality_score"))
    lib = edits.patch_faces(lib, better, ["quality_score"])
    stars = lib.persons.filter("person_id % 2 = 0").select("person_id", (F.col("person_id") * 10).alias("representative_face_id"))
    return full_digest(edits.patch_persons(lib, stars, ["representative_face_id"]))


# --- representatives after edits -----------------------------------------------------------------

# Before the edit each person has this one, so that it shows who was looked at again.
_BEFORE = "1000000 + person_id"


def _touched(name: str, touched: str, edit) -> None:
    """Register the representatives after the edit of query ``name``; ``touched`` selects the persons it looks at again."""
    head = sql_of(name).rsplit("SELECT 'photo' AS tbl", 1)[0].rstrip()
    basis = _BASIS_SQL.format(name="centre", weight="1.0", source="basis").replace("FROM faces", "FROM nf")
    body = f"""SELECT person_id, name, CASE WHEN person_id IN ({touched}) THEN r.face_id ELSE {_BEFORE} END AS representative_face_id
        FROM nr LEFT JOIN ({REP_SQL}) r USING (person_id)"""

    @register(f"{name}_refreshed", f"{head},\n{basis}\n{body}")
    def _(spark, sf):
        lib = fx.library(spark, sf)
        lib = replace(lib, persons=lib.persons.withColumn("representative_face_id", F.expr(_BEFORE)))
        return edit(lib).persons.select("person_id", "name", "representative_face_id")


def _ids(lib: Library, condition: str) -> DataFrame:
    return lib.faces.filter(condition).select("face_id")


def _to_ninths(lib: Library) -> DataFrame:
    return lib.faces.filter(_POOL).select("face_id", (F.col("face_id") % 9).alias("person_id"))


_OWNERS = "SELECT person_id FROM faces WHERE person_id IS NOT NULL AND {}"

_touched(
    "m01_confirm_face", _OWNERS.format("person_id < 7 AND name IS NULL AND face_id % 2 = 0"),
    lambda lib: edits.confirm_faces(lib, lib.faces.filter("person_id IS NOT NULL AND name IS NULL AND face_id % 2 = 0").select("face_id", "person_id")),
)
_touched(
    "m03_remove_unconfirmed", "1, 8",
    lambda lib: edits.remove_unconfirmed(lib, lib.persons.filter("person_id IN (1, 8)").select("person_id")),
)
_touched("m06_ignore_faces", _OWNERS.format("face_id % 4 = 1"), lambda lib: edits.ignore_faces(lib, _ids(lib, "face_id % 4 = 1")))
_touched("m06_unignore_faces", _OWNERS.format("ignored AND face_id % 2 = 0"), lambda lib: edits.unignore_faces(lib, _ids(lib, "ignored AND face_id % 2 = 0")))
_touched("m07_delete_faces", _OWNERS.format("face_id % 3 = 1"), lambda lib: edits.delete_faces(lib, _ids(lib, "face_id % 3 = 1")))
_touched("m08_remove_from_person", "8", lambda lib: edits.remove_from_person(lib, _ids(lib, "person_id = 8")))
_touched(
    "m09_assign_confirmed", f"SELECT face_id % 9 FROM faces WHERE {_POOL} AND face_id % 9 < 7",
    lambda lib: edits.assign_faces(lib, _to_ninths(lib)),
)
_touched(
    "m09_assign_suggested", f"SELECT face_id % 9 FROM faces WHERE {_POOL}",
    lambda lib: edits.assign_faces(lib, _to_ninths(lib), confirm=False),
)
_touched("m11_name_suggestions", "7, 8, 9", lambda lib: edits.name_suggestions(lib, _name_requests(lib)))
_touched("m11_name_suggestions_confirmed", "7, 8, 9", lambda lib: edits.name_suggestions(lib, _name_requests(lib), confirm=True))
_touched("m12_merge_persons", "1", lambda lib: edits.merge_persons(lib, _merges(lib)))
_touched("m12_merge_persons_confirmed", "1", lambda lib: edits.merge_persons(lib, _merges(lib), confirm=True))
_touched("m12_merge_persons_strict", "1", lambda lib: edits.merge_persons(lib, _merges(lib), strict_reference=True))
