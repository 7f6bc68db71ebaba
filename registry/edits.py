"""Edits of the library, each shown as the rows of the three tables after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetrics.functions.quality import blend_quality
from albumetrics.operators import edits
from albumetrics.schema import Library
from albumetrics.sources.snapshots import insert_ignore, latest_per_key, upsert
from registry import fixtures as fx
from registry import register
from registry.fixtures import FOLDERS, FOLDERS_SQL, sql
from registry.vectors import _BASIS_SQL, REP_SQL


def digest(library: Library) -> DataFrame:
    """The state an edit can change, as one table."""
    none = F.lit(None)
    photos = library.photos.select(
        F.lit("photo").alias("tbl"), F.col("photo_id").alias("id"), none.cast("bigint").alias("person_id"),
        F.col("folder").alias("name"), F.col("pending_xmp_write").alias("flag"), F.col("stage").cast("bigint").alias("stage"),
    )
    persons = library.persons.select(
        F.lit("person").alias("tbl"), F.col("person_id").alias("id"), none.cast("bigint").alias("person_id"), "name",
        none.cast("boolean").alias("flag"), none.cast("bigint").alias("stage"),
    )
    faces = library.faces.select(
        F.lit("face").alias("tbl"), F.col("face_id").alias("id"), "person_id", "name", F.col("ignored").alias("flag"),
        F.col("photo_id").alias("stage"),
    )
    return photos.unionByName(persons).unionByName(faces)


def digest_sql(
    photos: str = "SELECT * FROM photos", persons: str = "SELECT * FROM persons", faces: str = "SELECT * FROM faces",
    extra: str = "",
) -> str:
    tail = (extra + ", " if extra else "") + f"np AS ({photos}), nr AS ({persons}), nf AS ({faces})"
    return sql(
        """SELECT 'photo' AS tbl, photo_id AS id, CAST(NULL AS BIGINT) AS person_id, folder AS name, pending_xmp_write AS flag, CAST(stage AS BIGINT) AS stage FROM np
        UNION ALL SELECT 'person', person_id, NULL, name, NULL, NULL FROM nr
        UNION ALL SELECT 'face', face_id, person_id, name, ignored, photo_id FROM nf""",
        "photos", "persons", "faces", extra=tail,
    )


def _pending(condition: str) -> str:
    """Photos, queued where they hold a face of the condition."""
    return f"SELECT * REPLACE (pending_xmp_write OR photo_id IN (SELECT photo_id FROM faces WHERE {condition}) AS pending_xmp_write) FROM photos"


def _faces(**columns: str) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"{value} AS {name}" for name, value in columns.items()) + ") FROM faces"


_PRUNED = "SELECT * FROM persons WHERE {keep} OR person_id IN (SELECT person_id FROM nf WHERE person_id IS NOT NULL)"


def _ordered_digest_sql(photos: str, persons: str, faces: str, extra: str = "") -> str:
    """Like ``digest_sql`` but the person rows may look at the new faces."""
    return digest_sql(photos, persons, faces, extra).replace(
        f"np AS ({photos}), nr AS ({persons}), nf AS ({faces})", f"np AS ({photos}), nf AS ({faces}), nr AS ({persons})"
    )


# --- faces -------------------------------------------------------------------------------------


@register(
    "m01_confirm_face",
    digest_sql(
        photos=_pending("person_id IS NOT NULL AND person_id < 7 AND name IS NULL AND face_id % 2 = 0"),
        faces=_faces(name="CASE WHEN person_id IS NOT NULL AND person_id < 7 AND name IS NULL AND face_id % 2 = 0 THEN 'P' || CAST(person_id AS VARCHAR) ELSE name END"),
    ),
)
def _(spark, sf):
    """Confirm every second suggested face to its person; unnamed persons are refused."""
    lib = fx.library(spark, sf)
    wanted = lib.faces.filter("person_id IS NOT NULL AND name IS NULL AND face_id % 2 = 0").select("face_id", "person_id")
    return digest(edits.confirm_faces(lib, wanted, refresh=False))


@register(
    "m01_confirm_representative",
    sql(
        "SELECT p.person_id, r.face_id AS representative_face_id FROM persons p LEFT JOIN (" + REP_SQL + ") r ON r.person_id = p.person_id AND p.name IS NOT NULL",
        "persons",
        extra="faces AS (SELECT * REPLACE (CASE WHEN person_id IS NOT NULL AND person_id < 7 AND name IS NULL AND face_id % 2 = 0 THEN 'P' || CAST(person_id AS VARCHAR) ELSE name END AS name) FROM old), "
        + _BASIS_SQL.format(name="centre", weight="1.0", source="basis"),
    ).replace("WITH persons", "WITH old AS (" + fx._CTES["faces"] + "), persons"),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    wanted = lib.faces.filter("person_id IS NOT NULL AND name IS NULL AND face_id % 2 = 0").select("face_id", "person_id")
    return edits.confirm_faces(lib, wanted).persons.select("person_id", "representative_face_id")


@register(
    "m06_ignore_faces",
    _ordered_digest_sql(
        photos="SELECT * FROM photos",
        faces=_faces(
            ignored="ignored OR face_id % 4 = 1", person_id="CASE WHEN face_id % 4 = 1 THEN NULL ELSE person_id END",
            name="CASE WHEN face_id % 4 = 1 THEN NULL ELSE name END",
        ),
        persons=_PRUNED.format(keep="person_id NOT IN (SELECT person_id FROM faces WHERE face_id % 4 = 1 AND person_id IS NOT NULL)"),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.ignore_faces(lib, lib.faces.filter("face_id % 4 = 1").select("face_id"), refresh=False))


@register("m06_unignore_faces", digest_sql(faces=_faces(ignored="ignored AND face_id % 2 = 1")))
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.unignore_faces(lib, lib.faces.filter("ignored AND face_id % 2 = 0").select("face_id"), refresh=False))


@register(
    "m07_delete_faces",
    _ordered_digest_sql(
        photos=_pending("face_id % 3 = 1"),
        faces="SELECT * FROM faces WHERE face_id % 3 <> 1",
        persons=_PRUNED.format(keep="person_id NOT IN (SELECT person_id FROM faces WHERE face_id % 3 = 1 AND person_id IS NOT NULL)"),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.delete_faces(lib, lib.faces.filter("face_id % 3 = 1").select("face_id"), refresh=False))


@register(
    "m08_remove_from_person",
    _ordered_digest_sql(
        photos=_pending("person_id = 8 AND person_id IS NOT NULL"),
        faces=_faces(person_id="CASE WHEN person_id = 8 THEN NULL ELSE person_id END", name="CASE WHEN person_id = 8 THEN NULL ELSE name END"),
        persons="SELECT * FROM persons WHERE person_id <> 8",
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.remove_from_person(lib, lib.faces.filter("person_id = 8").select("face_id"), refresh=False))


_POOL = "person_id IS NULL AND NOT ignored"


@register(
    "m09_assign_confirmed",
    digest_sql(
        photos=_pending(f"{_POOL} AND face_id % 9 < 7"),
        faces=_faces(
            person_id=f"CASE WHEN {_POOL} AND face_id % 9 < 7 THEN face_id % 9 ELSE person_id END",
            name=f"CASE WHEN {_POOL} AND face_id % 9 < 7 THEN 'P' || CAST(face_id % 9 AS VARCHAR) ELSE name END",
        ),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    wanted = lib.faces.filter(_POOL).select("face_id", (F.col("face_id") % 9).alias("person_id"))
    return digest(edits.assign_faces(lib, wanted, refresh=False))


@register(
    "m09_assign_suggested",
    digest_sql(faces=_faces(person_id=f"CASE WHEN {_POOL} THEN face_id % 9 ELSE person_id END")),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    wanted = lib.faces.filter(_POOL).select("face_id", (F.col("face_id") % 9).alias("person_id"))
    return digest(edits.assign_faces(lib, wanted, confirm=False, refresh=False))


# New persons have hashed ids; the SQL side names them by their name.
@register(
    "m09_assign_by_name",
    sql(
        f"""SELECT face_id, coalesce(o.name, 'none') AS owner FROM (SELECT face_id, CASE WHEN {_POOL} THEN 'P' || CAST(face_id % 12 AS VARCHAR) ELSE p.name END AS name
        FROM faces LEFT JOIN persons p USING (person_id)) o""".replace("p.name END AS name", "pname END AS name").replace(
            "FROM faces LEFT JOIN persons p USING (person_id)", "FROM (SELECT f.*, p.name AS pname FROM faces f LEFT JOIN persons p ON p.person_id = f.person_id)"
        ),
        "faces", "persons",
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    wanted = lib.faces.filter(_POOL).select("face_id", F.concat(F.lit("P"), F.col("face_id") % 12).alias("name"))
    after = edits.assign_faces_by_name(lib, wanted, refresh=False)
    owners = after.persons.select("person_id", F.col("name").alias("owner"))
    return after.faces.select("face_id", "person_id").join(owners, "person_id", "left").select(
        "face_id", F.coalesce("owner", F.lit("none")).alias("owner")
    )


# --- persons --------------------------------------------------------------------------------------


@register(
    "m02_reject_suggestions",
    digest_sql(
        persons="SELECT * FROM persons WHERE person_id NOT IN (7, 9)",
        faces=_faces(person_id="CASE WHEN person_id IN (7, 9) THEN NULL ELSE person_id END"),
    ),
)
def _(spark, sf):
    """Persons 3, 7 and 9 are asked for; 3 has a name and stays."""
    lib = fx.library(spark, sf)
    return digest(edits.reject_suggestions(lib, lib.persons.filter("person_id IN (3, 7, 9)").select("person_id")))


@register(
    "m03_remove_unconfirmed",
    _ordered_digest_sql(
        photos="SELECT * FROM photos",
        faces=_faces(person_id="CASE WHEN person_id IN (1, 8) AND name IS NULL THEN NULL ELSE person_id END"),
        persons=_PRUNED.format(keep="person_id NOT IN (1, 8)"),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    chosen = lib.persons.filter("person_id IN (1, 8)").select("person_id")
    return digest(edits.remove_unconfirmed(lib, chosen, refresh=False))


@register(
    "m04_reject_all_suggestions",
    _ordered_digest_sql(
        photos="SELECT * FROM photos",
        faces=_faces(person_id="CASE WHEN name IS NULL OR person_id > 6 THEN NULL ELSE person_id END"),
        persons="SELECT * FROM persons WHERE name IS NOT NULL AND person_id IN (SELECT person_id FROM nf WHERE person_id IS NOT NULL)",
    ),
)
def _(spark, sf):
    return digest(edits.reject_all_suggestions(fx.library(spark, sf)))


@register(
    "m05_delete_persons",
    digest_sql(
        photos=_pending("person_id IN (2, 5)"),
        persons="SELECT * FROM persons WHERE person_id NOT IN (2, 5)",
        faces=_faces(person_id="CASE WHEN person_id IN (2, 5) THEN NULL ELSE person_id END", name="CASE WHEN person_id IN (2, 5) THEN NULL ELSE name END"),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.delete_persons(lib, lib.persons.filter("person_id IN (2, 5, 900)").select("person_id")))


_RENAME = "CASE WHEN person_id < 5 THEN 'N' || CAST(person_id AS VARCHAR) ELSE name END"


@register(
    "m10_rename_persons",
    digest_sql(
        photos=_pending("person_id < 5 AND name IS NOT NULL"),
        persons=f"SELECT * REPLACE ({_RENAME} AS name) FROM persons",
        faces=_faces(name="CASE WHEN name IS NOT NULL AND person_id < 5 THEN 'N' || CAST(person_id AS VARCHAR) ELSE name END"),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    wanted = lib.persons.filter("person_id < 5").select("person_id", F.concat(F.lit("N"), "person_id").alias("new_name"))
    return digest(edits.rename_persons(lib, wanted))


def _name_requests(lib):
    return lib.persons.filter("name IS NULL").select("person_id", F.concat(F.lit("N"), "person_id").alias("new_name"))


_NAMED_PERSONS = "SELECT * REPLACE (CASE WHEN name IS NULL THEN 'N' || CAST(person_id AS VARCHAR) ELSE name END AS name) FROM persons"


@register("m11_name_suggestions", digest_sql(persons=_NAMED_PERSONS))
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.name_suggestions(lib, _name_requests(lib), refresh=False))


@register(
    "m11_name_suggestions_confirmed",
    digest_sql(
        photos=_pending("person_id > 6"), persons=_NAMED_PERSONS,
        faces=_faces(name="CASE WHEN person_id > 6 AND NOT ignored THEN 'N' || CAST(person_id AS VARCHAR) ELSE name END"),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.name_suggestions(lib, _name_requests(lib), confirm=True, refresh=False))


def _merges(lib):
    return lib.persons.filter("person_id IN (4, 8, 9)").selectExpr(
        "person_id AS source_id", "CAST(CASE WHEN person_id = 9 THEN 7 ELSE 1 END AS BIGINT) AS winner_id"
    )


_MERGED_FACES = dict(person_id="CASE WHEN person_id IN (4, 8) THEN 1 ELSE person_id END")


@register(
    "m12_merge_persons",
    digest_sql(
        photos=_pending("name IS NOT NULL AND person_id IN (1, 4, 8)"),
        persons="SELECT * FROM persons WHERE person_id NOT IN (4, 8)",
        faces=_faces(**_MERGED_FACES, name="CASE WHEN person_id IN (1, 4, 8) AND name IS NOT NULL THEN 'P1' ELSE name END"),
    ),
)
def _(spark, sf):
    """4 and 8 go to 1; the merge of 9 into the unnamed 7 is refused."""
    lib = fx.library(spark, sf)
    return digest(edits.merge_persons(lib, _merges(lib), refresh=False))


@register(
    "m12_merge_persons_confirmed",
    digest_sql(
        photos=_pending("NOT ignored AND person_id IN (1, 4, 8)"),
        persons="SELECT * FROM persons WHERE person_id NOT IN (4, 8)",
        faces=_faces(**_MERGED_FACES, name="CASE WHEN person_id IN (1, 4, 8) AND NOT ignored THEN 'P1' ELSE name END"),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.merge_persons(lib, _merges(lib), confirm=True, refresh=False))


@register(
    "m12_merge_persons_strict",
    digest_sql(
        photos=_pending("name IS NOT NULL AND person_id IN (1, 4, 8)"),
        persons="SELECT * FROM persons WHERE person_id NOT IN (4, 8)",
        faces=_faces(**_MERGED_FACES),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.merge_persons(lib, _merges(lib), strict_reference=True, refresh=False))


_WANTED_SQL = """wanted AS (SELECT person_id, CASE WHEN person_id = 3 THEN '' WHEN person_id < 3 THEN 'P' || CAST(person_id + 1 AS VARCHAR)
  ELSE 'Z' || CAST(person_id AS VARCHAR) END AS new_name FROM persons)"""


@register(
    "m13_rename_conflicts",
    sql(
        """SELECT w.person_id AS request_id, p.person_id, (SELECT count(*) FROM visible v WHERE v.person_id = p.person_id AND NOT v.ignored) AS visible_count
        FROM wanted w JOIN persons p ON p.name = w.new_name AND p.person_id <> w.person_id
        WHERE w.new_name <> '' AND EXISTS (SELECT 1 FROM visible v WHERE v.person_id = p.person_id AND NOT v.ignored)""",
        "persons", "visible", extra=_WANTED_SQL,
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return edits.rename_or_conflict(lib, _wanted(lib), FOLDERS)[1].select("request_id", "person_id", "visible_count")


def _wanted(lib):
    return lib.persons.selectExpr(
        "person_id",
        """CASE WHEN person_id = 3 THEN '  ' WHEN person_id < 3 THEN concat(' P', person_id + 1, ' ') ELSE concat('Z', person_id) END AS new_name""",
    )


@register(
    "m13_rename_without_conflict",
    sql("SELECT person_id, CASE WHEN person_id > 3 THEN 'Z' || CAST(person_id AS VARCHAR) ELSE name END AS name FROM persons", "persons"),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return edits.rename_or_conflict(lib, _wanted(lib), FOLDERS)[0].persons.select("person_id", "name")


# --- folders and resets --------------------------------------------------------------------------------


@register(
    "m14_split_by_visibility",
    sql(
        f"""SELECT f.face_id, f.person_id IS NOT NULL AND NOT s.inside AND m.person_id IS NOT NULL AS moved, p.name
        FROM faces f JOIN (SELECT face_id, folder IN {FOLDERS_SQL} AS inside FROM faces JOIN photos USING (photo_id)) s USING (face_id)
        LEFT JOIN persons p ON p.person_id = f.person_id
        LEFT JOIN (SELECT person_id FROM faces JOIN photos USING (photo_id) WHERE person_id IS NOT NULL GROUP BY person_id
          HAVING bool_or(folder IN {FOLDERS_SQL}) AND NOT bool_and(folder IN {FOLDERS_SQL})) m ON m.person_id = f.person_id""",
        "photos", "faces", "persons",
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    after = edits.split_by_visibility(lib, FOLDERS)
    names = after.persons.select("person_id", F.col("name").alias("owner"))
    return after.faces.select("face_id", "person_id").join(names, "person_id", "left").select(
        "face_id", F.coalesce(F.col("person_id") > 1000, F.lit(False)).alias("moved"), F.col("owner").alias("name")
    )


@register(
    "m15_purge_outside",
    _ordered_digest_sql(
        photos=f"SELECT * FROM photos WHERE folder IN {FOLDERS_SQL}",
        faces=f"SELECT * FROM faces WHERE photo_id IN (SELECT photo_id FROM photos WHERE folder IN {FOLDERS_SQL})",
        persons=_PRUNED.format(keep="false"),
    ),
)
def _(spark, sf):
    return digest(edits.purge_outside(fx.library(spark, sf), FOLDERS)[0])


@register("m15_purged_count", sql(f"SELECT count(*) AS removed FROM photos WHERE folder NOT IN {FOLDERS_SQL}", "photos"))
def _(spark, sf):
    return edits.purge_outside(fx.library(spark, sf), FOLDERS)[1]


@register(
    "m16_reset_photos",
    digest_sql(
        photos="SELECT * REPLACE (CASE WHEN photo_id % 4 = 0 THEN 0 ELSE stage END AS stage) FROM photos",
        faces="SELECT * FROM faces WHERE photo_id % 4 <> 0",
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.reset_photos(lib, lib.photos.filter("photo_id % 4 = 0").select("photo_id")))


@register(
    "m16_reset_folders",
    _ordered_digest_sql(
        photos=f"SELECT * REPLACE (CASE WHEN folder IN {FOLDERS_SQL} THEN 1 ELSE stage END AS stage) FROM photos",
        faces=f"SELECT * FROM faces WHERE photo_id NOT IN (SELECT photo_id FROM photos WHERE folder IN {FOLDERS_SQL})",
        persons=_PRUNED.format(keep="false"),
    ),
)
def _(spark, sf):
    return digest(edits.reset_folders(fx.library(spark, sf), FOLDERS))


@register(
    "m16_reset_everything",
    digest_sql(
        photos="SELECT * REPLACE (0 AS stage) FROM photos", persons="SELECT * FROM persons WHERE false", faces="SELECT * FROM faces WHERE false"
    ),
)
def _(spark, sf):
    return digest(edits.reset_everything(fx.library(spark, sf)))


_STALE = "photo_id NOT IN (SELECT photo_id FROM faces WHERE name IS NOT NULL AND NOT ignored)"


@register(
    "m17_detector_keep_confirmed",
    _ordered_digest_sql(
        photos=f"SELECT * REPLACE (CASE WHEN {_STALE} THEN 0 ELSE stage END AS stage) FROM photos",
        faces=f"SELECT * FROM faces WHERE NOT ({_STALE})",
        persons=_PRUNED.format(keep="false"),
    ),
)
def _(spark, sf):
    return digest(edits.change_detector(fx.library(spark, sf), "keep_confirmed"))


@register(
    "m18_vector_space_change",
    digest_sql(persons="SELECT * FROM persons WHERE false", faces=_faces(person_id="CAST(NULL AS BIGINT)")),
)
def _(spark, sf):
    return digest(edits.change_vector_space(fx.library(spark, sf)))


@register(
    "m18_reattach_by_name",
    sql("SELECT face_id, CASE WHEN name IS NOT NULL AND NOT ignored THEN name END AS owner FROM faces", "faces"),
)
def _(spark, sf):
    after = edits.reattach_by_name(edits.change_vector_space(fx.library(spark, sf)))
    owners = after.persons.select("person_id", F.col("name").alias("owner"))
    return after.faces.select("face_id", "person_id").join(owners, "person_id", "left").select("face_id", "owner")


# --- point updates and deletes ---------------------------------------------------------------------------


@register(
    "m19_point_updates",
    sql(
        """SELECT photo_id AS id, 'photo' AS tbl, CASE WHEN photo_id % 2 = 0 THEN modified_at + 5 ELSE modified_at END AS v,
          CAST(CASE WHEN photo_id % 3 = 0 THEN 2 * (photo_id % 2) ELSE stage END AS DOUBLE) AS w FROM photos
        UNION ALL SELECT face_id, 'face', CAST(embedding_failed OR face_id % 10 = 3 AS BIGINT), round(CASE WHEN face_id % 10 = 4 THEN coalesce(quality_score, w)*0.667 + w*0.333 ELSE quality_score END, 6) FROM faces
        UNION ALL SELECT person_id, 'person', CASE WHEN person_id % 2 = 0 THEN person_id * 10 END, NULL FROM persons""",
        "photos", "faces", "persons",
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    even = lib.photos.filter("photo_id % 2 = 0").select("photo_id", (F.col("modified_at") + 5).alias("modified_at"))
    lib = edits.patch_photos(lib, even, ["modified_at"])
    flags = lib.photos.filter("photo_id % 3 = 0").select("photo_id", (F.col("photo_id") % 2 == 1).alias("analysed"))
    lib = edits.set_analysed(lib, flags)
    lib = edits.patch_faces(lib, lib.faces.filter("face_id % 10 = 3").select("face_id", F.lit(True).alias("embedding_failed")), ["embedding_failed"])
    better = lib.faces.filter("face_id % 10 = 4").select("face_id", blend_quality(F.col("quality_score"), F.col("region.w")).alias("quality_score"))
    lib = edits.patch_faces(lib, better, ["quality_score"])
    stars = lib.persons.filter("person_id % 2 = 0").select("person_id", (F.col("person_id") * 10).alias("representative_face_id"))
    lib = edits.patch_persons(lib, stars, ["representative_face_id"])
    photos = lib.photos.select(F.col("photo_id").alias("id"), F.lit("photo").alias("tbl"), F.col("modified_at").alias("v"), F.col("stage").cast("double").alias("w"))
    faces = lib.faces.select(
        F.col("face_id").alias("id"), F.lit("face").alias("tbl"), F.col("embedding_failed").cast("bigint").alias("v"), F.round("quality_score", 6).alias("w")
    )
    persons = lib.persons.select(
        F.col("person_id").alias("id"), F.lit("person").alias("tbl"), F.col("representative_face_id").alias("v"), F.lit(None).cast("double").alias("w")
    )
    return photos.unionByName(faces).unionByName(persons)


@register(
    "m20_delete_photos",
    _ordered_digest_sql(
        photos="SELECT * FROM photos WHERE photo_id % 5 <> 0", faces="SELECT * FROM faces WHERE photo_id % 5 <> 0", persons=_PRUNED.format(keep="false")
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.delete_photos(lib, lib.photos.filter("photo_id % 5 = 0").select("photo_id")))


@register(
    "m20_drop_persons",
    digest_sql(
        persons="SELECT * FROM persons WHERE person_id % 2 = 1",
        faces=_faces(person_id="CASE WHEN person_id % 2 = 1 THEN person_id END"),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return digest(edits.drop_persons(lib, lib.persons.filter("person_id % 2 = 0").select("person_id")))


# Above five million photos the moved ids meet present ones, which an upsert replaces and an insert leaves alone.
_PATCH_SQL = """patch AS (SELECT CASE WHEN photo_id % 6 = 1 THEN photo_id + 5000000 ELSE photo_id END AS photo_id FROM photos WHERE photo_id % 6 < 2)"""


@register(
    "s04_upsert",
    sql(
        """SELECT photo_id, folder FROM photos WHERE photo_id NOT IN (SELECT photo_id FROM patch)
        UNION ALL SELECT photo_id, 'moved' FROM patch""",
        "photos", extra=_PATCH_SQL,
    ),
)
def _(spark, sf):
    photos = fx.photos(spark, sf)
    patch = photos.filter("photo_id % 6 < 2").withColumn("folder", F.lit("moved")).withColumn(
        "photo_id", F.expr("CASE WHEN photo_id % 6 = 1 THEN photo_id + 5000000 ELSE photo_id END")
    )
    twice = patch.withColumn("n", F.lit(2)).unionByName(patch.withColumn("folder", F.lit("older")).withColumn("n", F.lit(1)))
    return upsert(photos, latest_per_key(twice, "photo_id", "n"), "photo_id").select("photo_id", "folder")


@register(
    "s04_insert_ignore",
    sql(
        """SELECT photo_id, folder FROM photos
        UNION ALL SELECT photo_id, 'new' FROM patch WHERE photo_id NOT IN (SELECT photo_id FROM photos)""",
        "photos", extra=_PATCH_SQL,
    ),
)
def _(spark, sf):
    photos = fx.photos(spark, sf)
    patch = photos.filter("photo_id % 6 < 2").withColumn("folder", F.lit("new")).withColumn(
        "photo_id", F.expr("CASE WHEN photo_id % 6 = 1 THEN photo_id + 5000000 ELSE photo_id END")
    )
    return insert_ignore(photos, patch, "photo_id").select("photo_id", "folder")


# --- imports, reprocessing, rotation -----------------------------------------------------------------------


def _metadata_regions(spark, sf):
    """Every third face read as a metadata region of its photo."""
    return fx.faces(spark, sf).filter("face_id % 3 = 0").selectExpr(
        "photo_id", "face_id AS position",
        "CASE WHEN face_id % 2 = 0 THEN concat('P', face_id % 9) END AS name",
        "named_struct('x', region.x, 'y', region.y, 'w', region.w, 'h', region.h, 'landmarks', CAST(NULL AS ARRAY<DOUBLE>)) AS region",
    )


_SIZE_QUALITY = "round(0.40*(1/(1+exp(-10.0*(least(greatest(w*h,0.0),1.0)-0.05)))) + 0.35*0.5 + 0.25*0.5, 6)"


@register(
    "m21_import_regions",
    sql(
        f"""SELECT photo_id, owner, q FROM (
          SELECT f.photo_id, coalesce(p.name, 'none') AS owner, round(f.quality_score, 6) AS q FROM faces f LEFT JOIN persons p ON p.person_id = f.person_id
            JOIN photos ph ON ph.photo_id = f.photo_id WHERE ph.stage = 2
          UNION ALL SELECT f.photo_id, CASE WHEN face_id % 2 = 0 THEN 'P' || CAST(face_id % 9 AS VARCHAR) ELSE 'none' END, {_SIZE_QUALITY}
            FROM faces f JOIN photos ph ON ph.photo_id = f.photo_id WHERE face_id % 3 = 0 AND ph.stage <> 2)""",
        "photos", "faces", "persons",
    ),
)
def _(spark, sf):
    after = edits.import_regions(fx.library(spark, sf), _metadata_regions(spark, sf))
    owners = after.persons.select("person_id", F.col("name").alias("owner"))
    return after.faces.select("photo_id", "person_id", "quality_score").join(owners, "person_id", "left").select(
        "photo_id", F.coalesce("owner", F.lit("none")).alias("owner"), F.round("quality_score", 6).alias("q")
    )


@register(
    "m21_import_stages",
    sql(
        """SELECT photo_id, CAST(CASE WHEN stage = 2 THEN 2 WHEN photo_id IN (SELECT photo_id FROM faces WHERE face_id % 3 = 0) THEN 2 ELSE 1 END AS INTEGER) AS stage FROM photos""",
        "photos", "faces",
    ),
)
def _(spark, sf):
    return edits.import_regions(fx.library(spark, sf), _metadata_regions(spark, sf)).photos.select("photo_id", "stage")


_FOUND_SQL = """found AS (SELECT photo_id, face_id, x*800 - w*400 AS px, y*600 - h*300 AS py, w*800 AS pw, h*600 AS ph, CAST(face_id % 7 - 3 AS DOUBLE)/10 AS rot FROM faces)"""


@register(
    "m22_store_detections",
    sql(
        """SELECT photo_id, round((px + pw/2)/800, 6) AS x, round((py + ph/2)/600, 6) AS y,
          round(0.40*(1/(1+exp(-10.0*((pw/800)*(ph/600)-0.05)))) + 0.35*exp(-(rot*rot)/0.245) + 0.25*0.5, 6) AS q FROM found""",
        "faces", extra=_FOUND_SQL,
    ),
)
def _(spark, sf):
    lib, boxes = _detected(spark, sf)
    after = edits.store_detections(lib, boxes, lib.photos.select("photo_id"))
    made = after.faces.filter("face_id > 4000000000")
    return made.select("photo_id", F.round("region.x", 6).alias("x"), F.round("region.y", 6).alias("y"), F.round("quality_score", 6).alias("q"))


@register(
    "m22_detected_photos",
    sql(
        """SELECT photo_id, CAST(2 AS INTEGER) AS stage, CASE WHEN photo_id IN (SELECT photo_id FROM faces) THEN coalesce(taken_at, modified_at // 1000 * 1000) ELSE taken_at END AS taken_at FROM photos""",
        "photos", "faces",
    ),
)
def _(spark, sf):
    lib, boxes = _detected(spark, sf)
    return edits.store_detections(lib, boxes, lib.photos.select("photo_id")).photos.select("photo_id", "stage", "taken_at")


def _detected(spark, sf):
    lib = fx.library(spark, sf)
    boxes = lib.faces.selectExpr(
        "photo_id", "face_id AS position", "region.x*800 - region.w*400 AS x_min", "region.y*600 - region.h*300 AS y_min",
        "region.w*800 AS width", "region.h*600 AS height", "CAST(face_id % 7 - 3 AS DOUBLE)/10 AS rotation",
        "CAST(NULL AS ARRAY<DOUBLE>) AS landmarks", "800 AS image_w", "600 AS image_h",
    )
    return lib, boxes


@register(
    "m23_reprocess_photos",
    _ordered_digest_sql(
        photos="SELECT * REPLACE (CASE WHEN photo_id % 3 = 0 THEN 0 ELSE stage END AS stage) FROM photos WHERE NOT (photo_id % 3 = 0 AND photo_id % 2 = 0)",
        faces="SELECT * FROM faces WHERE photo_id % 3 <> 0",
        persons=_PRUNED.format(keep="person_id NOT IN (SELECT person_id FROM faces WHERE photo_id % 6 = 0 AND person_id IS NOT NULL)"),
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    asked = lib.photos.filter("photo_id % 3 = 0").select("photo_id")
    present = lib.photos.filter("photo_id % 2 = 1").select("path")
    return digest(edits.reprocess_photos(lib, asked, present))


@register(
    "m24_batch_edits",
    _ordered_digest_sql(
        photos="""SELECT * REPLACE (CASE WHEN photo_id % 10 = 4 THEN 0 ELSE stage END AS stage,
          pending_xmp_write OR photo_id IN (SELECT photo_id FROM faces WHERE person_id < 7 AND face_id % 3 = 1) AS pending_xmp_write) FROM photos""",
        faces="""SELECT * REPLACE (CASE WHEN person_id < 7 AND face_id % 3 = 1 THEN 'P' || CAST(person_id AS VARCHAR) ELSE CASE WHEN face_id % 3 = 2 AND face_id % 2 = 0 THEN NULL ELSE name END END AS name,
          CASE WHEN face_id % 3 = 2 AND face_id % 2 = 0 THEN NULL ELSE person_id END AS person_id,
          ignored OR (face_id % 3 = 2 AND face_id % 2 = 0) AS ignored) FROM faces WHERE photo_id % 10 <> 4""",
        persons="SELECT * FROM persons",
    ),
)
def _(spark, sf):
    """Confirm, ignore and re-detect whole selections, one after the other."""
    lib = fx.library(spark, sf)
    chosen = lib.faces.filter("person_id < 7 AND face_id % 3 = 1").select("face_id", "person_id")
    lib = edits.confirm_faces(lib, chosen, refresh=False)
    lib = edits.ignore_faces(lib, lib.faces.filter("face_id % 3 = 2 AND face_id % 2 = 0").select("face_id"), refresh=False)
    return digest(edits.reset_photos(lib, lib.photos.filter("photo_id % 10 = 4").select("photo_id")))


@register(
    "m25_rotate_photos",
    sql(
        """SELECT face_id, round(CASE photo_id % 3 WHEN 0 THEN 1-y WHEN 1 THEN y ELSE x END, 6) AS x, round(CASE photo_id % 3 WHEN 0 THEN x WHEN 1 THEN 1-x ELSE y END, 6) AS y,
          CASE WHEN photo_id % 3 < 2 THEN h ELSE w END AS w FROM faces""",
        "faces",
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    turned, _codes = edits.rotate_photos(lib, _turns(lib))
    return turned.faces.select("face_id", F.round("region.x", 6).alias("x"), F.round("region.y", 6).alias("y"), "region.w")


def _turns(lib):
    return lib.photos.filter("photo_id % 3 < 2").selectExpr(
        "photo_id", "CASE photo_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 8 END AS orientation",
        "CASE WHEN photo_id % 3 = 0 THEN 90 ELSE -90 END AS delta",
    )


@register(
    "m25_orientation_codes",
    sql(
        """SELECT photo_id, CAST(CASE (photo_id % 4 * 90 + CASE WHEN photo_id % 3 = 0 THEN 90 ELSE -90 END + 360) % 360
          WHEN 90 THEN 6 WHEN 180 THEN 3 WHEN 270 THEN 8 ELSE 1 END AS INTEGER) AS orientation FROM photos WHERE photo_id % 3 < 2""",
        "photos",
    ),
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    return edits.rotate_photos(lib, _turns(lib))[1]


@register(
    "m26_reanalyse",
    sql(f"SELECT photo_id, path FROM photos WHERE folder IN {FOLDERS_SQL} OR stage = 1", "photos"),
)
def _(spark, sf):
    return edits.reanalyse(fx.library(spark, sf), FOLDERS)[1]
