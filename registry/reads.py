"""Catalogue scans, projections, relational joins, counts, lists and folder sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from albumetrics import schema
from albumetrics.functions import paths
from albumetrics.functions.dates import month_key
from albumetrics.operators import catalog, reads
from registry import fixtures as fx
from registry import register
from registry.fixtures import FOLDERS, FOLDERS_SQL, sql

PHOTO_COLS = ["photo_id", "path", "folder", "modified_at", "taken_at", "stage", "pending_xmp_write"]
PHOTO_SQL = ", ".join(PHOTO_COLS)
NARROW_SQL = "face_id, photo_id, person_id, name, ignored, quality_score, embedding_failed"
ROOT_SQL = """CASE WHEN rtrim(rel_path,'/') = 'DCIM/Camera' OR starts_with(rel_path,'DCIM/Camera/') THEN 'DCIM/Camera'
     WHEN rtrim(rel_path,'/') = 'Pictures' OR starts_with(rel_path,'Pictures/') THEN 'Pictures' END"""
SCAN_SQL = f"""scan AS (SELECT * FROM (SELECT path, rel_path, modified_at, taken_at, {ROOT_SQL} AS folder
  FROM catalogue WHERE mime_type = 'image/jpeg') WHERE folder IS NOT NULL)"""
SINCE = 1_700_000_500_000


# --- scans -----------------------------------------------------------------------


@register("s01_catalogue_scan", sql("SELECT path, folder, modified_at FROM scan", "catalogue", extra=SCAN_SQL))
def _(spark, sf):
    return catalog.scan(fx.catalogue(spark, sf), FOLDERS).select("path", "folder", "modified_at")


@register(
    "s02_incremental_scan",
    sql(f"SELECT path, folder, modified_at FROM scan WHERE modified_at > {SINCE}", "catalogue", extra=SCAN_SQL),
)
def _(spark, sf):
    return catalog.scan(fx.catalogue(spark, sf), FOLDERS, SINCE).select("path", "folder", "modified_at")


@register(
    "s03_folder_listing",
    sql(
        """SELECT DISTINCT rtrim(rel_path,'/') AS folder FROM catalogue
        WHERE mime_type = 'image/jpeg' AND trim(rtrim(rel_path,'/')) <> ''""",
        "catalogue",
    ),
)
def _(spark, sf):
    return catalog.folder_listing(fx.catalogue(spark, sf))


# --- projections and filters --------------------------------------------------------


@register(
    "f01_point_lookup",
    sql(
        """SELECT 'path' AS by, photo_id AS id FROM photos WHERE path = '/media/77.jpg'
        UNION ALL SELECT 'id', photo_id FROM photos WHERE photo_id = 78
        UNION ALL SELECT 'name', CAST(min(person_id) AS BIGINT) FROM persons WHERE name = 'P3' GROUP BY name""",
        "photos", "persons",
    ),
)
def _(spark, sf):
    photos, persons = fx.photos(spark, sf), fx.persons(spark, sf)
    by_path = reads.by_column(photos, "path", "/media/77.jpg")
    by_id = reads.by_column(photos, "photo_id", 78)
    by_name = reads.person_by_name(persons, "P3")
    return (
        by_path.select(F.lit("path").alias("by"), F.col("photo_id").alias("id"))
        .unionByName(by_id.select(F.lit("id").alias("by"), F.col("photo_id").alias("id")))
        .unionByName(by_name.select(F.lit("name").alias("by"), F.col("person_id").cast("bigint").alias("id")))
    )


@register("f02_all_photos", sql(f"SELECT {PHOTO_SQL} FROM photos", "photos"))
def _(spark, sf):
    return fx.photos(spark, sf).select(*PHOTO_COLS)


@register("f03_photos_in_folders", sql(f"SELECT {PHOTO_SQL} FROM photos WHERE folder IN {FOLDERS_SQL}", "photos"))
def _(spark, sf):
    return reads.in_folders(fx.photos(spark, sf), FOLDERS).select(*PHOTO_COLS)


@register("f04_photos_by_stage", sql("SELECT stage, count(*) AS n FROM photos WHERE stage = 1 GROUP BY stage", "photos"))
def _(spark, sf):
    rows = reads.by_stage(fx.photos(spark, sf), schema.STAGE_NEEDS_DETECTION)
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@register(
    "f05_named_and_suggestions",
    sql("SELECT person_id, name, CASE WHEN name IS NULL THEN 'suggestion' ELSE 'named' END AS kind FROM persons", "persons"),
)
def _(spark, sf):
    persons = fx.persons(spark, sf)
    named = reads.named_persons(persons).select("person_id", "name", F.lit("named").alias("kind"))
    return named.unionByName(
        reads.suggestions(persons).select("person_id", "name", F.lit("suggestion").alias("kind"))
    )


@register(
    "f06_awaiting_vector",
    sql("SELECT face_id, photo_id FROM faces WHERE embedding IS NULL AND NOT ignored AND NOT embedding_failed", "faces"),
)
def _(spark, sf):
    return fx.faces(spark, sf).filter(schema.awaiting_vector()).select("face_id", "photo_id")


@register(
    "f07_faces_by_photo_and_person",
    sql(
        f"""SELECT 'photo' AS by, {NARROW_SQL} FROM faces WHERE photo_id = 42
        UNION ALL SELECT 'person', {NARROW_SQL} FROM faces WHERE person_id = 3""",
        "faces",
    ),
)
def _(spark, sf):
    faces = reads.narrow_faces(fx.faces(spark, sf))
    return (
        reads.by_column(faces, "photo_id", 42).withColumn("by", F.lit("photo"))
        .unionByName(reads.by_column(faces, "person_id", 3).withColumn("by", F.lit("person")))
    )


@register("f08_narrow_projection", sql(f"SELECT {NARROW_SQL} FROM faces", "faces"))
def _(spark, sf):
    return reads.narrow_faces(fx.faces(spark, sf))


@register(
    "f09_confirmed_split",
    sql(
        """SELECT face_id, CASE WHEN name IS NOT NULL THEN 'confirmed' ELSE 'unconfirmed' END AS label
        FROM faces WHERE person_id = 3 AND NOT ignored""",
        "faces",
    ),
)
def _(spark, sf):
    return reads.split_faces(fx.faces(spark, sf), 3).select("face_id", "label")


@register(
    "f10_name_search",
    sql(
        """SELECT person_id, name, false AS offer_create FROM persons WHERE contains(lower(name), 'p')
        UNION ALL SELECT NULL, 'P', true WHERE NOT EXISTS (FROM persons WHERE lower(name) = 'p')""",
        "persons",
    ),
)
def _(spark, sf):
    return reads.search_names(fx.persons(spark, sf), " P ").select("person_id", "name", "offer_create")


@register(
    "f10_name_search_without_hit",
    sql(
        """SELECT person_id, name, false AS offer_create FROM persons WHERE contains(lower(name), 'zoe')
        UNION ALL SELECT NULL, 'Zoe', true WHERE NOT EXISTS (FROM persons WHERE lower(name) = 'zoe')""",
        "persons",
    ),
)
def _(spark, sf):
    return reads.search_names(fx.persons(spark, sf), "Zoe").select("person_id", "name", "offer_create")


@register(
    "f11_whitelist_root",
    sql("SELECT folder, count(*) AS n, count(DISTINCT rel_path) AS paths FROM scan GROUP BY folder", "catalogue", extra=SCAN_SQL),
)
def _(spark, sf):
    rows = catalog.scan(fx.catalogue(spark, sf), FOLDERS, ordered=False)
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rel_path").alias("paths"))


_CATEGORY_SQL = """CASE
  WHEN folder = 'Android/media' OR starts_with(folder,'Android/media/') OR folder = 'Android/data' OR starts_with(folder,'Android/data/') THEN 'APPS'
  WHEN folder = 'DCIM' OR starts_with(folder,'DCIM/') THEN 'CAMERA'
  WHEN folder = 'Pictures' OR starts_with(folder,'Pictures/') OR folder = 'Download' OR starts_with(folder,'Download/')
    OR folder = 'Downloads' OR starts_with(folder,'Downloads/') THEN 'COMMON' ELSE 'OTHER' END"""

# Document sources and languages give a second, differently nested set of folders.
_FOLDERS_SQL = """folders AS (
  SELECT DISTINCT CASE WHEN doc_id % 6 = 0 THEN 'Android/media' WHEN doc_id % 6 = 1 THEN 'DCIM'
    WHEN doc_id % 6 = 2 THEN 'Pictures' WHEN doc_id % 6 = 3 THEN 'Downloads' WHEN doc_id % 6 = 4 THEN 'PicturesX' ELSE source END
    || CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '/' || lang
    WHEN doc_id % 4 = 2 THEN '/' || lang || '/' || source ELSE '/Camera' END AS folder FROM documents)"""


def _doc_folders(spark, sf):
    return fx.table(spark, sf, "documents").selectExpr(
        """concat(CASE WHEN doc_id % 6 = 0 THEN 'Android/media' WHEN doc_id % 6 = 1 THEN 'DCIM'
        WHEN doc_id % 6 = 2 THEN 'Pictures' WHEN doc_id % 6 = 3 THEN 'Downloads' WHEN doc_id % 6 = 4 THEN 'PicturesX' ELSE source END,
        CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN concat('/', lang)
        WHEN doc_id % 4 = 2 THEN concat('/', lang, '/', source) ELSE '/Camera' END) AS folder"""
    ).distinct()


@register("f12_folder_category", sql(f"SELECT folder, {_CATEGORY_SQL} AS category FROM folders", extra=_FOLDERS_SQL))
def _(spark, sf):
    return _doc_folders(spark, sf).withColumn("category", paths.category(F.col("folder")))


_MINIMAL_SQL = """SELECT folder FROM {t} a WHERE NOT EXISTS (
  SELECT 1 FROM {t} b WHERE starts_with(a.folder, b.folder || '/'))"""


@register(
    "f13_preselect",
    sql(
        _MINIMAL_SQL.format(t="picked"),
        extra=_FOLDERS_SQL
        + """, main AS (SELECT folder FROM folders WHERE folder = 'DCIM/Camera' OR starts_with(folder, 'DCIM/Camera/')),
        picked AS (SELECT folder FROM main UNION ALL SELECT folder FROM folders
          WHERE contains(lower(folder), 'camera') AND NOT EXISTS (SELECT 1 FROM main))""",
    ),
)
def _(spark, sf):
    return paths.preselect(_doc_folders(spark, sf))


# --- joins -----------------------------------------------------------------------------


@register(
    "j01_person_faces_with_date",
    sql("SELECT face_id, photo_id, name, taken_at FROM faces JOIN photos USING (photo_id) WHERE person_id = 3", "photos", "faces"),
)
def _(spark, sf):
    mine = reads.by_column(fx.faces(spark, sf), "person_id", 3)
    return reads.faces_with_date(mine, fx.photos(spark, sf)).select("face_id", "photo_id", "name", "taken_at")


@register(
    "j02_clusterable_with_date",
    sql(
        """SELECT face_id, photo_id, taken_at FROM faces JOIN photos USING (photo_id)
        WHERE person_id IS NULL AND NOT ignored AND embedding IS NOT NULL""",
        "photos", "faces",
    ),
)
def _(spark, sf):
    pool = fx.faces(spark, sf).filter(schema.clusterable())
    return reads.faces_with_date(pool, fx.photos(spark, sf)).select("face_id", "photo_id", "taken_at")


@register(
    "j03_photos_without_confirmed",
    sql(
        """SELECT photo_id FROM photos
        LEFT JOIN (SELECT photo_id, bool_or(name IS NOT NULL AND NOT ignored) AS found FROM faces GROUP BY photo_id) USING (photo_id)
        WHERE found IS NOT TRUE""",
        "photos", "faces",
    ),
)
def _(spark, sf):
    return reads.photos_without_confirmed(fx.photos(spark, sf), fx.faces(spark, sf)).select("photo_id")


@register(
    "j04_person_counts",
    sql(
        """SELECT person_id, person_name AS name, confirmed_count, unconfirmed_count FROM tally
        JOIN (SELECT person_id, name AS person_name FROM persons WHERE name IS NOT NULL) USING (person_id)""",
        "persons", "visible",
        extra="""kinds AS (SELECT person_id, CASE WHEN ignored THEN 2 WHEN name IS NULL THEN 1 ELSE 0 END AS kind FROM visible),
tally AS (SELECT person_id, count(*) FILTER (kind = 0) AS confirmed_count, count(*) FILTER (kind = 1) AS unconfirmed_count
          FROM kinds GROUP BY person_id)""",
    ),
)
def _(spark, sf):
    return reads.person_counts(fx.persons(spark, sf), fx.faces(spark, sf), fx.photos(spark, sf), FOLDERS)


@register(
    "j05_visible_namesakes",
    sql(
        """SELECT request_id, person_id, visible_count
        FROM tally JOIN named USING (person_id) JOIN requests ON requests.digit = named.digit
        WHERE request_id <> person_id""",
        "persons", "visible",
        extra="""tally AS (SELECT person_id, count(*) AS visible_count FROM visible WHERE NOT ignored GROUP BY person_id),
named AS (SELECT person_id, person_id % 3 AS digit FROM persons WHERE name IS NOT NULL),
requests AS (SELECT person_id AS request_id, person_id % 3 AS digit FROM persons)""",
    ),
)
def _(spark, sf):
    persons = fx.persons(spark, sf)
    name = F.concat(F.lit("P"), F.col("person_id") % 3)
    same = persons.withColumn("name", F.when(F.col("name").isNotNull(), name))
    requests = persons.select("person_id", name.alias("new_name"))
    found = reads.visible_namesakes(same, fx.faces(spark, sf), fx.photos(spark, sf), FOLDERS, requests)
    return found.select("request_id", "person_id", "visible_count")


@register(
    "j06_visible_suggestions",
    sql(
        """SELECT person_id, count(*) FILTER (NOT ignored) AS visible_count FROM visible
        SEMI JOIN (SELECT person_id FROM persons WHERE name IS NULL) USING (person_id) GROUP BY person_id""",
        "persons", "visible",
    ),
)
def _(spark, sf):
    return reads.visible_suggestions(fx.persons(spark, sf), fx.faces(spark, sf), fx.photos(spark, sf), FOLDERS)


@register(
    "j07_confirmed_photos",
    sql(
        f"""SELECT photo_id, path, taken_at FROM (FROM photos WHERE folder IN {FOLDERS_SQL})
        SEMI JOIN (FROM faces WHERE person_id = 3 AND NOT ignored AND name IS NOT NULL) USING (photo_id)""",
        "photos", "faces",
    ),
)
def _(spark, sf):
    found = reads.confirmed_photos(fx.photos(spark, sf), fx.faces(spark, sf), 3, FOLDERS)
    return found.select("photo_id", "path", "taken_at")


@register(
    "j08_confirmed_face_by_photo",
    sql("SELECT photo_id, max(face_id) AS face_id FROM faces WHERE person_id = 3 AND name IS NOT NULL AND NOT ignored GROUP BY photo_id", "faces"),
)
def _(spark, sf):
    return reads.confirmed_face_by_photo(fx.faces(spark, sf), 3)


@register(
    "j09_face_visibility",
    sql(f"SELECT face_id, person_id, folder IN {FOLDERS_SQL} AS inside FROM faces JOIN photos USING (photo_id)", "photos", "faces"),
)
def _(spark, sf):
    found = reads.face_visibility(fx.faces(spark, sf), fx.photos(spark, sf), FOLDERS)
    return found.select("face_id", "person_id", "inside")


# A library that has not yet seen every file of the catalogue, and knows some that are gone.
_KNOWN_SQL = """known AS (
  SELECT * FROM photos WHERE photo_id % 7 <> 0
  UNION ALL SELECT photo_id + 1000000000, '/gone' || path, folder, modified_at, taken_at, stage, pending_xmp_write
  FROM photos WHERE photo_id % 50 = 0)"""


def known_photos(spark, sf):
    photos = fx.photos(spark, sf)
    gone = photos.filter("photo_id % 50 = 0").withColumn("photo_id", F.col("photo_id") + 1_000_000_000)
    return photos.filter("photo_id % 7 <> 0").unionByName(
        gone.withColumn("path", F.concat(F.lit("/gone"), "path"))
    )


@register(
    "j10_scan_reconcile",
    sql(
        """SELECT s.path, CASE WHEN k.photo_id IS NULL THEN 'NEW' WHEN k.modified_at <> s.modified_at THEN 'MODIFIED'
          WHEN k.stage = 2 THEN 'UNCHANGED' ELSE 'RESUME' END AS action, s.folder
        FROM scan s LEFT JOIN known k USING (path) WHERE NOT coalesce(k.pending_xmp_write, false)""",
        "catalogue", "photos", extra=SCAN_SQL + ", " + _KNOWN_SQL,
    ),
)
def _(spark, sf):
    entries = catalog.scan(fx.catalogue(spark, sf), FOLDERS, ordered=False)
    return catalog.reconcile(entries, known_photos(spark, sf)).select("path", "action", "folder")


@register(
    "j11_deletion_check",
    sql(
        "SELECT path, photo_id FROM known WHERE path NOT IN (SELECT path FROM catalogue WHERE mime_type = 'image/jpeg')",
        "catalogue", "photos", extra=_KNOWN_SQL,
    ),
)
def _(spark, sf):
    return catalog.missing_paths(known_photos(spark, sf), fx.catalogue(spark, sf)).select("path", "photo_id")


@register(
    "j12_orphaned_persons",
    sql("SELECT person_id, name FROM persons ANTI JOIN faces USING (person_id)", "persons", "faces"),
)
def _(spark, sf):
    return reads.orphaned_persons(fx.persons(spark, sf), fx.faces(spark, sf)).select("person_id", "name")


@register(
    "j14_orphan_artefacts",
    sql(
        """SELECT file_name FROM (SELECT CAST(event_id * 3 AS VARCHAR) || '.webp' AS file_name FROM events)
        WHERE regexp_replace(file_name, '\\.[^.]*$', '') NOT IN (SELECT CAST(face_id AS VARCHAR) FROM faces)""",
        "faces",
    ),
)
def _(spark, sf):
    files = fx.table(spark, sf, "events").select(F.concat(F.col("event_id") * 3, F.lit(".webp")).alias("file_name"))
    return reads.orphan_artefacts(files, fx.faces(spark, sf))


# --- counts ------------------------------------------------------------------------------


@register(
    "a01_suggestion_face_counts",
    sql(
        """SELECT person_id, face_count FROM (SELECT person_id, count(*) AS face_count FROM faces GROUP BY person_id)
        SEMI JOIN (FROM persons WHERE name IS NULL) USING (person_id)""",
        "persons", "faces",
    ),
)
def _(spark, sf):
    return reads.suggestion_face_counts(fx.persons(spark, sf), fx.faces(spark, sf))


@register(
    "a02_pool_counts",
    sql(
        """SELECT count(CASE WHEN person_id IS NULL AND NOT ignored AND NOT embedding_failed THEN 1 END) AS unknown_count,
          count(CASE WHEN ignored THEN 1 END) AS ignored_count FROM visible""",
        "visible",
    ),
)
def _(spark, sf):
    return reads.pool_counts(fx.faces(spark, sf), fx.photos(spark, sf), FOLDERS)


@register("a03_photo_count", sql("SELECT count(*) AS n FROM photos", "photos"))
def _(spark, sf):
    return fx.photos(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@register(
    "a04_overview",
    sql(
        """SELECT 'person' AS kind, CAST(p.person_id AS BIGINT) AS id, p.name,
          count(CASE WHEN v.name IS NOT NULL AND NOT v.ignored THEN 1 END) AS n,
          count(CASE WHEN v.name IS NULL AND NOT v.ignored THEN 1 END) AS m, CAST(NULL AS BIGINT) AS first_face
        FROM persons p JOIN visible v ON v.person_id = p.person_id WHERE p.name IS NOT NULL GROUP BY p.person_id, p.name
        UNION ALL
        SELECT 'suggestion', CAST(p.person_id AS BIGINT), NULL, (SELECT count(*) FROM faces f WHERE f.person_id = p.person_id),
          count(CASE WHEN NOT v.ignored THEN 1 END), (SELECT min(face_id) FROM faces f WHERE f.person_id = p.person_id)
        FROM persons p JOIN visible v ON v.person_id = p.person_id WHERE p.name IS NULL GROUP BY p.person_id
        UNION ALL
        SELECT 'pools', NULL, NULL, count(CASE WHEN person_id IS NULL AND NOT ignored AND NOT embedding_failed THEN 1 END),
          count(CASE WHEN ignored THEN 1 END), NULL FROM visible""",
        "persons", "visible",
    ),
)
def _(spark, sf):
    return reads.overview(fx.persons(spark, sf), fx.faces(spark, sf), fx.photos(spark, sf), FOLDERS)


@register(
    "a13_detection_check",
    sql(
        """SELECT photo_id, CAST(coalesce(e, 0) AS BIGINT) AS expected, CAST(coalesce(g, 0) AS BIGINT) AS found,
          coalesce(e, 0) = coalesce(g, 0) AS ok
        FROM (SELECT photo_id, count(*) AS e FROM faces WHERE NOT ignored GROUP BY photo_id)
        FULL JOIN (SELECT photo_id, count(*) AS g FROM faces WHERE embedding IS NOT NULL GROUP BY photo_id) USING (photo_id)""",
        "faces",
    ),
)
def _(spark, sf):
    faces = fx.faces(spark, sf)
    return reads.detection_check(faces.filter("NOT ignored"), faces.filter("embedding IS NOT NULL"))


@register(
    "a15_affected_photos",
    sql("SELECT DISTINCT photo_id FROM faces WHERE person_id IN (2, 3) AND name IS NOT NULL", "faces"),
)
def _(spark, sf):
    edited = fx.faces(spark, sf).filter(F.col("person_id").isin(2, 3) & F.col("name").isNotNull())
    return edited.select("photo_id").distinct()


@register(
    "a17_folders_per_category",
    sql(f"SELECT category, string_agg(folder, ',' ORDER BY folder) AS folders FROM (SELECT folder, {_CATEGORY_SQL} AS category FROM folders) GROUP BY category", extra=_FOLDERS_SQL),
)
def _(spark, sf):
    return catalog.folders_per_category(_doc_folders(spark, sf))


@register(
    "a17_folder_rows",
    sql(f"SELECT DISTINCT {_CATEGORY_SQL} AS category, folder FROM folders", extra=_FOLDERS_SQL),
)
def _(spark, sf):
    return catalog.folders_by_category(_doc_folders(spark, sf))


# --- lists --------------------------------------------------------------------------------


@register(
    "l01_photos_by_date",
    sql(f"SELECT photo_id, taken_at FROM photos WHERE folder IN {FOLDERS_SQL} ORDER BY taken_at DESC NULLS LAST, photo_id", "photos"),
)
def _(spark, sf):
    return reads.photos_by_date(fx.photos(spark, sf), FOLDERS).select("photo_id", "taken_at")


@register(
    "l02_person_faces",
    sql(
        f"""SELECT {NARROW_SQL}, taken_at FROM (FROM visible WHERE person_id = 3)
        QUALIFY row_number() OVER (ORDER BY if(name IS NULL, 0, 1), -coalesce(taken_at, -9e18), face_id) <= 10000""",
        "visible",
    ),
)
def _(spark, sf):
    return reads.person_faces(fx.faces(spark, sf), fx.photos(spark, sf), 3, FOLDERS)


@register(
    "l03_unknown_faces",
    sql(
        f"""SELECT {NARROW_SQL}, taken_at FROM visible WHERE person_id IS NULL AND NOT ignored AND NOT embedding_failed
        ORDER BY taken_at DESC NULLS LAST, face_id LIMIT 10000""",
        "visible",
    ),
)
def _(spark, sf):
    return reads.unknown_faces(fx.faces(spark, sf), fx.photos(spark, sf), FOLDERS)


_AFTER = 1_400_000_000_000


@register(
    "l03_unknown_page",
    sql(
        f"""SELECT {NARROW_SQL}, taken_at FROM visible WHERE person_id IS NULL AND NOT ignored AND NOT embedding_failed
        AND ((taken_at = {_AFTER} AND face_id > 10) OR taken_at < {_AFTER} OR taken_at IS NULL)
        ORDER BY taken_at DESC NULLS LAST, face_id LIMIT 90""",
        "visible",
    ),
)
def _(spark, sf):
    return reads.unknown_page(fx.faces(spark, sf), fx.photos(spark, sf), FOLDERS, after=(_AFTER, 10))


@register(
    "l04_ignored_faces",
    sql(f"SELECT {NARROW_SQL}, taken_at FROM visible WHERE ignored ORDER BY taken_at DESC NULLS LAST, face_id LIMIT 10000", "visible"),
)
def _(spark, sf):
    return reads.ignored_faces(fx.faces(spark, sf), fx.photos(spark, sf), FOLDERS)


@register("l05_pending_queue", sql("SELECT photo_id, path FROM photos WHERE pending_xmp_write ORDER BY photo_id LIMIT 500", "photos"))
def _(spark, sf):
    pending = fx.photos(spark, sf).filter("pending_xmp_write")
    return pending.orderBy("photo_id").limit(500).select("photo_id", "path")


_MONTH_SQL = """CASE WHEN taken_at IS NULL THEN 'no-date' ELSE
  CAST(year(make_timestamp(taken_at*1000)) AS VARCHAR) || '-' || CAST(month(make_timestamp(taken_at*1000)) AS VARCHAR) END"""


@register(
    "w05_month_headers",
    sql(
        f"""SELECT {_MONTH_SQL} AS month_key, count(*) AS photo_count, max(taken_at) AS newest
        FROM photos WHERE folder IN {FOLDERS_SQL} GROUP BY 1""",
        "photos",
    ),
)
def _(spark, sf):
    return reads.month_headers(reads.in_folders(fx.photos(spark, sf), FOLDERS))


@register(
    "w05_month_list",
    sql(
        f"""SELECT photo_id, month_key, month_key IS DISTINCT FROM lag(month_key) OVER (ORDER BY taken_at DESC NULLS LAST, photo_id) AS starts_month
        FROM (SELECT photo_id, taken_at, {_MONTH_SQL} AS month_key FROM photos WHERE folder IN {FOLDERS_SQL})""",
        "photos",
    ),
)
def _(spark, sf):
    rows = reads.month_list(reads.in_folders(fx.photos(spark, sf), FOLDERS))
    return rows.select("photo_id", "month_key", "starts_month")


@register("e17_month_key", sql(f"SELECT photo_id, {_MONTH_SQL} AS month_key FROM photos", "photos"))
def _(spark, sf):
    return fx.photos(spark, sf).select("photo_id", month_key(F.col("taken_at")).alias("month_key"))


# --- folder sets ------------------------------------------------------------------------------


@register(
    "x01_descendants",
    sql("SELECT a.folder AS folder, b.folder AS ancestor FROM folders a JOIN folders b ON starts_with(a.folder, b.folder || '/')", extra=_FOLDERS_SQL),
)
def _(spark, sf):
    folders = _doc_folders(spark, sf)
    chains = folders.select("folder", F.explode(paths.strict_ancestors(F.col("folder"))).alias("ancestor"))
    return chains.join(folders.select(F.col("folder").alias("ancestor")), "ancestor").filter(
        paths.is_descendant(F.col("folder"), F.col("ancestor"))
    )


@register(
    "x02_covered",
    sql("SELECT folder FROM folders a WHERE EXISTS (SELECT 1 FROM folders b WHERE starts_with(a.folder, b.folder || '/'))", extra=_FOLDERS_SQL),
)
def _(spark, sf):
    return paths.covered(_doc_folders(spark, sf))


@register("x03_minimise", sql(_MINIMAL_SQL.format(t="folders"), extra=_FOLDERS_SQL))
def _(spark, sf):
    return paths.minimise(_doc_folders(spark, sf))


@register(
    "x04_select_deselect",
    sql(
        """SELECT DISTINCT 'select' AS edit, folder FROM (SELECT folder FROM folders WHERE NOT starts_with(folder, 'Pictures/') UNION ALL SELECT 'Pictures')
        UNION ALL SELECT 'deselect', folder FROM folders WHERE folder <> 'Pictures'""",
        extra=_FOLDERS_SQL,
    ),
)
def _(spark, sf):
    folders = _doc_folders(spark, sf)
    chosen = paths.select_folder(folders, "Pictures").withColumn("edit", F.lit("select"))
    return chosen.unionByName(paths.deselect_folder(folders, "Pictures").withColumn("edit", F.lit("deselect")))


@register(
    "x05_known_minus_present",
    sql("SELECT path FROM known EXCEPT SELECT path FROM catalogue", "catalogue", "photos", extra=_KNOWN_SQL),
)
def _(spark, sf):
    known = known_photos(spark, sf).select("path")
    return known.join(fx.catalogue(spark, sf).select("path"), "path", "left_anti").distinct()


@register(
    "x06_normalise_folder",
    sql(
        """SELECT event_id, CASE WHEN f = 'DCIM/Camera' OR starts_with(f, 'DCIM/Camera/') THEN 'DCIM/Camera'
          WHEN f = 'Pictures' OR starts_with(f, 'Pictures/') THEN 'Pictures' ELSE f END AS folder
        FROM (SELECT event_id, rtrim(rel_path, '/') AS f FROM catalogue)""",
        "catalogue",
    ),
)
def _(spark, sf):
    rows = fx.catalogue(spark, sf).select("event_id", paths.trim_slashes(F.col("rel_path")).alias("folder"))
    return catalog.normalize_folders(rows, FOLDERS)
