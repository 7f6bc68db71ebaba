"""The library tables derived from the given parquet tables, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumetrics.schema import Library

FOLDERS = ["DCIM/Camera", "Pictures"]
FOLDERS_SQL = "('DCIM/Camera', 'Pictures')"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """One row per media file, as an indexer would list it."""
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "concat('/media/', event_id, '.jpg') AS path",
        """CASE event_type WHEN 'click' THEN 'DCIM/Camera/' WHEN 'view' THEN 'DCIM/Camera/2024/'
             WHEN 'purchase' THEN 'Pictures/' WHEN 'signup' THEN 'Pictures/Trips/'
             ELSE 'Download/' END AS rel_path""",
        "CASE WHEN event_id % 41 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime_type",
        "1700000000000 + event_id*1000 + CASE WHEN event_id % 13 = 0 THEN 500 ELSE 0 END AS modified_at",
        """CASE WHEN event_id % 17 = 0 THEN NULL
             ELSE 1104537600000 + ((event_id*37) % 1000)*604800000 END AS taken_at""",
    )


def photos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS photo_id",
        "concat('/media/', event_id, '.jpg') AS path",
        """CASE event_type WHEN 'click' THEN 'DCIM/Camera' WHEN 'view' THEN 'DCIM/Camera'
             WHEN 'purchase' THEN 'Pictures' WHEN 'signup' THEN 'Pictures'
             ELSE 'Download' END AS folder""",
        "1700000000000 + event_id*1000 AS modified_at",
        """CASE WHEN event_id % 17 = 0 THEN NULL
             ELSE 1104537600000 + ((event_id*37) % 1000)*604800000 END AS taken_at""",
        "CAST(event_id % 3 AS INT) AS stage",
        "event_id % 29 = 0 AS pending_xmp_write",
    )


_FACE_COLUMNS = [
    "vec_id AS face_id",
    "(vec_id % 250)*2 AS photo_id",
    "CASE WHEN vec_id % 5 = 0 OR vec_id % 23 = 0 THEN NULL ELSE CAST(label AS BIGINT) END AS person_id",
    """CASE WHEN vec_id % 5 <> 0 AND vec_id % 23 <> 0 AND label < 7 AND vec_id % 3 = 0
         THEN concat('P', label) END AS name""",
    """named_struct('x', 0.1D + (vec_id % 8)/10.0D, 'y', 0.15D + (vec_id % 7)/10.0D,
         'w', 0.05D + (vec_id % 5)/50.0D, 'h', 0.08D + (vec_id % 6)/50.0D,
         'landmarks', CASE WHEN vec_id % 4 = 0 THEN
            transform(sequence(0, 9), i -> 0.05D + (vec_id % 9)/20.0D + i/100.0D) END) AS region""",
]


def faces(spark: SparkSession, sf: str, planted: bool = True) -> DataFrame:
    vector = (
        "transform(CAST(embedding AS ARRAY<DOUBLE>), (x,i) -> x + CASE WHEN i = label THEN 2.0D ELSE 0.0D END)"
        if planted
        else "CAST(embedding AS ARRAY<DOUBLE>)"
    )
    return table(spark, sf, "embeddings").selectExpr(
        *_FACE_COLUMNS,
        f"CASE WHEN vec_id % 37 = 0 THEN NULL ELSE {vector} END AS embedding",
        "vec_id % 23 = 0 AS ignored",
        "CASE WHEN vec_id % 19 = 0 THEN NULL ELSE CAST(vec_id % 10 AS DOUBLE)/10 END AS quality_score",
        "vec_id % 74 = 0 AS embedding_failed",
    )


def persons(spark: SparkSession, sf: str) -> DataFrame:
    """Labels 7..9 are unnamed suggestions; person 90 has no face."""
    labels = table(spark, sf, "embeddings").select("label").distinct()
    known = labels.selectExpr(
        "CAST(label AS BIGINT) AS person_id",
        "CASE WHEN label < 7 THEN concat('P', label) END AS name",
        "CAST(NULL AS BIGINT) AS representative_face_id",
    )
    empty = labels.filter("label = 0").selectExpr(
        "CAST(90 AS BIGINT) AS person_id", "'Empty' AS name", "CAST(NULL AS BIGINT) AS representative_face_id"
    )
    return known.unionByName(empty)


def library(spark: SparkSession, sf: str, planted: bool = True) -> Library:
    return Library(photos(spark, sf), persons(spark, sf), faces(spark, sf, planted))


def raw_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )


# --- the same views as text for the SQL side -------------------------------

_CTES = {
    "catalogue": """
    SELECT event_id, '/media/' || CAST(event_id AS VARCHAR) || '.jpg' AS path,
      CASE event_type WHEN 'click' THEN 'DCIM/Camera/' WHEN 'view' THEN 'DCIM/Camera/2024/'
        WHEN 'purchase' THEN 'Pictures/' WHEN 'signup' THEN 'Pictures/Trips/' ELSE 'Download/' END AS rel_path,
      CASE WHEN event_id % 41 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime_type,
      1700000000000 + event_id*1000 + CASE WHEN event_id % 13 = 0 THEN 500 ELSE 0 END AS modified_at,
      CASE WHEN event_id % 17 = 0 THEN NULL
        ELSE 1104537600000 + ((event_id*37) % 1000)*604800000 END AS taken_at
    FROM events""",
    "photos": """
    SELECT event_id AS photo_id, '/media/' || CAST(event_id AS VARCHAR) || '.jpg' AS path,
      CASE event_type WHEN 'click' THEN 'DCIM/Camera' WHEN 'view' THEN 'DCIM/Camera'
        WHEN 'purchase' THEN 'Pictures' WHEN 'signup' THEN 'Pictures' ELSE 'Download' END AS folder,
      1700000000000 + event_id*1000 AS modified_at,
      CASE WHEN event_id % 17 = 0 THEN NULL
        ELSE 1104537600000 + ((event_id*37) % 1000)*604800000 END AS taken_at,
      CAST(event_id % 3 AS INTEGER) AS stage, event_id % 29 = 0 AS pending_xmp_write
    FROM events""",
    "faces": """
    SELECT vec_id AS face_id, (vec_id % 250)*2 AS photo_id,
      CASE WHEN vec_id % 5 = 0 OR vec_id % 23 = 0 THEN NULL ELSE CAST(label AS BIGINT) END AS person_id,
      CASE WHEN vec_id % 5 <> 0 AND vec_id % 23 <> 0 AND label < 7 AND vec_id % 3 = 0
        THEN 'P' || CAST(label AS VARCHAR) END AS name,
      CAST(0.1 AS DOUBLE) + CAST(vec_id % 8 AS DOUBLE)/10 AS x,
      CAST(0.15 AS DOUBLE) + CAST(vec_id % 7 AS DOUBLE)/10 AS y,
      CAST(0.05 AS DOUBLE) + CAST(vec_id % 5 AS DOUBLE)/50 AS w,
      CAST(0.08 AS DOUBLE) + CAST(vec_id % 6 AS DOUBLE)/50 AS h,
      CASE WHEN vec_id % 4 = 0 THEN list_transform(range(0, 10), lambda i:
        CAST(0.05 AS DOUBLE) + CAST(vec_id % 9 AS DOUBLE)/20 + CAST(i AS DOUBLE)/100) END AS landmarks,
      CASE WHEN vec_id % 37 = 0 THEN NULL ELSE list_transform(CAST(embedding AS DOUBLE[]),
        lambda v, i: v + CASE WHEN i - 1 = label THEN 2.0 ELSE 0.0 END) END AS embedding,
      vec_id % 23 = 0 AS ignored,
      CASE WHEN vec_id % 19 = 0 THEN NULL ELSE CAST(vec_id % 10 AS DOUBLE)/10 END AS quality_score,
      vec_id % 74 = 0 AS embedding_failed
    FROM embeddings""",
    "persons": """
    SELECT DISTINCT CAST(label AS BIGINT) AS person_id, CASE WHEN label < 7 THEN 'P' || CAST(label AS VARCHAR) END AS name
    FROM embeddings
    UNION ALL SELECT DISTINCT CAST(90 AS BIGINT) AS person_id, 'Empty' AS name FROM embeddings WHERE label = 0""",
    "visible": f"""
    SELECT f.*, ph.taken_at, ph.folder FROM faces f JOIN photos ph USING (photo_id)
    WHERE ph.folder IN {FOLDERS_SQL}""",
}

COSD = (
    "CASE WHEN sqrt(list_dot_product({a},{a}))*sqrt(list_dot_product({b},{b})) < 1e-10 THEN 1.0 "
    "ELSE 1.0 - list_dot_product({a},{b})/(sqrt(list_dot_product({a},{a}))*sqrt(list_dot_product({b},{b}))) END"
)


def cosd(a: str, b: str) -> str:
    return COSD.format(a=a, b=b)


def penalty(a: str, b: str, weight: float, ref: float) -> str:
    if weight <= 0:
        return "0.0"
    years = f"(abs(CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)) / 31557600000.0)"
    raw = f"{ref} * (1 - exp(-(0.6931/3.0) * {years})) * {weight}"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 ELSE least(greatest({raw}, 0.0), {ref}) END"


def bonus(a: str, b: str, weight: float) -> str:
    if weight <= 0:
        return "0.0"
    years = f"((CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)) / 31557600000.0)"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} <= 0 OR {b} <= 0 THEN 0.0 "
        f"ELSE 0.15 * {weight} * exp(-({years}*{years})/18.0) END"
    )


def sql(body: str, *views: str, extra: str = "") -> str:
    """Prefix ``body`` with the named views as common table expressions."""
    wanted = list(views)
    if "visible" in wanted:
        for base in ("photos", "faces"):
            if base not in wanted:
                wanted.insert(0, base)
        wanted.remove("visible")
        wanted.append("visible")
    parts = [f"{name} AS ({_CTES[name]})" for name in wanted]
    if extra:
        parts.append(extra)
    prefix = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return prefix + body
