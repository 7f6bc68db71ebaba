"""User edits as functions from a library and a table of edits to a new library.

Edit tables are small next to the library: they are joined to it by key, so the
large tables stay where they are. Deletes are followed through all three tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetrics.functions.dates import fill_taken_at
from albumetrics.functions.geometry import normalise_box, rotate_orientation, rotate_region
from albumetrics.functions.quality import region_quality
from albumetrics.operators.boxes import best_overlap
from albumetrics.operators.catalog import normalize_folders
from albumetrics.operators.reads import (
    face_visibility,
    in_folders,
    orphaned_persons,
    photos_without_confirmed,
    visible_namesakes,
)
from albumetrics.operators.representatives import refresh_representatives
from albumetrics.schema import (
    REGION_TYPE,
    STAGE_DONE,
    STAGE_NEEDS_DETECTION,
    STAGE_NEW,
    Library,
    confirmed,
)
from albumetrics.sources.snapshots import first_per_key, patch_columns


def new_person_id(*parts: Column) -> Column:
    """Id of a person made by an edit: a hash of what caused it, far above small ids."""
    return F.xxhash64(F.lit("person"), *parts).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)


def new_face_id(*parts: Column) -> Column:
    return F.xxhash64(F.lit("face"), *parts).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)


# --- shared steps ------------------------------------------------------------------


def set_owner(faces: DataFrame, patch: DataFrame) -> DataFrame:
    """Overwrite person and name of the faces in ``patch(face_id, person_id, name)``."""
    return patch_columns(faces, patch, "face_id", ["person_id", "name"])


def mark_pending(photos: DataFrame, photo_ids: DataFrame) -> DataFrame:
    """Queue photos for a packet write."""
    hits = photo_ids.select("photo_id").distinct().withColumn("_hit", F.lit(True))
    return photos.join(hits, "photo_id", "left").select(
        *[
            F.coalesce("_hit", F.col(c)).alias(c) if c == "pending_xmp_write" else F.col(c)
            for c in photos.columns
        ]
    )


def _flag(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_hit`` telling whether its key is among ``keys``."""
    hits = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(hits, key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _change(df: DataFrame, keys: DataFrame, key: str, extra: Column | None = None, **values: Column) -> DataFrame:
    """Set columns where the key is among ``keys`` (and ``extra`` holds)."""
    hit = F.col("_hit") if extra is None else F.col("_hit") & extra
    return _flag(df, keys, key).select(
        *[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns]
    )


def _null(df: DataFrame, column: str) -> Column:
    return F.lit(None).cast(df.schema[column].dataType)


def prune(persons: DataFrame, faces: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Drop persons without a face: all of them, or only ``touched`` ones."""
    gone = orphaned_persons(persons, faces).select("person_id")
    if touched is not None:
        gone = gone.join(touched.select("person_id"), "person_id", "left_semi")
    return persons.join(gone, "person_id", "left_anti")


def _settle(library: Library, touched: DataFrame, refresh: bool, pruned: bool = True) -> Library:
    """Prune and refresh the persons an edit touched."""
    persons = prune(library.persons, library.faces, touched) if pruned else library.persons
    if refresh:
        persons = refresh_representatives(persons, library.faces, touched)
    return Library(library.photos, persons, library.faces)


def _owners(faces: DataFrame, face_ids: DataFrame) -> DataFrame:
    return (
        faces.join(face_ids.select("face_id"), "face_id", "left_semi")
        .filter("person_id IS NOT NULL").select("person_id").distinct()
    )


def _photos_of(faces: DataFrame, face_ids: DataFrame) -> DataFrame:
    return faces.join(face_ids.select("face_id"), "face_id", "left_semi").select("photo_id")


# --- single faces --------------------------------------------------------------------


def _named_edits(library: Library, edits: DataFrame) -> DataFrame:
    """Edits of known faces to named persons, with the name and the face's photo."""
    named = library.persons.filter("name IS NOT NULL").select("person_id", "name")
    known = library.faces.select("face_id", "photo_id")
    return edits.select("face_id", "person_id").join(named, "person_id").join(known, "face_id")


def confirm_faces(library: Library, edits: DataFrame, refresh: bool = True) -> Library:
    """Confirm faces ``(face_id, person_id)`` to named persons; others are left alone."""
    valid = _named_edits(library, edits)
    changed = Library(
        mark_pending(library.photos, valid), library.persons,
        set_owner(library.faces, valid.select("face_id", "person_id", "name")),
    )
    return _settle(changed, valid.select("person_id").distinct(), refresh, pruned=False)


def assign_faces(library: Library, edits: DataFrame, confirm: bool = True, refresh: bool = True) -> Library:
    """Move faces to existing persons, confirmed or as suggestions."""
    if confirm:
        valid = _named_edits(library, edits)
        faces = set_owner(library.faces, valid.select("face_id", "person_id", "name"))
        photos = mark_pending(library.photos, valid)
    else:
        valid = edits.select("face_id", "person_id").join(library.persons.select("person_id"), "person_id", "left_semi")
        faces = patch_columns(library.faces, valid, "face_id", ["person_id"])
        photos = library.photos
    previous = _owners(library.faces, valid)
    changed = _settle(Library(photos, library.persons, faces), previous, refresh=False)
    if refresh:
        touched = previous.unionByName(valid.select("person_id")).distinct()
        changed = _settle(changed, touched, True, pruned=False)
    return changed


def find_or_create_persons(persons: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons extended by one for each new name, and a ``(name, person_id)`` lookup.

    Of several persons with one name the smallest id is meant.
    """
    wanted = names.select("name").filter("name IS NOT NULL").distinct()
    known = (
        persons.filter("name IS NOT NULL").join(wanted, "name", "left_semi")
        .groupBy("name").agg(F.min("person_id").alias("person_id"))
    )
    made = wanted.join(known, "name", "left_anti").withColumn("person_id", new_person_id(F.lit("name"), F.col("name")))
    grown = persons.unionByName(made.withColumn("representative_face_id", F.lit(None).cast("bigint")))
    return grown, known.unionByName(made.select("name", "person_id"))


def assign_faces_by_name(library: Library, edits: DataFrame, confirm: bool = True, refresh: bool = True) -> Library:
    """Move faces ``(face_id, name)`` to the person of that name, made where there is none."""
    persons, lookup = find_or_create_persons(library.persons, edits)
    resolved = edits.select("face_id", "name").join(lookup, "name").select("face_id", "person_id")
    return assign_faces(Library(library.photos, persons, library.faces), resolved, confirm, refresh)


def remove_from_person(library: Library, face_ids: DataFrame, refresh: bool = True) -> Library:
    owned = library.faces.filter("person_id IS NOT NULL").join(face_ids.select("face_id"), "face_id", "left_semi")
    owners = owned.select("person_id").distinct()
    faces = _change(
        library.faces, owned, "face_id",
        person_id=_null(library.faces, "person_id"), name=_null(library.faces, "name"),
    )
    return _settle(Library(mark_pending(library.photos, owned), library.persons, faces), owners, refresh)


def ignore_faces(library: Library, face_ids: DataFrame, refresh: bool = True) -> Library:
    """Ignore faces: person and name are cleared with it."""
    owners = _owners(library.faces, face_ids)
    faces = _change(
        library.faces, face_ids, "face_id", ignored=F.lit(True),
        person_id=_null(library.faces, "person_id"), name=_null(library.faces, "name"),
    )
    return _settle(Library(library.photos, library.persons, faces), owners, refresh)


def unignore_faces(library: Library, face_ids: DataFrame, refresh: bool = True) -> Library:
    """Un-ignore faces: neither person nor name comes back."""
    owners = _owners(library.faces, face_ids)
    faces = _change(library.faces, face_ids, "face_id", ignored=F.lit(False))
    return _settle(Library(library.photos, library.persons, faces), owners, refresh, pruned=False)


def delete_faces(library: Library, face_ids: DataFrame, refresh: bool = True) -> Library:
    """Delete faces for good; their photos are queued for a packet write and stay done."""
    owners = _owners(library.faces, face_ids)
    photos = mark_pending(library.photos, _photos_of(library.faces, face_ids))
    faces = library.faces.join(face_ids.select("face_id"), "face_id", "left_anti").select(*library.faces.columns)
    return _settle(Library(photos, library.persons, faces), owners, refresh)


# --- persons ---------------------------------------------------------------------------


def reject_suggestions(library: Library, person_ids: DataFrame) -> Library:
    """Detach the faces of unnamed persons and delete those persons."""
    unnamed = library.persons.filter("name IS NULL").join(person_ids.select("person_id"), "person_id", "left_semi")
    faces = _change(library.faces, unnamed, "person_id", person_id=_null(library.faces, "person_id"))
    persons = library.persons.join(unnamed.select("person_id"), "person_id", "left_anti")
    return Library(library.photos, persons, faces)


def remove_unconfirmed(library: Library, person_ids: DataFrame, refresh: bool = True) -> Library:
    faces = _change(
        library.faces, person_ids, "person_id", extra=F.col("name").isNull(), person_id=_null(library.faces, "person_id")
    )
    return _settle(Library(library.photos, library.persons, faces), person_ids, refresh)


def reject_all_suggestions(library: Library) -> Library:
    """Take back every suggestion: unnamed persons, and unconfirmed faces of named ones."""
    unnamed = library.persons.filter("name IS NULL").select("person_id")
    faces = _flag(library.faces, unnamed, "person_id")
    detach = F.col("_hit") | F.col("name").isNull()
    faces = faces.select(
        *[
            F.when(detach, _null(library.faces, c)).otherwise(F.col(c)).alias(c) if c == "person_id" else F.col(c)
            for c in library.faces.columns
        ]
    )
    persons = library.persons.filter("name IS NOT NULL")
    return Library(library.photos, prune(persons, faces), faces)


def delete_persons(library: Library, person_ids: DataFrame) -> Library:
    """Delete persons: faces lose person and name, all their photos are queued."""
    known = person_ids.select("person_id").join(library.persons.select("person_id"), "person_id", "left_semi")
    held = library.faces.join(known, "person_id", "left_semi")
    faces = _change(
        library.faces, known, "person_id",
        person_id=_null(library.faces, "person_id"), name=_null(library.faces, "name"),
    )
    persons = library.persons.join(known, "person_id", "left_anti")
    return Library(mark_pending(library.photos, held), persons, faces)


def rename_persons(library: Library, edits: DataFrame) -> Library:
    """Rename persons ``(person_id, new_name)`` and the faces already confirmed to them."""
    names = edits.select("person_id", F.col("new_name").alias("name"))
    persons = patch_columns(library.persons, names, "person_id", ["name"])
    hits = names.select("person_id", F.col("name").alias("_new"))
    faces = library.faces.join(hits, "person_id", "left").select(
        *[
            F.when(F.col("name").isNotNull(), F.coalesce("_new", "name")).alias(c) if c == "name" else F.col(c)
            for c in library.faces.columns
        ]
    )
    named = library.faces.filter("name IS NOT NULL").join(names.select("person_id"), "person_id", "left_semi")
    return Library(mark_pending(library.photos, named), persons, faces)


def _confirm_all(faces: DataFrame, names: DataFrame, strict_reference: bool) -> DataFrame:
    """Name the faces of ``names(person_id, _new)``.

    Confirming names every face that is not ignored; with ``strict_reference``
    only faces that already have a name are renamed.
    """
    whole = F.col("name").isNotNull() if strict_reference else F.col("name").isNotNull() | ~F.col("ignored")
    return faces.join(names, "person_id", "left").select(
        *[
            F.when(whole & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(c)).alias(c) if c == "name" else F.col(c)
            for c in faces.columns
        ]
    )


def name_suggestions(
    library: Library, edits: DataFrame, confirm: bool = False, strict_reference: bool = False, refresh: bool = True
) -> Library:
    """Give suggestions ``(person_id, new_name)`` a name, and their faces too if confirmed."""
    names = edits.select("person_id", F.col("new_name").alias("name"))
    persons = patch_columns(library.persons, names, "person_id", ["name"])
    faces, photos = library.faces, library.photos
    if confirm:
        faces = _confirm_all(faces, names.select("person_id", F.col("name").alias("_new")), strict_reference)
        photos = mark_pending(photos, library.faces.join(names.select("person_id"), "person_id", "left_semi"))
    return _settle(Library(photos, persons, faces), names.select("person_id"), refresh, pruned=False)


def merge_persons(
    library: Library, edits: DataFrame, confirm: bool = False, strict_reference: bool = False, refresh: bool = True
) -> Library:
    """Merge ``source_id`` into the named ``winner_id``.

    Faces already confirmed take the winner's name; with ``strict_reference``
    they keep the old one unless ``confirm`` is set.
    """
    winners = library.persons.filter("name IS NOT NULL").select(
        F.col("person_id").alias("winner_id"), F.col("name").alias("_new")
    )
    moves = edits.filter("source_id <> winner_id").select("source_id", "winner_id").join(winners, "winner_id")
    sources = moves.select(F.col("source_id").alias("person_id"), F.col("winner_id").alias("_winner"))
    persons = library.persons.join(sources.select("person_id"), "person_id", "left_anti")
    moved = library.faces.join(sources, "person_id", "left").select(
        *[F.coalesce("_winner", "person_id").alias(c) if c == "person_id" else F.col(c) for c in library.faces.columns]
    )
    touched = moves.select(F.col("winner_id").alias("person_id"), "_new").distinct()
    if confirm:
        faces = _confirm_all(moved, touched, strict_reference)
    elif strict_reference:
        faces = moved
    else:
        faces = _confirm_all(moved, touched, True)
    named = faces.filter("name IS NOT NULL").join(touched.select("person_id"), "person_id", "left_semi")
    changed = Library(mark_pending(library.photos, named), persons, faces)
    return _settle(changed, touched.select("person_id"), refresh, pruned=False)


def rename_or_conflict(
    library: Library, edits: DataFrame, folders: list[str], check: bool = True
) -> tuple[Library, DataFrame]:
    """Rename where no visible person has the name already; return the conflicts otherwise.

    Names are trimmed and blank ones ignored. A conflict row names the persons
    that could be merged into. ``check=False`` is the plain rename.
    """
    wanted = edits.select("person_id", F.trim("new_name").alias("new_name")).filter("new_name <> ''")
    if not check:
        return rename_persons(library, edits.select("person_id", "new_name")), wanted.limit(0)
    conflicts = visible_namesakes(library.persons, library.faces, library.photos, folders, wanted)
    blocked = conflicts.select(F.col("request_id").alias("person_id"))
    free = wanted.join(blocked, "person_id", "left_anti")
    return rename_persons(library, free), conflicts


# --- folders, resets -----------------------------------------------------------------------


def split_by_visibility(library: Library, folders: list[str]) -> Library:
    """Persons with both visible and hidden faces: the hidden ones go to a new namesake."""
    if not folders:
        return library
    seen = face_visibility(library.faces, library.photos, folders).filter("person_id IS NOT NULL")
    mixed = (
        seen.groupBy("person_id")
        .agg(F.bool_or("inside").alias("_some"), F.bool_and("inside").alias("_all"))
        .filter("_some AND NOT _all")
        .select("person_id", new_person_id(F.lit("split"), F.col("person_id")).alias("_new"))
    )
    fresh = library.persons.join(mixed, "person_id").select(
        F.col("_new").alias("person_id"), "name", F.lit(None).cast("bigint").alias("representative_face_id")
    )
    hidden = seen.filter("NOT inside").join(mixed, "person_id").select("face_id", F.col("_new").alias("person_id"))
    faces = patch_columns(library.faces, hidden, "face_id", ["person_id"])
    return Library(library.photos, library.persons.unionByName(fresh), faces)


def delete_photos(library: Library, photo_ids: DataFrame, pruned: bool = True) -> Library:
    """Delete photos with their faces, and the persons that are left without one."""
    gone = photo_ids.select("photo_id")
    photos = library.photos.join(gone, "photo_id", "left_anti").select(*library.photos.columns)
    faces = library.faces.join(gone, "photo_id", "left_anti").select(*library.faces.columns)
    persons = prune(library.persons, faces) if pruned else library.persons
    return Library(photos, persons, faces)


def purge_outside(library: Library, folders: list[str], allow_empty: bool = False) -> tuple[Library, DataFrame]:
    """Delete all photos outside the folders; also returns the number removed."""
    if not folders and not allow_empty:
        raise ValueError("an empty folder list would delete every photo; pass allow_empty=True to do that")
    outside = library.photos.filter(~F.col("folder").isin(folders)) if folders else library.photos
    return delete_photos(library, outside), outside.agg(F.count(F.lit(1)).alias("removed"))


def reset_photos(library: Library, photo_ids: DataFrame, stage: int = STAGE_NEW) -> Library:
    """Drop the faces of photos and send the photos back to ``stage``; persons are kept."""
    photos = _change(library.photos, photo_ids, "photo_id", stage=F.lit(stage))
    faces = library.faces.join(photo_ids.select("photo_id"), "photo_id", "left_anti").select(*library.faces.columns)
    return Library(photos, library.persons, faces)


def reset_folders(library: Library, folders: list[str]) -> Library:
    """Re-detect the photos of the folders, sub-folders included; an empty list does nothing."""
    if not folders:
        return library
    photos = normalize_folders(library.photos, folders)
    inside = in_folders(photos, folders).select("photo_id")
    reset = reset_photos(Library(photos, library.persons, library.faces), inside, STAGE_NEEDS_DETECTION)
    return Library(reset.photos, prune(reset.persons, reset.faces), reset.faces)


def reset_everything(library: Library) -> Library:
    photos = library.photos.withColumn("stage", F.lit(STAGE_NEW))
    return Library(photos, library.persons.limit(0), library.faces.limit(0))


def change_detector(library: Library, strategy: str) -> Library:
    """``keep_all``, ``keep_confirmed`` (reset photos without a confirmed face) or ``redetect_all``."""
    if strategy == "keep_all":
        return library
    if strategy == "redetect_all":
        return reset_everything(library)
    if strategy != "keep_confirmed":
        raise ValueError(f"unknown strategy {strategy!r}")
    stale = photos_without_confirmed(library.photos, library.faces).select("photo_id")
    reset = reset_photos(library, stale)
    return Library(reset.photos, prune(reset.persons, reset.faces), reset.faces)


def change_vector_space(library: Library, strategy: str = "recompute_all") -> Library:
    """Drop persons and vectors that belong to another vector space; names stay on the faces."""
    if strategy == "keep":
        return library
    if strategy != "recompute_all":
        raise ValueError(f"unknown strategy {strategy!r}")
    replaced = {
        "person_id": _null(library.faces, "person_id"),
        "embedding": _null(library.faces, "embedding"),
        "embedding_failed": F.lit(False),
    }
    faces = library.faces.select(*[replaced.get(c, F.col(c)).alias(c) for c in library.faces.columns])
    return Library(library.photos, library.persons.limit(0), faces)


def reattach_by_name(library: Library) -> Library:
    """Give named faces without a person the person of that name, made where there is none."""
    loose = library.faces.filter(confirmed() & F.col("person_id").isNull()).select("face_id", "name")
    persons, lookup = find_or_create_persons(library.persons, loose)
    patch = loose.join(lookup, "name").select("face_id", "person_id")
    return Library(library.photos, persons, patch_columns(library.faces, patch, "face_id", ["person_id"]))


def reanalyse(library: Library, folders: list[str]) -> tuple[Library, DataFrame]:
    """Reset the visible folders and return the photos now queued for detection."""
    reset = reset_folders(library, folders)
    return reset, reset.photos.filter(F.col("stage") == STAGE_NEEDS_DETECTION).select("photo_id", "path")


# --- point updates and deletes -------------------------------------------------------------------


def patch_photos(library: Library, patch: DataFrame, columns: list[str]) -> Library:
    return Library(patch_columns(library.photos, patch, "photo_id", columns), library.persons, library.faces)


def patch_persons(library: Library, patch: DataFrame, columns: list[str]) -> Library:
    return Library(library.photos, patch_columns(library.persons, patch, "person_id", columns), library.faces)


def patch_faces(library: Library, patch: DataFrame, columns: list[str]) -> Library:
    return Library(library.photos, library.persons, patch_columns(library.faces, patch, "face_id", columns))


def set_analysed(library: Library, flags: DataFrame) -> Library:
    """``(photo_id, analysed)``: true means done, false means new."""
    stage = F.when(F.col("analysed"), STAGE_DONE).otherwise(STAGE_NEW)
    return patch_photos(library, flags.select("photo_id", stage.alias("stage")), ["stage"])


def drop_persons(library: Library, person_ids: DataFrame) -> Library:
    """Delete person rows; their faces keep their name but lose the person."""
    gone = person_ids.select("person_id").distinct()
    faces = _change(library.faces, gone, "person_id", person_id=_null(library.faces, "person_id"))
    return Library(library.photos, library.persons.join(gone, "person_id", "left_anti"), faces)


def reprocess_photos(library: Library, photo_ids: DataFrame, present: DataFrame) -> Library:
    """Send photos back to the start, or delete those whose path is not ``present``."""
    asked = library.photos.join(photo_ids.select("photo_id"), "photo_id", "left_semi").select("photo_id", "path")
    gone = asked.join(present.select("path"), "path", "left_anti")
    again = asked.join(present.select("path"), "path", "left_semi")
    cleared = delete_photos(library, gone, pruned=False)
    reset = reset_photos(cleared, again)
    lost = library.faces.join(gone.select("photo_id"), "photo_id", "left_semi").select("person_id").distinct()
    return Library(reset.photos, prune(reset.persons, reset.faces, lost), reset.faces)


# --- imports ---------------------------------------------------------------------------------------


def import_regions(library: Library, regions: DataFrame, detections: DataFrame | None = None) -> Library:
    """Import metadata regions ``(photo_id, position, name, region)`` of photos not yet done.

    A named region belongs to the person of that name and counts as confirmed.
    Landmarks come from the overlapping detection, if any. Photos with regions
    become done, the others wait for detection.
    """
    todo = library.photos.filter(F.col("stage") != STAGE_DONE).select("photo_id")
    found = regions.join(todo, "photo_id", "left_semi").withColumn(
        "face_id", new_face_id(F.col("photo_id"), F.lit("region"), F.col("position"))
    )
    if detections is not None:
        asked = found.select(F.col("face_id").alias("region_id"), "photo_id", "region")
        marks = best_overlap(asked, detections).select(F.col("region_id").alias("face_id"), F.col("landmarks").alias("_marks"))
        found = found.join(marks, "face_id", "left").withColumn(
            "region",
            F.struct(*[F.col(f"region.{c}").alias(c) for c in "xywh"], F.coalesce("_marks", "region.landmarks").alias("landmarks")),
        )
    persons, lookup = find_or_create_persons(library.persons, found)
    made = found.join(lookup, "name", "left").select(
        "face_id", "photo_id", "person_id", "name", F.col("region").cast(REGION_TYPE).alias("region"),
        F.lit(None).cast("array<double>").alias("embedding"), F.lit(False).alias("ignored"),
        region_quality(F.col("region.w"), F.col("region.h")).alias("quality_score"), F.lit(False).alias("embedding_failed"),
    )
    kept = library.faces.join(todo, "photo_id", "left_anti").select(*library.faces.columns)
    photos = _change(library.photos, todo, "photo_id", stage=F.lit(STAGE_NEEDS_DETECTION))
    photos = _change(photos, found.select("photo_id"), "photo_id", stage=F.lit(STAGE_DONE))
    return Library(photos, persons, kept.unionByName(made))


def store_detections(library: Library, detections: DataFrame, attempted: DataFrame, fill_dates: bool = True) -> Library:
    """Store detector boxes as unnamed faces; every attempted photo is done, failed ones too.

    ``detections``: photo_id, x_min, y_min, width, height, rotation, landmarks,
    image_w, image_h in pixels, and position.
    """
    box = normalise_box(*[F.col(c) for c in ("x_min", "y_min", "width", "height", "landmarks", "image_w", "image_h")])
    sized = detections.withColumn("region", box)
    made = sized.select(
        new_face_id(F.col("photo_id"), F.lit("detected"), F.col("position")).alias("face_id"), "photo_id",
        _null(library.faces, "person_id").alias("person_id"), _null(library.faces, "name").alias("name"),
        F.col("region").cast(REGION_TYPE).alias("region"), F.lit(None).cast("array<double>").alias("embedding"),
        F.lit(False).alias("ignored"),
        region_quality(F.col("region.w"), F.col("region.h"), F.col("rotation")).alias("quality_score"),
        F.lit(False).alias("embedding_failed"),
    )
    photos = _change(library.photos, attempted, "photo_id", stage=F.lit(STAGE_DONE))
    filled = fill_taken_at(F.col("taken_at"), F.col("modified_at"), fill_dates)
    photos = _change(photos, detections, "photo_id", taken_at=filled)
    # Ids come from photo and position, so storing the same boxes again replaces them.
    kept = library.faces.join(made.select("face_id"), "face_id", "left_anti").select(*library.faces.columns)
    return Library(photos, library.persons, kept.unionByName(made))


def rotate_photos(library: Library, turns: DataFrame) -> tuple[Library, DataFrame]:
    """Turn photos ``(photo_id, orientation, delta)``: boxes turn along, new codes are returned."""
    one = first_per_key(turns, "photo_id", F.col("delta"))
    codes = one.select("photo_id", rotate_orientation(F.col("orientation"), F.col("delta")).alias("orientation"))
    hits = one.select("photo_id", F.col("delta").alias("_delta"))
    faces = library.faces.join(hits, "photo_id", "left").select(
        *[
            F.when(F.col("_delta").isNotNull(), rotate_region(F.col("region"), F.col("_delta"))).otherwise(F.col(c)).alias(c)
            if c == "region" else F.col(c)
            for c in library.faces.columns
        ]
    )
    return Library(library.photos, library.persons, faces), codes
