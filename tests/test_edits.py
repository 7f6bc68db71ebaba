"""Edits: references stay whole, and the rules SQL tests do not reach."""

import pytest
from pyspark.sql import functions as F

from albumetrics.operators import edits
from albumetrics.plans.resolve import ResolveConfig, resolve
from albumetrics.schema import FACES_DDL, PERSONS_DDL, PHOTOS_DDL, Library

FOLDERS = ["A", "B"]


@pytest.fixture(scope="module")
def lib(spark):
    photos = [(i, f"/{i}.jpg", "AB"[i % 2] if i < 6 else "C", 1000 + i, None if i == 3 else i, i % 3, False) for i in range(9)]
    persons = [(1, "Ann", None), (2, "Bo", None), (3, None, None), (4, "Ann", None)]
    faces = [
        (10, 0, 1, "Ann", None, [1.0, 0.0], False, 0.9, False), (11, 1, 1, None, None, [0.9, 0.1], False, None, False),
        (12, 2, 2, "Bo", None, [0.0, 1.0], False, 0.5, False), (13, 7, 2, None, None, None, False, None, False),
        (14, 3, 3, None, None, [0.5, 0.5], False, None, False), (15, 4, None, None, None, [0.0, 0.9], False, None, False),
        (16, 5, None, None, None, None, True, None, False), (17, 8, 4, "Ann", None, [1.0, 0.0], False, None, False),
    ]
    return Library(
        spark.createDataFrame(photos, PHOTOS_DDL), spark.createDataFrame(persons, PERSONS_DDL), spark.createDataFrame(faces, FACES_DDL)
    )


def ids(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], f"{column} bigint")


def pairs(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def whole(library):
    """No face without its photo, none with an unknown person, ids unique."""
    faces, persons, photos = library.faces, library.persons, library.photos
    assert faces.join(photos, "photo_id", "left_anti").count() == 0
    assert faces.filter("person_id IS NOT NULL").join(persons, "person_id", "left_anti").count() == 0
    for df, key in ((faces, "face_id"), (persons, "person_id"), (photos, "photo_id")):
        assert df.count() == df.select(key).distinct().count()


def faces_of(library):
    return {r.face_id: (r.person_id, r.name) for r in library.faces.collect()}


def test_every_edit_keeps_references_whole(spark, lib):
    face, person, photo = (lambda *v, c=c: ids(spark, c, *v) for c in ("face_id", "person_id", "photo_id"))
    assign = pairs(spark, "face_id bigint, person_id bigint", (15, 2), (11, 4), (99, 1), (14, 77))
    results = [
        edits.confirm_faces(lib, assign), edits.assign_faces(lib, assign), edits.assign_faces(lib, assign, confirm=False),
        edits.assign_faces_by_name(lib, pairs(spark, "face_id bigint, name string", (15, "New"), (14, "Bo"))),
        edits.remove_from_person(lib, face(14, 12)), edits.ignore_faces(lib, face(14)), edits.unignore_faces(lib, face(16)),
        edits.delete_faces(lib, face(14, 17)), edits.reject_suggestions(lib, person(1, 3)), edits.remove_unconfirmed(lib, person(1, 2, 3)),
        edits.reject_all_suggestions(lib), edits.delete_persons(lib, person(1, 3)),
        edits.merge_persons(lib, pairs(spark, "source_id bigint, winner_id bigint", (4, 1), (3, 1))),
        edits.split_by_visibility(lib, FOLDERS), edits.purge_outside(lib, FOLDERS)[0], edits.reset_photos(lib, photo(0, 3)),
        edits.reset_folders(lib, FOLDERS), edits.reset_everything(lib), edits.change_detector(lib, "keep_confirmed"),
        edits.change_vector_space(lib), edits.reattach_by_name(edits.change_vector_space(lib)), edits.delete_photos(lib, photo(0, 8)),
        edits.drop_persons(lib, person(1)), edits.reprocess_photos(lib, photo(0, 8), lib.photos.filter("photo_id < 5").select("path")),
    ]
    for result in results:
        whole(result)


def test_representative_follows_a_confirmation(spark, lib):
    after = edits.confirm_faces(lib, pairs(spark, "face_id bigint, person_id bigint", (11, 1)))
    row = after.persons.filter("person_id = 1").first()
    assert row.representative_face_id in (10, 11)
    assert after.persons.filter("person_id = 2").first().representative_face_id is None


def test_unnamed_persons_are_not_confirmed_to(spark, lib):
    after = edits.confirm_faces(lib, pairs(spark, "face_id bigint, person_id bigint", (14, 3)))
    assert faces_of(after) == faces_of(lib)


def test_merge_names_and_the_strict_rule(spark, lib):
    moves = pairs(spark, "source_id bigint, winner_id bigint", (2, 1))
    assert faces_of(edits.merge_persons(lib, moves))[12] == (1, "Ann")
    assert faces_of(edits.merge_persons(lib, moves, strict_reference=True))[12] == (1, "Bo")
    assert faces_of(edits.merge_persons(lib, moves, confirm=True))[13] == (1, "Ann")
    assert faces_of(edits.merge_persons(lib, moves, confirm=True, strict_reference=True))[13] == (1, None)


def test_empty_folder_lists(lib):
    with pytest.raises(ValueError):
        edits.purge_outside(lib, [])
    assert edits.purge_outside(lib, [], allow_empty=True)[0].photos.count() == 0
    assert edits.split_by_visibility(lib, []) is lib and edits.reset_folders(lib, []) is lib


def test_split_is_repeatable(lib):
    once, again = edits.split_by_visibility(lib, FOLDERS), edits.split_by_visibility(lib, FOLDERS)
    assert faces_of(once) == faces_of(again)
    twice = edits.split_by_visibility(once, FOLDERS)
    assert faces_of(twice) == faces_of(once)


def test_renames_trim_and_report_conflicts(spark, lib):
    wanted = pairs(spark, "person_id bigint, new_name string", (2, "  Ann "), (1, "   "), (3, "Cy"))
    after, conflicts = edits.rename_or_conflict(lib, wanted, FOLDERS)
    assert {(r.request_id, r.person_id) for r in conflicts.collect()} == {(2, 1)}
    assert {r.person_id: r.name for r in after.persons.collect()} == {1: "Ann", 2: "Bo", 3: "Cy", 4: "Ann"}


def test_resolve_is_a_function_of_its_input(lib):
    config = ResolveConfig.for_512(time_weight=0.0)
    first, second = resolve(lib, config), resolve(lib, config)
    assert faces_of(first.library) == faces_of(second.library)
    whole(first.library)
    assert faces_of(first.library)[15] == (2, "Bo")


def test_new_clusters_become_suggestions_and_the_cap_dissolves_them(spark, lib):
    rows = [(100 + i, 0, None, None, None, v, False, None, False) for i, v in enumerate([[-1.0, 0.0], [-1.0, 0.05], [0.0, -1.0], [0.05, -1.0], [0.02, -1.0]])]
    grown = Library(lib.photos, lib.persons.filter("person_id <> 3"), lib.faces.filter("face_id <> 14").unionByName(spark.createDataFrame(rows, FACES_DDL)))
    config = ResolveConfig.for_512(time_weight=0.0)
    owners = faces_of(resolve(grown, config).library)
    assert owners[102][0] == owners[103][0] == owners[104][0] is not None
    capped = resolve(grown, ResolveConfig.for_512(time_weight=0.0, max_suggestions=0))
    whole(capped.library)
    assert capped.library.persons.filter(F.col("name").isNull()).count() == 0
