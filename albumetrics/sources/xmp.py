"""Region metadata packets: reading, writing, person tags and clearing."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Public namespaces and markers of the packet format.
NS = {
    "x": "adobe:ns:meta/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "mwg-rs": "http://www.metadataworkinggroup.com/schemas/regions/",
    "stArea": "http://ns.adobe.com/xmp/sType/Area#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "digiKam": "http://www.digikam.org/ns/1.0/",
    "lr": "http://ns.adobe.com/lightroom/1.0/",
    "Iptc4xmpExt": "http://iptc.org/std/Iptc4xmpExt/2008-02-29/",
}
PACKET_HEADER = b"http://ns.adobe.com/xap/1.0/\x00"
EXTENSION_HEADER = b"http://ns.adobe.com/xmp/extension/\x00"
NOTE = "http://ns.adobe.com/xmp/note/"
# Most bytes in a file segment after its length, and of an extension's data in one.
SEGMENT_BYTES = 65_533
EXTENSION_BYTES = 65_400
# Packets are handed from Python to Spark in pieces of about this many characters.
BATCH_CHARS = 1 << 22
BOM = b"\xef\xbb\xbf"
TAG_PREFIX = "People/"

REGION_LIST = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "w", "h")]])
)
TAG_LISTS = T.StructType(
    [T.StructField(c, T.ArrayType(T.StringType())) for c in ("subject", "tags", "persons", "hierarchy")]
)
_REGION_ARROW = pa.list_(
    pa.struct([("name", pa.string()), *[(c, pa.float64()) for c in ("x", "y", "w", "h")]])
)


def _tag(prefixed: str) -> str:
    prefix, name = prefixed.split(":")
    return f"{{{NS[prefix]}}}{name}"


def _struct(node: ET.Element) -> ET.Element:
    """The element that carries a structure's fields."""
    inner = node.find(_tag("rdf:Description"))
    return node if inner is None else inner


def _value(node: ET.Element | None, name: str) -> str | None:
    """A simple field, written as an attribute or as an element."""
    if node is None:
        return None
    node = _struct(node)
    if _tag(name) in node.attrib:
        return node.attrib[_tag(name)]
    child = node.find(_tag(name))
    return None if child is None else (child.text or "")


def _child(node: ET.Element | None, name: str) -> ET.Element | None:
    return None if node is None else _struct(node).find(_tag(name))


def _number(text: str | None) -> float | None:
    try:
        return None if text is None or "_" in text else float(text)
    except ValueError:
        return None


def _items(root: ET.Element, name: str) -> list[ET.Element]:
    return [li for top in root.iter(_tag(name)) for li in top.iter(_tag("rdf:li"))]


def parse_regions(packet: str | None) -> list[dict]:
    """Face regions of one packet; a broken packet has none, a broken region is skipped."""
    if not packet:
        return []
    try:
        root = ET.fromstring(packet)
    except ET.ParseError:
        return []
    out = []
    for top in root.iter(_tag("mwg-rs:Regions")):
        bag = _child(top, "mwg-rs:RegionList")
        for item in [] if bag is None else [li for box in bag for li in box.findall(_tag("rdf:li"))]:
            holder = item if _value(item, "mwg-rs:Type") is not None else _child(item, "mwg-rs:RegionExtensions")
            kind = _value(holder, "mwg-rs:Type")
            if kind is None or kind.lower() != "face":
                continue
            area = _child(holder, "mwg-rs:Area")
            box = {c: _number(_value(area, f"stArea:{c}")) for c in ("x", "y", "w", "h")}
            if None in box.values():
                continue
            name = _value(holder, "mwg-rs:Name")
            out.append({"name": name if name and name.strip() else None, **box})
    return out


def packet_segments(packet: str) -> list[bytes]:
    """Bodies of the file segments that hold a packet: one, or a short main packet and its extensions.

    A packet that does not fit a segment goes into extension segments, each with the packet's digest, its length and the
    place of the piece; the main packet then names the digest.
    """
    data = packet.encode()
    if len(PACKET_HEADER) + len(data) <= SEGMENT_BYTES:
        return [PACKET_HEADER + data]
    digest = hashlib.md5(data, usedforsecurity=False).hexdigest().upper()
    main = (
        f'<x:xmpmeta xmlns:x="{NS["x"]}"><rdf:RDF xmlns:rdf="{NS["rdf"]}"><rdf:Description rdf:about="" '
        f'xmlns:xmpNote="{NOTE}" xmpNote:HasExtendedXMP="{digest}"/></rdf:RDF></x:xmpmeta>'
    )
    head = EXTENSION_HEADER + digest.encode() + len(data).to_bytes(4, "big")
    pieces = range(0, len(data), EXTENSION_BYTES)
    return [PACKET_HEADER + main.encode(), *(head + at.to_bytes(4, "big") + data[at : at + EXTENSION_BYTES] for at in pieces)]


def _bodies(content: bytes) -> list[bytes]:
    """Bodies of the metadata segments of a JPEG, in order."""
    at, out = 2, []
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xE1:
            out.append(content[at + 4 : at + 2 + size])
        at += 2 + size
    return out


def _extension(bodies: list[bytes], main: str) -> str | None:
    """The packet that extension segments hold, if the main packet names one and all of it is there."""
    pieces: dict[str, dict[int, bytes]] = {}
    lengths: dict[str, int] = {}
    for body in bodies:
        if body.startswith(EXTENSION_HEADER) and len(body) >= len(EXTENSION_HEADER) + 40:
            rest = body[len(EXTENSION_HEADER) :]
            digest = rest[:32].decode("ascii", errors="replace")
            lengths[digest] = int.from_bytes(rest[32:36], "big")
            pieces.setdefault(digest, {})[int.from_bytes(rest[36:40], "big")] = rest[40:]
    for digest, parts in pieces.items():
        data = b"".join(parts[k] for k in sorted(parts))
        if digest in main and len(data) == lengths[digest]:
            return data.decode("utf-8", errors="replace")
    return None


def locate_packet(content: bytes | None) -> str | None:
    """The UTF-8 packet text inside JPEG bytes, without a byte order mark; a packet in extension segments is put together."""
    if content is None or content[:2] != b"\xff\xd8":
        return None
    bodies = _bodies(content)
    for body in bodies:
        if body.startswith(PACKET_HEADER):
            main = body[len(PACKET_HEADER) :].removeprefix(BOM).decode("utf-8", errors="replace")
            return _extension(bodies, main) or main
    return None


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def segments_of(packets: pa.Array) -> pa.Array:
    """Per packet the bodies of its file segments; null where there is no packet."""
    return pa.array([None if (text := p.as_py()) is None else packet_segments(text) for p in packets], pa.list_(pa.binary()))


@F.arrow_udf(REGION_LIST)
def regions_of(packets: pa.Array) -> pa.Array:
    # Packet by packet, so that the regions of one are held as Python objects at a time.
    parts = [pa.array([parse_regions(p.as_py())], _REGION_ARROW) for p in packets]
    return pa.concat_arrays(parts) if parts else pa.array([], _REGION_ARROW)


@F.arrow_udf(T.StringType())
def packet_of(contents: pa.Array) -> pa.Array:
    return pa.array([locate_packet(c.as_py()) for c in contents], pa.string())


def read_regions(packets: DataFrame) -> DataFrame:
    """One row per face region of ``packets(photo_id, packet)``: photo_id, position, name, region."""
    found = packets.select("photo_id", F.posexplode(regions_of("packet")).alias("position", "r"))
    return found.select(
        "photo_id", F.col("position").cast("bigint").alias("position"), "r.name",
        F.struct(
            *[F.col(f"r.{c}").alias(c) for c in ("x", "y", "w", "h")],
            F.lit(None).cast("array<double>").alias("landmarks"),
        ).alias("region"),
    )


def person_tags(names: Column) -> Column:
    """The four tag lists that go with a set of confirmed names."""
    distinct = F.array_distinct(F.filter(names, lambda n: n.isNotNull()))
    return F.struct(
        distinct.alias("persons"), distinct.alias("subject"),
        F.transform(distinct, lambda n: F.concat(F.lit("People/"), n)).alias("tags"),
        F.transform(distinct, lambda n: F.concat(F.lit("People|"), n)).alias("hierarchy"),
    )


def merge_subjects(subject: Column, old_tags: Column, names: Column) -> Column:
    """Replace exactly the persons of the old tag list by ``names``; other subjects stay."""
    people = F.transform(
        F.filter(old_tags, lambda t: t.startswith(TAG_PREFIX)), lambda t: F.substr(t, F.lit(len(TAG_PREFIX) + 1))
    )
    kept = F.filter(subject, lambda s: ~F.coalesce(F.array_contains(people, s), F.lit(False)))
    return F.concat(F.coalesce(kept, F.array().cast("array<string>")), names)


def _drop_property(root: ET.Element, name: str) -> None:
    tag = _tag(name)
    for parent in root.iter(_tag("rdf:Description")):
        parent.attrib.pop(tag, None)
        for child in parent.findall(tag):
            parent.remove(child)


def _list_property(target: ET.Element, name: str, values: list[str], kind: str = "rdf:Bag") -> None:
    if not values:
        return
    box = ET.SubElement(ET.SubElement(target, _tag(name)), _tag(kind))
    for value in values:
        ET.SubElement(box, _tag("rdf:li")).text = value


def rewrite_packet(packet: str | None, regions: list[dict] | None, clear: bool = False) -> str | None:
    """Packet with its regions and person tags replaced, or removed if ``clear``.

    Persons leave the subject list first, while the old tag list still tells
    which entries they are.
    """
    for prefix, uri in NS.items():
        ET.register_namespace(prefix, uri)
    root = None
    if packet:
        try:
            root = ET.fromstring(packet)
        except ET.ParseError:
            return packet
    if root is None:
        if clear:
            return None
        root = ET.Element(_tag("x:xmpmeta"))
        ET.SubElement(root, _tag("rdf:RDF"))
    frame = root if root.tag == _tag("rdf:RDF") else root.find(_tag("rdf:RDF"))
    target = frame.find(_tag("rdf:Description"))
    if target is None:
        target = ET.SubElement(frame, _tag("rdf:Description"), {_tag("rdf:about"): ""})
    old_people = {
        li.text.removeprefix(TAG_PREFIX) for li in _items(root, "digiKam:TagsList") if (li.text or "").startswith(TAG_PREFIX)
    }
    subjects = [li.text or "" for li in _items(root, "dc:subject")]
    kept = [s for s in subjects if s not in old_people]
    names = [] if clear else list(dict.fromkeys(r["name"] for r in regions or [] if r["name"] is not None))
    for name in ("mwg-rs:Regions", "Iptc4xmpExt:PersonInImage", "dc:subject", "digiKam:TagsList", "lr:hierarchicalSubject"):
        _drop_property(root, name)
    _list_property(target, "dc:subject", kept + names)
    _list_property(target, "Iptc4xmpExt:PersonInImage", names)
    _list_property(target, "digiKam:TagsList", [TAG_PREFIX + n for n in names], "rdf:Seq")
    _list_property(target, "lr:hierarchicalSubject", ["People|" + n for n in names])
    if regions and not clear:
        outer = ET.SubElement(target, _tag("mwg-rs:Regions"), {_tag("rdf:parseType"): "Resource"})
        box = ET.SubElement(ET.SubElement(outer, _tag("mwg-rs:RegionList")), _tag("rdf:Bag"))
        for region in regions:
            item = ET.SubElement(box, _tag("rdf:li"), {_tag("rdf:parseType"): "Resource"})
            ET.SubElement(item, _tag("mwg-rs:Type")).text = "Face"
            if region["name"] is not None:
                ET.SubElement(item, _tag("mwg-rs:Name")).text = region["name"]
            area = {_tag(f"stArea:{c}"): repr(region[c]) for c in ("x", "y", "w", "h")}
            ET.SubElement(item, _tag("mwg-rs:Area"), {**area, _tag("stArea:unit"): "normalized"})
    return ET.tostring(root, encoding="unicode")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets of (photo_id, packet, regions), photo by photo; what is handed back at a time is about ``BATCH_CHARS``."""
    for batch in batches:
        photos, packets, regions = batch.columns
        texts, held, done = [], 0, 0
        for at in range(batch.num_rows):
            texts.append(rewrite_packet(packets[at].as_py(), regions[at].as_py()))
            held += len(texts[-1] or "")
            if held >= BATCH_CHARS or at + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([photos.slice(done, len(texts)), pa.array(texts, pa.string())], ["photo_id", "packet"])
                texts, held, done = [], 0, at + 1


@F.arrow_udf(T.StringType())
def cleared_packet(packets: pa.Array) -> pa.Array:
    return pa.array([rewrite_packet(p, None, clear=True) for p in packets.to_pylist()], pa.string())


@F.arrow_udf(TAG_LISTS)
def tag_lists(packets: pa.Array) -> pa.Array:
    """The four lists as a packet holds them."""
    names = {
        "subject": "dc:subject", "tags": "digiKam:TagsList", "persons": "Iptc4xmpExt:PersonInImage", "hierarchy": "lr:hierarchicalSubject",
    }
    kind = pa.struct([(n, pa.list_(pa.string())) for n in names])

    def lists(packet: str | None) -> dict | None:
        if not packet:
            return None
        try:
            root = ET.fromstring(packet)
        except ET.ParseError:
            return None
        return {n: [li.text or "" for li in _items(root, p)] for n, p in names.items()}

    return pa.array([lists(p) for p in packets.to_pylist()], kind)


def write_packets(
    photos: DataFrame, faces: DataFrame, packets: DataFrame | None = None, include_unnamed: bool = True
) -> DataFrame:
    """New packet per photo holding all its faces, however many: ``(photo_id, packet)``.

    A packet is one value, as large as its faces make it; ``segments_of`` cuts
    it for a file. ``packets`` are the present ones, whose other properties are kept.
    """
    kept = faces.filter("region IS NOT NULL")
    kept = kept if include_unnamed else kept.filter("name IS NOT NULL AND NOT ignored")
    fields = [F.col("name"), *[F.col(f"region.{c}").alias(c) for c in ("x", "y", "w", "h")]]
    gathered = kept.groupBy("photo_id").agg(
        F.array_sort(F.collect_list(F.struct("face_id", F.struct(*fields).alias("r")))).alias("_l")
    )
    listed = gathered.select("photo_id", F.transform("_l", lambda e: e["r"]).alias("_regions"))
    joined = photos.select("photo_id").join(listed, "photo_id", "left")
    if packets is None:
        joined = joined.withColumn("packet", F.lit(None).cast("string"))
    else:
        joined = joined.join(packets.select("photo_id", "packet"), "photo_id", "left")
    kind = joined.schema["photo_id"].dataType.simpleString()
    return joined.select("photo_id", "packet", "_regions").mapInArrow(_written, f"photo_id {kind}, packet string")


def clear_packets(packets: DataFrame) -> DataFrame:
    return packets.withColumn("packet", cleared_packet("packet"))


def pending_photos(photos: DataFrame, limit: int | None = None) -> DataFrame:
    pending = photos.filter("pending_xmp_write")
    return pending if limit is None else pending.orderBy("photo_id").limit(limit)


def drain_pending(
    photos: DataFrame, faces: DataFrame, present: DataFrame, written_at: Column, failed: DataFrame | None = None,
    packets: DataFrame | None = None, limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Write the packets of pending photos; returns (photos after, packets written).

    A photo whose file is not in ``present(path)`` is only taken off the queue.
    A photo in ``failed(photo_id)`` stays pending for the next run.
    """
    queue = pending_photos(photos, limit).select("photo_id", "path")
    todo = queue.join(present.select("path"), "path", "left_semi")
    if failed is not None:
        todo = todo.join(failed.select("photo_id"), "photo_id", "left_anti")
    gone = queue.join(present.select("path"), "path", "left_anti")
    mine = faces.join(todo.select("photo_id"), "photo_id", "left_semi")
    out = write_packets(todo, mine, packets)
    state = todo.select("photo_id", F.lit("written").alias("_s")).unionByName(gone.select("photo_id", F.lit("gone").alias("_s")))
    joined = photos.join(state, "photo_id", "left")
    values = {
        "pending_xmp_write": F.col("pending_xmp_write") & F.col("_s").isNull(),
        "modified_at": F.when(F.col("_s") == "written", written_at).otherwise(F.col("modified_at")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in photos.columns]), out


def refresh_imported(photos: DataFrame, faces: DataFrame, imported: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """Rewritten packets of just imported photos, each with all its faces."""
    chosen = photos.join(imported.select("photo_id"), "photo_id", "left_semi")
    return write_packets(chosen, faces.join(imported.select("photo_id"), "photo_id", "left_semi"), packets)
