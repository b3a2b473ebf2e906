"""Registered queries of readers, writers, parsers and the stream, each a round trip or a parse whose result SQL can state.

Round trips write whole tables to a path of their own in the shared folder and read them again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake.functions import keys as k
from detlake.functions import pixels
from detlake.operators import quality, reconcile, temporal
from detlake.plans import curation as c
from detlake.session import exchange_path, norm, table
from detlake.sources import files
from detlake.streaming import events as streaming


def _entry_rows(s, d):
    e = table(s, d, "export_entries").select("canonical_image_id", F.nullif("country", F.lit("")).alias("country"), norm("split").alias("split"), "width", "height", "is_positive")
    return e.distinct()


def jsonl_roundtrip(s, d):
    """Export entries written as canonical JSON lines and read back."""
    rows, path = _entry_rows(s, d), exchange_path(s, "jsonl")
    files.write_jsonl(rows, path)
    return files.read_jsonl(s, path, "canonical_image_id string, country string, split string, width int, height int, is_positive boolean")


def csv_roundtrip(s, d):
    """Export entries written as CSV with a header and read back."""
    rows, path = _entry_rows(s, d), exchange_path(s, "csv")
    files.write_csv(rows, path)
    return files.read_csv(s, path, rows.schema.simpleString()[7:-1].replace(":", " "))


def parquet_roundtrip(s, d):
    """Export entries written in folders a split and read back from one of them: the others aren't touched."""
    rows, path = _entry_rows(s, d).where("split IS NOT NULL"), exchange_path(s, "parquet")
    files.write_parquet(rows, path, ["split"])
    return s.read.parquet(path).where("split = 'val'")


def malformed_lines(s, d):
    """Job logs read as JSON lines: every third one is cut off and comes out as corrupt."""
    path = exchange_path(s, "lines")
    line = F.to_json(F.struct("event_id", "user_id"))
    rows = table(s, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(line).alias("value"))
    rows.write.text(path)
    return files.read_jsonl(s, path, "event_id long, user_id long", strict=False).select("event_id", "user_id", F.col("_corrupt").alias("corrupt"))


def annotation_xml(s, d):
    """Annotations written as XML, one document an order with its lines as objects, and parsed again; some are malformed."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    text = lambda x: x.cast("long").cast("string")
    obj = F.concat(
        F.lit("<object><name>D"), text(F.col("l_suppkey") % 4), F.lit("0</name><bndbox><xmin>"), text(F.col("l_partkey") % 50), F.lit("</xmin><ymin>"), text(F.col("l_suppkey") % 40), F.lit("</ymin><xmax>"),
        text(F.col("l_partkey") % 50 + 9), F.lit("</xmax><ymax>"), text(F.col("l_suppkey") % 40 + 7), F.lit("</ymax></bndbox></object>"),
    )
    docs = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", obj.alias("x")))), lambda e: e["x"]), "").alias("x"))
    xml = F.concat(F.lit("<annotation><filename>f</filename><size><width>640</width><height>480</height><depth>3</depth></size>"), "x", F.when(F.col("l_orderkey") % 97 == 0, F.lit("</annot")).otherwise(F.lit("</annotation>")))
    parsed = files.parse_voc(docs.select("l_orderkey", xml.alias("text")))
    return parsed.select("l_orderkey", "parse_error", "width", "height", "object_index", "raw_class", *(F.col(x).try_cast("long").alias(x) for x in ("xmin", "ymin", "xmax", "ymax")))


def exif_times(s, d):
    """Times written into EXIF blocks of JPEG headers and read from the bytes."""
    ms = F.col("exif_timestamp_sort_ms")
    stamp = F.date_format(F.timestamp_millis(ms), "yyyy:MM:dd HH:mm:ss")
    # one directory of one entry: tag 0x0132, text of 20 bytes at offset 26, little-endian
    tiff = F.concat(F.lit("49492A0008000000" + "0100" + "3201" + "0200" + "14000000" + "1A000000" + "00000000"), F.hex(stamp), F.lit("00"))
    block = F.concat(F.lit("457869660000"), tiff)
    size = F.lpad(F.hex((F.length(block) / 2 + 2).cast("long")), 4, "0")
    rows = c._records(s, d).where("exif_timestamp_sort_ms BETWEEN 0 AND 4000000000000").select("canonical_image_id", F.unhex(F.concat(F.lit("FFD8FFE1"), size, block, F.lit("FFDA"))).alias("content"))
    return rows.select("canonical_image_id", pixels.exif_ms(F.col("content")).alias("taken_ms"))


def content_formats(s, d):
    """Format, length and digests of byte contents: label texts behind the leading bytes of several formats."""
    head = {0: "FFD8FFE0", 1: "89504E470D0A1A0A", 2: "424D", 3: "52494646"}
    kind = F.pmod(F.col("width") + F.col("height"), F.lit(5))
    lead = F.lit("00")
    for n, x in head.items():
        lead = F.when(kind == n, F.lit(x)).otherwise(lead)
    e = table(s, d, "export_entries").where("canonical_image_id IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL").groupBy("canonical_image_id").agg(F.max("label_text").alias("t"), F.max("width").alias("width"), F.max("height").alias("height"))
    content = F.unhex(F.concat(lead, F.hex(F.coalesce("t", F.lit("")))))
    rows = e.select("canonical_image_id", content.alias("content"))
    return rows.select("canonical_image_id", k.image_format(F.col("content")).alias("format"), F.octet_length("content").alias("length"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


#: A region of interest in normalised coordinates.
_REGION = [(0.1, 0.2), (0.9, 0.3), (0.7, 0.9), (0.5, 0.5), (0.2, 0.8)]


def region_hits(s, d):
    """Valid observations whose centre lies in a polygon."""
    obs = c._observations(s, d)
    return obs.where(pixels.in_polygon((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, _REGION)).select("detection_id")


def repeated_rows(s, d):
    """Export entries that the table holds in other numbers than its distinct rows, as bags."""
    e = table(s, d, "export_entries").select("canonical_image_id", norm("split").alias("split"), "width")
    return reconcile.bag_difference(e, e.distinct()).groupBy("canonical_image_id", "split", "width", "side").agg(F.count("*").alias("n"))


def overridden_objects(s, d):
    """Actions of raw classes, and statuses that a stated table of exceptions replaces."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    raw = F.concat(F.lit("D"), F.lpad((F.col("l_suppkey") % 6 * 10).cast("int").cast("string"), 2, "0"))
    act = quality.action(raw, ["D00", "D10", "D20", "D40"], ["D30"])
    rows = li.select("l_orderkey", "l_linenumber", raw.alias("raw_class"), act.alias("action"), F.lit("retain_target").alias("status"))
    rules = rows.where("l_orderkey % 50 = 0").select("l_orderkey", "l_linenumber", F.lit("quarantine_reviewed").alias("new_status")).distinct()
    return quality.override(rows, rules, ["l_orderkey", "l_linenumber"]).groupBy("raw_class", "action", "status").agg(F.count("*").alias("n"))


def work_units(s, d):
    """Sheets of a contact grid and batches of an epoch that a split's images make."""
    n = c._splits(s, d).groupBy("split").agg(F.count("*").alias("images"))
    return n.select("split", "images", k.batches(F.col("images"), F.lit(12)).alias("sheets"), k.batches(F.col("images"), F.lit(16)).alias("batches"))


def streamed_totals(s, d):
    """Observations as a file stream through keyed state into a sealed sink: what its events hold together, a video and class."""
    obs = c._observations(s, d)
    source, sink, state = (exchange_path(s, x) for x in ("stream", "events", "state"))
    rows = obs.select(*(x for x in streaming.INPUT_COLUMNS if x != "end"), F.lit(False).alias("end"))
    last = rows.groupBy("video_id", "class_id").agg(F.max("frame_index").alias("frame_index"), F.max("fps").alias("fps"))
    zero = {"detection_index": "int", "timestamp_ms": "bigint", **dict.fromkeys(("confidence", "area", "pixels", "x1", "y1", "x2", "y2"), "double")}
    ends = last.select("video_id", "class_id", (F.col("frame_index") + 1).alias("frame_index"), *(F.lit(0).cast(t).alias(x) for x, t in zero.items()), "fps", F.lit(True).alias("end"))
    rows.unionByName(ends).write.parquet(source)
    stream = s.readStream.schema(s.read.parquet(source).schema).parquet(source)
    query = streaming.stream_events(stream).writeStream.foreachBatch(streaming.sealed_sink(sink)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    found = s.read.schema(temporal.EVENT_SCHEMA).option("recursiveFileLookup", True).parquet(sink)
    return found.groupBy("video_id", "class_id").agg(F.sum("observation_count").alias("observations"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.max("max_confidence").alias("max_confidence"), F.sum(F.col("iou_matches") + F.col("center_matches") + 1).alias("associations"))


def queries():
    named = (jsonl_roundtrip, csv_roundtrip, parquet_roundtrip, malformed_lines, annotation_xml, exif_times, content_formats, region_hits, repeated_rows, overridden_objects, work_units, streamed_totals)
    return {f.__name__: f for f in named}


def oracle_sql():
    entry = "SELECT DISTINCT canonical_image_id, nullif(country, '') AS country, lower(trim(split)) AS split, width, height, is_positive FROM export_entries"
    cross = " + ".join(
        f"CASE WHEN (({y1}::DOUBLE > y) <> ({y2}::DOUBLE > y)) AND x < (y - {y1}::DOUBLE) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE + {x1}::DOUBLE THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(_REGION, _REGION[1:] + _REGION[:1]) if y1 != y2
    )
    return {
        "jsonl_roundtrip": entry,
        "csv_roundtrip": entry,
        "parquet_roundtrip": f"SELECT * FROM ({entry}) WHERE split = 'val'",
        "malformed_lines": "SELECT CASE WHEN event_id % 3 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 3 = 0 THEN 'broken ' || event_id END AS corrupt FROM events",
        "annotation_xml": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM l WHERE l_orderkey % 97 <> 0)
SELECT l_orderkey, false AS parse_error, 640 AS width, 480 AS height, k::INT AS object_index, 'D' || (l_suppkey % 4) || '0' AS raw_class, l_partkey % 50 AS xmin, l_suppkey % 40 AS ymin, l_partkey % 50 + 9 AS xmax, l_suppkey % 40 + 7 AS ymax FROM n
UNION ALL SELECT DISTINCT l_orderkey, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM l WHERE l_orderkey % 97 = 0""",
        "exif_times": f"WITH {c._REC} SELECT canonical_image_id, exif_timestamp_sort_ms // 1000 * 1000 AS taken_ms FROM rec WHERE exif_timestamp_sort_ms BETWEEN 0 AND 4000000000000",
        "content_formats": """WITH e AS (SELECT canonical_image_id, coalesce(max(label_text), '') AS t, (max(width) + max(height)) % 5 AS kind FROM export_entries WHERE canonical_image_id IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL GROUP BY 1),
b AS (SELECT *, unhex(CASE kind WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '424D' WHEN 3 THEN '52494646' ELSE '00' END || hex(t)) AS content FROM e)
SELECT canonical_image_id, CASE kind WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'bmp' WHEN 3 THEN 'riff' ELSE 'unknown' END AS format, octet_length(content)::INT AS length, sha256(content) AS sha256, md5(content) AS md5 FROM b""",
        "region_hits": f"WITH {c._OBS}, p AS (SELECT detection_id, (b[1] + b[3]) / 2 AS x, (b[2] + b[4]) / 2 AS y FROM obs) SELECT detection_id FROM p WHERE ({cross}) % 2 = 1",
        "repeated_rows": "SELECT canonical_image_id, lower(trim(split)) AS split, width, 'left' AS side, count(*) - 1 AS n FROM export_entries GROUP BY 1, 2, 3 HAVING count(*) > 1",
        "overridden_objects": f"""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem), r AS (SELECT 'D' || lpad((l_suppkey % 6 * 10)::VARCHAR, 2, '0') AS raw_class, CASE WHEN l_orderkey % 50 = 0 THEN 'quarantine_reviewed' ELSE 'retain_target' END AS status FROM l)
SELECT raw_class, CASE WHEN raw_class IN ('D00', 'D10', 'D20', 'D40') THEN '{quality.RETAIN}' WHEN raw_class = 'D30' THEN '{quality.NON_TARGET}' ELSE '{quality.UNKNOWN}' END AS action, status, count(*) AS n FROM r GROUP BY 1, 2, 3""",
        "work_units": f"""WITH e AS (SELECT canonical_image_id, min({c._SPLIT}) AS split FROM export_entries WHERE canonical_image_id IS NOT NULL AND split IS NOT NULL GROUP BY 1)
SELECT split, count(*) AS images, (count(*) + 11) // 12 AS sheets, (count(*) + 15) // 16 AS batches FROM e GROUP BY 1""",
        "streamed_totals": f"WITH {c._OBS} SELECT video_id, class_id, count(*) AS observations, min(frame_index) AS first_frame, max(frame_index) AS last_frame, max(confidence) AS max_confidence, count(*) AS associations FROM obs GROUP BY 1, 2",
    }
