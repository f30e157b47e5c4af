"""Captured request bodies to events: shapes, field resolution, enrichment."""

from __future__ import annotations

import base64
import zlib
from urllib.parse import parse_qs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.properties import PROMOTED, promoted
from strandline.functions.times import DAY, HOUR
from strandline.session import materialize

MAX_ID_CHARS = 200
MAX_FUTURE = 23 * HOUR
DROPPED = "$performance_event"
UUID = r"^\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"

# Marks of common user agents, most specific first, with the version as a group.
CRAWLER = r"(?i)bot\b|crawl|spider|slurp|facebookexternalhit|bingpreview|lighthouse"
BROWSERS = (
    ("Edge", r"\bEdg(?:e|A|iOS)?/([\d.]+)"),
    ("Opera", r"\b(?:OPR|Opera|OPiOS)/([\d.]+)"),
    ("Samsung Internet", r"\bSamsungBrowser/([\d.]+)"),
    ("Yandex Browser", r"\bYaBrowser/([\d.]+)"),
    ("Vivaldi", r"\bVivaldi/([\d.]+)"),
    ("UC Browser", r"\bUCBrowser/([\d.]+)"),
    ("DuckDuckGo", r"\bDuckDuckGo/([\d.]+)"),
    ("Silk", r"\bSilk/([\d.]+)"),
    ("Firefox", r"\b(?:Firefox|FxiOS)/([\d.]+)"),
    ("Chrome", r"\b(?:Chrome|CriOS|HeadlessChrome|Chromium)/([\d.]+)"),
    ("Internet Explorer", r"\b(?:MSIE |Trident/.*\brv:)([\d.]+)"),
    ("Safari", r"\bVersion/([\d.]+).*\bSafari/"),
)
SYSTEMS = (
    ("Windows Phone", r"Windows Phone(?: OS)? ([\d.]+)"),
    ("Windows 10", r"Windows NT (10\.0)"),
    ("Windows 8.1", r"Windows NT (6\.3)"),
    ("Windows 8", r"Windows NT (6\.2)"),
    ("Windows 7", r"Windows NT (6\.1)"),
    ("Windows Vista", r"Windows NT (6\.0)"),
    ("Windows XP", r"Windows NT (5\.[12])"),
    ("Windows", r"Windows(?: NT ([\d.]+))?"),
    ("iOS", r"(?:iPhone|iPad|iPod)(?:.*? OS ([\d_]+))?"),
    ("Mac OSX", r"Mac OS X(?: ([\d_.]+))?"),
    ("Android", r"Android(?: ([\d.]+))?"),
    ("ChromeOS", r"CrOS \S+ ([\d.]+)"),
    ("BlackBerry", r"(?:BlackBerry|BB10)(?:.*\bVersion/([\d.]+))?"),
    ("Linux", r"Linux()"),
)


LZ_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
MAX_BODY = 20 << 20


def unpack_lz(text: str) -> str | None:
    """The text behind lz-string's base64 form; null if it is damaged.

    Codes are read least bit first and get one bit longer whenever the table is full. Codes 0 and
    1 bring a new character of 8 or 16 bits, 2 ends the text, others repeat an entry.
    """
    bits = iter([LZ_LETTERS.index(c) >> k & 1 for c in text if c in LZ_LETTERS for k in range(5, -1, -1)])

    def read(n: int) -> int:
        return sum(next(bits) << k for k in range(n))

    table: list[str] = ["", "", ""]
    width, room, last, out, size = 2, 4, None, [], 0
    try:
        while True:
            code = read(width)
            if code == 2:
                return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            if code < 2:
                entry = chr(read(8 if code == 0 else 16))
                table.append(entry)
                room -= 1
                if last is None:
                    width, room = 3, 4
                elif room == 0:
                    room, width = 1 << width, width + 1
            elif code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[0]
            else:
                return None
            out.append(entry)
            size += len(entry)
            if size > MAX_BODY:
                return None
            if last is not None:
                table.append(last + entry[0])
                room -= 1
                if room == 0:
                    room, width = 1 << width, width + 1
            last = entry
    except (StopIteration, RuntimeError):
        return None


def unpack(body: bytes | None, how: str | None) -> str | None:
    """A request body as JSON text: gzip, base64, lz64 or form fields undone, as told by `how` or
    seen from the bytes. Null if it can't be read or is larger than 20 MiB."""
    if not body:
        return None
    try:
        for _ in range(3):
            if body[:2] == b"\x1f\x8b":
                unzip = zlib.decompressobj(31)
                body = unzip.decompress(body, MAX_BODY)
                if unzip.unconsumed_tail:
                    return None
            elif body.startswith(b"data=") or b"&data=" in body:
                body = parse_qs(body.decode(), keep_blank_values=True)["data"][0].encode()
            elif how == "lz64":
                return unpack_lz(body.decode())
            elif body.lstrip()[:1] not in (b"{", b"["):
                body = base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
            else:
                break
        return body.decode("utf-8", "replace") if len(body) <= MAX_BODY else None
    except (ValueError, KeyError, zlib.error, IndexError):
        return None


def unpack_bodies(requests: DataFrame) -> DataFrame:
    """`requests` (body as bytes, compression) with the body as text; see `unpack`."""

    @F.pandas_udf("string")
    def text(body: pd.Series, how: pd.Series) -> pd.Series:
        return pd.Series([unpack(None if b is None else bytes(b), h) for b, h in zip(body, how)], dtype=object)

    return requests.withColumn("body", text("body", "compression"))


def timestamp_us(text: Column) -> Column:
    """Microseconds of an RFC 3339 time; also with a blank for the T, a bare +NN zone, or no zone (UTC)."""
    fixed = F.regexp_replace(F.trim(text), r"([+-]\d{2})$", "$1:00")
    known = fixed.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$")
    return F.when(known, F.unix_micros(F.try_to_timestamp(fixed)))


def parse(bodies: DataFrame) -> DataFrame:
    """One row per raw event of `bodies` (body, received_us, sent_at_us; more columns are kept).

    A body is an array of events, an object with a batch, or a single event; an object without
    event name is an $identify. A batch's token and sent_at count for all its events. Events that
    are no objects, and bodies that are no JSON, give no rows here; see `rejected`.
    """
    body = F.try_parse_json("body")
    is_array = F.schema_of_variant(body).startswith("ARRAY")
    batch = F.variant_get(body, "$.batch", "array<variant>")
    single = F.array(body)
    items = F.when(is_array, F.try_variant_get(body, "$", "array<variant>")).when(batch.isNotNull(), batch).otherwise(single)
    in_batch = batch.isNotNull() & ~is_array
    token = F.when(in_batch, F.coalesce(F.try_variant_get(body, "$.token", "string"), F.try_variant_get(body, "$.api_key", "string")))
    sent = F.when(in_batch, timestamp_us(F.try_variant_get(body, "$.sent_at", "string")))
    rows = bodies.where(body.isNotNull()).select("*", F.explode(items).alias("raw"), token.alias("batch_token"), sent.alias("batch_sent_us"), in_batch.alias("in_batch"))
    objects = rows.where(F.schema_of_variant("raw").startswith("OBJECT"))
    name = F.try_variant_get("raw", "$.event", "string")
    event = F.when(name.isNull() & ~F.col("in_batch"), F.lit("$identify")).otherwise(name)
    return objects.withColumn("event", event).where((F.col("event") != "") & (F.col("event") != DROPPED))


def rejected(bodies: DataFrame) -> DataFrame:
    """Bodies that are no JSON."""
    return bodies.where(F.try_parse_json("body").isNull())


def resolve(parsed: DataFrame) -> DataFrame:
    """uuid, event, distinct_id, token, timestamp, properties and the promoted columns.

    token: the batch's, else the event's, else its properties'. distinct_id: the event's, else its
    properties'; numbers and others as text, NUL replaced, 200 characters at most; blank ones are
    no events. timestamp: offset before receipt, else the given time corrected by the sender's
    clock skew unless asked not to, else receipt; more than 23 hours ahead counts as receipt.
    uuid: the given one, else derived from the event's content, so a retry gives the same. $set
    and $set_once beside the properties move into them.
    """
    text = lambda path: F.try_variant_get("raw", path, "string")
    members = F.coalesce(F.from_json(F.to_json(F.try_variant_get("raw", "$.properties", "variant")), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    beside = [F.when(F.try_variant_get("raw", f"$['{k}']", "variant").isNotNull() & ~F.map_contains_key(members, k), F.create_map(F.lit(k), F.try_variant_get("raw", f"$['{k}']", "variant"))) for k in ("$set", "$set_once")]
    empty = F.create_map().cast("map<string,variant>")
    whole = F.map_concat(members, *(F.coalesce(b, empty) for b in beside))
    token = F.coalesce("batch_token", text("$.token"), text("$['$token']"), text("$.api_key"), text("$.properties.token"))
    distinct_id = F.substring(F.replace(F.coalesce(text("$.distinct_id"), text("$['$distinct_id']"), text("$.properties.distinct_id")), F.lit("\x00"), F.lit("�")), 1, MAX_ID_CHARS)
    received = F.col("received_us")
    sent = F.coalesce("batch_sent_us", "sent_at_us")
    ignore = F.coalesce(F.try_variant_get("raw", "$.properties['$ignore_sent_at']", "boolean"), F.lit(False))
    offset = F.try_variant_get("raw", "$.offset", "bigint")
    given = text("$.timestamp")
    corrected = timestamp_us(given) - F.when(sent.isNotNull() & ~ignore, sent - received).otherwise(0)
    at = F.when(offset.isNotNull(), received - offset * 1000).when(given.isNull(), received).when(corrected > received + MAX_FUTURE, received).otherwise(corrected)
    shaped = parsed.select("*", whole.alias("members"), token.alias("token"), distinct_id.alias("distinct_id"), at.alias("at"), text("$.uuid").alias("given_uuid"))
    usable = shaped.where(F.col("token").isNotNull() & (F.trim("distinct_id") != "") & F.col("at").isNotNull() & (F.col("given_uuid").isNull() | F.col("given_uuid").rlike(UUID)))
    digest = F.md5(F.concat_ws("\u001f", "token", "distinct_id", "event", F.col("at").cast("string"), F.to_json("raw")))
    made = F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    plain = F.regexp_replace(F.lower("given_uuid"), "[^0-9a-f]", "")
    uuid = F.coalesce(F.regexp_replace(plain, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), made)
    out = usable.select(uuid.alias("uuid"), "event", "distinct_id", "token", F.timestamp_micros("at").alias("timestamp"), F.to_json("members").alias("properties"), *(c for c in ("received_us", "user_agent", "ip") if c in parsed.columns))
    return out.withColumns({column: promoted(F.col("properties"), key) for key, column in PROMOTED.items()})


def _first(marks: tuple, agent: Column) -> tuple[Column, Column]:
    """The name of the first mark that an agent has, and the version beside it."""
    name = F.coalesce(*(F.when(agent.rlike(pattern), F.lit(name)) for name, pattern in marks))
    version = F.coalesce(*(F.when(agent.rlike(pattern), F.regexp_replace(F.regexp_extract(agent, pattern, 1), "_", ".")) for _, pattern in marks))
    return name, F.nullif(version, F.lit(""))


def _with_members(document: Column, members: dict[str, Column]) -> Column:
    """A JSON object's text with members added that it doesn't have; those without a value are left out."""
    has = F.json_object_keys(document)
    new = F.map_filter(F.create_map(*(x for k, v in members.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull() & ~F.array_contains(has, k))
    added = F.to_json(new)
    joined = F.concat(F.substr(document, F.lit(1), F.length(document) - 1), F.lit(","), F.substr(added, F.lit(2)))
    return F.when(F.size(new) == 0, document).when(F.size(has) == 0, added).otherwise(joined)


def enrich(events: DataFrame, salt: str | None = None) -> DataFrame:
    """Browser, system, their versions and the device type from the user agent, where the event has
    none of its own, in the properties and as columns; with a salt a device id that is the same for
    an address all day and unrelated the next. An agent with no known mark adds nothing."""
    own = F.coalesce(*(F.get_json_object("properties", f"$['{k}']") for k in ("$user_agent", "$useragent")))
    agent = F.nullif(F.coalesce("user_agent", own), F.lit(""))
    device = F.when(agent.rlike(CRAWLER), "Crawler").when(agent.rlike(r"iPad|Tablet|Silk/|Android(?!.*Mobile)"), "Tablet").when(agent.rlike(r"Mobi|iPhone|iPod|Android|BlackBerry|BB10"), "Mobile").when(agent.isNotNull(), "Desktop")
    (browser, browser_version), (system, system_version) = _first(BROWSERS, agent), _first(SYSTEMS, agent)
    found = {"$browser": F.coalesce("browser", browser), "$browser_version": browser_version, "$os": F.coalesce("os", system), "$os_version": system_version, "$device_type": F.coalesce("device_type", device)}
    out = events.withColumns({"properties": F.when(agent.isNotNull(), _with_members(F.col("properties"), found)).otherwise(F.col("properties")), "browser": found["$browser"], "os": found["$os"], "device_type": found["$device_type"]})
    if salt:
        day = (F.col("received_us") / F.lit(DAY)).cast("long").cast("string")
        own = F.when(F.nullif("ip", F.lit("")).isNotNull(), F.sha2(F.concat_ws(":", "ip", F.lit(salt), day), 256).substr(1, 16))
        out = out.withColumn("device_id", F.coalesce(F.get_json_object("properties", "$['$device_id']"), own))
    return out


def import_events(exported: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """An exported history as a feed in the order of (timestamp, uuid), with `seq`; persons, if
    given (distinct_id, properties, other ids), come first as merges and property updates. The
    numbered feed is written down, so an event keeps its seq when a lost task runs again; a caller
    that stops halfway can go on from the last seq it has taken in."""
    columns = ["uuid", "event", "distinct_id", "timestamp", "properties"]
    feed = exported.select(*columns)
    if people is not None:
        merges = people.select(F.col("distinct_id"), F.explode("other_ids").alias("alias")).select(F.md5(F.concat("distinct_id", F.lit("|"), "alias")).alias("uuid"), F.lit("$merge_dangerously").alias("event"), "distinct_id", F.timestamp_micros(F.lit(0)).alias("timestamp"), F.to_json(F.struct("alias")).alias("properties"))
        sets = people.select(F.md5("distinct_id").alias("uuid"), F.lit("$set").alias("event"), "distinct_id", F.timestamp_micros(F.lit(1)).alias("timestamp"), F.concat(F.lit('{"$set":'), F.coalesce("properties", F.lit("{}")), F.lit("}")).alias("properties"))
        feed = merges.unionByName(sets).unionByName(feed)
    placed = feed.repartitionByRange("timestamp", "uuid").sortWithinPartitions("timestamp", "uuid")
    return materialize(placed.withColumn("seq", F.monotonically_increasing_id()))
