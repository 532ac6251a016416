"""Column functions of the event log: routing hash, session keys, trace ids, JSON-free predicates, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV-1a offset basis and prime, the topic of agent events, and the suffix of dead-letter topics.
FNV_BASIS, FNV_PRIME, WORD = 2166136261, 16777619, 4294967295
#: What a session's key is hashed behind for its trace id; another system's ids need that system's prefix.
TRACE_PREFIX = "session/"
AGENT_TOPIC, DLQ_SUFFIX = "agent-events", ".dlq"

_BLANK = r"(?U)^\s+|\s+$"


def fold_bytes(octets: Column) -> Column:
    """FNV-1a over an array of byte values, as an unsigned 32-bit number in a BIGINT."""
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(WORD))
    return F.aggregate(octets, F.lit(FNV_BASIS).cast("long"), step)


def octets_of(text: Column) -> Column:
    """The UTF-8 bytes of a string as an array of BIGINT."""
    # every byte as the character of its number
    signs = F.split(F.decode(F.encode(text, "utf-8"), "iso-8859-1"), "")
    return F.transform(F.filter(signs, lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a32(text: Column) -> Column:
    return fold_bytes(octets_of(text))


def little_endian(number: Column) -> Column:
    """The four bytes of a 32-bit number, lowest first."""
    return F.array(*(F.shiftright(number.cast("long"), 8 * k).bitwiseAND(F.lit(255)) for k in range(4)))


def bucket_of(text: Column, count: int | Column) -> Column:
    """Where a key goes among ``count`` buckets; a single bucket takes everything."""
    return (fnv1a32(text) % count).cast("int")


def trimmed(text: Column) -> Column:
    """Without leading and trailing Unicode white space; null stays null."""
    return F.regexp_replace(text, _BLANK, "")


def session_key(tenant: Column, project: Column, session: Column) -> Column:
    return F.concat_ws("/", trimmed(tenant), trimmed(project), trimmed(session))


def trace_id(key: Column, prefix: str = TRACE_PREFIX) -> Column:
    """Lower-case hex of a session's 16-byte trace id; null for a key without any part."""
    return F.when(key != "//", F.left(F.sha2(F.concat(F.lit(prefix), key), 256), F.lit(32)))


def dlq_topic(topic: Column, override: Column | None = None) -> Column:
    named = F.nullif(trimmed(override), F.lit("")) if override is not None else F.lit(None).cast("string")
    return F.coalesce(named, F.concat(topic, F.lit(DLQ_SUFFIX)))


def is_dlq(topic: Column) -> Column:
    return trimmed(topic).endswith(DLQ_SUFFIX)


def clamp_count(asked: int, default: int, most: int) -> int:
    """A request's row count: the default where it isn't positive, never over the most allowed."""
    return default if asked <= 0 else min(asked, most)


def short_number(n: Column) -> Column:
    """1200 -> 1.2K, in thousands, millions and billions; 0 for anything that isn't positive."""
    scaled = lambda size, sign: F.format_string(f"%.1f{sign}", n / size)
    return (
        F.when(n <= 0, "0").when(n >= 1_000_000_000, scaled(1e9, "B")).when(n >= 1_000_000, scaled(1e6, "M")).when(n >= 1_000, scaled(1e3, "K")).otherwise(n.cast("long").cast("string"))
    )


def uptime(seconds: Column) -> Column:
    """1h 2m 3s, without leading zero units."""
    h, m, s = (seconds / 3600).cast("long"), (seconds % 3600 / 60).cast("long"), (seconds % 60).cast("long")
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def trend(now: Column, before: Column) -> Column:
    return F.when(now > before, " ↑").when(now < before, " ↓").otherwise("")


def header_pair(line: Column) -> Column:
    """struct(name, value) of ``Name: value``, blanks before the value left out; null without a name or anything after the colon."""
    name, value = F.substring_index(line, ":", 1), F.regexp_extract(line, r"(?s)^[^:]*:[ \t]*(.*)$", 1)
    return F.when(line.rlike(r"(?s)^[^:]+:."), F.struct(name.alias("name"), value.alias("value")))


def register(spark) -> None:
    """SQL names of the functions, for spark.sql users."""
    signs = "filter(split(decode(encode({0}, 'utf-8'), 'iso-8859-1'), ''), c -> c <> '')"
    fold = f"aggregate({signs}, {FNV_BASIS}L, (h, c) -> ((h ^ ascii(c)) * {FNV_PRIME}L) & {WORD}L)"
    blank = "regexp_replace({0}, '(?U)^\\\\s+|\\\\s+$', '')"
    spark.sql(f"create or replace temporary function fnv1a32(k string) returns bigint return {fold.format('k')}")
    spark.sql(f"create or replace temporary function session_key(t string, p string, s string) returns string return concat_ws('/', {', '.join(blank.format(x) for x in 'tps')})")
    spark.sql(f"create or replace temporary function session_trace_id(k string, prefix string default '{TRACE_PREFIX}') returns string return if(k = '//', null, left(sha2(concat(prefix, k), 256), 32))")
    spark.sql("create or replace temporary function partition_for(k string, n int) returns int return cast(fnv1a32(k) % n as int)")
