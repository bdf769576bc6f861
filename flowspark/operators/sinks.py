"""Sinks: attribute logging (and its parser), latest-wins replace, stored output.

``log_lines`` / ``parse_log`` are inverse projections (no shuffle). ``latest``
is the one exchange of the store path: a grouped ``max_by`` with partial
aggregation, so a hot (directory, filename) collapses map-side before the
shuffle. ``store`` appends versions and ``read_store`` resolves latest-wins,
so a crashed or replayed write can never lose a stored record.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.once import first_of_keys
from flowspark.records import ATTRIBUTES, CONTENT, CREATED_AT, RECORD_ID

# Fixed value: level order.
LEVELS = ["trace", "debug", "info", "warn", "error"]


@dataclass(frozen=True)
class LogLayout:
    """Markers of a log block; pass another layout to write or parse other texts.

    ``head`` begins a block and, when it ends in a blank, is followed by the
    record id; ``section`` is a line of its own.
    """

    head: str = "Logging record "
    section: str = "Record attributes"
    key: str = "Key: '"
    value: str = "  Value: '"
    payload: str = "Payload: "

    @property
    def has_id(self) -> bool:
        return self.head.endswith(" ")


LAYOUT = LogLayout()

# Fixed value: the folder that a partitioned write uses for null.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def escape_log(c: Column) -> Column:
    """Backslashes and line ends as two characters, so a text stays on its line."""
    for raw, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape_log(c: Column) -> Column:
    """Inverse of ``escape_log``: doubled backslashes split the text, so no code spans one."""
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), lambda x: F.replace(
        F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))), "\\")


def level_rank(level: Column) -> Column:
    """debug < info < warn < error; unknown → null (never passes a level filter)."""
    lv = F.lower(level)
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(LEVELS))):
        rank = F.when(lv == name, F.lit(i)).otherwise(rank)
    return rank


def log_lines(df: DataFrame, level: str | Column = "info", payload: bool = False,
              min_level: str | None = None, attributes: str = ATTRIBUTES,
              record_id: str = RECORD_ID, content: str = CONTENT,
              keep: Sequence[str] = (), columns: Mapping[str, Column] | None = None,
              layout: LogLayout = LAYOUT) -> DataFrame:
    """One text block per record: head, section, sorted Key/Value pairs, payload.

    Texts are escaped (``escape_log``), so no value can pass for another line.

    Keys are sorted so the text is deterministic. ``min_level`` drops blocks
    below that level (level may be a per-row Column). With ``columns`` the
    attributes are those named columns instead of the map (same text).
    """
    lv = F.lower(F.lit(level)) if isinstance(level, str) else F.lower(level)
    rid = escape_log(F.col(record_id).cast("string"))
    # An id that begins like a head must not look like one to the block reader.
    rid = F.when(F.startswith(rid, F.lit(layout.head)), F.concat(F.lit("\\^"), rid)).otherwise(rid)
    head = [F.concat(F.lit(layout.head), rid) if layout.has_id else F.lit(layout.head), F.lit(layout.section)]
    if columns is not None:
        # Typed fast path: keys known on the driver, sorted once; a null value
        # is a missing attribute and prints nothing (no map, no lambda).
        blocks = [F.concat(F.lit(layout.key), escape_log(F.lit(k)), F.lit(f"'\n{layout.value}"),
                           escape_log(v.cast("string")), F.lit("'"))
                  for k, v in sorted(columns.items())]
        text = F.concat_ws("\n", *head, *blocks)
    else:
        # a null value is a missing attribute here as well
        pairs = F.transform(F.array_sort(F.map_entries(F.map_filter(F.col(attributes), lambda k, v: v.isNotNull()))),
                            lambda e: F.concat(F.lit(layout.key), escape_log(e["key"]), F.lit("'\n" + layout.value),
                                               escape_log(e["value"]), F.lit("'")))
        text = F.concat_ws("\n", *head, pairs)
    if payload:
        text = F.concat(text, F.lit("\n" + layout.payload), escape_log(F.coalesce(F.col(content), F.lit(""))))
    out = df.select(F.col(record_id).alias(RECORD_ID), *keep, lv.alias("level"), text.alias("line"))
    if min_level is not None:
        out = out.filter(level_rank(F.col("level")) >= LEVELS.index(min_level.lower()))
    return out


def write_log(lines: DataFrame, path: str, line: str = "line", mode: str = "append") -> None:
    """Persist log blocks as text (one block per text row; blocks span lines)."""
    lines.select(F.col(line)).write.mode(mode).text(path)


def parse_log(df: DataFrame, line: str = "line", layout: LogLayout = LAYOUT) -> DataFrame:
    """Inverse of ``log_lines``: record_id, attributes map and payload from a block.

    Only the head (text before the first payload marker) is searched for pairs,
    so payload text cannot pass for an attribute. The first of repeated keys
    counts. A layout without an id gives a null ``record_id``.
    """
    text = F.col(line)
    marker = F.instr(text, F.lit("\n" + layout.payload))
    head = F.when(marker > 0, F.substr(text, F.lit(1), marker - 1)).otherwise(text)
    pay = F.when(marker > 0, unescape_log(F.substr(text, marker + len(layout.payload) + 1)))
    # Java: (?d) makes only \n a line end
    pair_re = (f"(?dm)^{_quote(layout.key)}([^\n]*)'\n{_quote(layout.value)}([^\n]*)'$")
    attributes = first_of_keys(F.transform(F.regexp_extract_all(head, F.lit(pair_re), 1), unescape_log),
                               F.transform(F.regexp_extract_all(head, F.lit(pair_re), 2), unescape_log))
    rid = unescape_log(F.regexp_extract(head, "^" + _quote(layout.head) + r"(?:\\\^)?([^\n]*)", 1)) \
        if layout.has_id else F.lit(None).cast("string")
    return df.select(rid.alias(RECORD_ID), attributes.alias(ATTRIBUTES), pay.alias(CONTENT))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 '])", r"\\\1", text)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest-wins: one row per key, the one with the greatest ``order`` tuple.

    ``order`` should end in a unique id so ties cannot pick at random.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def store(df: DataFrame, root: str, by: str, filename: str,
          conflict: str = "replace", order: Sequence[str] = (CREATED_AT, RECORD_ID)) -> DataFrame:
    """Store records under ``root/<by>=<value>/``, one stored row per (by, filename).

    Returns the rejects (directory null, empty or the reserved name of the null
    folder, or filename null: the failure relationship). Rows are appended as
    versions; ``read_store`` resolves replace. The write is rebalanced on the
    directory: small directories share tasks, a huge one is split over several.
    """
    if conflict != "replace":
        raise ValueError(f"unsupported conflict strategy: {conflict}")
    folder = F.col(by).cast("string")
    ok = F.coalesce(folder.isNotNull() & (folder != "") & (folder != NULL_FOLDER) & F.col(filename).isNotNull(),
                    F.lit(False))
    good = latest(df.filter(ok), [by, filename], order)
    good.hint("rebalance", by).write.mode("append").partitionBy(by).parquet(root)
    return df.filter(~ok)


def read_store(spark: SparkSession, root: str, by: str, filename: str,
               order: Sequence[str] = (CREATED_AT, RECORD_ID),
               directories: Sequence[str] | None = None, by_type: str = "string") -> DataFrame:
    """What the store holds now: latest version per (directory, filename).

    Folder names are read as ``by_type`` (text by default: '01' is not 1).
    ``directories`` limits the read to those folders (partition pruning: the
    other folders are never listed into the scan)."""
    stored = _stored(spark, root, by, by_type)
    if directories is not None:
        stored = stored.filter(F.col(by).isin(list(directories)))
    return latest(stored, [by, filename], order)


def _stored(spark: SparkSession, root: str, by: str, by_type: str) -> DataFrame:
    """The stored files with the folder column's type given, not guessed from its values."""
    found = spark.read.parquet(root).schema
    fields = [f"`{f.name}` {by_type if f.name == by else f.dataType.simpleString()}" for f in found.fields]
    return spark.read.schema(", ".join(fields)).parquet(root)


def compact_store(spark: SparkSession, root: str, target: str, by: str, filename: str,
                  order: Sequence[str] = (CREATED_AT, RECORD_ID), by_type: str = "string") -> DataFrame:
    """Write the resolved store (latest version per key) to a new folder.

    Never overwrites in place: readers switch to ``target`` once it is
    complete, so a crash during compaction loses nothing.
    """
    current = read_store(spark, root, by, filename, order, by_type=by_type)
    current.hint("rebalance", by).write.mode("errorifexists").partitionBy(by).parquet(target)
    return _stored(spark, target, by, by_type)
