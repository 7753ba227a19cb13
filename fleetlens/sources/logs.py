"""Log files to entries: four line formats, true line numbers, multi-line stitching.

Lines are shuffled once, by (file, block). What crosses block borders - line offsets
and lines that continue the entry of an earlier block - is settled on a table with one
row per block and joined back on the same keys, so a huge file is never one task. Entries
are made of pieces of bounded size, numbered by running counts over blocks; those that are too
large to be one value stay in pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage, stage
from fleetlens.sources.fleet import Fleet

# Levels, patterns and limits of the formats.
LEVELS = "INFO|WARN|ERROR|DEBUG|TRACE|FATAL"
CSV_LEVELS = ["INFO", "WARN", "WARNING", "ERROR", "ERR", "DEBUG", "TRACE", "FATAL", "CRITICAL"]
MAIN_LOG = "redpanda.log"
MIN_STANDARD = 25
RFC3339 = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\z"
ZONED = r"\A(\d{4}-\d\d-\d\d) (\d\d:\d\d:\d\d(?:\.\d+)?) ([+-]\d\d)(\d\d) [A-Z]+\z"

_STANDARD_HEAD = rf"\A[\uFEFF ]*(?:{LEVELS}) +.{{4}}-..-.."
_STANDARD = rf"(?s)\A[\uFEFF ]*({LEVELS}) +(.{{4}}-..-..(?:[ T][^ \[]*)?) *(?:\[shard([^\]]*)\])? *(.*)\z"
_MARK = "\u0001"
ENTRY = "struct<level:string,ts:timestamp,shard:string,component:string,message:string>"


def decode_line(value: Column) -> Column:
    """Text of a line, also of UTF-16LE files, with a trailing CR removed.

    Cut at LF bytes, a UTF-16LE file gives a first line that starts with its mark FF FE and
    further lines that start with the zero byte of the line end. No text line starts so,
    hence the encoding is known from the line itself and files stay splittable.
    """
    raw = value.cast("binary")
    first = F.substring(raw, 1, 2) == F.lit(bytearray(b"\xff\xfe"))
    later = value.startswith("\x00")
    skip = F.when(first, 2).otherwise(1)
    even = (F.octet_length(raw) - skip) % 2 == 0
    wide = F.decode(F.substring(raw, skip + 1, F.octet_length(raw)), "UTF-16LE")
    text = F.when((first | later) & even, wide).otherwise(value)
    return F.when(value.endswith("\r") | first | later, F.regexp_replace(text, r"\r\z", "")).otherwise(value)


def _entry(level, ts, shard, component, message) -> Column:
    return F.struct(
        level.alias("level"), ts.alias("ts"), shard.cast("string").alias("shard"),
        component.alias("component"), message.alias("message"),
    )


def rfc3339(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


def standard_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with a fraction of any length, cut or filled to millis."""
    whole = (F.length(text) == 19) | F.substring(text, 20, 1).isin(",", ".")
    spelled = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8), F.lit("."), F.rpad(F.substring(text, 21, 3), 3, "0"))
    return F.when(whole, spelled.try_cast("timestamp"))


def _standard_parts(line: Column) -> Column:
    """[level, time, shard, rest] by one pass of the pattern; fewer parts if it fails."""
    long_enough = (F.octet_length(line) >= MIN_STANDARD) & (F.octet_length(F.ltrim(line, F.lit("\ufeff "))) >= MIN_STANDARD)
    # A line that does not match comes back as it is, which the mark tells; only a line that
    # has the mark itself needs the pattern twice.
    marked = F.regexp_replace(line, _STANDARD, _MARK.join(("$1", "$2", "$3", "$4")))
    plain = ~F.contains(line, F.lit(_MARK)) | line.rlike(_STANDARD_HEAD)
    return F.when(long_enough & plain, F.split(marked, _MARK, 4))


def _is_standard(parts: Column) -> Column:
    return F.coalesce(F.size(parts) == 4, F.lit(False))


def _standard_entry(p: Column) -> Column:
    rest = p[3]
    dash, space = F.instr(rest, " - "), F.instr(rest, " ")
    component = F.when(dash > 0, F.substring(rest, F.lit(1), dash - 1)).otherwise(F.substring_index(rest, " ", 1))
    start = F.when(dash > 0, dash + 3).when(space > 0, space + 1).otherwise(F.length(rest) + 1)
    shard = F.substring_index(F.substring_index(F.ltrim(p[2], F.lit(": ")), ":", 1), " ", 1)
    message = F.btrim(F.substring(rest, start, F.length(rest)), F.lit(" \t\r\n"))
    return _entry(p[0], standard_time(F.trim(p[1])), F.nullif(shard, F.lit("")), F.trim(component), message)


def _named(value: Column, build) -> Column:
    """``build`` over one evaluation of ``value``, inside a single expression."""
    return F.transform(F.array(value), build)[0]


def parse_standard_line(line: Column) -> Column:
    """``LEVEL time [shard n:group] component - message``."""
    return _named(_standard_parts(line), lambda p: F.when(_is_standard(p), _standard_entry(p)))


K8S_HEAD = r"\A.{10}T.{8}Z"


def _k8s_entry(line: Column) -> Column:
    rest = F.substring(line, F.lit(21), F.length(line))
    named = F.regexp_extract(rest, r'level=(?:"([^"]+)|([^" ][^ ]*))', 0)
    value = F.upper(F.regexp_replace(named, r'\Alevel="?', ""))
    level = F.when(named == "", F.lit("INFO")).otherwise(value)
    return _entry(level, rfc3339(F.substring(line, 1, 20)), F.lit(None), F.lit("k8s-sidecar"), F.btrim(rest, F.lit(" \t\r\n")))


def parse_k8s_line(line: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ ... level=x ...``."""
    return F.when(line.rlike(K8S_HEAD), _k8s_entry(line))


def _json_doc(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(" \t\r\n"))
    return F.when(trimmed.startswith("{") & trimmed.endswith("}"), F.from_json(trimmed, "map<string,string>"))


def _json_entry(doc: Column, line: Column) -> Column:
    def pick(*names: str, default) -> Column:
        return F.coalesce(*[F.nullif(doc[n], F.lit("")) for n in names], default)

    return _entry(
        F.upper(pick("level", default=F.lit("INFO"))), rfc3339(pick("ts", "timestamp", default=F.lit(""))), F.lit(None),
        pick("logger", "component", default=F.lit("sidecar")), pick("msg", "message", default=F.btrim(line, F.lit(" \t\r\n"))),
    )


def parse_json_line(line: Column) -> Column:
    """One object per line; level, ts or timestamp, msg or message, logger or component."""
    return _named(_json_doc(line), lambda doc: F.when(doc.isNotNull(), _json_entry(doc, line)))


def parse_csv_line(line: Column) -> Column:
    """Free columns: the first that looks like a time, a level, the longest rest."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(?:"(?:[^"]|"")*"|[^,]*)'), F.lit(0))
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.substring(c, F.lit(2), F.length(c)), r'(?s)\A"(.*)"\z', "$1"), '""', '"')
    fields = F.transform(quoted, cell)
    timed = r"(?s)\A.{4}-.{2}-.{2}[T ].{8}"

    def build(f: Column) -> Column:
        at = F.array_position(F.transform(f, lambda x: x.rlike(timed)), True)
        is_level = F.transform(f, lambda x, i: (i + 1 != at) & F.upper(x).isin(CSV_LEVELS))
        level_at = F.array_position(is_level, True)
        rest = F.filter(f, lambda x, i: (i + 1 != at) & ((level_at == 0) | (i + 1 != level_at)))
        longest = F.array_max(F.transform(rest, lambda x: F.octet_length(x)))
        message = F.coalesce(F.get(F.filter(rest, lambda x: F.octet_length(x) == longest), F.lit(0)), F.lit(""))
        ts = F.get(f, at.cast("int") - 1)
        spaced = F.regexp_replace(ts, ZONED, "$1T$2$3:$4")
        level = F.when(level_at > 0, F.upper(F.get(f, level_at.cast("int") - 1))).otherwise("INFO")
        entry = _entry(level, rfc3339(spaced), F.lit(None), F.lit("csv-export"), message)
        return F.when((at > 0) & (F.size(f) >= 2), entry)

    return _named(fields, build)


def with_head(lines: DataFrame, csv: bool = False) -> DataFrame:
    """Adds ``head``: the entry that a line opens, or NULL for a line that continues one.

    The pattern's parts and the JSON document are columns of their own, so that each is
    computed once and everything stays in generated code.
    """
    line = F.col("line")
    if csv:
        return lines.withColumn("head", parse_csv_line(line))
    staged = lines.withColumn("_std", _standard_parts(line))
    staged = staged.withColumn("_doc", F.when(~_is_standard(F.col("_std")), _json_doc(line)))
    head = (
        F.when(_is_standard(F.col("_std")), _standard_entry(F.col("_std")))
        .when(line.rlike(K8S_HEAD), _k8s_entry(line))
        .when(F.col("_doc").isNotNull(), _json_entry(F.col("_doc"), line))
    )
    return staged.withColumn("head", head).drop("_std", "_doc")


def scan_lines(fleet: Fleet, logs_only: bool = False, csv: bool = False) -> DataFrame:
    """(file_path, block, pos, line) of all log files: the main log and ``logs/``, or every
    top-level file. CSV files, known by their name, are read apart."""
    kind, names = ("*.csv", "*.{csv,CSV}") if csv else ("*", "*.{log,txt,LOG,TXT}")
    nested = fleet.raw_lines("logs", recursive=True, name_glob=names)
    if logs_only:
        top = fleet.raw_lines(kind)
        top = top if csv else top.filter(~F.col("file_path").endswith(".csv"))
    elif csv:
        top = nested.limit(0)
    else:
        top = fleet.raw_lines(MAIN_LOG)
    lines = top.unionByName(nested)
    return lines.select("file_path", "block", "pos", decode_line(F.col("value")).alias("line"))


def file_names(fleet: Fleet):
    """Adds bundle_id and node (the file's stem) to rows with a ``file_path``."""

    def name(df: DataFrame) -> DataFrame:
        path = F.col("file_path")
        stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*\z", "")
        return df.withColumns({"bundle_id": fleet.bundle_of(path), "node": stem})

    return name


BLOCK = ["file_path", "block"]
#: Text of one entry is cut after so many bytes, at the end of a line; parts are joined up to the second bound.
PIECE_BYTES, ENTRY_BYTES = 1 << 20, 16 << 20


def entries_by_block(lines: DataFrame, csv: bool = False, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Entries as far as one block shows them, in pieces of some ``piece_bytes``; entry 0 is what precedes its first header.

    Columns: block_lines and block_entries of the block; n, bytes, raw of the piece; the header's fields on piece 0,
    where ``text`` is the message's part of the piece (on others it is the raw text).
    """
    kept = F.length("line") >= 1
    # Shuffled as plain text and parsed behind the shuffle, whose partitioning the windows,
    # the aggregation and the joins below all share.
    placed = lines.repartition(*BLOCK).select("file_path", "block", "pos", F.when(kept, F.col("line")).alias("line"))
    parsed = with_head(placed, csv)
    opens = F.col("head").isNotNull().cast("bigint")
    ordered = Window.partitionBy(*BLOCK).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*BLOCK)
    size = F.coalesce(F.octet_length("line") + 1, F.lit(0)).cast("bigint")
    local = parsed.withColumns(
        {
            "n": F.row_number().over(ordered).cast("bigint"),
            "entry": F.sum(opens).over(ordered),
            "block_lines": F.count("*").over(whole),
            "block_entries": F.sum(opens).over(whole),
            "before": F.sum(size).over(ordered) - size,
        }
    )
    # Bytes of the block before the entry began; an entry's piece is told by where in it a line begins.
    began = F.coalesce(F.last(F.when(F.col("head").isNotNull(), F.col("before")), ignorenulls=True).over(ordered), F.lit(0).cast("bigint"))
    local = local.withColumn("piece", F.floor((F.col("before") - began) / piece_bytes))
    number = F.when(F.col("line").isNotNull(), F.col("n"))
    grouped = local.groupBy(*BLOCK, "entry", "piece").agg(
        F.max("block_lines").alias("block_lines"), F.max("block_entries").alias("block_entries"), F.min(number).alias("n"), F.sum(size).alias("bytes"),
        F.first("head", ignorenulls=True).alias("head"),
        F.collect_list(F.when(F.col("line").isNotNull(), F.struct("n", "line"))).alias("body"),
    )
    alone = F.size("body") == 1
    lines_of = F.transform(F.sort_array("body"), lambda b: b["line"])
    raw = F.when(alone, F.col("body")[0]["line"]).otherwise(F.array_join(lines_of, "\n"))
    rest = F.slice(lines_of, F.lit(2), F.greatest(F.size("body") - 1, F.lit(0)))
    message = F.when(alone, F.col("head.message")).otherwise(F.array_join(F.concat(F.array("head.message"), rest), "\n"))
    filled = F.size("body") > 0
    return grouped.select(
        *BLOCK, "entry", "piece", "block_lines", "block_entries", "n", "bytes", "head.level", "head.ts", "head.shard", "head.component",
        F.when(filled, F.when(F.col("head").isNotNull(), message).otherwise(raw)).alias("text"), F.when(filled, raw).alias("raw"),
    )


def _block_table(entries: DataFrame, name) -> DataFrame:
    """One row per block, without any text: lines before it, bundle, node and number of its file; the block
    whose last entry its leading lines continue (``owner``; -1: none, they are an entry of their own) and that entry's
    number; how many pieces of that entry lie before them; whether later blocks continue its own last entry."""
    lead, last = F.col("entry") == 0, (F.col("entry") > 0) & (F.col("entry") == F.col("block_entries"))
    held = F.col("raw").isNotNull()
    count = lambda what: F.sum(F.when(what & held, 1).otherwise(0)).cast("bigint")
    blocks = entries.groupBy(*BLOCK).agg(
        F.max("block_lines").alias("lines"), F.max("block_entries").alias("entries"), count(lead).alias("lead_pieces"), count(last).alias("last_pieces"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = name(blocks.select("file_path").distinct()).withColumn(
        "file_no", F.row_number().over(Window.partitionBy("bundle_id").orderBy("file_path")).cast("bigint")
    )
    of_owner = lambda c: F.last(F.when(F.col("entries") > 0, F.col(c)), ignorenulls=True).over(before)
    none = F.lit(0).cast("bigint")
    blocks = blocks.withColumns({
        "offset": F.coalesce(F.sum("lines").over(before), none), "owner": F.coalesce(of_owner("block"), F.lit(-1).cast("bigint")),
        "owner_entry": F.coalesce(of_owner("entries"), none), "owner_pieces": F.coalesce(of_owner("last_pieces"), none)})
    chain = Window.partitionBy("file_path", "owner").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("pieces_before", F.col("owner_pieces") + F.coalesce(F.sum("lead_pieces").over(chain), none))
    continued = blocks.filter("owner >= 0 AND lead_pieces > 0").select("file_path", F.col("owner").alias("block"), F.lit(True).alias("continued")).distinct()
    # Rows per block and per file: few bytes when shuffled, too many to broadcast for a large fleet.
    return blocks.join(continued, BLOCK, "left").join(files.hint("merge"), "file_path").select(
        *BLOCK, "offset", "owner", "owner_entry", "pieces_before", "continued", "bundle_id", "node", "file_no")


def stitch(entries: DataFrame, name, materialize: bool = False, piece_bytes: int = PIECE_BYTES, entry_bytes: int = ENTRY_BYTES) -> DataFrame:
    """Entries of whole files: line numbers over blocks, and continuations over borders.
    ``name`` adds bundle_id and node to a table of file paths.

    An entry that lies in one piece of one block passes as it is. The pieces of any other are joined where they have
    ``entry_bytes`` together at most. A larger entry stays in rows of one piece each, in order of ``piece``
    (0 for all other rows): each has the header's level, time, shard and component and the number of its own first line, and
    no task ever holds the whole.
    """
    blocks = _block_table(entries, name)
    blocks = cut_lineage(blocks) if materialize else blocks
    file_columns = ["bundle_id", "node", "file_no"]
    placed = entries.filter(F.col("raw").isNotNull()).join(blocks.hint("merge"), BLOCK)
    lead = F.col("entry") == 0
    last = F.coalesce("continued", F.lit(False)) & (F.col("entry") == F.col("block_entries"))
    apart = lead | (F.col("piece") > 0) | (F.col("bytes") >= piece_bytes) | last
    line_number = (F.col("offset") + F.col("n")).alias("line_number")
    simple = placed.filter(~apart).select(
        *file_columns, "file_path", line_number, "level", "ts", "shard", "component", F.col("text").alias("message"), "raw", F.lit(0).cast("bigint").alias("piece"))

    head = F.when(F.col("level").isNotNull(), F.struct("level", "ts", "shard", "component"))
    pieces = placed.filter(apart).select(
        *file_columns, "file_path", F.when(lead, F.col("owner")).otherwise(F.col("block")).alias("_block"), F.when(lead, F.col("owner_entry")).otherwise(F.col("entry")).alias("_entry"),
        line_number, (F.col("piece") + F.when(lead, F.col("pieces_before")).otherwise(0)).alias("piece"), "bytes", head.alias("head"), F.col("text").alias("message"), "raw")
    key = ["file_path", "_block", "_entry"]
    pieces = stage(pieces, "entry-pieces") if materialize else pieces
    sizes = pieces.groupBy(*key).agg(F.sum("bytes").alias("_bytes"), F.first("head", ignorenulls=True).alias("_head"))
    sized = pieces.join(sizes, key)
    small, large = F.col("_bytes") <= entry_bytes, F.col("_bytes") > entry_bytes
    default = lambda field, value: F.coalesce(F.col(f"_head.{field}"), value).alias(field)
    fields = [default("level", F.when(F.col("_head").isNull(), "INFO")), F.col("_head.ts").alias("ts"), F.col("_head.shard").alias("shard"), default("component", F.when(F.col("_head").isNull(), "stdout"))]
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", c))), lambda x: x[c]), "\n").alias(c)
    joined = sized.filter(small).groupBy(*key).agg(
        *[F.min(c).alias(c) for c in file_columns], F.min("line_number").alias("line_number"), ordered("message"), ordered("raw"), F.first("_head").alias("_head"))
    joined = joined.select(*file_columns, "file_path", "line_number", *fields, "message", "raw", F.lit(0).cast("bigint").alias("piece"))
    cut = sized.filter(large).select(*file_columns, "file_path", "line_number", *fields, "message", "raw", "piece")
    both = simple.unionByName(joined).unionByName(cut)
    # Unique and in line order within a bundle: file number above 40 bits of line number.
    return both.select(
        "bundle_id", (F.shiftleft("file_no", 40) + F.col("line_number")).alias("id"), "ts", "level", "node", "shard", "component", "message",
        "raw", "line_number", "file_path", "piece",
    )


def scan_logs(
    fleet: Fleet, logs_only: bool = False, materialize: bool = True, piece_bytes: int = PIECE_BYTES, entry_bytes: int = ENTRY_BYTES
) -> DataFrame:
    """Log entries (bundle_id, id, ts, level, node, shard, component, message, raw,
    line_number, file_path, piece) of all bundles; ``piece`` is over 0 for the further rows of an entry of over
    ``entry_bytes`` bytes.

    With ``materialize`` the entries by block are written once to the shared folder, so
    the text is read, shuffled and parsed once; the block table then reads a few narrow
    columns of it. Without it the plan is lazy and parses once per use.
    """
    entries = entries_by_block(scan_lines(fleet, logs_only), piece_bytes=piece_bytes)
    entries = entries.unionByName(entries_by_block(scan_lines(fleet, logs_only, csv=True), csv=True, piece_bytes=piece_bytes))
    return stitch(stage(entries, "log-entries") if materialize else entries, file_names(fleet), materialize, piece_bytes, entry_bytes)
