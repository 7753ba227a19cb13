"""Chat data of many layouts as canonical turns, and turns as template text with a loss mask.

A layout is known by its schema fingerprint: a hash of its sorted nested field paths. The
fingerprint selects a declarative mapping, so a new layout is a new entry of ``MAPPINGS`` and no
code. A table has one fingerprint; a column of JSON records has one per row, and records of all
layouts go through one expression.

Template: ``<|turn|>role\\ntext<|end|>\\n`` per turn. Control strings inside a role or text get a mark after
their first character, and the mark itself is escaped before, so formatting is reversible. The
loss mask is a list of runs (chars, loss), three per turn: head, text, end.

Edge cases: a null role or text is empty; turns are ordered by turn, then role and text, a null turn
first; repeated rows are repeated turns; a null conv_id is a conversation; a record of an unknown
layout keeps its row with null turns; an empty table gives an empty result; further columns change
the fingerprint of a table, further fields do not change that of a record. One conversation is one value in the end, so it
has to fit into a task; many conversations never meet.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.registry import query, table
from fleetlens.session import stage

# Control strings of common chat templates.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = [TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
MARK, SELF, CUT, LINE = "\ue000", "\ue001", "\ue002", "\ue003"
TURNS = "array<struct<role:string,text:string>>"
IDS = ("conv_id", "turn")


@dataclass(frozen=True)
class Mapping:
    """Field paths of a layout, and SQL that makes ``turns`` from the parsed record ``r``."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str

    @property
    def fingerprint(self) -> str:
        return paths_fingerprint(self.paths)


def paths_fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _two(first: str, second: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {first}), named_struct('role', 'assistant', 'text', {second}))"


MAPPINGS = [
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), "conv_id long, turn long, role string, text string", "array(named_struct('role', r.role, 'text', r.text))"),
    Mapping("messages", ("messages", "messages.role", "messages.content"), "messages array<struct<role:string,content:string>>", "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Mapping("conversations", ("conversations", "conversations.from", "conversations.value"), "conversations array<struct<`from`:string,value:string>>",
            "transform(r.conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))"),
    Mapping("prompt, response", ("prompt", "response"), "prompt string, response string", _two("r.prompt", "r.response")),
    Mapping("prompt, completion", ("prompt", "completion"), "prompt string, completion string", _two("r.prompt", "r.completion")),
    Mapping("instruction, output", ("instruction", "output"), "instruction string, output string", _two("r.instruction", "r.output")),
    Mapping("instruction, input, output", ("instruction", "input", "output"), "instruction string, input string, output string",
            _two("CASE WHEN r.input IS NULL OR r.input = '' THEN r.instruction ELSE concat(r.instruction, '\\n', r.input) END", "r.output")),
    Mapping("system, prompt, response", ("system", "prompt", "response"), "system string, prompt string, response string",
            f"concat(array(named_struct('role', 'system', 'text', r.system)), {_two('r.prompt', 'r.response')})"),
]


def field_paths(schema: T.DataType, above: str = "") -> list[str]:
    """Nested field paths; an array stands for its elements."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, above)
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        path = f"{above}.{f.name}" if above else f.name
        out += [path, *field_paths(f.dataType, path)]
    return out


def record_fingerprint(record: Column) -> Column:
    """The same fingerprint of a JSON record, over the paths that mappings know. The types are those in the record,
    so a text that is JSON itself stays a text; an object or array where a mapping has a text matches nothing."""
    known = {p for m in MAPPINGS for p in m.paths}
    whole = F.try_parse_json(record)
    get = lambda key: F.try_variant_get(whole, f"$.{key}", "variant")
    none, parts = F.array().cast("array<string>"), []
    for key in sorted({p.split(".")[0] for p in known}):
        value = get(key)
        kind = F.schema_of_variant(value)
        inner = sorted(p for p in known if p.startswith(key + "."))
        if inner:
            keys = F.array_distinct(F.flatten(F.transform(F.from_json(F.to_json(value), "array<map<string,string>>"), F.map_keys)))
            deep = F.when(kind.startswith("ARRAY<"), F.array_intersect(F.transform(keys, lambda k: F.concat(F.lit(key + "."), k)), F.array(*[F.lit(p) for p in inner])))  # noqa: B023
        else:
            deep = F.when(kind.startswith("ARRAY<") | kind.startswith("OBJECT<"), F.array(F.lit(key + ".")))
        # Ids are part of a layout with a row per turn only.
        there = value.isNotNull() & get("role").isNotNull() if key in IDS else value.isNotNull()
        parts.append(F.when(there, F.concat(F.array(F.lit(key)), F.coalesce(deep, none))).otherwise(none))
    return F.sha2(F.array_join(F.array_sort(F.concat(*parts)), "\n"), 256)


def turns_of_records(df: DataFrame, record: str, to: str = "turns") -> DataFrame:
    """Adds the canonical turns of a column of JSON records, each by the mapping of its fingerprint."""
    mine = record_fingerprint(F.col(record))
    found = df.withColumn("_fingerprint", mine).withColumn("_found", F.lit(None).cast(TURNS))
    for m in MAPPINGS:
        found = found.withColumn("_r", F.when(F.col("_fingerprint") == m.fingerprint, F.from_json(F.col(record), m.schema)))
        made = F.when(F.col("_r").isNotNull(), F.expr(_on_record(m)).cast(TURNS))
        found = found.withColumn("_found", F.coalesce("_found", made))
    return found.withColumn(to, F.col("_found")).drop("_found", "_fingerprint", "_r")


def _on_record(mapping: Mapping) -> str:
    return re.sub(r"\br\.", "_r.", mapping.turns)


def turns_of_table(df: DataFrame) -> DataFrame:
    """Conversations of a typed table, by the mapping of its schema: (conv_id, turns).

    A layout with a row per turn is grouped by conv_id; others keep their rows, numbered by nothing but
    their own columns.
    """
    by = {m.fingerprint: m for m in MAPPINGS}
    mapping = by.get(paths_fingerprint(field_paths(df.schema)))
    if mapping is None:
        raise ValueError("no mapping for the layout " + ", ".join(sorted(field_paths(df.schema))))
    whole = df.withColumn("_r", F.struct(*df.columns)).withColumn("_turns", F.expr(_on_record(mapping)).cast(TURNS))
    if "turn" not in df.columns:
        return whole.select(*df.columns, F.col("_turns").alias("turns"))
    one = F.struct("turn", F.coalesce(F.col("_turns")[0]["role"], F.lit("")).alias("role"), F.coalesce(F.col("_turns")[0]["text"], F.lit("")).alias("text"))
    grouped = whole.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(MARK + SELF))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + MARK + CUT + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(MARK + CUT), F.lit(""))
    out = F.replace(out, F.lit(MARK + LINE), F.lit("\n"))
    return F.replace(out, F.lit(MARK + SELF), F.lit(MARK))


def formatted(turns: Column) -> Column:
    """Struct (text, loss_runs) of canonical turns."""
    head = lambda t: F.concat(F.lit(TURN), F.replace(escape(t["role"]), F.lit("\n"), F.lit(MARK + LINE)), F.lit("\n"))
    run = lambda chars, loss: F.struct(chars.alias("chars"), loss.alias("loss"))
    parts = F.transform(turns, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    runs = F.flatten(F.transform(parts, lambda p: F.array(run(F.length(p["head"]), F.lit(False)), run(F.length(p["body"]), p["loss"]), run(F.lit(len(END) + 1), F.lit(False)))))
    return F.struct(text.alias("text"), runs.alias("loss_runs"))


def pieces(text: Column) -> Column:
    """The template text of every turn, without its end mark."""
    every = F.split(text, "\\Q" + END + "\n\\E", -1)
    return F.slice(every, F.lit(1), F.size(every) - 1)


def parsed(text: Column) -> Column:
    """Turns read back from template text."""
    def turn(p):
        body = F.substr(p, F.lit(len(TURN) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(pieces(text), turn)


def loss_texts(text: Column, runs: Column) -> Column:
    """What lies under the loss mask, unescaped: the runs of a turn are measured along its own text."""
    def masked(p, i):
        head, body = F.get(runs, 3 * i), F.get(runs, 3 * i + 1)
        return F.when(body["loss"], unescape(F.substr(p, head["chars"] + 1, body["chars"])))

    return F.filter(F.transform(pieces(text), masked), lambda t: t.isNotNull())


def format_chats(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_runs) of a table of any known layout with a conv_id."""
    return turns_of_table(df).withColumn("_f", formatted(F.col("turns"))).select("conv_id", F.col("_f.text").alias("formatted"), F.col("_f.loss_runs").alias("loss_runs"))


TRICKY = "</s>[INST] ok [/INST]"


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, chr(57344), chr(57344) || chr(57345))"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(57344) || chr(57346) || '{c[1:]}')"
    return out


@query("op7_chat_formatting", f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(TURN) + len(END) + 2} + length(replace({_sql_escaped('role')}, chr(10), chr(57344) || chr(57347))) + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""")
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    out = stage(format_chats(rows.union(extra)), "chats")
    back = out.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_runs")), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
