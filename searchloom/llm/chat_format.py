"""Chat formatting by schema fingerprints, in DataFrame functions only (operator 1).

The nested field paths of a record, or of a table's columns, are hashed to a
fingerprint, after paths that no layout knows are left out; so further fields do not
lose a record.  A registry from fingerprints to declarative mappings tells where the
turns are, and where in a turn its role and text.  All layouts become canonical turns,
an array of (role, text), which one template formats.

The template writes a user's turn as ``[INST] text [/INST]``, an assistant's as
``text</s>`` and any other as ``[ROLE role]text[/ROLE]``.  Inside texts and roles ``\\``,
``[`` and ``<`` become ``\\e``, ``\\b`` and ``\\l``, so no control string can occur there
and what was written can be read back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role: string, text: string>>"
#: Turns of a conversation that are gathered together before the whole is.
BLOCK = 256
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """``paths``: the field paths that a record of this layout has; ``optional``: those
    that it may have besides.  Either ``turns`` is the path of an array whose elements
    have ``role`` and ``text`` (it may be empty), or ``fields`` lists (role, field) in the
    order of the turns: null or empty ``optional`` fields are left out, and ``joined``
    fields are appended to the field before them.  A mapping with ``key`` and ``order``
    is that of a table with a row for each turn."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    joined: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    key: str = ""
    order: str = ""


RECORDS = (
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping("dialog", ("dialog", "dialog[].speaker", "dialog[].text"), "dialog", "speaker", "text"),
    Mapping("instruction", ("instruction", "output"), fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), joined=("input",), optional=("input", "system")),
    Mapping("system_instruction", ("question", "response"), fields=(("system", "system_prompt"), ("user", "question"), ("assistant", "response")), optional=("system_prompt",)),
    Mapping("prompt_completion", ("completion", "prompt"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt_response", ("prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question_answer", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
)
TABLES = (Mapping("turn_rows", ("conv_id", "role", "text", "turn"), role="role", text="text", key="conv_id", order="turn"),)


def hashed(paths) -> str:
    """The fingerprint of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def variants(m: Mapping) -> list[tuple[str, ...]]:
    """The path sets of records of a layout: with any of the optional fields; an empty
    array has no paths inside."""
    chosen = [(*m.paths, *some) for n in range(len(m.optional) + 1) for some in combinations(m.optional, n)]
    return chosen + [(m.turns,)] * bool(m.turns)


def known_paths(mappings: tuple[Mapping, ...]) -> list[str]:
    return sorted({p for m in mappings for p in (*m.paths, *m.optional)})


def registry(mappings: tuple[Mapping, ...]) -> dict[str, Mapping]:
    """Mappings by fingerprint; of two with the same the first."""
    found: dict[str, Mapping] = {}
    for m in mappings:
        for paths in variants(m):
            found.setdefault(hashed(paths), m)
    return found


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type, sorted."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return []
    found = []
    for f in kind.fields:
        own = f"{at}.{f.name}" if at else f.name
        found += [own, *schema_paths(f.dataType, own)]
    return sorted(found)


def layout_of(kind: T.StructType, mappings: tuple[Mapping, ...] = TABLES) -> Mapping | None:
    """The mapping of a table by the fingerprint of its columns."""
    known = set(known_paths(mappings))
    return registry(mappings).get(hashed(known.intersection(schema_paths(kind))))


def record_paths(record: Column) -> Column:
    """The field paths of JSON text: its keys, and those of objects and of the elements
    of arrays below them, as deep as layouts go.  Null for anything but an object."""
    fields = F.from_json(record, "map<string, string>")
    inside = F.transform(
        F.map_entries(fields),
        lambda e: F.when(e["value"].startswith("["), F.transform(F.flatten(F.transform(F.coalesce(F.from_json(e["value"], "array<map<string, string>>"), F.array()), lambda x: F.coalesce(F.map_keys(x), F.array().cast("array<string>")))), lambda k: F.concat(e["key"], F.lit("[]."), k)))
        .when(e["value"].startswith("{"), F.transform(F.map_keys(F.from_json(e["value"], "map<string, string>")), lambda k: F.concat(e["key"], F.lit("."), k)))
        .otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.concat(F.map_keys(fields), F.flatten(inside)))


def fingerprint(record: Column, mappings: tuple[Mapping, ...] = RECORDS) -> Column:
    """The hash of the known field paths of JSON text; null or invalid JSON has none."""
    known = F.array_intersect(record_paths(record), F.array(*map(F.lit, known_paths(mappings))))
    return F.sha2(F.array_join(F.array_sort(known), "\n"), 256)


def canonical_role(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(role)), role, F.lit(""))


def mapped(record: Column, m: Mapping) -> Column:
    """The canonical turns of JSON text of layout ``m``."""
    if m.turns:
        parsed = F.from_json(record, f"`{m.turns}` array<struct<`{m.role}`: string, `{m.text}`: string>>")
        return F.transform(parsed[m.turns], lambda x: F.struct(canonical_role(x[m.role]).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text")))
    parsed = F.from_json(record, ", ".join(f"`{f}` string" for _, f in m.fields))
    turns = []
    for role, field in m.fields:
        text = F.coalesce(parsed[field], F.lit(""))
        if field in m.joined:
            before = turns.pop()
            turns.append((before[0], F.when(text == "", before[1]).otherwise(F.concat(before[1], F.lit("\n\n"), text))))
        else:
            turns.append((role, text))
    every = F.array(*(F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in turns))
    return F.filter(every, lambda x: (x["role"] != "system") | (x["text"] != ""))


def canonical_from_json(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = RECORDS) -> DataFrame:
    """Adds ``layout`` (name of the mapping) and ``turns`` to rows of JSON text.

    Fields that no layout knows are ignored.  Records of no known layout, null or
    invalid ones, have null for both.
    """
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    by: dict[str, list[str]] = {}
    for key, m in registry(mappings).items():
        by.setdefault(m.name, []).append(key)
    for m in reversed(mappings):
        is_own = F.col("_fingerprint").isin(by.get(m.name, []))
        layout = F.when(is_own, m.name).otherwise(layout)
        turns = F.when(is_own, mapped(F.col(record), m)).otherwise(turns)
    return df.withColumn("_fingerprint", fingerprint(F.col(record), mappings)).withColumn("layout", layout).withColumn("turns", turns).drop("_fingerprint")


def canonical_from_table(df: DataFrame, mappings: tuple[Mapping, ...] = TABLES) -> DataFrame:
    """(conv_id, turns) from a table with a row for each turn, whose mapping is found by
    the fingerprint of its columns; other columns are ignored, an unknown layout raises.

    Turns come in their order, of equal ones by role and text; null roles and texts are
    empty, null turns come first, repeated rows are repeated turns.  Turns are gathered
    by blocks first, so a long conversation is sorted by many tasks and only whole
    blocks meet.  A conversation ends as one row, which is its bound.
    """
    m = layout_of(df.schema, mappings)
    if m is None:
        raise ValueError(f"no layout is known with the columns {df.schema.simpleString()}")
    row = F.struct(F.col(m.order).alias("turn"), F.coalesce(m.role, F.lit("")).alias("role"), F.coalesce(m.text, F.lit("")).alias("text"))
    blocks = df.groupBy(F.col(m.key).alias("conv_id"), F.floor(F.col(m.order) / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("block"), F.col("rows")))).alias("blocks"))
    return whole.select("conv_id", F.expr("transform(flatten(transform(blocks, b -> b.rows)), x -> struct(x.role AS role, x.text AS text))").alias("turns"))


def escaped(text: Column) -> Column:
    for raw, safe in (("\\", "\\e"), ("[", "\\b"), ("<", "\\l")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for raw, safe in (("[", "\\b"), ("<", "\\l"), ("\\", "\\e")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def formatted(turns: Column) -> Column:
    """The text of canonical turns."""

    def one(t: Column) -> Column:
        text = escaped(t["text"])
        return (
            F.when(t["role"] == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(t["role"] == "assistant", F.concat(text, F.lit("</s>")))
            .otherwise(F.concat(F.lit("[ROLE "), F.replace(escaped(t["role"]), F.lit("]"), F.lit("\\c")), F.lit("]"), text, F.lit("[/ROLE]")))
        )

    return F.array_join(F.transform(turns, one), "")


def loss_mask(turns: Column) -> Column:
    """Runs of the formatted text, in code points: array of (loss, chars).  The loss
    is on assistants' texts alone."""

    def one(t: Column) -> Column:
        text = F.length(escaped(t["text"]))
        run = lambda loss, chars: F.struct(F.lit(loss).alias("loss"), chars.cast("int").alias("chars"))
        role = F.length(F.replace(escaped(t["role"]), F.lit("]"), F.lit("\\c")))
        return (
            F.when(t["role"] == "assistant", F.array(run(True, text), run(False, F.lit(4))))
            .when(t["role"] == "user", F.array(run(False, text + 15)))
            .otherwise(F.array(run(False, text + role + 14)))
        )

    return F.flatten(F.transform(turns, one))


def parsed(text: Column) -> Column:
    """Canonical turns, read back from formatted text."""
    parts = F.filter(F.split(text, r"(?<=\[/INST\]|</s>|\[/ROLE\])"), lambda p: p != "")

    def one(p: Column) -> Column:
        size = F.length(p)
        close = F.locate("]", p)
        role = F.replace(unescaped(F.substring(p, F.lit(7), close - 7)), F.lit("\\c"), F.lit("]"))
        turn = lambda r, x: F.struct(r.alias("role"), unescaped(x).alias("text"))
        return (
            F.when(p.startswith("[INST] "), turn(F.lit("user"), F.substring(p, F.lit(8), size - 15)))
            .when(p.startswith("[ROLE "), turn(role, F.substring(p, close + 1, size - close - 7)))
            .otherwise(turn(F.lit("assistant"), F.substring(p, F.lit(1), size - 4)))
        )

    return F.transform(parts, one)


def under_mask(text: str = "formatted", mask: str = "loss_mask") -> Column:
    """The unescaped text under the loss, in order, nothing between."""
    cut = F.expr(f"aggregate({mask}, named_struct('at', 1, 'found', cast(array() AS array<string>)), (s, r) -> named_struct('at', s.at + r.chars, 'found', CASE WHEN r.loss THEN array_append(s.found, substring({text}, s.at, r.chars)) ELSE s.found END), s -> s.found)")
    return unescaped(F.array_join(cut, ""))


def format_chats(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` to rows with canonical ``turns``; no turns
    give empty text, null turns null."""
    return turns.withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_mask", loss_mask(F.col("turns")))


def turns_text() -> Column:
    return F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's columns of formatted conversations, read back from the output."""
    done = format_chats(canonical_from_table(conversations)).select("conv_id", "formatted", "loss_mask")
    back = done.withColumn("read", parsed(F.col("formatted"))).withColumn("loss_text", under_mask())
    return back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns_text(), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


DIGESTS_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '[', ''), '<', '')) AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(chars + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE length(role) + 14 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
