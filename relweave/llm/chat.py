"""Chat formatting with schema fingerprinting.

A layout is known by the nested field paths that a record fills (``messages[].role``, ``instruction``, ...). For each declarative
mapping, which says where roles and texts lie, those of its own paths that are filled are sorted and hashed; it fits if the hash
is that of the paths it needs, with any of those it may fill. Of mappings that fit, the first in the order of ``MAPPINGS`` is taken.
All are compiled to one CASE, so a table may mix layouts. Paths that a mapping doesn't name are ignored, so extra columns change
nothing, even if another mapping names them.

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles, a backslash is put into anything that looks like
the beginning of a control string (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` and so on), which is undone exactly. The
loss mask is the text of assistant turns, given as start and length in the turn's segment.

Cases: null text and null role are empty strings; a turn row without a number is a turn after the numbered ones; in a table that
has no layout but turn rows, a row of nulls is an empty turn; a record whose paths match no mapping gives no turns (``layout`` is
null); turns with equal order are ordered by role, then text; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<turn:bigint,role:string,text:string>"


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths it must fill, those it may fill, and its turns as (role, path of the text) or one array of turns.

    ``array``, ``role``, ``text``: turns in an array of structs. ``row``: path of the turn's number, where each record is a turn.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    row: str = ""
    roles: dict = field(default_factory=dict, hash=False)


#: Other names of roles in message layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
TURN_ROWS = {"role": "role", "text": "text", "row": "turn"}
#: In order of precedence: arrays of turns, numbered turns with role or text, single exchanges, then turn rows that lack something.
MAPPINGS = (
    Mapping("messages", ("messages[].role",), ("messages[].content",), array="messages", role="role", text="content", roles=ROLES),
    Mapping("conversations", ("conversations[].from",), ("conversations[].value",), array="conversations", role="from", text="value", roles=ROLES),
    Mapping("turn rows", ("turn", "role"), ("text",), **TURN_ROWS),
    Mapping("turn rows", ("turn", "text"), **TURN_ROWS),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), turns=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("prompt and completion", ("prompt", "completion"), ("system",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", ("prompt", "response"), ("system",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", ("question", "answer"), ("context",), turns=(("user", "context+question"), ("assistant", "answer"))),
    Mapping("turn rows", ("turn",), **TURN_ROWS),
    Mapping("turn rows", ("role",), ("text",), **TURN_ROWS),
    Mapping("turn rows", ("text",), **TURN_ROWS),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(schema: T.StructType, prefix: str = "") -> Iterator[str]:
    """Nested paths of a schema; ``[]`` after an array."""
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = f"{path}[]", kind.elementType
        if isinstance(kind, T.StructType):
            yield from field_paths(kind, f"{path}.")
        else:
            yield path


def _filled(path: str) -> Column:
    """Whether a record fills the path; for a path in an array, whether any element does."""
    array, _, rest = path.partition("[].")
    quoted = lambda x: F.col(".".join(f"`{p}`" for p in x.split(".")))
    return F.exists(quoted(array), lambda x: x[rest].isNotNull()) if rest else quoted(path).isNotNull()


def record_fingerprint(df: DataFrame, mappings: Iterable[Mapping] = MAPPINGS) -> Column:
    known = {p for m in mappings for p in (*m.needs, *m.may)}
    there = sorted(known & set(field_paths(df.schema)))
    filled = F.array(*[F.when(_filled(p), F.lit(p)) for p in there]) if there else F.array().cast("array<string>")
    return F.substring(F.sha2(F.concat_ws("\n", F.array_sort(F.array_compact(filled))), 256), 1, 16)


def _turns(df: DataFrame, m: Mapping) -> Column:
    has = set(field_paths(df.schema))
    text = lambda p: F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("")) if p in has else F.lit("")
    if m.row:
        return F.array(F.struct(F.col(f"`{m.row}`").cast("long").alias("turn"), text(m.role).alias("role"), text(m.text).alias("text")))
    if m.array:
        names = F.create_map(*[F.lit(x) for kv in m.roles.items() for x in kv])
        filled = f"{m.array}[].{m.text}" in has
        return F.transform(F.col(f"`{m.array}`"), lambda x, i: F.struct(i.cast("long").alias("turn"), F.coalesce(names[x[m.role]], x[m.role], F.lit("")).alias("role"), (F.coalesce(x[m.text].cast("string"), F.lit("")) if filled else F.lit("")).alias("text")))
    out = []
    for i, (role, paths) in enumerate(m.turns):
        joined = F.concat_ws("\n", *[F.when(text(p) != "", text(p)) for p in paths.split("+")])
        turn = F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), joined.alias("text"))
        out.append(F.when(text(paths) != "", turn) if role == "system" else turn)
    return F.array_compact(F.array(*out))


def canonical(df: DataFrame, keys: Iterable[str], mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """One row per turn: the keys, layout, turn, role, text. Records of unknown layout give one row with nulls."""
    has = set(field_paths(df.schema))
    able = [m for m in mappings if {*m.needs, *filter(None, [m.row])} <= has]
    which, made, layout = [], [], []
    for i, m in enumerate(able):
        prints = [fingerprint((*m.needs, *some)) for n in range(len(m.may) + 1) for some in itertools.combinations(m.may, n)]
        which.append(F.when(record_fingerprint(df, [m]).isin(prints), F.lit(i)))
        made.append(F.when(F.col("__which") == i, _turns(df, m).cast(f"array<{TURN}>")))
        layout.append(F.when(F.col("__which") == i, F.lit(m.name)))
    if able and all(m.row for m in able):
        which.append(F.lit(len(able) - 1))
    turns = F.coalesce(F.lit(None).cast(f"array<{TURN}>"), *made)
    chosen = df.withColumn("__which", F.coalesce(F.lit(None).cast("int"), *which))
    return chosen.select(*keys, F.coalesce(F.lit(None).cast("string"), *layout).alias("layout"), F.explode_outer(turns).alias("__t")).select(*keys, "layout", "__t.*")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def segments(turns: DataFrame, keys: Iterable[str], loss_roles: Iterable[str] = ("assistant",)) -> DataFrame:
    """Canonical turns with ``segment`` (the turn as formatted) and the loss mask in it: loss_start, loss_length (code points)."""
    role, text = F.regexp_replace(F.regexp_replace(escape(F.col("role")), r"\\n", r"\\\\n"), "\n", r"\\n"), escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    return turns.where(F.col("role").isNotNull()).select(
        *keys, "layout", "turn", "role", "text",
        F.concat(head, text, F.lit(f"{END}\n")).alias("segment"), F.length(head).cast("long").alias("loss_start"),
        F.when(F.col("role").isin(*loss_roles), F.length(text)).otherwise(0).cast("long").alias("loss_length"),
    )


_CONTROL = re.compile(r"<\\(\\*)\|")
_READ = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def unescape(text: str) -> str:
    return _CONTROL.sub(r"<\1|", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted piece of whole turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _READ.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = re.sub(r"\\(\\n|n)", lambda x: "\n" if x[1] == "n" else "\\n", m[1])
        out.append((unescape(role), unescape(m[2])))
        at = m.end()
    return out


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segs: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation, from its segments read back in order: key and DIGEST.

    Segments are dealt by key and sorted on disk if need be; a task goes through them as a stream with hashes as its only state,
    so a conversation of any length takes bounded memory.
    """
    kind = dict(segs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        close = lambda: [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]
        for b in batches:
            rows = []
            for k, s, start, n in zip(b[key].astype(object), b["segment"], b["loss_start"], b["loss_length"], strict=True):
                k = None if pd.isna(k) else k
                if state is None or k != now:
                    rows += [close()] if state else []
                    now, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(s):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(s[start : start + n])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(s)
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        if state:
            yield pd.DataFrame([close()], columns=columns)

    columns = [key, *(c.split()[0] for c in DIGEST.split(", "))]
    dealt = segs.select(key, "turn", "role", "text", "segment", "loss_start", "loss_length").repartition(key).sortWithinPartitions(key, F.col("turn").asc_nulls_last(), "role", "text")
    return dealt.select(key, "segment", "loss_start", "loss_length").mapInPandas(run, f"{key} {kind}, {DIGEST}")


def oracle(control: str) -> str:
    """The digests' rows in DuckDB's SQL, for turn rows in ``conversations`` and the conversation -1 of ``control``."""
    escaped = lambda x: f"regexp_replace({x}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{control}' UNION ALL SELECT -1, 1, 'assistant', '{control}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
