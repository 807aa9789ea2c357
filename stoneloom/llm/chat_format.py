"""Chat formatting by schema fingerprints.

The nested field paths of a table or of a JSON record (``messages[].role``), held to the paths
that any mapping names, are hashed; the fingerprint selects a declarative mapping that turns the
layout into canonical turns (conv_id, turn, role, text). Fields that no mapping names do not
change the fingerprint.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts get a
backslash after their first character, and strings that already look so get one more; taking one
off restores the text. Pieces stay one row for each turn, so no conversation, however long, has
to fit a task: reading back sorts pieces by conversation and turn and folds them as a stream
whose state is two digests and a few counts.

Defined results: a null text or role is empty; turns are ordered by turn (nulls first), then
role, then text; rows that agree in all count as turns each; a null conv_id is a conversation of
its own; turns of a conversation -1 in the table are of one conversation with the two that the query adds; records of unknown layout keep one row with null role and text from ``convert_json``
(so that nothing is lost silently) and raise in ``convert_table``. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Rests of the control strings by first character; no rest holds a first character, so matches can't overlap.
CONTROLS = {
    "<": ["s>", "/s>", "|im_start|>", "|im_end|>", "|endoftext|>", "|startoftext|>"],
    "[": ["INST]", "/INST]"],
}


def _patterns(extra: str) -> list[str]:
    return [f"({re.escape(a)}){extra}(\\\\*)({'|'.join(map(re.escape, rest))})" for a, rest in CONTROLS.items()]


UNESCAPE = [re.compile(p) for p in _patterns(r"\\")]

#: kind rows: one row a turn; list: an array of turns; fields: one field a turn, joined by a blank line where several are named.
MAPPINGS = [
    {"kind": "rows", "conv": "conv_id", "turn": "turn", "role": "role", "text": "text"},
    {"kind": "list", "list": "messages", "role": "role", "text": "content"},
    {"kind": "list", "list": "conversations", "role": "from", "text": "value"},
    {"kind": "list", "list": "turns", "role": "role", "text": "text"},
    {"kind": "fields", "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"kind": "fields", "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"kind": "fields", "turns": [("user", ["question"]), ("assistant", ["answer"])]},
    {"kind": "fields", "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"kind": "fields", "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"kind": "fields", "turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def mapping_paths(m: dict) -> set[str]:
    if m["kind"] == "rows":
        return {m[k] for k in ("conv", "turn", "role", "text")}
    if m["kind"] == "list":
        return {f"{m['list']}[].{m['role']}", f"{m['list']}[].{m['text']}"}
    return {f for _, fields in m["turns"] for f in fields}


KNOWN = {p for m in MAPPINGS for p in mapping_paths(m)}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths & KNOWN)).encode()).hexdigest()[:16]


BY_PRINT = {fingerprint(mapping_paths(m)): m for m in MAPPINGS}


def select_mapping(paths: set[str]) -> dict | None:
    """By fingerprint; where paths of several layouts are present, the mapping with most of them."""
    exact = BY_PRINT.get(fingerprint(paths))
    if exact:
        return exact
    return max((m for m in MAPPINGS if mapping_paths(m) <= paths), key=lambda m: len(mapping_paths(m)), default=None)


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def record_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in record_paths(v, f"{at}[]")}
    return {at}


def _role(c: Column) -> Column:
    pairs = [F.lit(x) for kv in ROLES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def convert_table(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns of a table in any known layout; ``id_col`` names its record id."""
    m = select_mapping(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping for the fields {sorted(schema_paths(df.schema))}")
    ident = F.col(id_col).cast("long").alias("conv_id")
    if m["kind"] == "rows":
        return df.select(
            ident, F.col(m["turn"]).cast("long").alias("turn"), F.col(m["role"]).alias("role"), F.col(m["text"]).alias("text")
        )
    if m["kind"] == "list":
        turns = df.select(ident, F.posexplode(m["list"]).alias("p", "m"))
        return turns.select(
            "conv_id", F.col("p").cast("long").alias("turn"), _role(F.col("m")[m["role"]]).alias("role"), F.col("m")[m["text"]].alias("text")
        )
    turns = F.array(
        *[F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *map(F.col, fields)).alias("text")) for role, fields in m["turns"]]
    )
    return df.select(ident, F.posexplode(turns).alias("p", "m")).select("conv_id", F.col("p").cast("long").alias("turn"), "m.role", "m.text")


def record_turns(record) -> list[tuple[str | None, str | None]] | None:
    m = select_mapping(record_paths(record)) if isinstance(record, dict) else None
    if m is None or m["kind"] == "rows":
        return None
    if m["kind"] == "list":
        rows = [x for x in record[m["list"]] if isinstance(x, dict)]
        return [(ROLES.get(x.get(m["role"]), x.get(m["role"])), x.get(m["text"])) for x in rows]
    return [(role, "\n\n".join(str(record[f]) for f in fields if record.get(f) not in (None, ""))) for role, fields in m["turns"]]


def convert_json(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns of JSON records whose layouts may differ from row to row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, turns, roles, texts = [], [], [], []
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = record_turns(json.loads(raw or "null"))
                except ValueError:
                    found = None
                for i, (role, text) in enumerate([(None, None)] if found is None else found):
                    ids.append(key)
                    turns.append(i)
                    roles.append(role)
                    texts.append(text if text is None or isinstance(text, str) else json.dumps(text, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(turns, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())],
                names=["conv_id", "turn", "role", "text"],
            )

    ship_package(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).alias("json"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string")


def escaped(text: Column) -> Column:
    for p in _patterns(""):
        text = F.regexp_replace(text, p, r"$1\\$2$3")
    return text


def unescaped(text: str) -> str:
    for p in UNESCAPE:
        text = p.sub(r"\1\2\3", text)
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """Canonical turns to pieces: conv_id, turn, piece, loss_start and loss_length, the span of
    code points that counts for the loss (a whole assistant text; length 0 elsewhere)."""
    role = F.coalesce("role", F.lit(""))
    # the role ends at the first line end, so line ends in it are written as \n
    head = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    text = F.coalesce("text", F.lit(""))
    parts = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), escaped(head).alias("h"), escaped(text).alias("e"))
    loss = F.col("role") == "assistant"
    return parts.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(F.lit(OPEN), "h", F.lit("\n"), "e", F.lit(CLOSE)).alias("piece"),
        F.when(loss, F.char_length("h") + len(OPEN) + 1).otherwise(0).alias("loss_start"),
        F.when(loss, F.char_length("e")).otherwise(0).alias("loss_length"),
    )


def parse_piece(piece: str) -> tuple[str, str]:
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
        raise ValueError("not a turn")
    head, _, body = piece[len(OPEN) : -len(CLOSE)].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(head))
    return role, unescaped(body)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
    out: list[tuple] = []
    key, state = None, None

    def close() -> None:
        if state:
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        for conv, piece, start, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if state is None or conv != key:
                close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_piece(piece)
            masked = unescaped(piece[start : start + length])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(masked)
            state[3].update(masked.encode())
            state[4] += len(piece)
        if len(out) > 10_000:
            yield batch()
    close()
    yield batch()


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of every conversation, from its pieces alone."""
    ship_package(pieces.sparkSession)
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "piece", "loss_start", "loss_length").mapInArrow(_fold, DIGESTS)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = convert_table(table(spark, sf_dir, "conversations"))
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    return read_back(format_turns(turns.unionByName(extra)))


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {
    "op9_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, '<|im_start|>' || role || chr(10) ||
    regexp_replace(regexp_replace(text, '(<)(\\*)(s>|/s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>)', '\1\\\2\3', 'g'),
                   '(\[)(\\*)(INST\]|/INST\])', '\1\\\2\3', 'g') || '<|im_end|>' || chr(10) AS piece
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
}
