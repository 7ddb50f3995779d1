"""Chat formatting by schema fingerprints.

A record is a JSON object in any of several layouts. Its fingerprint is a hash of
its nested field paths (arrays as ``[]``; fields that no mapping names are left
out), and selects a declarative mapping: the path of the turns, and the paths of
role and text within one, or a fixed list of (role, text paths). So all layouts
become canonical turns (role, text).

A turn is written as ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and texts a
backslash is doubled, and every control string (of this template and of other
common ones) gets a backslash behind its first character; in roles a line feed gets
one in front. Removing the backslash before any character undoes both. The loss
mask covers exactly the texts of assistant turns.

Defined cases: null roles and texts count as empty; other fields are ignored. A
record whose fingerprint no mapping has gives one row with a null ``layout`` and
no text, so that none goes unnoticed. Repeated rows are turns of their own, ordered
by role and text. Turns of one conversation are streamed in order, so a
conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField

from reasonscope.llm.common import extended

START, END = "<|turn|>", "<|end|>"
# Control strings of common chat templates.
CONTROLS = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>",
            "[BOS]", "[EOS]", "[SEP]", "[CLS]", "[PAD]", "<pad>", "<bos>", "<eos>", "<unk>"]


@dataclass(frozen=True)
class Mapping:
    """``turns``: path of the list of turns ("" if the record is one turn itself), with
    ``role`` and ``text`` paths inside; or ``fixed``: (role, text paths) of the turns,
    several paths being joined by a blank line. ``optional`` paths may be absent."""
    name: str
    turns: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        if self.fixed:
            return [p for _, ps in self.fixed for p in ps]
        return [self.role, self.text] if not self.turns else [f"{self.turns}[].{p}" for p in (self.role, self.text)]


MAPPINGS = (
    Mapping("turn", turns="", role="role", text="text"),
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("from_value", turns="conversations", role="from", text="value"),
    Mapping("prompt", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt_response", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("instruction", fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
            optional=("system", "input")),
    Mapping("question", fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, path: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items()])
    if isinstance(value, list):
        return set().union(*[field_paths(v, path + "[]") for v in value])
    return {path}


def schema_fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


class Registry:
    """Mappings by the fingerprint of each set of paths they accept."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.known = {p for m in mappings for p in m.paths()}
        self.by_print: dict[str, Mapping] = {}
        for m in mappings:
            for n in range(len(m.optional) + 1):
                for absent in combinations(m.optional, n):
                    self.by_print.setdefault(schema_fingerprint(set(m.paths()) - set(absent)), m)

    def layout(self, record) -> Mapping | None:
        return self.by_print.get(schema_fingerprint(field_paths(record) & self.known))


def _at(record, path: str) -> str:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return "" if record is None else record if isinstance(record, str) else json.dumps(record, ensure_ascii=False)


def canonical(record, mapping: Mapping) -> list[tuple[str, str]]:
    """The turns of a record."""
    if mapping.fixed:
        each = [(role, [t for t in (_at(record, p) for p in paths) if t]) for role, paths in mapping.fixed]
        return [(role, "\n\n".join(texts)) for role, texts in each if texts or role != "system"]
    rows = [record] if not mapping.turns else record[mapping.turns]
    roles = ((_at(r, mapping.role), r) for r in rows)
    return [(ROLES.get(role, role) if mapping.turns else role, _at(r, mapping.text)) for role, r in roles]


_CONTROL = re.compile(f"(?={'|'.join(map(re.escape, CONTROLS))})(.)", re.S)


def escape(text: str) -> str:
    """Reversible by ``unescape``; the result holds no control string."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def written(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the bounds of its text."""
    head = START + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|))*)" + re.escape(END) + r"\n", re.S)


def parsed(turn: str) -> tuple[str, str]:
    """Role and text, read back from a formatted turn."""
    found = _TURN.fullmatch(turn)
    return unescape(found[1]), unescape(found[2])


def _turn_rows(record_col: str, mappings: tuple[Mapping, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(mappings)
        for batch in batches:
            at, new = [], []
            for i, raw in enumerate(batch.column(record_col).to_pylist()):
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                mapping = registry.layout(record)
                if mapping is None:
                    at.append(i)
                    new.append((None, 0, None, None, None, None))
                    continue
                for n, (role, text) in enumerate(canonical(record, mapping)):
                    turn, low, high = written(role, text)
                    at.append(i)
                    new.append((mapping.name, n, role, turn, *((low, high) if role == "assistant" else (None, None))))
            rest = batch.select([c for c in batch.schema.names if c != record_col]).take(pa.array(at, pa.int64()))
            columns = list(zip(*new)) or [()] * 6
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*rest.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=[*rest.schema.names, "layout", "position", "role", "formatted", "loss_start", "loss_end"])
    return run


def format_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """One row per turn: the record's other columns, ``layout``, ``position`` in the
    record, ``role``, the ``formatted`` turn, and its loss mask ``loss_start`` to
    ``loss_end`` (null outside assistant turns). ``record_col`` holds JSON."""
    added = ("layout", "position", "role", "formatted", "loss_start", "loss_end")
    rest = [f for f in records.schema.fields if f.name != record_col and f.name.lower() not in added]
    source = records.select(*[f"`{f.name}`" for f in rest], record_col)
    schema = extended(source.drop(record_col).schema, StructField("layout", StringType()), StructField("position", IntegerType()),
                      StructField("role", StringType()), StructField("formatted", StringType()),
                      StructField("loss_start", LongType()), StructField("loss_end", LongType()))
    return source.mapInArrow(_turn_rows(record_col, mappings), schema)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over turns sorted by conversation: what the formatted text says of each."""
    key, state, out = None, None, []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def closed() -> tuple:
        return key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
        for conv, turn, low, high in zip(*columns):
            if key != (conv,):
                if key is not None:
                    out.append(closed())
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if turn is None:
                continue
            role, text = parsed(turn)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if low is not None:
                said = unescape(turn[low:high])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(turn)
        if len(out) >= 4096:
            yield batch_of(out)
            out = []
    if key is not None:
        out.append(closed())
    if out:
        yield batch_of(out)


def read_back(turns: DataFrame, order: list[str]) -> DataFrame:
    """Digests of each conversation, parsed from its formatted turns in ``order``."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", *order, "position", "role", "formatted")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def table_records(conversations: DataFrame) -> DataFrame:
    """Rows of a table (conv_id, turn, role, text) as records of the turn layout."""
    record = F.to_json(F.struct("role", F.coalesce("text", F.lit("")).alias("text")), {"ignoreNullFields": "false"})
    return conversations.select("conv_id", "turn", record.alias("record"))
