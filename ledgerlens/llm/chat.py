"""Chat formatting by schema fingerprints.

Records come in several layouts (prompt and response, instruction and input,
lists of messages). A record's fingerprint is the hash of its nested field
paths that hold a value; each layout declares which paths it has and how they
become turns, so a fingerprint selects its mapping by one look-up. Tables of
one message a row become nested records first (``conversation_records``): a
system turn at the head is the record's system field, a question and its
answer are prompt and response, other conversations a list of messages. Paths that no layout names are ignored. A record whose fingerprint
no layout has gets the layout null and no turns.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control
strings inside texts are escaped reversibly: of ``<``, any number of
backslashes and ``|``, one backslash more is written, so ``<|`` occurs in the
template only, and all other text stays as it is. In roles, line ends are
written ``<n>``, and ``<``, backslashes, ``n>`` get one backslash more. The
loss mask is a list of (skip, take) characters, one pair per turn, over the
formatted text; it covers the assistants' texts.

Null texts and roles are empty. Turns with equal numbers are ordered by role
and text, null numbers first; rows with a null conversation id are one
conversation. An empty table gives an empty result. A conversation's formatted
text is one value, so it must fit one row; its rows meet in one grouped
aggregate with map-side combine, all else is done within the record. Only
DataFrame functions run here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain, combinations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TAIL = END + "\n"
ASSISTANT = "assistant"
#: Role names of the from/value layout.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Said:
    """One turn: a role and the paths whose values make up its text."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    """One turn per element of an array of structs."""

    array: str
    role: str
    text: str
    renamed: bool = False


@dataclass(frozen=True)
class Layout:
    name: str
    required: tuple[str, ...]
    turns: tuple[Said | Listed, ...]
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> list[int]:
        sets = chain.from_iterable(combinations(self.optional, k) for k in range(len(self.optional) + 1))
        return [path_hash([*self.required, *more]) for more in sets]


RECORD_LAYOUTS = (
    Layout("prompt and response", ("prompt", "response"), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",))), ("system",)),
    Layout("prompt and completion", ("prompt", "completion"), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("completion",))), ("system",)),
    Layout("instruction", ("instruction", "output"), (Said("system", ("system",)), Said("user", ("instruction", "input")), Said("assistant", ("output",))), ("input", "system")),
    Layout("question", ("question", "answer"), (Said("system", ("system",)), Said("user", ("context", "question")), Said("assistant", ("answer",))), ("context", "system")),
    Layout("messages", ("messages[].role", "messages[].content"), (Said("system", ("system",)), Listed("messages", "role", "content")), ("system",)),
    Layout("from and value", ("conversations[].from", "conversations[].value"), (Said("system", ("system",)), Listed("conversations", "from", "value", True)), ("system",)),
)


def path_hash(paths: list[str]) -> int:
    """What ``xxhash64`` gives for the sorted paths, one a line."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def field_paths(schema: T.StructType, under: str = "") -> list[str]:
    """Paths of the leaves; ``[]`` marks the elements of an array."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, under + f.name
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += field_paths(kind.elementType, path + "[].")
        elif isinstance(kind, T.StructType):
            out += field_paths(kind, path + ".")
        else:
            out.append(path)
    return out


def _at(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _present(path: str) -> Column:
    array, _, field = path.partition("[].")
    if not field:
        return _at(path).isNotNull()
    return F.coalesce(F.exists(_at(array), lambda x: x[field].isNotNull()), F.lit(False))


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...]) -> Column:
    """Hash of the paths with a value, of those that a layout names."""
    named = {p for x in layouts for p in (*x.required, *x.optional)}
    here = [p for p in sorted(field_paths(df.schema)) if p in named]
    return F.xxhash64(F.concat_ws("\n", *[F.when(_present(p), F.lit(p)) for p in here]))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _listed(listed: Listed) -> Callable[[Column], Column]:
    def turn(x: Column) -> Column:
        role = _text(x[listed.role])
        for old, new in ROLE_NAMES.items() if listed.renamed else ():
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), _text(x[listed.text]).alias("text"))

    return turn


def _turns(df: DataFrame, layout: Layout) -> Column:
    here, parts = set(field_paths(df.schema)), []
    for t in layout.turns:
        if isinstance(t, Listed):
            parts.append(F.coalesce(F.transform(_at(t.array), _listed(t)), F.array().cast("array<struct<role:string,text:string>>")))
            continue
        paths = [p for p in t.paths if p in here]
        if paths:
            turn = F.array(F.struct(F.lit(t.role).alias("role"), F.concat_ws("\n\n", *[_at(p).cast("string") for p in paths]).alias("text")))
            said = F.coalesce(*[_at(p).cast("string") for p in paths]).isNotNull()
            parts.append(F.when(said, turn).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
    return F.concat(*parts)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = RECORD_LAYOUTS) -> DataFrame:
    """``records`` with ``layout`` (name, null if there is none) and ``turns``
    (array of role, text). Columns of these names are replaced."""
    key, name, turns = fingerprint(records, layouts), F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    here = set(field_paths(records.schema))
    for x in layouts:
        if set(x.required) <= here:
            mine = key.isin(x.fingerprints())
            name, turns = F.when(mine, F.lit(x.name)).otherwise(name), F.when(mine, _turns(records, x)).otherwise(turns)
    return records.withColumns({"layout": name, "turns": turns})


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(escape(role), r"<(\\*)n>", r"<\\$1n>"), F.lit("\n"), F.lit("<n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(F.replace(role, F.lit("<n>"), F.lit("\n")), r"<\\(\\*)n>", r"<$1n>"))


def formatted(role: Column, text: Column) -> Column:
    """(body, skip, take) of one turn: its formatted text, the characters of
    its head, and of its text if the loss covers it."""
    head, said = F.concat(F.lit(START), escape_role(role), F.lit("\n")), escape(text)
    return F.struct(F.concat(head, said, F.lit(TAIL)).alias("body"), F.length(head).cast("long").alias("skip"),
                    F.when(role == ASSISTANT, F.length(said)).otherwise(0).cast("long").alias("take"), F.length(said).cast("long").alias("long"))


def conversation_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv_id, system, prompt, response, messages): one nested record a
    conversation, from one message a row. What a record does not have is null."""
    each = rows.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), _text(F.col("role")).alias("role"), _text(F.col("text")).alias("content")).alias("m"))
    held = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("all"))
    led = (F.size("all") > 1) & (F.col("all")[0]["role"] == "system")
    parts = held.select("conv_id", F.when(led, F.col("all")[0]["content"]).alias("system"), F.when(led, F.slice("all", 2, F.size("all") - 1)).otherwise(F.col("all")).alias("said"))
    pair = (F.size("said") == 2) & (F.col("said")[0]["role"] == "user") & (F.get("said", F.lit(1))["role"] == ASSISTANT)
    return parts.select("conv_id", "system", F.when(pair, F.col("said")[0]["content"]).alias("prompt"), F.when(pair, F.get("said", F.lit(1))["content"]).alias("response"),
                        F.when(~F.coalesce(pair, F.lit(False)), F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("messages"))


def format_records(records: DataFrame, layouts: tuple[Layout, ...] = RECORD_LAYOUTS) -> DataFrame:
    """``records`` with ``layout``, ``formatted`` and ``mask`` (as described on
    top; the text of a record that no layout fits is empty). Columns of these
    names, of ``turns`` and of ``t`` are replaced."""
    canon = canonical_turns(records, layouts)
    held = canon.withColumn("t", F.transform("turns", lambda x: F.struct(formatted(x["role"], x["text"]).alias("f")))).drop("turns")
    mask = F.transform("t", lambda x, k: F.struct(
        (x["f"]["skip"] + F.when(k > 0, F.lit(len(TAIL)) + F.when(F.col("t")[k - 1]["f"]["take"] == 0, F.col("t")[k - 1]["f"]["long"]).otherwise(0)).otherwise(0)).alias("skip"), x["f"]["take"].alias("take")))
    return held.withColumns({"formatted": F.array_join(F.transform("t", lambda x: x["f"]["body"]), ""), "mask": mask}).drop("t")


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv_id, layout, formatted, mask) from one message a row: nested
    records, mapped to turns by the layout that their fingerprint selects."""
    return format_records(conversation_records(rows, id_col, turn_col)).select("conv_id", "layout", "formatted", "mask")


def read_back(df: DataFrame) -> DataFrame:
    """``df`` (formatted, mask, ...) with ``turns``, as they were, and
    ``loss``, the text under the mask. A pair of the mask begins where the one
    before ends, so its text is what follows its turn's head."""
    marked = F.split("formatted", r"<\|im_start\|>")
    parts = df.withColumn("__parts", F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = x.substr(F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(TAIL))
        return F.struct(role.alias("role"), text.alias("text"))

    raw = parts.withColumn("__raw", F.transform("__parts", turn)).drop("__parts")
    loss = F.zip_with("__raw", "mask", lambda t, m: t["text"].substr(F.lit(1), m["take"].cast("int")))
    return raw.withColumns({
        "turns": F.transform("__raw", lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text"))),
        "loss": F.array_join(F.transform(loss, unescape), "")}).drop("__raw")


def with_control_conversation(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -1, whose texts are control strings."""
    text = END + START + "assistant ok"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
                                                     for k, role in enumerate(("user", ASSISTANT))])).alias("r")).select("r.*")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
