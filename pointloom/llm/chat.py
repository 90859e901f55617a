"""Chat formatting of turns with typed content parts.

A turn's content is an array of parts (type, text, ref, width, height, seconds,
pages). A visitor with one method for each type flattens them in order: text
is escaped, an image, audio clip or document becomes a placeholder;
attachments record what each placeholder refers to, where it stands and how
many tokens a model expands it to.

A turn reads ``<|turn|>role<|says|>content<|end|>``. Control strings inside
texts and roles get a backslash after their first character, backslashes are
doubled, so none survives inside a text and undoing it is exact. Texts that
follow one another are escaped as one, so no control string can be put
together from several parts.

Defined cases: a null text, role or part is empty; an unknown part type
counts as text; sizes that are missing, zero, negative or not finite count one unit, so a
placeholder expands to a token at least; placeholders are never under the loss
mask; rows of a conversation are ordered by turn (nulls first), then role,
then content, so repeated rows stay and ties do not depend on chance; rows
without a conv_id are one conversation; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, narrow

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that mean something to a template or tokenizer, ours and the usual others.
CONTROLS = (TURN, SAYS, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens by expansion: square image patches, audio frames, pages.
PATCH, PATCH_TOKENS, FRAMES_A_SECOND, TOKENS_A_PAGE = 14, 1, 25, 256


_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.DOTALL)
_BACK = re.compile(r"\\(.)|(" + "|".join(map(re.escape, PLACEHOLDERS.values())) + ")", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str, placeholders: bool = True) -> str:
    """The text before ``escape``; live placeholders stay, or go."""
    return _BACK.sub(lambda m: m[1] if m[1] is not None else m[2] if placeholders else "", text)


def part_of(kind: str, **values: Column) -> Column:
    """One content part; fields that are not named are null."""
    fields = (("text", "string"), ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))
    return F.struct(F.lit(kind).alias("type"), *[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields])


def text_part(text: Column) -> Column:
    """Content of one text part."""
    return F.array(part_of("text", text=text))


def _units(value: float | None, size: float = 1) -> int:
    """Units of ``size`` that a value fills, at least 1; a value that is no finite number counts as missing."""
    return max(1, math.ceil(value / size)) if value and math.isfinite(value) else 1


class Flattener:
    """Visits the parts of one turn in order."""

    def __init__(self, start: int):
        self.pieces: list[str] = []
        self.held: list[str] = []
        self.size = start
        self.spans: list[dict] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        part = part or {}
        kind = (part.get("type") or "").lower()
        getattr(self, kind if kind in PLACEHOLDERS else "text")(part)

    def text(self, part: dict) -> None:
        self.held.append(part.get("text") or "")

    def image(self, part: dict) -> None:
        self._placed("image", part, _units(part["width"], PATCH) * _units(part["height"], PATCH) * PATCH_TOKENS)

    def audio(self, part: dict) -> None:
        self._placed("audio", part, _units((part["seconds"] or 0) * FRAMES_A_SECOND))

    def document(self, part: dict) -> None:
        self._placed("document", part, _units(part["pages"]) * TOKENS_A_PAGE)

    def _placed(self, kind: str, part: dict, tokens: int) -> None:
        self.close()
        self.attachments.append({"type": kind, "ref": part["ref"], "tokens": tokens, "at": self.size})
        self._add(PLACEHOLDERS[kind])

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def close(self) -> None:
        """The texts held so far, escaped together."""
        text, self.held = escape("".join(self.held)), []
        if text:
            self.spans.append({"start": self.size, "length": len(text)})
            self._add(text)


def formatted_turn(role: str | None, content: list | None) -> tuple[str, list, list]:
    """(formatted text, spans of its texts, attachments) of one turn."""
    head = TURN + escape(role or "") + SAYS
    flat = Flattener(len(head))
    for part in content or []:
        flat.visit(part)
    flat.close()
    return "".join([head, *flat.pieces, END]), flat.spans, flat.attachments


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))


def format_turns(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, content array<PART>) -> one row per turn, no shuffle:

    conv_id, turn, role, ``formatted``, ``loss`` (spans (start, length) of
    ``formatted`` in code points under the loss mask: the texts of trained
    roles, without placeholders), ``attachments`` (type, ref, tokens, at;
    ``at`` is the placeholder's offset in ``formatted``) and ``extra_tokens``,
    what expanding the placeholders adds beyond one token each. A
    conversation's text is its turns' ``formatted`` in order.
    """
    rows = turns.select("conv_id", "turn", "role", F.col("content").cast(f"array<{PART}>").alias("content"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            roles = batch.column(2).to_pylist()
            found = [formatted_turn(r, c) for r, c in zip(roles, batch.column(3).to_pylist(), strict=True)]
            loss = [spans if role in trained_roles else [] for role, (_, spans, _) in zip(roles, found, strict=True)]
            extra = [sum(a["tokens"] - 1 for a in attached) for _, _, attached in found]
            columns = [pa.array([f for f, _, _ in found], pa.string()), pa.array(loss, _SPANS), pa.array([a for _, _, a in found], _ATTACHED), pa.array(extra, pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["conv_id", "turn", "role", "formatted", "loss", "attachments", "extra_tokens"])

        return step

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return map_batches(rows, make, f"{keys}, formatted string, loss array<struct<start:long,length:long>>, attachments array<struct<type:string,ref:string,tokens:long,at:long>>, extra_tokens long")


def parse_turn(formatted: str, placeholders: bool = True) -> tuple[str, str]:
    """(role, content) of one formatted turn, unescaped; placeholders stay, or go."""
    inside = formatted[len(TURN) : -len(END)]
    role, _, content = inside.partition(SAYS)
    return unescape(role), unescape(content, placeholders)


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted text alone.

    Turns are dealt by conversation, sorted, and streamed through running
    hashes, so a conversation of any length takes the memory of one batch.
    (A hash of one conversation is sequential by nature; nothing else is.)
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]

    def digest(batches):
        now, started = None, False

        def closed(state):
            return [state["conv"], state["turns"], state["all"].hexdigest(), state["loss"], state["lost"].hexdigest(), state["chars"], state["attached"], state["tokens"]]

        for batch in batches:
            done = []
            for conv, text, loss, attached in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not started or now["conv"] != conv:
                    if started:
                        done.append(closed(now))
                    now, started = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": 0, "lost": hashlib.sha256(), "chars": 0, "attached": 0, "tokens": 0}, True
                role, content = parse_turn(text, placeholders=False)
                now["turns"] += 1
                now["all"].update(f"{role}\n{content}\n".encode())
                masked = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in loss)
                now["loss"] += len(masked)
                now["lost"].update(masked.encode())
                now["chars"] += len(text)
                now["attached"] += sum(text.startswith(PLACEHOLDERS[a["type"]], a["at"]) for a in attached)
                now["tokens"] += sum(a["tokens"] for a in attached)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(closed(now), kinds, strict=True)], names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    columns = ordered.select(F.col("conv_id").cast("long"), "formatted", "loss", "attachments")
    return columns.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")


def parted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with content: the text in two parts, and attachments by rule from turn and length.

    A text of a length divisible by 5 has an image before it, by 7 an audio
    clip between its halves; a turn divisible by 6 ends with a document.
    """
    text, turn = F.coalesce("text", F.lit("")), F.coalesce("turn", F.lit(1)).cast("long")
    size = F.length(text)
    half = F.floor(size / 2).cast("int")
    ref = F.concat_ws("/", "conv_id", "turn")
    image = part_of("image", ref=ref, width=28 * (1 + turn % 4), height=F.lit(14))
    audio = part_of("audio", ref=ref, seconds=size / 10.0)
    document = part_of("document", ref=ref, pages=1 + turn % 3)
    halves = part_of("text", text=F.substring(text, F.lit(1), half)), part_of("text", text=F.substring(text, half + 1, size))
    parts = F.array(F.when(size % 5 == 0, image), halves[0], F.when(size % 7 == 0, audio), halves[1], F.when(turn % 6 == 0, document))
    return turns.select("conv_id", "turn", "role", F.filter(parts, lambda p: p.isNotNull()).alias("content"))


def op7_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = narrow(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="conv_id", turn="turn", role="role", text="text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(parted(rows.unionByName(probe))))


def _sql_size(column: str) -> str:
    doubled = f"length({column}) + length({column}) - length(replace({column}, '\\', ''))"
    return doubled + "".join(f" + (length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROLS)


OP7_SQL = f"""
WITH told AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT *, substring(text, 1, length(text) // 2) AS first_half, substring(text, length(text) // 2 + 1) AS second_half,
           (length(text) % 5 = 0)::BIGINT AS image, (length(text) % 7 = 0)::BIGINT AS audio, (coalesce(turn, 1) % 6 = 0)::BIGINT AS document FROM told
), sized AS (
    SELECT *, CASE WHEN audio = 1 THEN {_sql_size("first_half")} + {_sql_size("second_half")} ELSE {_sql_size("text")} END AS size FROM turns
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN) + len(SAYS) + len(END)} + {_sql_size("role")} + size + image * {len(PLACEHOLDERS["image"])} + audio * {len(PLACEHOLDERS["audio"])} + document * {len(PLACEHOLDERS["document"])})::BIGINT AS formatted_chars,
       sum(image + audio + document)::BIGINT AS n_attachments,
       sum(image * 2 * (1 + coalesce(turn, 1) % 4) + audio * greatest(1, cast(ceil(length(text) / 10.0::DOUBLE * {FRAMES_A_SECOND}) AS BIGINT)) + document * (1 + coalesce(turn, 1) % 3) * {TOKENS_A_PAGE})::BIGINT AS expanded_tokens
FROM sized GROUP BY conv_id
"""
