r"""Chat records of many layouts as one reversible text format, with DataFrame functions only.

The nested field paths of a record, such as ``messages[].role``, are hashed; a
field that is null or empty of values has no path. The hash selects one of the
declared layouts, which says where ids, roles and texts are. Records come as
JSON strings, each of a layout of its own, or as typed columns.

The format writes a turn as ``### role: text</turn>`` and a line feed. Inside
roles and texts ``\`` becomes ``\\``, ``###`` becomes ``\h``, ``</turn>`` becomes
``\e``, and in roles ``:`` becomes ``\c``; so control strings stand only where the
format puts them, and ``read_turns`` gives the turns back. Each turn has its
place in the text and a span of characters to train on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import only

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
ESCAPES = [("###", "\\h"), ("</turn>", "\\e")]
TURN = "array<struct<turn:long,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a record has its turns.

    ``parts`` names turns in order, each a role and the fields whose values,
    joined by an empty line, are its text. ``items`` is an array of turns with
    the fields ``role`` and ``text``. ``pairs`` is an array of arrays of a user's
    and an assistant's text, before the parts. A ``row`` is one turn of a longer
    conversation, with fields for its id, place, role and text. ``roles``
    renames roles. Fields of ``optional`` may be absent; further fields of a record
    must be named there, as a record with other fields has another fingerprint.
    """

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    pairs: str | None = None
    row: tuple[str, str, str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        found = [f for _, fields in self.parts for f in fields] + list(self.row or ())
        if self.items:
            at, role, text = self.items
            found += [at, f"{at}[]", f"{at}[].{role}", f"{at}[].{text}"]
        if self.pairs:
            found += [self.pairs, f"{self.pairs}[]", f"{self.pairs}[][]"]
        return sorted({*found, *self.optional})

    def shapes(self) -> list[str]:
        """The path sets of all records of this layout, each as one string."""
        free = [p for p in self.paths() if p in self.optional]
        gone = [set(c) for n in range(len(free) + 1) for c in combinations(free, n)]
        return ["\n".join(p for p in self.paths() if p not in g) for g in gone]


NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn rows", row=("conv_id", "turn", "role", "text"), optional=("conv_id", "turn", "role", "text")),
    Layout("messages", items=("messages", "role", "content"), optional=("id", "source", "messages[].content")),
    Layout("from and value", items=("conversations", "from", "value"), optional=("id", "source", "conversations[].value"), roles=NAMES),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("id", "source", "system", "input")),
    Layout("prompt and response", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("id", "source", "system")),
    Layout("prompt and completion", parts=(("user", ("prompt",)), ("assistant", ("completion",))), optional=("id", "source")),
    Layout("question and answer", parts=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("id", "source", "context")),
    Layout("query with history", pairs="history", parts=(("user", ("query",)), ("assistant", ("answer",))), optional=("id", "source", "history", "history[]", "history[][]")),
)


class _Json:
    """Records as JSON strings; what is no JSON object has no paths."""

    def __init__(self, column: str):
        self.v = F.try_parse_json(F.col(column))

    def paths(self) -> Column:
        """The sorted paths, from the record's schema read as a sequence of names and brackets."""
        schema = F.regexp_replace(F.replace(F.schema_of_variant(self.v), F.lit("ARRAY<VOID>"), F.lit("ARRAY")), r"(`(?:[^`]|``)*`|[^\s<>,:`]+): VOID(, )?", "")
        tokens = F.regexp_extract_all(schema, F.lit(r"((?:`(?:[^`]|``)*`|[^\s<>,:`]+): |OBJECT<|ARRAY<|>)"))
        start = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("out"))
        inside = lambda s: F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(""))

        def step(s: Column, t: Column) -> Column:
            name = F.concat(inside(s), F.regexp_replace(t, "^`|`?: $", ""))
            field_ = F.struct(name.alias("at"), s["open"].alias("open"), F.concat(s["out"], F.array(name)).alias("out"))
            to = F.when(s["at"] == "", "").otherwise(F.concat(s["at"], F.lit(".")))
            object_ = F.struct(s["at"].alias("at"), F.concat(s["open"], F.array(to)).alias("open"), s["out"].alias("out"))
            within = F.concat(s["at"], F.lit("[]"))
            array_ = F.struct(within.alias("at"), F.concat(s["open"], F.array(within)).alias("open"), F.concat(s["out"], F.array(within)).alias("out"))
            close = F.struct(s["at"].alias("at"), F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0))).alias("open"), s["out"].alias("out"))
            return F.when(F.endswith(t, F.lit(": ")), field_).when(t == "OBJECT<", object_).when(t == "ARRAY<", array_).otherwise(close)

        return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["out"])))

    def shape(self) -> Column:
        return F.nullif(F.array_join(self.paths(), "\n"), F.lit(""))

    def value(self, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(self.v, "$." + path, kind)

    def has(self, layout: Layout) -> bool:
        return True


def _member(at, name: str):
    return lambda x: F.col(f"`{name}`") if x is None else at(x).getField(name)


def _given(at):
    return lambda x: at(x).isNotNull()


def _some(at, test):
    """Whether an element of the array passes."""
    return lambda x: F.coalesce(F.exists(at(x), lambda y: test(y)), F.lit(False))


class _Columns:
    """Records as typed columns of a table."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.found = sorted(self._walk("", schema, lambda x: x))

    def _walk(self, prefix: str, kind: T.DataType, at) -> list[tuple[str, Callable[[Column | None], Column]]]:
        """(path, whether a record has a value there); ``at`` takes what is around to the value at ``prefix``."""
        if isinstance(kind, T.ArrayType):
            inner = [(prefix + "[]", lambda x: x.isNotNull()), *self._walk(prefix + "[]", kind.elementType, lambda x: x)]
            return [(path, _some(at, test)) for path, test in inner]
        out = []
        for f in kind.fields if isinstance(kind, T.StructType) else []:
            path, own = f"{prefix}.{f.name}" if prefix else f.name, _member(at, f.name)
            out += [(path, _given(own)), *self._walk(path, f.dataType, own)]
        return out

    def shape(self) -> Column:
        return F.concat_ws("\n", *[F.when(has(None), F.lit(path)) for path, has in self.found])

    def value(self, path: str, kind: str = "string") -> Column:
        return F.col(f"`{path}`").cast(kind) if path in self.schema.names else F.lit(None).cast(kind)

    def has(self, layout: Layout) -> bool:
        return {p for p in layout.paths() if p not in layout.optional} <= {p for p, _ in self.found}


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    return reduce(lambda c, x: c.when(role == x[0], F.lit(x[1])), roles.items(), F.when(F.lit(False), role)).otherwise(role)


def _turns(source, layout: Layout) -> Column:
    """The turns of a record of this layout."""
    text = lambda *paths: F.concat_ws("\n\n", *[source.value(p) for p in paths])
    if layout.row:
        _, turn, role, own = layout.row
        return F.array(F.struct(source.value(turn, "long").alias("turn"), source.value(role).alias("role"), source.value(own).alias("text"))).cast(TURN)
    bare = [F.struct(F.lit(role).alias("role"), text(*paths).alias("text")) for role, paths in layout.parts]
    shown = [reduce(lambda a, b: a | b, [source.value(p).isNotNull() for p in paths]) for _, paths in layout.parts]
    found = F.filter(F.array(*[F.when(s, b) for s, b in zip(shown, bare)]), lambda x: x.isNotNull()) if bare else F.array().cast("array<struct<role:string,text:string>>")
    if layout.items:
        at, role, own = layout.items
        items = source.value(at, f"array<struct<`{role}`:string,`{own}`:string>>")
        found = F.transform(items, lambda x: F.struct(_renamed(x[role], layout.roles).alias("role"), x[own].alias("text")))
    if layout.pairs:
        pairs = F.coalesce(source.value(layout.pairs, "array<array<string>>"), F.array().cast("array<array<string>>"))
        both = lambda x: F.array(F.struct(F.lit("user").alias("role"), F.get(x, F.lit(0)).alias("text")), F.struct(F.lit("assistant").alias("role"), F.get(x, F.lit(1)).alias("text")))
        found = F.concat(F.flatten(F.transform(pairs, both)), found)
    return F.transform(found, lambda x, i: F.struct(i.cast("long").alias("turn"), x["role"].alias("role"), x["text"].alias("text"))).cast(TURN)


def fingerprinted(records: DataFrame, id_col: str = "conv_id", json_col: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Each record with its ``fingerprint``, the name of its ``layout`` (null if none is declared for it) and its ``turns``.

    ``json_col`` names a column of JSON strings; without it the columns
    themselves are the record. Strings that are no JSON objects or hold no values
    have neither fingerprint nor layout.
    """
    source = _Json(json_col) if json_col else _Columns(records.schema)
    usable = [x for x in layouts if source.has(x)]
    known = lambda x: F.col("fingerprint").isin(*[F.xxhash64(F.lit(s)) for s in x.shapes()])
    chosen = reduce(lambda c, x: c.when(known(x), F.lit(x.name)), usable, F.when(F.lit(False), F.lit("")))
    turns = reduce(lambda c, x: c.when(F.col("layout") == x.name, _turns(source, x)), usable, F.when(F.lit(False), F.lit(None).cast(TURN)))
    key = reduce(lambda c, x: c.when(F.col("layout") == x.name, source.value(x.row[0], "long")), [x for x in usable if x.row], F.when(F.lit(False), F.lit(None).cast("long")))
    found = records.withColumn("_shape", source.shape())
    rows = found.withColumn("fingerprint", F.when(F.col("_shape").isNotNull(), F.xxhash64("_shape"))).withColumn("layout", chosen)
    return rows.select(key.otherwise(F.col(id_col).cast("long")).alias("conv_id"), "fingerprint", "layout", turns.alias("turns"))


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in ESCAPES + ([(":", "\\c")] if role else []):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    """Pairs of backslashes are single ones; what is between them has the other codes."""

    def decoded(x: Column) -> Column:
        for plain, code in [*ESCAPES, (":", "\\c")]:
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), decoded), "\\")


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per ``conv_id`` of rows (conv_id, turn, role, text): ``formatted``, ``turn_starts`` and ``loss_spans``.

    Turns stand in the order of ``turn``, null first; equal ones by role, then
    text; repeated rows stay. ``turn_starts`` has the place of each turn's first
    character, ``loss_spans`` the start and length of its text if its role is
    trained, else length 0; both have an entry per turn. A null role or text is
    written as an empty one, and rows without an id are one conversation.
    """
    head = F.concat(F.lit(HEAD), escaped(F.coalesce("role", F.lit("")), True), F.lit(COLON))
    rows = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    size = F.length("head") + F.length("body") + len(TAIL)
    before = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long")))
    loss = F.coalesce(F.col("role").isin(*trained), F.lit(False))
    span = F.struct((F.col("start") + F.length("head")).alias("start"), F.when(loss, F.length("body")).otherwise(0).cast("long").alias("length"))
    rows = rows.select("conv_id", F.struct("start", F.concat("head", "body", F.lit(TAIL)).alias("piece"), span.alias("span")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # places ascend, so the pieces sort by them
    return grouped.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.col("t.start").alias("turn_starts"), F.col("t.span").alias("loss_spans"))


def _pieces(formatted: Column) -> Column:
    parts = F.split(formatted, TAIL)
    return F.transform(F.array(parts), lambda p: F.slice(p, 1, F.size(p) - 1))[0]  # nothing follows the last turn


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds, as an array of role and text."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(HEAD) + 1)), COLON, 1)
        text = F.substr(piece, F.length(role) + (len(HEAD) + len(COLON) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(_pieces(formatted), turn)


def read_loss(formatted: Column, turn_starts: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    zipped = F.arrays_zip(_pieces(formatted).alias("piece"), turn_starts.alias("at"), loss_spans.alias("span"))
    under = F.filter(zipped, lambda x: x["span"]["length"] > 0)
    cut = lambda x: F.substr(x["piece"], (x["span"]["start"] - x["at"] + 1).cast("int"), x["span"]["length"].cast("int"))
    return F.transform(under, lambda x: unescaped(cut(x)))


def chats(records: DataFrame, id_col: str = "conv_id", json_col: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Records of any declared layout as formatted conversations; see ``format_chats`` for the columns.

    Records of no declared layout have no turns and are left out; ``fingerprinted``
    lists them. Records that share an id are one conversation. A conversation must
    fit a row, as a document must. Other columns are ignored in JSON records'
    tables; an empty table gives an empty result.
    """
    turns = fingerprinted(records, id_col, json_col, layouts).select("conv_id", F.inline("turns"))
    return format_chats(turns, trained)


PLANTED = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all ``conversations`` and one of control strings, formatted and read back."""
    rows = only(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    out = chats(rows.unionByName(own))
    loss = F.array_join(read_loss(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans")), "")
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
filled AS (
  SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text,
         replace(replace(replace(coalesce(text, ''), '\', '\\'), '###', '\h'), '</turn>', '\e') AS body,
         replace(replace(replace(replace(coalesce(role, ''), '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS head
  FROM turns),
texts AS (
  SELECT conv_id, count(*) AS n, sum(length(head) + length(body) + 14) AS chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS lines,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), '') AS loss
  FROM filled GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars
FROM texts
"""
