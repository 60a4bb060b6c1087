"""Chat formatting: a finite-state machine over roles and a declarative template, in SQL functions.

Each role of the template has an opening and a closing mark and says whether its text counts
for the loss; roles that it doesn't know get a generic mark with their name. Inside texts the
first character of every mark is written as an entity, so a text can't contain a mark, and the
escape is undone exactly. A conversation is a list of segments (text, loss); its formatted form is
their concatenation.

The machine starts in ``start`` and takes one transition a turn; a turn without a transition
makes the conversation invalid and is reported. Invalid conversations are formatted, too: it
is for the caller to drop them.

Nulls: a null text is the empty text, a null role the empty role; rows without a conv_id form
one conversation with a null id. Turns with equal numbers go by role, then text; repeated rows
are repeated turns; a null turn number comes first. A conversation without rows doesn't exist,
so an empty table gives an empty result. Further columns are not read. A conversation, however
long, is one output row, so its turns meet in one task; turns of different conversations
never do more than share a partition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks and loss flags by role, and the transitions of the machine."""

    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<s>", "</s>", True),
        }
    )
    generic: tuple[str, str, str] = ("<|role:", "|>", "<|end|>")
    #: In this order when escaping, the other way round when reading.
    entities: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )


def escape(text: Column, template: Template) -> Column:
    for plain, entity in template.entities:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column, template: Template) -> Column:
    for plain, entity in reversed(template.entities):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _by_role(role: Column, pick, other: Column, template: Template) -> Column:
    out = None
    for name, marks in template.roles.items():
        out = F.when(role == name, F.lit(pick(marks))) if out is None else out.when(role == name, F.lit(pick(marks)))
    return other if out is None else out.otherwise(other)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, segments (text, loss), formatted, valid, bad_turn (from 0, null if none)."""
    template = template or Template()
    before, behind, end = template.generic
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        generic = F.concat(F.lit(before), escape(t["role"], template), F.lit(behind))
        parts = (
            (_by_role(t["role"], lambda m: m[0], generic, template), F.lit(False)),
            (escape(t["text"], template), _by_role(t["role"], lambda m: m[2], F.lit(False), template)),
            (_by_role(t["role"], lambda m: m[1], F.lit(end), template), F.lit(False)),
        )
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])

    steps = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\n{role}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(steps, F.concat(acc["state"], F.lit("\n"), t["role"]))
        bad = F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"]))
        return F.struct(F.coalesce(to, t["role"]).alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", segments)).alias("segments"), F.aggregate("turns", start, step)["bad"].alias("bad_turn"))
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Add ``read``, the turns (role, text) found in the formatted text, and ``loss_text``.

    Both come from ``segments``: the turns from their texts joined, which is the formatted text,
    and the loss from the texts under their flags.
    """
    template = template or Template()
    before, behind, _ = template.generic
    quote = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    opens = "|".join([*(quote(m[0]) for m in template.roles.values()), quote(before) + r"[^<\[|]*" + quote(behind)])
    pattern = F.lit(rf"({opens})([^<\[|]*)")
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    marks = F.regexp_extract_all(whole, pattern, F.lit(1))
    texts = F.regexp_extract_all(whole, pattern, F.lit(2))

    def turn(mark: Column, text: Column) -> Column:
        role = unescape(F.substring(mark, F.lit(len(before) + 1), F.length(mark) - len(before) - len(behind)), template)
        for name, m in template.roles.items():
            role = F.when(mark == m[0], F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    pairs = F.arrays_zip(marks.alias("m"), texts.alias("t"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return formatted.withColumn("read", F.transform(pairs, lambda p: turn(p["m"], p["t"]))).withColumn("loss_text", loss)


def chat_digest(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Format, read back, and digest what was read."""
    read = read_chats(format_chats(turns, template), template)
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: The conversation that carries the template's own marks in its texts.
MARKED = "</s>[INST] ok [/INST]"


def with_marked(turns: DataFrame) -> DataFrame:
    """``turns`` with conversation -1, whose texts hold control strings."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = turns.sparkSession.sql(f"select * from values (-1L, 0L, 'user', '{MARKED}'), (-1L, 1L, 'assistant', '{MARKED}') as t(conv_id, turn, role, text)")
    return rows.unionByName(more)


def oracle(template: Template | None = None) -> str:
    """DuckDB SQL for the digest of ``conversations``, written from what a digest means."""
    template = template or Template()
    roles = template.roles
    marks = " ".join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b, _) in roles.items())
    generic = sum(map(len, template.generic))

    def grown(text: str) -> str:
        return f"length({text}) + " + " + ".join(f"{len(e) - 1} * (length({text}) - length(replace({text}, '{p}', '')))" for p, e in template.entities)

    loss = ", ".join(f"'{r}'" for r, m in roles.items() if m[2])
    allowed = ", ".join(f"'{a}>{b}'" for a, b in template.transitions)
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{MARKED}' union all select -1, 1, 'assistant', '{MARKED}'),
turns as (
  select *, coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text), 'start') as before from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role in ({loss})), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role in ({loss})), '')) as loss_sha256,
  cast(sum({grown("text")} + case role {marks} else {generic} + {grown("role")} end) as bigint) as formatted_chars,
  bool_and(before || '>' || role in ({allowed})) as valid
from turns group by conv_id"""
