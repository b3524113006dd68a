"""Chat formatting with a grammar round trip: what is rendered is parsed again and must give the source back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ref, table

# The template's marks and the other control strings that no text may show as they are.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join(sorted(("".join(c if c.isalnum() else "\\" + c for c in s[1:]) for s in CONTROL), key=len, reverse=True))
#: A backslash run after a control string's first character belongs to the escape.
_CONFLICT = rf"([<\[])(\\*)({_TAILS})"
_RAW = rf"[<\[](?:{_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"


def escaped(text: Column) -> Column:
    """One backslash more after the first character of each control string, escaped ones included."""
    return F.regexp_replace(text, _CONFLICT, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escaped_role(role: Column) -> Column:
    """A role must end with its line: a backslash becomes two, a line break a backslash and n."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """Pairs are read from the left: what stands between double backslashes has only line breaks to restore."""
    return unescaped(F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))


def _render(turns: Column, escape) -> Column:
    """escape: for a turn, whether it is escaped."""
    own = lambda t: F.when(escape(t), F.concat(escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]))).otherwise(F.concat(t["role"], F.lit("\n"), t["text"]))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), own(t), F.lit(CLOSE))), "")


def _pieces(formatted: Column) -> Column:
    """What stands before each end mark."""
    all_ = F.split(formatted, r"<\|im_end\|>", -1)
    return F.slice(all_, 1, F.size(all_) - 1)


def well_formed(formatted: Column) -> Column:
    """Whether the text is of the grammar (OPEN role newline text CLOSE)*, with no control string in role or text."""
    body = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
    good = lambda p: p.startswith(OPEN) & F.contains(p, F.lit("\n")) & ~F.rlike(body(p), F.lit(_RAW))
    return ((formatted == "") | formatted.endswith(CLOSE)) & F.forall(_pieces(formatted), good)


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation: array<struct<role, text>>; null if the text isn't of the grammar."""
    head = lambda p: F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), "\n", 1)
    turns = F.transform(_pieces(formatted), lambda p: F.struct(
        unescaped_role(head(p)).alias("role"),
        unescaped(F.substring(p, F.length(head(p)) + len(OPEN) + 2, F.length(p))).alias("text"),
    ))
    return F.when(well_formed(formatted), turns)


def loss_spans(formatted: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """array<struct<start, length>>: where in the rendered text (code points, from 0) the trained texts stand."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state, p):
        head = F.length(F.substring_index(p, "\n", 1)) + 1
        own = F.array(F.struct((state["at"] + head).alias("start"), (F.length(p) - head).alias("length")))
        role = unescaped_role(F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), "\n", 1))
        return F.struct((state["at"] + F.length(p) + len(CLOSE)).alias("at"), F.when(role.isin(*roles), F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(_pieces(formatted), start, step)["spans"]


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, formatted, escaped (how many turns), round_trip, turns and loss_spans.

    Turns that hold a control string, or an escaped one, or whose role has a line break or backslash are escaped, the others are
    rendered as they are; the result is parsed again by the grammar, which rejects control strings inside texts, and compared
    with the source turn by turn. If it gives other turns, all are escaped and parsed once more.
    round_trip says whether the turns came back; if they never did, formatted is null. Null texts and roles
    are empty; line breaks in roles are escaped; very long texts are kept whole. Equal turn numbers are ordered by
    role and text, so repeated rows stand side by side; a null conv_id is a conversation of its own, null turns come first.
    Other columns are ignored, whatever their names; no rows give none. A conversation is one row of the
    result, so its turns are gathered in one task by need; nothing else is.
    """
    own = F.struct(ref(turn).alias("turn"), F.coalesce(ref(role), F.lit("")).alias("role"), F.coalesce(ref(text), F.lit("")).alias("text"))
    chats = rows.select(ref(conv_id).alias("conv_id"), own.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    conflict = lambda t: F.rlike(F.concat(t["role"], F.lit("\n"), t["text"]), F.lit(_CONFLICT)) | F.rlike(t["role"], F.lit(r"[\n\\]"))
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), conflict(t).alias("conflict")))
    chats = chats.select("conv_id", source.alias("s")).withColumn("source", F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    chats = chats.withColumn("escaped", F.size(F.filter("s", lambda t: t["conflict"])))
    chats = chats.withColumn("first", _render(F.col("s"), lambda t: t["conflict"])).withColumn("found", parsed(F.col("first")))
    came = F.col("found").eqNullSafe(F.col("source"))
    chats = chats.select("conv_id", "source", F.when(came, F.col("escaped")).otherwise(F.size("s")).alias("escaped"), F.when(came, F.col("first")).otherwise(_render(F.col("s"), lambda t: F.lit(True))).alias("formatted"))
    chats = chats.withColumn("turns", parsed(F.col("formatted"))).withColumn("round_trip", F.col("turns").eqNullSafe(F.col("source")))
    formatted = F.when(F.col("round_trip"), F.col("formatted"))
    return chats.select("conv_id", formatted.alias("formatted"), F.col("escaped").cast("long").alias("escaped"), "round_trip", "turns", loss_spans(formatted).alias("loss_spans"))


def op5(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = format_chats(rows.unionByName(extra))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return chats.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle_sql() -> str:
    escape = rf"regexp_replace({{}}, '([<\[])(\\*)({_TAILS})', '\1\\\2\3', 'g')"
    conflict = rf"regexp_matches(role || chr(10) || text, '[<\[]\\*({_TAILS})') or regexp_matches(role, '[\n\\]')"
    role = rf"replace(replace({escape.format('role')}, '\', '\\'), chr(10), '\n')"
    return f"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
c as (select *, case when {conflict} then length({role}) + length({escape.format('text')}) else length(role) + length(text) end as n from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
sum(n + {len(OPEN) + len(CLOSE) + 1})::bigint as formatted_chars from c group by conv_id
"""
