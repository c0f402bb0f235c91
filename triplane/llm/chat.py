"""Chat formatting as a grammar round trip, in DataFrame functions only.

A conversation renders as turns joined by a new line, each ``### role: text</turn>``. The parser is deterministic:
cut at ``</turn>``, cut the header off, cut the role at the first ``": "``, drop escape marks. A turn is first rendered
as it is and reparsed; where the recovered turn differs from its source, its content is escaped: a backslash doubles,
and one is put inside each control string, so that no control string is left in content. Dropping the marks gives the
content back, so the second rendering always reparses to its source; ``exact`` says so for each conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "</turn>"
#: A control string and the same with an escape mark inside.
MARKED = (("\\", "\\\\"), (END, "<\\/turn>"), (HEAD, "#\\## "))


def escape(text: Column, role: bool = False) -> Column:
    for plain, marked in MARKED + (((SEP, ":\\ "),) if role else ()):
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(SEP), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Rendered conversation -> array of (role, text). A turn that breaks the grammar gives nulls."""
    pieces = F.split(formatted, END, -1)
    pieces = F.when(formatted == "", F.array().cast("array<string>")).otherwise(F.slice(pieces, 1, F.size(pieces) - 1))

    def turn(piece: Column, i: Column) -> Column:
        body = F.when(piece.startswith(F.when(i == 0, F.lit(HEAD)).otherwise(F.lit("\n" + HEAD))), F.substr(piece, F.when(i == 0, F.lit(len(HEAD) + 1)).otherwise(F.lit(len(HEAD) + 2))))
        cut = F.instr(body, SEP)
        sound = (cut > 0) & ~body.contains(HEAD)
        return F.struct(
            F.when(sound, unescape(F.substr(body, F.lit(1), cut - 1))).alias("role"),
            F.when(sound, unescape(F.substr(body, cut + len(SEP)))).alias("text"),
        )

    return F.transform(pieces, turn)


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows of turns -> one row a conversation: ``conv_id, turns, formatted, loss_spans, exact``.

    ``turns``: the source as array of (role, text); ``loss_spans``: (start, length) in code points of the texts of the
    ``trained`` roles inside ``formatted``, escape marks included; ``exact``: the reparsed turns equal the source.

    Null role or text: empty. Null turn: before the others. Ties of turn: by role, then text; repeated rows all stay.
    Null conv_id: one conversation of its own. Empty table: no rows. Other columns are not read. A conversation is
    held as one row, as its text must be; conversations are the unit of parallel work.
    """
    empty = F.lit("")
    said = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))

    def rendered(t: Column) -> Column:
        plain = _render(t["role"], t["text"])
        back = parse(plain)
        same = (F.size(back) == 1) & F.coalesce((back[0]["role"] == t["role"]) & (back[0]["text"] == t["text"]), F.lit(False))
        role_out = F.when(same, t["role"]).otherwise(escape(t["role"], role=True))
        text_out = F.when(same, t["text"]).otherwise(escape(t["text"]))
        return F.struct(t["role"].alias("role"), t["text"].alias("text"), role_out.alias("role_out"), text_out.alias("text_out"))

    one = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    one = one.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), F.transform("t", rendered).alias("r"))
    lead = len(HEAD) + len(SEP)

    def placed(acc: Column, r: Column) -> Column:
        start = acc["at"] + lead + F.length(r["role_out"])
        span = F.struct(start.alias("start"), F.length(r["text_out"]).alias("length"))
        return F.struct(
            (start + F.length(r["text_out"]) + len(END) + 1).alias("at"),
            F.when(r["role"].isin(*trained), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    out = one.select(
        "conv_id",
        "turns",
        F.array_join(F.transform("r", lambda r: _render(r["role_out"], r["text_out"])), "\n").alias("formatted"),
        F.aggregate("r", none, placed)["spans"].alias("loss_spans"),
    )
    return out.withColumn("exact", parse(F.col("formatted")) == F.col("turns"))


def query(spark, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations, with conversation -7 added."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    done = format_chat(rows.unionByName(more))
    back = done.select("conv_id", "formatted", "exact", parse(F.col("formatted")).alias("p"), F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss"))
    back = back.withColumn("loss", F.array_join("loss", ""))
    return back.select(
        "conv_id",
        F.size("p").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("p", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "exact",
    )


_ESC = r"replace(replace(replace({}, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ')"
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(length(replace({_ESC.format('role')}, ': ', ':\\ ')) + length({_ESC.format('text')}) + {len(HEAD) + len(SEP) + len(END) + 1}) - 1)::BIGINT AS formatted_chars,
  true AS exact
FROM rows GROUP BY conv_id
"""
