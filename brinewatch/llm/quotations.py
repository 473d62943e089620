"""Quotation linking and chat formatting, in SQL functions only.

The leading ``>`` signs of a line give its quote level. At each level the lines make up a text of their own,
whose passages (paragraphs, and single lines) are normalised and hashed. A quoted passage is joined to the
message of its conversation that wrote those words first, at level 0. A message replies to the original of
its shallowest quotes, of which it quotes most. What remains at level 0, without lines that announce a
quote, is the message's content; replies stand behind the message at the top of their chain.

Cases: a null text is an empty one; a missing conversation, turn or quote gives no link, so the message
starts a thread of its own; a passage first written later than its quotation is no original; rows that
share conversation and turn count as one message for links and keep a row each; other columns pass
through, except those with the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewatch.llm.tables import numbered
from brinewatch.session import checked_broadcast, checkpointed

QUOTE = r"^((?:[ \t]*>)+)[ \t]?"
#: A line that announces a quote, in the languages of the data.
ANNOUNCES = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
RESULT = ("content", "parent", "thread", "depth", "chat")
#: Messages that are written into one chat text at most.
BLOCK_TURNS = 1000


def _lines(text: Column) -> Column:
    """(level, body) of each line."""
    return F.transform(
        F.split(F.coalesce(text.cast("string"), F.lit("")), r"\r?\n", -1),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), r"[^>]", "")).alias("level"),
            F.regexp_replace(line, QUOTE, "").alias("body"),
        ),
    )


def _at_level(lines: Column, level: Column) -> Column:
    """The text of one level; lines of others part its paragraphs."""
    return F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["body"]).otherwise("")), "\n")


def _passages(text: Column) -> Column:
    """Distinct normalised paragraphs and lines."""
    pieces = F.concat(F.split(text, r"\n\s*\n", -1), F.split(text, r"\n", -1))
    plain = F.transform(pieces, lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " ")))
    return F.array_distinct(F.filter(plain, lambda p: F.length(p) > 0))


def _content(lines: Column) -> Column:
    """What the author wrote: level 0, without announcements that a quote follows."""
    numbered = F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), i.alias("i")))
    follows = lambda x: F.coalesce(F.get(lines, x["i"] + 1)["level"], F.lit(0)) > 0
    own = F.filter(numbered, lambda x: (x["level"] == 0) & ~(x["body"].rlike(ANNOUNCES) & follows(x)))
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def reply_links(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """``(c, t, parent)``: the turn that each replying message answers."""
    parsed = messages.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), _lines(F.col(text)).alias("lines")
    )
    levels = F.array_distinct(F.transform("lines", lambda x: x["level"]))
    leveled = parsed.select("c", "t", "lines", F.explode(levels).alias("level"))
    passages = leveled.select(
        "c", "t", "level", F.explode(_passages(_at_level(F.col("lines"), F.col("level")))).alias("p")
    ).select("c", "t", "level", F.sha2("p", 256).alias("h"), F.length("p").alias("n"))
    # Counted together before the join, so hot passages and conversations combine map-side.
    written = passages.where("level = 0").groupBy("c", "h").agg(F.min("t").alias("first"))
    quoted = passages.where("level > 0").distinct()
    found = quoted.join(written, ["c", "h"]).where(F.col("first") < F.col("t"))
    weighed = found.groupBy("c", "t", "level", "first").agg(F.sum("n").alias("n"))
    best = F.max_by("first", F.struct(-F.col("level"), "n", "first"))
    return weighed.groupBy("c", "t").agg(best.alias("parent"))


def reply_chains(links: DataFrame) -> DataFrame:
    """``(c, t, parent, top, depth)``: each reply's message at the top of its chain, by doubling the steps."""
    chains = checkpointed(links.select("c", "t", "parent", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = chains.select("c", F.col("t").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        if chains.join(above, ["c", "top"], "left_semi").isEmpty():
            return chains
        chains = checkpointed(
            chains.join(above, ["c", "top"], "left").select(
                "c", "t", "parent", F.coalesce("next", "top").alias("top"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            )
        )


def link_quotations(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``messages`` with ``content``, ``parent``, ``thread``, ``depth`` and ``chat``.

    Reply order within a conversation is (thread, turn): a message stands behind those it answers.
    """
    chains = reply_chains(reply_links(messages, conv, turn, text))
    kept = [c for c in messages.columns if c not in RESULT]
    m, ch = messages.alias("m"), chains.alias("ch")
    joined = m.join(ch, (F.col(f"m.{conv}") == F.col("ch.c")) & (F.col(f"m.{turn}") == F.col("ch.t")), "left")
    content = _content(_lines(F.col(f"m.{text}")))
    return joined.select(
        *(F.col(f"m.`{c}`") for c in kept),
        content.alias("content"),
        F.col("ch.parent").alias("parent"),
        F.coalesce(F.col("ch.top"), F.col(f"m.{turn}")).alias("thread"),
        F.coalesce(F.col("ch.depth"), F.lit(0).cast("long")).alias("depth"),
        F.concat(F.lit("<|"), F.coalesce(f"m.{role}", F.lit("unknown")), F.lit("|>\n"), content, F.lit("\n")).alias("chat"),
    )


def chat_texts(linked: DataFrame, conv: str = "conv_id", turn: str = "turn", block: int = BLOCK_TURNS) -> DataFrame:
    """One chat text for each conversation, in reply order; a block of turns of a thread is a row.

    A row gathers at most ``block`` turns; rows of a conversation follow each other by (thread, block).
    """
    part = F.floor(F.col(turn) / block).alias("block")
    ordered = F.sort_array(F.collect_list(F.struct(turn, "chat")))
    return linked.groupBy(conv, "thread", part).agg(
        F.count(F.lit(1)).alias("n_messages"), F.array_join(F.transform(ordered, lambda x: x["chat"]), "").alias("chat")
    )


def conversation_report(messages: DataFrame) -> DataFrame:
    """One row per message: where it stands in reply order and what it says without quotes."""
    return link_quotations(messages).select("conv_id", "turn", "role", "content", "parent", "thread", "depth", "chat")


def built_conversations(messages: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """``(conv_id, block, n_messages, chat)``: each conversation without quotes, in reply order (thread, turn).

    A message that quotes nothing stands at its own turn. A conversation of at most ``block`` messages is one row;
    a longer one is cut at multiples of ``block`` threads, threads there that hold more at multiples of ``block``
    turns, and turns that still hold more, as of messages that share theirs or have none, after every ``block``
    messages. Messages without conversation are one conversation.
    """
    turns = checkpointed(link_quotations(messages).select("conv_id", "turn", "thread", "chat"))
    sized = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = sized.select(F.col("conv_id").alias("c"))
    near = F.when(F.col("c_large"), F.floor(F.col("thread") / block)).otherwise(F.lit(0).cast("long"))
    placed = turns.join(
        large.withColumn("c_large", F.lit(True)), F.col("conv_id").eqNullSafe(F.col("c")), "left"
    ).select("conv_id", "turn", "thread", "chat", near.alias("p1"))
    full = placed.groupBy("conv_id", "p1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    full = full.select(F.col("conv_id").alias("c"), F.col("p1").alias("q"), F.lit(True).alias("q_large"))
    cut = placed.join(full, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("p1").eqNullSafe(F.col("q")), "left").select(
        "conv_id", "turn", "thread", "chat", "p1", F.when(F.col("q_large"), F.col("thread")).alias("p2"),
        F.when(F.col("q_large"), F.floor(F.col("turn") / block)).alias("p3"),
    )
    parts = ["conv_id", "p1", "p2", "p3"]
    cut = checkpointed(cut)
    over = checkpointed(cut.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).drop("n"))
    if over.isEmpty():
        cut = cut.withColumn("p4", F.lit(None).cast("long"))
    else:
        cut = _counted_off(cut, over, parts, block)
    parts = [*parts, "p4"]
    ordered = F.sort_array(F.collect_list(F.struct("thread", "turn", "chat")))
    rows = cut.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("n_messages"), F.array_join(F.transform(ordered, lambda x: x["chat"]), "").alias("chat")
    )
    # Conversations of one block are number 0; the blocks of the others are counted off.
    rows = checkpointed(rows)
    several = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    keys = _counted_off(rows.select(*parts), several, ["conv_id"], 1, "block", parts)
    return _matched(rows, keys, parts).select("conv_id", F.coalesce("block", F.lit(0)).cast("long").alias("block"), "n_messages", "chat")


def _matched(df: DataFrame, other: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``df`` joined with ``other`` on columns that may be null."""
    other, _ = checked_broadcast(other.withColumnsRenamed({c: f"_of_{c}" for c in on}))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(other, same, how).drop(*(f"_of_{c}" for c in on))


def _counted_off(
    df: DataFrame, large: DataFrame, group: list[str], size: int, name: str = "p4", order: list[str] | None = None
) -> DataFrame:
    """Rows with ``name``: after every ``size`` rows of their group the next number, null in groups not in ``large``.

    The order of all such rows is made by ranges, so no task has to hold a group.
    """
    order = order or [*group, "thread", "turn", "chat"]
    within = _matched(df.withColumn("_row", F.monotonically_increasing_id()), large.withColumn("_large", F.lit(True)), group)
    within = checkpointed(within)
    placed, _ = numbered(within.where("_large"), "_at", *(F.col(c).asc_nulls_first() for c in order), F.col("_row").asc())
    placed = checkpointed(placed)
    first = placed.groupBy(*group).agg(F.min("_at").alias("_first"))
    counted = _matched(placed, first, group).withColumn(name, F.floor((F.col("_at") - F.col("_first")) / size))
    rest = within.where("_large is null").withColumn(name, F.lit(None).cast("long"))
    columns = [*df.columns, name]
    return counted.select(*columns).unionByName(rest.select(*columns))


#: The same in DuckDB: links, then chains by recursion.
REPORT_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, rid, i, x,
         length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
         regexp_replace(x, '^((?:[ \t]*>)+)[ \t]?', '') AS body
  FROM (SELECT conv_id, turn, rid, unnest(parts) AS x, generate_subscripts(parts, 1) AS i
        FROM (SELECT conv_id, turn, row_number() OVER () AS rid,
                     string_split_regex(coalesce(text, ''), '\r?\n') AS parts FROM conversations))
), levels AS (
  SELECT l.conv_id, l.turn, l.rid, d.level,
         string_agg(CASE WHEN l.level = d.level THEN l.body ELSE '' END, chr(10) ORDER BY l.i) AS t
  FROM lines l JOIN (SELECT DISTINCT rid, level FROM lines) d USING (rid)
  WHERE l.conv_id IS NOT NULL AND l.turn IS NOT NULL GROUP BY ALL
), passages AS (
  SELECT DISTINCT conv_id, turn, level, p FROM (
    SELECT conv_id, turn, level, trim(regexp_replace(lower(q), '\s+', ' ', 'g')) AS p
    FROM (SELECT conv_id, turn, level, unnest(string_split_regex(t, '\n\s*\n') || string_split_regex(t, '\n')) AS q
          FROM levels)) WHERE length(p) > 0
), written AS (
  SELECT conv_id, p, min(turn) AS first FROM passages WHERE level = 0 GROUP BY ALL
), weighed AS (
  SELECT q.conv_id, q.turn, q.level, first, sum(length(p)) AS n
  FROM passages q JOIN written USING (conv_id, p) WHERE q.level > 0 AND first < q.turn GROUP BY ALL
), links AS (
  SELECT conv_id, turn, first AS parent FROM weighed
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, first DESC) = 1
), chains AS (
  SELECT conv_id, turn, parent, parent AS top, 1::BIGINT AS depth FROM links
  UNION ALL
  SELECT c.conv_id, c.turn, c.parent, l.parent, c.depth + 1 FROM chains c JOIN links l
  ON l.conv_id = c.conv_id AND l.turn = c.top
), tops AS (
  SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1
), own AS (
  SELECT rid, coalesce(regexp_replace(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE kept), '^\s+|\s+$', '', 'g'), '')
         AS content
  FROM (SELECT *, level = 0 AND NOT (
          regexp_matches(body, '(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$')
          AND coalesce(lead(level) OVER (PARTITION BY rid ORDER BY i), 0) > 0) AS kept FROM lines)
  GROUP BY rid
)
SELECT m.conv_id, m.turn, m.role, content, t.parent, coalesce(t.top, m.turn) AS thread,
       coalesce(t.depth, 0)::BIGINT AS depth,
       '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || content || chr(10) AS chat
FROM (SELECT *, row_number() OVER () AS rid FROM conversations) m JOIN own USING (rid)
LEFT JOIN tops t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""

#: Built conversations from the same messages; ``{block}`` is the number of messages of a block.
CHATS_SQL = """
WITH m AS ({report}), a AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY conv_id) > {block} THEN floor(thread / {block})::BIGINT ELSE 0 END AS p1
  FROM m
), b AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, p1) > {block} AS cut FROM a
), c AS (
  SELECT *, CASE WHEN cut THEN thread END AS p2, CASE WHEN cut THEN floor(turn / {block})::BIGINT END AS p3 FROM b
), e AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY conv_id, p1, p2, p3) > {block} THEN (row_number() OVER (
    PARTITION BY conv_id, p1, p2, p3 ORDER BY thread NULLS FIRST, turn NULLS FIRST, chat) - 1) // {block} END AS p4 FROM c
), d AS (
  SELECT conv_id, p1, p2, p3, p4, count(*) AS n_messages,
         string_agg(chat, '' ORDER BY thread NULLS FIRST, turn NULLS FIRST, chat) AS chat
  FROM e GROUP BY conv_id, p1, p2, p3, p4
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id
         ORDER BY p1 NULLS FIRST, p2 NULLS FIRST, p3 NULLS FIRST, p4 NULLS FIRST) - 1 AS block,
       n_messages, chat FROM d
"""


def chats_sql(block: int = BLOCK_TURNS) -> str:
    return CHATS_SQL.replace("{report}", REPORT_SQL).replace("{block}", str(block))
