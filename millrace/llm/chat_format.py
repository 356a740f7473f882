"""Chat formatting by quotation linking.

A line that begins with n marks '>' is quoted n levels deep; a run of lines of one level is a passage.
Quoted passages, and their single lines, are normalised (A-Z lowered, white space folded), hashed and
joined to the first message of the same conversation that holds them as its own words; if that one is
earlier, it is a message quoted from. A message answers the one it quotes at the shallowest level (then the
longest passage, then the latest message). Following those links by pointer doubling gives each message
its thread's root and its depth, so (conv_id, thread_root, depth, turn) is reply order: every message comes
after the one it answers. The returned text is without quotes.

DataFrame functions only; joins are on (conversation, hash) or (conversation, turn), never on the
conversation alone, so a conversation that holds a third of all rows is spread like any other.

Defined results: null text is returned as null, and quotes nothing; messages that quote nothing known
answer nothing (reply_to null, their own root, depth 0); messages with a null turn are never linked;
a null conv_id is a conversation of its own; repeated rows each get a row; messages that share a turn share
their links; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, discard, written

MARKS = r"^[ \t]*((?:>[ \t]*)+)"
QUOTED_LINES = r"(?m)^[ \t]*>.*(?:\n|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))


def _passages(messages: DataFrame) -> DataFrame:
    """ckey, turn, mkey, level, run, h, n_words: the runs and single lines of messages."""
    lines = messages.select("ckey", "turn", "mkey", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "ckey", "turn", "mkey", "pos",
        F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), "[^>]", "")).alias("level"),
        F.regexp_replace("line", MARKS, "").alias("words"),
    )
    message = Window.partitionBy("mkey").orderBy("pos")
    turns = F.when(F.col("level") == F.lag("level").over(message), 0).otherwise(1)
    lines = lines.withColumn("new", turns).withColumn("run", F.sum("new").over(message))
    runs = lines.groupBy("ckey", "turn", "mkey", "level", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"]), " ").alias("words")
    )
    both = runs.unionByName(lines.select("ckey", "turn", "mkey", "level", "run", "words"))
    both = both.withColumn("norm", _normal(F.col("words"))).filter("norm <> ''")
    return both.select("ckey", "turn", "mkey", "level", "run", F.unhex(F.md5("norm")).alias("h"), F.regexp_count("norm", F.lit(WORD)).alias("n_words"))


def _threads(replies: DataFrame) -> DataFrame:
    """ckey, turn, reply_to, thread_root, depth from ckey, turn, reply_to; reply_to is always earlier."""
    now = written(replies.withColumn("thread_root", F.col("reply_to")).withColumn("depth", F.lit(1).cast("bigint")), "chat-threads")
    while True:
        up = now.select(F.col("ckey"), F.col("turn").alias("thread_root"), F.col("thread_root").alias("up_root"), F.col("depth").alias("up_depth"))
        if now.join(up, ["ckey", "thread_root"], "left_semi").isEmpty():
            return now
        further = now.join(up, ["ckey", "thread_root"], "left").select(
            "ckey", "turn", "reply_to", F.coalesce("up_root", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth")
        )
        before, now = now, written(further, "chat-threads")
        discard(before)


def link_quotations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, reply_to, thread_root, depth, formatted of every
    row of conversations (conv_id, turn, role, text)."""
    keyed = conversations.select(
        "conv_id", "turn", "role", "text", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ckey"),
        F.unhex(F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text")))).alias("mkey"),
        F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False)).alias("quotes"),
    )
    quoting = keyed.filter("quotes").select("ckey").distinct()
    own_text = F.when(F.col("quotes"), F.trim(F.regexp_replace("text", QUOTED_LINES, ""), F.lit(" \t\r\n"))).otherwise(F.col("text"))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    messages = keyed.withColumn("text", own_text).withColumn("formatted", formatted).drop("quotes")
    if quoting.isEmpty():
        return messages.select(
            "conv_id", "turn", "role", "text", F.lit(0).cast("bigint").alias("n_quotes"), F.lit(None).cast("bigint").alias("reply_to"),
            F.col("turn").cast("bigint").alias("thread_root"), F.lit(0).cast("bigint").alias("depth"), "formatted",
        )
    threads = keyed.join(quoting, "ckey", "left_semi").dropDuplicates(["mkey"])
    passages = written(_passages(threads), "chat-passages")
    origins = passages.filter("level = 0").groupBy("ckey", "h").agg(F.min("turn").alias("origin"))
    quoted = passages.filter("level > 0")
    links = quoted.join(origins, ["ckey", "h"]).filter("origin < turn")
    replies = links.groupBy("ckey", "turn").agg(F.min(F.struct("level", -F.col("n_words"), -F.col("origin"))).alias("best"))
    replies = replies.select("ckey", "turn", (-F.col("best.col3")).cast("bigint").alias("reply_to"))
    counts = quoted.groupBy("mkey").agg(F.countDistinct("run").alias("n_quotes"))
    return (
        messages.join(counts, "mkey", "left").join(_threads(replies), ["ckey", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "text", F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), "reply_to",
            F.coalesce("thread_root", F.col("turn").cast("bigint")).alias("thread_root"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), "formatted",
        )
    )


OP9_SQL = r"""
WITH RECURSIVE m AS (
  SELECT *, coalesce(conv_id::VARCHAR, '') AS ckey, coalesce(regexp_matches(text, '(?m)^[ \t]*>'), false) AS quotes,
         coalesce(conv_id::VARCHAR, '-') || '|' || coalesce(turn::VARCHAR, '-') || '|' || coalesce(role, '-') || '|' || coalesce(text, '-') AS mkey
  FROM conversations),
u AS (SELECT DISTINCT ckey, turn, mkey, text FROM m WHERE ckey IN (SELECT ckey FROM m WHERE quotes)),
l0 AS (SELECT ckey, turn, mkey, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM u),
l1 AS (
  SELECT ckey, turn, mkey, pos, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', '') AS words FROM l0),
l2 AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY mkey ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM l1),
l3 AS (SELECT *, sum(fresh) OVER (PARTITION BY mkey ORDER BY pos) AS run FROM l2),
p0 AS (
  SELECT ckey, turn, mkey, level, run, string_agg(words, ' ' ORDER BY pos) AS words FROM l3 GROUP BY ALL
  UNION ALL SELECT ckey, turn, mkey, level, run, words FROM l3),
p AS (
  SELECT *, len(regexp_extract_all(norm, '[^ ]+')) AS n_words FROM (
    SELECT ckey, turn, mkey, level, run, trim(regexp_replace(
      translate(words, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM p0)
  WHERE norm <> ''),
origins AS (SELECT ckey, norm, min(turn) AS origin FROM p WHERE level = 0 GROUP BY ALL),
replies AS (
  SELECT ckey, turn, arg_min(origin, [level, -n_words, -origin]) AS reply_to
  FROM p JOIN origins USING (ckey, norm) WHERE level > 0 AND origin < turn GROUP BY ckey, turn),
up AS (
  SELECT ckey, turn, reply_to, reply_to AS root, 1 AS depth FROM replies
  UNION ALL SELECT up.ckey, up.turn, up.reply_to, r.reply_to, up.depth + 1 FROM up JOIN replies r ON r.ckey = up.ckey AND r.turn = up.root),
threads AS (SELECT ckey, turn, any_value(reply_to) AS reply_to, arg_max(root, depth) AS thread_root, max(depth) AS depth FROM up GROUP BY ckey, turn),
counts AS (SELECT mkey, count(DISTINCT run) AS n_quotes FROM p WHERE level > 0 GROUP BY mkey),
o AS (SELECT *, CASE WHEN quotes THEN trim(regexp_replace(text, '(?m)^[ \t]*>.*(?:\n|$)', '', 'g'), chr(9) || chr(10) || chr(13) || ' ') ELSE text END AS own FROM m)
SELECT o.conv_id, o.turn, o.role, o.own AS text, coalesce(n_quotes, 0)::BIGINT AS n_quotes, t.reply_to::BIGINT AS reply_to,
       coalesce(t.thread_root, o.turn)::BIGINT AS thread_root, coalesce(t.depth, 0)::BIGINT AS depth,
       '<|' || coalesce(o.role, '') || '|>' || chr(10) || coalesce(o.own, '') || chr(10) AS formatted
FROM o LEFT JOIN counts USING (mkey) LEFT JOIN threads t ON t.ckey = o.ckey AND t.turn = o.turn
"""
