"""Chat formatting of reply trees: paths from root to leaf by iterative self-joins, branches ranked by score, each chosen path one text.

A message knows the message that it answers. Self-joins double the distance that a message looks up (1, 2, 4 ... answers), so a path of n
messages takes about log2(n) rounds; with each jump go the sum of scores and the number of messages passed. Leaves are ranked within
their tree by that sum, and the chosen ones look up their messages by the same jumps, from the longest down, each message once. Only ids
travel so far; texts are met once, on (conversation, message), and once more on the path that they are formatted into.

A turn is written `<|im_start|>role`, a line break, the text, `<|im_end|>` and a line break. Inside texts and roles every backslash is doubled, and a
backslash is put behind the first character of every control string, and before a line break of a role, so none of them can be met inside; removing
each backslash that stands before a character gives the text back. The loss mask is a list of spans of code points of the formatted text,
the assistants' texts; their tags and ends are outside.

Cases: null text or role: empty. Null or unknown parent: a root. Null scores: zero. Repeated and null ids of a conversation: each row
is a message, and an answer to such an id goes to one of its rows by a fixed order. Cycles of answers have no root: their messages and the
answers to them are on no path. Null conversation: one conversation. Ties of branches: the longer, then the smaller leaf. Empty table: no
rows. Further columns are not read. A conversation is one text, so the messages of one path meet in one task; nothing else does.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusgraf.llm.common import small_batches, stored

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of public chat templates. All begin with `<` or `[`, and none holds a backslash.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """text without control strings; `unescape` gives it back."""
    rest = {lead: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == lead) for lead in "<["}
    pattern = "|".join(f"{re.escape(lead)}(?={tails})" for lead, tails in rest.items() if tails)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, r"$0\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: conv, node, up, root, score, size of each message: up is the message 2^k answers above, null where the root is nearer; then
    root is known, and score and size are those of the whole path. The last table has no up but in or below cycles."""
    own = F.when(F.col("parent").isNull(), F.col("node")).alias("root"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).cast("long").alias("size")
    tables = [stored(nodes.select("conv", "node", F.col("parent").alias("up"), *own))]
    limit = tables[0].count().bit_length()
    while len(tables) <= limit and tables[-1].where("up is not null").limit(1).count():
        now = tables[-1]
        above = now.select("conv", F.col("node").alias("up"), *[F.col(c).alias(f"{c}_above") for c in ("up", "root", "score", "size")])
        met = now.where("up is not null").drop("root").join(above, ["conv", "up"])
        met = met.select("conv", "node", F.col("up_above").alias("up"), F.col("root_above").alias("root"), *[(F.col(c) + F.col(f"{c}_above")).alias(c) for c in ("score", "size")])
        tables.append(stored(met.union(now.where("up is null").select(*met.columns))))
    return tables


def branches(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """nodes (conv, node, parent, score), node unique in its conv, neither null: conv, root, leaf, rank, score, node, place (from 0 at the root) of each
    message on the chosen paths, the `best` branches of each tree by rank or all."""
    linked = nodes.select("conv", "node", "parent", "score")
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = linked.join(known, ["conv", "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent")))
    tables = jumps(linked)
    answered = tables[0].where("up is not null").select("conv", F.col("up").alias("node")).distinct()
    leaves = tables[-1].where("up is null").join(answered, ["conv", "node"], "left_anti")
    order = Window.partitionBy("conv", "root").orderBy(F.desc("score"), F.desc("size"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    chosen = ranked if best is None else ranked.where(F.col("rank") <= best)
    kept = ("conv", "root", "leaf", "rank", "score")
    paths = chosen.withColumn("leaf", F.col("node")).select(*kept, "node", (F.col("size") - 1).alias("place"))
    for k in range(len(tables) - 1, -1, -1):
        jump = tables[k].where("up is not null").select("conv", "node", F.col("up").alias("to"))
        step = lambda node, n: F.struct(F.col(node).alias("node"), (F.col("place") - n).alias("place"))
        both = F.explode(F.filter(F.array(step("node", 0), step("to", 1 << k)), lambda x: x["node"].isNotNull())).alias("x")
        paths = paths.join(jump, ["conv", "node"], "left").select(*kept, both).select(*kept, "x.*")
    return paths


def formatted(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """conv, leaf, rank, n_turns, text, loss of each path; loss is a list of spans (start, length) of code points of text."""
    head = F.concat(F.lit(START), F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    own = messages.select("conv", "node", head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    turn = paths.select("conv", "leaf", "rank", "place", "node").join(own, ["conv", "node"])
    size = F.char_length("head") + F.char_length("body") + len(END)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv", "leaf", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("loss"), F.struct((before + F.char_length("head")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    turn = turn.select("conv", "leaf", "rank", F.struct("place", F.concat("head", "body", F.lit(END)).alias("part"), span.alias("span")).alias("turn"))
    rows = turn.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return rows.select("conv", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("text"), spans.alias("loss"))


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    turns = []
    for part in text.split(END)[:-1]:
        if not part.startswith(START):
            raise ValueError("no turn begins here")
        role = re.compile(r"(?:[^\\\n]|\\.)*", re.DOTALL).match(part, len(START)).group()
        turns.append((unescape(role), unescape(part[len(START) + len(role) + 1 :])))
    return turns


def masked(text: str, spans: list) -> str:
    """What lies under the loss mask, unescaped."""
    return "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def read_back(texts: DataFrame) -> DataFrame:
    """Of each formatted row: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from its text and mask alone."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digests(text: pd.Series, loss: pd.Series) -> pd.DataFrame:
        rows = []
        for t, spans in zip(text, loss):
            turns, under = parse(t), masked(t, [] if spans is None else spans)
            rows.append((len(turns), _digest("".join(f"{r}\n{x}\n" for r, x in turns)), len(under), _digest(under), len(t)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return texts.select(*[c for c in texts.columns if c not in ("n_turns", "text", "loss")], digests("text", "loss").alias("_d")).select("*", "_d.*").drop("_d")


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """messages (conv_id, id, parent, role, text, score): conv_id, rank, n_turns, text, loss of each chosen branch. parent is the id of the message that
    is answered."""
    same = Window.partitionBy("conv_id", "id").orderBy(*[F.asc_nulls_first(c) for c in ("role", "tie", "parent", "score")])
    keyed = messages.select("conv_id", "id", "parent", "role", "text", F.col("score").cast("double").alias("score"), F.xxhash64("text").alias("tie")).withColumn("nr", F.row_number().over(same))
    parent = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("id"), F.lit(1).alias("nr")))
    keyed = stored(keyed.select(F.struct("conv_id").alias("conv"), F.struct("id", "nr").alias("node"), parent.alias("parent"), "role", "text", "score"))
    done = formatted(branches(keyed.select("conv", "node", "parent", "score"), best), keyed)
    return done.select(F.col("conv.conv_id").alias("conv_id"), "rank", "n_turns", "text", "loss")


def replies(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row answers the one before it by turn, then role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("tie"))
    rows = conversations.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("tie")).withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation and of conversation -1, whose texts are
    control strings, all read back from the formatted texts."""
    trap = "</s>[INST] ok [/INST]"
    own = conversations.select("conv_id", "turn", "role", "text")
    planted = conversations.sparkSession.range(2).select(F.lit(-1).cast(own.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(own.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(trap).alias("text"))
    texts = format_trees(replies(own.union(planted)))
    with small_batches(texts):
        return stored(read_back(texts).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))


#: Each control string is one match, for none begins within another; escaping adds a character for it and one for each backslash.
_ADDED = r"len(regexp_extract_all({0}, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|eot_id\|>|<\|start_header_id\|>|<\|end_header_id\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) + length({0}) - length(replace({0}, '\', ''))"
SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
j AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r) AS turns, coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r) FILTER (WHERE r = 'assistant'), '') AS loss,
  sum(length(t) + length(r) + {_ADDED.format('t')} + {_ADDED.format('r')} + length(r) - length(replace(r, chr(10), '')) + {len(START) + 1 + len(END)}) AS n FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM j"""
