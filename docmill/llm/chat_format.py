r"""Chat formatting of reply trees.

A message names its conversation, its id and the message it replies to. Iterative self-joins
double the distance that a message sees towards its root: after k rounds it knows its ancestor
2^k replies up and the scores on the way, or has dropped out because its branch is shorter. So
the deepest tree takes log2(depth) rounds over ever fewer rows. Leaves walk up these distances,
longest first, and add up the scores of their branch; branches are ranked by mean score, and the
chosen ones are enumerated from leaf to root by the same distances. Only ids and scores move in
these joins. Texts move once, dealt by conversation, to meet their places; conversations that
hold more than `LARGE` messages and a thousandth of all are dealt by message, then by branch.

Each turn is written as its role's opening mark, the text, and the role's closing mark. A control
string inside a text gets a backslash after its first character, one that has backslashes there
already gets one more, so taking one off restores every text. The loss mask covers the texts of
assistants. All steps are DataFrame functions.

Defined results: null texts and roles are empty ones; a null score counts for nothing, a branch
without scores has score 0. A message that replies to nothing, or to a message that is not there,
is a root; of a circle of replies the message with the smallest id is. Rows that share a
conversation and an id are one message of several turns, by role, then text; it replies to the
smallest of their parents, and their scores are averaged. Rows without a conversation are one
conversation. Rows without an id reply to nothing and have no replies: each conversation has one
such message, with a branch of its own. Branches of equal score go by their leaf. Other columns are not looked at. Empty
tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.session import staged

#: Opening and closing marks of the known roles; other roles are named between marks.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>\n")}
OTHER = ("<<ROLE>>", "<</ROLE>>", "</s>\n")
LEARNED = "assistant"
#: What no text may hold as it is: [INST], [/INST], <s>, </s>, <<SYS>>, <</SYS>>, <<ROLE>>, <</ROLE>>.
CONTROL = ((r"\[", r"/?INST\]"), ("<", r"(?:/?s>|</?(?:SYS|ROLE)>>)"))
#: A turn in the formatted text; no mark occurs inside its text.
TURN = r"(?s)<<SYS>>\n.*?\n<</SYS>>\n\n|\[INST\] .*? \[/INST\]|<s> .*? </s>\n|<<ROLE>>.*?<</ROLE>>.*?</s>\n"
LARGE = 100_000
SHARE = 1000
#: Up to so many branches of a conversation, the places of a message are a short list.
FEW = 64


# ---- the template ------------------------------------------------------------------------

def escaped(text: Column) -> Column:
    for first, rest in CONTROL:
        text = F.regexp_replace(text, rf"({first})(\\*{rest})", r"$1\\$2")
    return text


def unescaped(text: Column) -> Column:
    for first, rest in CONTROL:
        text = F.regexp_replace(text, rf"({first})\\(\\*{rest})", "$1$2")
    return text


def by_role(role: Column, known: list, other: Column) -> Column:
    for name, value in zip(MARKS, known):
        other = F.when(role == name, value).otherwise(other)
    return other


def opening(role: Column) -> Column:
    named = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
    return by_role(role, [F.lit(first) for first, _ in MARKS.values()], named)


def closing(role: Column) -> Column:
    return by_role(role, [F.lit(last) for _, last in MARKS.values()], F.lit(OTHER[2]))


def parsed(turn: Column) -> Column:
    """role and text of a formatted turn, unescaped."""
    end_of_role = F.locate(OTHER[1], turn)
    begun = len(OTHER[0])
    found = F.struct(
        unescaped(F.substr(turn, F.lit(begun + 1), end_of_role - begun - 1)).alias("role"),
        unescaped(F.substr(turn, end_of_role + len(OTHER[1]),
                           F.length(turn) - end_of_role - (len(OTHER[1]) + len(OTHER[2]) - 1))).alias("text"))
    for name, (first, last) in MARKS.items():
        inner = F.substr(turn, F.lit(len(first) + 1), F.length(turn) - (len(first) + len(last)))
        found = F.when(turn.startswith(first), F.struct(F.lit(name).alias("role"), unescaped(inner).alias("text"))
                       ).otherwise(found)
    return found


def read_back(formatted: DataFrame) -> DataFrame:
    """`turns` (role, text) and `learned` (all text under the loss mask) out of `formatted` and `loss`."""
    cut = formatted.withColumn("turns", F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)))
    spans = F.transform("loss", lambda s: unescaped(F.substr(F.get("turns", s["turn"]), s["at"] + 1, s["length"])))
    return cut.withColumn("learned", F.array_join(spans, "")).withColumn("turns", F.transform("turns", parsed))


# ---- reply trees -------------------------------------------------------------------------

def conversation(conv_id) -> Column:
    """A key that is null for no conversation."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("conv")


def replies(messages: DataFrame) -> DataFrame:
    """conv, id, parent, score of messages (conv_id, message_id, parent_id, score)."""
    parent = F.when(F.col("message_id").isNotNull(), F.col("parent_id"))
    return messages.select(conversation("conv_id"), F.col("message_id").alias("id"), parent.alias("parent"),
                           F.col("score").cast("double").alias("score"))


def chained(messages: DataFrame) -> DataFrame:
    """conv, id, parent of messages (conv_id, message_id) that each reply to the one before; all have ids."""
    own = messages.select(conversation("conv_id"), F.col("message_id").alias("id")).distinct()
    before = Window.partitionBy("conv").orderBy("id")
    return own.withColumn("parent", F.lag("id").over(before))


def tree(links: DataFrame) -> DataFrame:
    """conv, id, parent, leaf and, where links have scores, score: one row per message."""
    scored = ["score"] if "score" in links.columns else []
    own = links.select("conv", "id", "parent", F.lit(True).alias("there"), *scored)
    named = links.where("parent IS NOT NULL").select(
        "conv", F.col("parent").alias("id"), F.lit(None).cast(links.schema["parent"].dataType).alias("parent"),
        F.lit(False).alias("there"), *[F.lit(None).cast("double").alias("score") for _ in scored])
    return own.unionByName(named).groupBy("conv", "id").agg(
        F.min("parent").alias("parent"), F.max("there").alias("there"), F.min("there").alias("leaf"),
        *[F.avg(s).alias(s) for s in scored]).where("there").drop("there")


def doubled(level: DataFrame, add: tuple[str, ...] = ("total", "n")) -> DataFrame:
    """Pointers (conv, id, up) twice as far, with what is added up on the way; short branches drop out."""
    a, b = level.alias("a"), level.alias("b")
    return a.join(b, F.expr("a.conv = b.conv AND a.up = b.id")).select(
        "a.conv", "a.id", "b.up", *[(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in add])


def without_circles(nodes: DataFrame, on_circle: DataFrame, rounds: int) -> DataFrame:
    """`nodes` with the smallest message of every circle as a root; `on_circle` are the messages (conv, id) of circles."""
    low = nodes.join(on_circle, ["conv", "id"], "left_semi").select(
        "conv", "id", F.col("parent").alias("up"), F.least("id", "parent").alias("low"))
    for _ in range(rounds):
        low = staged(low, "circle")
        a, b = low.alias("a"), low.alias("b")
        low = a.join(b, F.expr("a.conv = b.conv AND a.up = b.id")).select(
            "a.conv", "a.id", "b.up", F.least("a.low", "b.low").alias("low"))
    roots = low.where("id = low").select("conv", "id", F.lit(True).alias("root"))
    cut = nodes.join(roots, ["conv", "id"], "left").withColumn("parent", F.expr("CASE WHEN root IS NULL THEN parent END"))
    return staged(tree(cut.drop("root", "leaf")), "tree")


def pointers(nodes: DataFrame, largest: int) -> tuple[DataFrame, list[DataFrame]]:
    """The nodes without circles, and for every k the pointers (conv, id, up, sums) 2^k replies up."""
    scored = "score" in nodes.columns
    sums = [F.coalesce("score", F.lit(0.0)).alias("total"), F.col("score").isNotNull().cast("long").alias("n")]
    level = staged(nodes.where("parent IS NOT NULL").select("conv", "id", F.col("parent").alias("up"),
                                                            *(sums if scored else [])), "reply-pointers")
    levels = []
    while not level.isEmpty():
        if 1 << len(levels) > largest:  # no branch is that long
            circle = level.select("conv", F.col("up").alias("id")).distinct()
            return pointers(without_circles(nodes, circle, len(levels)), largest)
        levels.append(level)
        level = staged(doubled(level, ("total", "n") if scored else ()), "reply-pointers")
    return nodes, levels


def branches(nodes: DataFrame, levels: list[DataFrame], keep: int | None) -> DataFrame:
    """conv, leaf, score, branch: the `keep` best branches of every conversation, or all, numbered from 1."""
    leaves = nodes.where("leaf").select("conv", F.col("id").alias("leaf"))
    if "score" in nodes.columns:
        walk = leaves.withColumn("at", F.col("leaf")).withColumn("total", F.lit(0.0)).withColumn("n", F.lit(0).cast("long"))
        for level in reversed(levels):
            up = level.select("conv", F.col("id").alias("at"), "up", F.col("total").alias("more"), F.col("n").alias("n2"))
            walk = walk.join(up, ["conv", "at"], "left").select(
                "conv", "leaf", F.coalesce("up", "at").alias("at"),
                (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
                (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        root = F.expr("a.conv = b.conv AND a.at <=> b.id")
        total = F.col("total") + F.coalesce("b.score", F.lit(0.0))
        n = F.col("n") + F.col("b.score").isNotNull().cast("long")
        leaves = walk.alias("a").join(nodes.alias("b"), root, "left").select(
            "a.conv", "a.leaf", F.when(n > 0, total / n).otherwise(0.0).alias("score"))
    else:
        leaves = leaves.withColumn("score", F.lit(0.0))
    order = Window.partitionBy("conv").orderBy(F.desc("score"), F.asc_nulls_first("leaf"))
    ranked = leaves.withColumn("branch", F.row_number().over(order))
    return ranked if keep is None else ranked.where(F.col("branch") <= keep)


def enumerated(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """conv, leaf, branch, score, id, back: all messages of the chosen branches, `back` replies above their leaf."""
    path = chosen.withColumn("id", F.col("leaf")).withColumn("back", F.lit(0).cast("long"))
    for k, level in reversed(list(enumerate(levels))):
        path = path.join(level.select("conv", "id", "up"), ["conv", "id"], "left")
        stay = F.struct("id", "back")
        jump = F.struct(F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        both = F.when(F.col("up").isNull(), F.array(stay)).otherwise(F.array(stay, jump))
        path = path.select("conv", "leaf", "branch", "score", F.inline(both))
    return path


# ---- formatting --------------------------------------------------------------------------

def placed(rows: DataFrame, path: DataFrame) -> DataFrame:
    """Each message of a path with its role and text, joined by message: texts move to meet their places."""
    same = F.expr("a.conv = b.conv AND a.id <=> b.id")
    return rows.alias("a").join(path.alias("b"), same).select(
        "a.conv", "a.conv_id", "a.role", "a.text", "b.leaf", "b.branch", "b.score", "b.back")


def gathered(rows: DataFrame, path: DataFrame) -> DataFrame:
    """As `placed`, for few branches a conversation: all is dealt by conversation, once.

    A join would deal the texts by message and `written` by branch again. Here the few places of a
    message are listed beside its rows, in a window that the dealing by conversation serves too.
    """
    place = F.struct("leaf", "branch", "score", "back").alias("place")
    places = path.select("conv", "id", place)
    nothing = F.lit(None).cast(places.schema["place"].dataType)
    both = rows.withColumn("place", nothing).unionByName(places, allowMissingColumns=True).repartition("conv")
    listed = both.withColumn("places", F.collect_list("place").over(Window.partitionBy("conv", "id")))
    return listed.where("text IS NOT NULL").select("conv", "conv_id", "role", "text", F.inline("places"))


def written(turns: DataFrame) -> DataFrame:
    """One row per branch: its turns in order, end to end, and where the loss mask is."""
    branch = ["conv", "branch"]
    first, last = opening(F.col("role")), closing(F.col("role"))
    rows = turns.select("*", first.alias("first"), escaped(F.col("text")).alias("body"), last.alias("last"))
    piece = F.concat("first", "body", "last")
    order = Window.partitionBy(*branch).orderBy(F.desc("back"), "role", "text")
    rows = rows.select(
        *branch, "leaf", "score", "conv_id", (F.row_number().over(order) - 1).alias("turn"), piece.alias("piece"),
        F.length("body").alias("length"), F.length("first").alias("at"), (F.col("role") == LEARNED).alias("learned"),
        (F.sum(F.length(piece).cast("long")).over(order) - F.length(piece) + F.length("first")).alias("start"))
    loss = F.when(F.col("learned"), F.struct("turn", "at", "start", "length"))
    whole = rows.groupBy(*branch).agg(*[F.first(c).alias(c) for c in ("conv_id", "leaf", "score")],
                                      F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("pieces"),
                                      F.array_sort(F.collect_list(loss)).alias("loss"))
    return whole.select("conv_id", "branch", F.col("leaf").alias("leaf_id"), "score",
                        F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss")


def format_branches(messages: DataFrame, links: DataFrame | None = None, keep: int | None = 1,
                    large: int = LARGE) -> DataFrame:
    """conv_id, branch (rank, from 1), leaf_id, score, formatted, loss: one row per chosen branch.

    `messages` are rows (conv_id, message_id, role, text); `links` come from `replies` (the default,
    if messages have parent_id and score too) or `chained`. `loss` lists the learned texts in order: number of the turn,
    where its text begins in the turn (`at`) and in the whole (`start`), and its length, in code points.
    """
    nodes = staged(tree(replies(messages) if links is None else links), "tree")
    sizes = staged(nodes.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "conversation-sizes")
    count, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes, levels = pointers(nodes, largest)
    path = staged(enumerated(branches(nodes, levels, keep), levels), "branches")
    rows = messages.select(conversation("conv_id"), "conv_id", F.col("message_id").alias("id"),
                           F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # fewer than SHARE conversations can each hold a larger part than 1 / SHARE, so the list is short
    hot = sizes.where(F.col("n") > max(large, count // SHARE)).select("conv")
    small = rows, path
    parts = []
    if not hot.isEmpty():
        small = [x.join(F.broadcast(hot), "conv", "left_anti") for x in small]
        parts = [placed(*[x.join(F.broadcast(hot), "conv", "left_semi") for x in (rows, path)])]
    parts.append((placed if keep is None or keep > FEW else gathered)(*small))
    return reduce(DataFrame.unionByName, [written(part) for part in parts])
