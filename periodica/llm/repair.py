"""Conversation structure repair: the cheapest edits that make a conversation's roles legal, by a checkpointed DP.

A legal conversation reads ``(s?(ua)+)?`` in the initials of its roles. Its rows are kept (0), given the role user or
assistant (3), or deleted (4); turns without text are inserted (3). The state of the DP is the last initial, so
the cost from a row on is a vector of four numbers. Rows are only held as one byte each, in blocks of about the root
of their number. Cost vectors are stored at the ends of blocks alone; a block's inner ones are computed again when the
walk forward reaches it and writes the ASCII-least of the edits that lose nothing against them.

Everything is DataFrame code. A conversation that fills more than one partition is cut into parts. What a part does to
any vector is a matrix of 4 x 4 costs, and what it does to a state is one of four walks, so parts are worked on side by
side and only these are chained.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from periodica.session import materialise, shuffle_width

#: Costs of the edits, and of an undeleted row that breaks off.
REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3
_NEVER = 1 << 40
#: States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. What comes next after each
#: (but for a system row, which can only come first), what is inserted at the end, and what that costs.
_NEXT = (2, 2, 3, 2)
_TAIL = ("", "ua", "a", "")
_LAST = (0, 2 * INSERT, INSERT, 0)
#: Codes of rows: 3 * initial (1 s, 2 u, 3 a, 0 other) + 0 sound, 1 to be deleted, 2 truncated. Costs of making a code s, u, a.
_FINE, _GONE, _CUT = range(3)
_COSTS = [[
    _NEVER if flaw == _GONE else (BROKEN if flaw == _CUT else 0) + (0 if initial == made else _NEVER if made == 1 else REROLE)
    for initial in range(4) for flaw in range(3)] for made in (1, 2, 3)]
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) with faults: by crc32 of ``conv:turn`` modulo 20, 0 drops a row, 1 empties its text,
    2 takes out ``.!?``, 3 repeats it, 4 makes its role user. A null is one space in all of this, but a null turn stays null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"),
        (F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20).cast("int").alias("fault"))
    left = dealt.filter(F.col("fault") != 0).select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        "fault")
    return left.select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("col")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with ``part`` and ``pos``: conversations by turn, nulls first, ties by role and text.

    ``pos`` grows along a conversation and is consecutive within a part, a piece of it in one sorted partition.
    Conversations are cut by the sort's borders alone, so one that holds a third of all rows fills a third of the tasks.
    """
    by = ["conv", "turn", "role"]
    width = shuffle_width(rows.sparkSession)
    dealt = rows.repartitionByRange(width, *by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")
    return materialise(dealt.select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "rows")


def faults(rows: DataFrame) -> DataFrame:
    """A compact row per row of ``in_order``: conv, part, pos, turn, initial (1 s, 2 u, 3 a, 0 other) and first fault.

    blank has no character but white space, duplicate has a role and text seen earlier in the conversation, truncated
    does not end in ``.!?``; the fault of other rows is null. First holders of a text are found where the rows are and
    meet them by their own place, so copies of one text never meet in one task.
    """
    bare = F.rtrim("text", F.lit(_SPACE))
    first = F.substring("role", 1, 1)
    told = rows.select(
        "conv", "part", "pos", "turn", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("name"),
        F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0).alias("initial"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("broken"))
    firsts = told.groupBy("conv", "name").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("broken"), "truncated")
    return materialise(told.drop("name").join(firsts, "pos", "left").select(
        "conv", "part", "pos", "turn", "initial", fault.alias("fault")), "faults")


def parts(told: DataFrame) -> DataFrame:
    """A row per conversation and part: conv, part, head (its first place, which names it), n, blocks, illegal, opens, closes.

    ``blocks`` holds the codes of its rows in blocks of the root of their number; ``illegal`` counts neighbours inside
    whose initials are not su, ua or au; opens and closes are its first and last initial.
    """
    flaw = F.when(F.col("fault").isin("blank", "duplicate"), _GONE).when(F.col("fault") == "truncated", _CUT).otherwise(_FINE)
    whole = W.partitionBy("conv", "part")
    before = F.lag("initial").over(whole.orderBy("pos"))
    pair = before * 10 + F.col("initial")
    size = F.ceil(F.sqrt(F.count(F.lit(1)).over(whole)))
    rows = told.select(
        "conv", "part", "pos", "initial", (F.col("initial") * 3 + flaw).cast("tinyint").alias("code"),
        F.when(before.isNull() | pair.isin(12, 23, 32), 0).otherwise(1).alias("illegal"),
        F.floor((F.row_number().over(whole.orderBy("pos")) - 1) / size).alias("block"))
    blocks = rows.groupBy("conv", "part", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "code", "initial"))).alias("held"), F.sum("illegal").alias("illegal"))
    return materialise(blocks.groupBy("conv", "part").agg(
        F.array_sort(F.collect_list(F.struct("block", "held"))).alias("all"), F.sum("illegal").alias("illegal")).select(
        "conv", "part", F.col("all")[0]["held"][0]["pos"].alias("head"), "illegal",
        F.transform("all", lambda b: F.transform(b["held"], lambda r: r["code"])).alias("blocks"),
        F.col("all")[0]["held"][0]["initial"].alias("opens"),
        F.element_at(F.element_at("all", -1)["held"], -1)["initial"].alias("closes")), "parts")


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is computed once."""
    return F.transform(F.array(value), use)[0]


def _longs(values) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _cost(made: int, code: Column) -> Column:
    return F.element_at(_longs(_COSTS[made - 1]), code.cast("int") + 1)


def _step(after: Column, code: Column) -> Column:
    """The cost vector before a row, insertions included, from the one after it."""
    user = after[2] + _cost(2, code)
    plain = F.array(
        F.least(after[0] + DELETE, after[1] + _cost(1, code), user), F.least(after[1] + DELETE, user),
        F.least(after[2] + DELETE, after[3] + _cost(3, code)), F.least(after[3] + DELETE, user))
    closed = _given(plain, lambda v: F.array(v[0], v[1], F.least(v[2], v[3] + INSERT), F.least(v[3], v[2] + INSERT)))
    return _given(closed, lambda v: F.array(F.least(v[0], v[2] + INSERT), F.least(v[1], v[2] + INSERT), v[2], v[3]))


def _before_block(block: Column, after: Column) -> Column:
    return F.aggregate(F.reverse(block), after, _step)


def _checkpoints(blocks: Column, end: Column) -> Column:
    """The cost vectors before each block, and ``end``."""
    return F.aggregate(F.reverse(blocks), F.array(end), lambda held, block: F.concat(F.array(_before_block(block, held[0])), held))


def _edit(state: Column, code: Column, before: Column, after: Column) -> Column:
    """The next (state, edits) at a row: the ASCII-least edits whose cost is the difference of the vectors.

    Edits are D delete, K keep, U and A rerole to user and assistant, u and a insert one of these; in ASCII order of
    their initials that is D, I, K, R. Nothing is ever deleted right after an insertion: deleting first costs the same.
    """
    at = lambda v, s: F.element_at(v, s + 1)
    following = lambda s: F.element_at(F.array(*map(F.lit, _NEXT)), s + 1)
    initial = F.floor(code / 3).cast("int")

    def made(s: Column, prefix: Column) -> Column:
        return F.when((s == 0) & (initial == 1) & (after[1] + _cost(1, code) == before[0]), F.struct(
            F.lit(1).alias("state"), F.concat(prefix, F.lit("K")).alias("edits"))).otherwise(F.struct(
                following(s).alias("state"),
                F.concat(prefix, F.when(initial == following(s), "K").when(following(s) == 2, "U").otherwise("A")).alias("edits")))

    return F.when(at(after, state) + DELETE == at(before, state), F.struct(state.alias("state"), F.lit("D").alias("edits"))).when(
        at(before, following(state)) + INSERT == at(before, state),
        made(following(state), F.when(following(state) == 2, "u").otherwise("a"))).otherwise(made(state, F.lit("")))


def _walk(blocks: Column, checkpoints: Column, state: Column) -> Column:
    """(state, edits) at the end of a part that is entered in ``state``; edits has a text per row.

    The vectors inside a block are computed again from the checkpoint at its end, and forgotten after it.
    """
    start = F.struct(state.alias("state"), F.expr("cast(array() as array<string>)").alias("edits"))

    def through(held: Column, block: Column, end: Column) -> Column:
        inner = F.aggregate(F.reverse(block), F.array(end), lambda vs, code: F.concat(F.array(_step(vs[0], code)), vs))
        rows = _given(inner, lambda vs: F.transform(block, lambda code, n: F.struct(
            code.alias("code"), vs[n].alias("before"), vs[n + 1].alias("after"))))
        return F.aggregate(rows, held, lambda acc, row: _given(
            _edit(acc["state"], row["code"], row["before"], row["after"]),
            lambda e: F.struct(e["state"].alias("state"), F.concat(acc["edits"], F.array(e["edits"])).alias("edits"))))

    pieces = F.zip_with(blocks, F.slice(checkpoints, 2, F.size(blocks)), lambda b, c: F.struct(b.alias("block"), c.alias("end")))
    begun = F.struct(start.alias("now"), F.expr("cast(array() as array<array<string>>)").alias("done"))
    walked = F.aggregate(
        pieces, begun, lambda acc, p: _given(through(F.struct(acc["now"]["state"].alias("state"), start["edits"].alias("edits")), p["block"], p["end"]),
                                             lambda r: F.struct(r.alias("now"), F.concat(acc["done"], F.array(r["edits"])).alias("done"))))
    return _given(walked, lambda w: F.struct(w["now"]["state"].alias("state"), F.flatten(w["done"]).alias("edits")))


def _ended(walk: Column) -> Column:
    """The edits of a last part, with what is inserted after its last row."""
    tail = F.element_at(F.array(*map(F.lit, _TAIL)), walk["state"] + 1)
    edits = walk["edits"]
    return F.concat(F.slice(edits, 1, F.size(edits) - 1), F.array(F.concat(F.element_at(edits, -1), tail)))


def plan(pieces: DataFrame) -> DataFrame:
    """The edits of each part: conv, part, head, edits (a text per row, see ``_edit``), cost (of the whole conversation,
    null but at its first part) and ``crossing``, the illegal pairs between its parts (at its first part).

    Only a conversation that is first or last in a partition can have several parts, so at most two parts of each
    partition are chained: that is the bound of what is broadcast and of the lists a conversation is chained in.
    """
    ends = pieces.groupBy("part").agg(*(f(F.struct("head", "conv", "opens", "closes")).alias(f.__name__) for f in (F.min, F.max)))
    edge = ends.select("part", F.explode(F.array_distinct(F.array("min", "max"))).alias("edge")).select("part", "edge.*")
    lists = edge.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "head", "opens", "closes"))).alias("chain"))
    chains = materialise(lists.filter(F.size("chain") > 1), "chains")
    links = chains.select(F.explode("chain").alias("link")).select("link.head")
    alone = pieces.join(F.broadcast(links), "head", "left_anti")
    last = _longs(_LAST)
    single = alone.select("*", _checkpoints(F.col("blocks"), last).alias("marks")).select(
        "conv", "part", "head", _ended(_walk(F.col("blocks"), F.col("marks"), F.lit(0))).alias("edits"),
        F.col("marks")[0][0].alias("cost"), F.lit(0).cast("long").alias("crossing"))
    linked = materialise(pieces.join(F.broadcast(links), "head"), "linked")
    units = F.array(*(_longs(0 if s == t else _NEVER for s in range(4)) for t in range(4)))
    matrix = F.transform(units, lambda unit: F.aggregate(F.reverse("blocks"), unit, lambda v, block: _before_block(block, v)))
    folded = linked.select("conv", F.struct("part", "head", matrix.alias("matrix")).alias("link")).groupBy("conv").agg(
        F.reverse(F.array_sort(F.collect_list("link"))).alias("links"))
    through = lambda m, v: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda t: F.get(F.get(m, t), s) + F.get(v, t))))
    vectors = F.aggregate("links", F.array(last), lambda held, link: F.concat(held, F.array(through(link["matrix"], F.element_at(held, -1)))))
    given = folded.select("conv", F.element_at(vectors, -1)[0].alias("cost"), F.explode(F.zip_with(
        "links", vectors, lambda link, v: F.struct(link["head"].alias("head"), v.alias("end")))).alias("link"))
    four = linked.join(F.broadcast(given.select("link.head", "link.end", "cost")), "head").select(
        "*", _checkpoints(F.col("blocks"), F.col("end")).alias("marks")).select("*", F.transform(
            F.array(*(F.lit(s) for s in range(4))), lambda s: _walk(F.col("blocks"), F.col("marks"), s)).alias("walks"))
    walked = materialise(four.select("conv", "part", "head", "opens", "closes", "cost", "walks"), "walks")
    moves = walked.select("conv", F.struct(
        "part", "head", "opens", "closes", F.transform("walks", lambda w: w["state"]).alias("exits")).alias("link")).groupBy("conv").agg(
        F.array_sort(F.collect_list("link")).alias("links"))
    states = F.aggregate("links", F.array(F.lit(0)), lambda held, link: F.concat(
        held, F.array(F.get(link["exits"], F.element_at(held, -1)))))
    pairs = F.zip_with(F.slice("links", 1, F.size("links") - 1), F.slice("links", 2, F.size("links")), lambda a, b: F.when(
        (a["closes"] * 10 + b["opens"]).isin(12, 23, 32), 0).otherwise(1))
    crossing = F.aggregate(pairs, F.lit(0).cast("long"), lambda n, p: n + p)
    entries = moves.select(crossing.alias("crossing"), F.size("links").alias("n"), F.posexplode(F.zip_with(
        "links", states, lambda link, s: F.struct(link["head"].alias("head"), s.alias("entry")))).alias("place", "link")).filter(
        F.col("place") < F.col("n")).select("link.head", "link.entry", "crossing", "place", (F.col("place") == F.col("n") - 1).alias("ends"))
    chosen = walked.join(F.broadcast(entries), "head").select("*", F.get("walks", F.col("entry")).alias("walk"))
    chained = chosen.select(
        "conv", "part", "head", F.when(F.col("ends"), _ended(F.col("walk"))).otherwise(F.col("walk.edits")).alias("edits"),
        F.when(F.col("place") == 0, F.col("cost")).alias("cost"), F.when(F.col("place") == 0, F.col("crossing")).otherwise(0).alias("crossing"))
    return single.unionByName(chained)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations: (report, repaired).

    ``rows`` has conv, turn (a number), role and text, none of the last two null; ``damage`` gives such rows. Rows
    without a conversation form one. ``report`` has a row per conversation: conv, gaps (turns that are missing between
    the first and the last), blank, duplicate, truncated (first faults), illegal (neighbours whose initials are not su,
    ua or au), cost, audit (initials of the edits in order: Delete, Insert, Keep, Rerole). ``repaired`` holds the rows
    that are left: conv, place, at (order within a conversation), edit, role, text; the text of an inserted one is empty.

    Equal rows are duplicates of the first; rows with equal turns go by role and text; other columns are left out;
    texts are handled whole, an empty table gives no rows. One conversation's audit is one text, whatever its length.
    """
    placed = in_order(rows.select("conv", "turn", "role", "text"))
    told = faults(placed)
    pieces = parts(told)
    planned = materialise(plan(pieces), "plan")
    counts = told.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    inside = pieces.groupBy("conv").agg(F.sum("illegal").alias("inside"))
    shown = planned.groupBy("conv").agg(
        F.max("cost").alias("cost"), F.sum("crossing").alias("crossing"),
        F.array_sort(F.collect_list(F.struct("part", F.translate(F.array_join("edits", ""), "UAua", "RRII").alias("audit")))).alias("audits"))
    same = lambda other: counts["conv"].eqNullSafe(other["conv"])
    report = counts.join(inside, same(inside)).join(shown, same(shown)).select(
        counts["conv"], "gaps", "blank", "duplicate", "truncated", (F.col("inside") + F.col("crossing")).alias("illegal"), "cost",
        F.array_join(F.transform("audits", lambda a: a["audit"]), "").alias("audit"))
    edits = planned.select("head", F.posexplode("edits").alias("n", "edits")).select((F.col("head") + F.col("n")).alias("pos"), "edits")
    made = placed.join(edits, "pos").select("conv", "pos", "role", "text", F.posexplode(F.split("edits", "")).alias("at", "edit"))
    repaired = made.filter(~F.col("edit").isin("D", "")).select(
        "conv", F.col("pos").alias("place"), "at", F.translate("edit", "UAua", "RRII").alias("edit"),
        F.when(F.lower("edit") == "u", "user").when(F.lower("edit") == "a", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(F.col("edit").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))
    return report, repaired
