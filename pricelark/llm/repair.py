"""Repair of conversation structure by a higher-order fold in Spark SQL functions.

1. Window functions over a conversation's rows, in the order of (turn, role,
   text), flag what is wrong with each: blank, duplicate, truncated, a gap, an
   adjacency of roles that isn't allowed.
2. The rows are collected as sorted structs, one array per conversation.
3. aggregate() folds the array into four structs (cost, audit), one per state
   of the automaton of allowed role initials, `(s?(ua)+)?`: nothing yet, after
   the system row, after a user, after an assistant. A row is kept, given
   another role, or deleted, and turns may be inserted before it; least() takes
   the cheapest struct of those that lead to a state, and of equal costs the
   audit that is least in ASCII.

The order of (cost, audit) survives what is appended to both: of two audits of
one cost over the same rows neither is a prefix of the other, since what
follows a prefix could only be insertions, and these cost something.

One audit string says all edits: the state decides which role a changed or
inserted turn gets. A second fold reads it back into the repaired turns.

Defined cases: a null text or role is one space; a null turn comes first and
counts for no gap; a null conv_id is a conversation of its own; rows that
repeat are duplicates; an empty table gives no rows. A conversation is one
value in the result (its turns repaired, or their hash), so its rows meet in
one task: one exchange by conv_id serves the windows and the collection. The
audits' copies make the fold quadratic in a conversation's rows, at a few bytes
a step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelark.llm.common import shuffle_partitions

#: White space that doesn't count as text.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Pairs of role initials that may follow one another.
ADJACENT = ("su", "ua", "au")


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


_STATE = "struct<cost: bigint, audit: string>"


def clean(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of role and text as one space."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties it, 2 takes its .!? away, 3 repeats it, 4 makes it a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = F.crc32(key.cast("binary")) % 20
    text = F.when(d == 1, "").when(d == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    kept = clean(rows).withColumn("d", d).where("d <> 0")
    changed = kept.withColumns({"text": text, "role": F.when(d == 4, "user").otherwise(F.col("role"))})
    return changed.withColumn("copy", F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("d", "copy")


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with their faults: `fault` (blank, duplicate, truncated or null), `new_turn`, `illegal`."""
    dealt = clean(rows).repartition(shuffle_partitions(rows.sparkSession), "conv_id")
    order = ["turn", "role", "text"]
    same = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    inside = Window.partitionBy("conv_id").orderBy(*order)
    body = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    fault = F.when(body == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.right(body, F.lit(1)).isin(*ENDS), "truncated")
    rows = dealt.withColumn("seen", F.row_number().over(same)).withColumns({"fault": fault, "initial": initial})
    before, pair = F.lag("turn").over(inside), F.concat(F.lag("initial").over(inside), "initial")
    return rows.withColumns({"new_turn": F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == before, F.lit(False)), "illegal": F.coalesce(~pair.isin(*ADJACENT), F.lit(False))})


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _edit(state: Column, letter: Column | str, cost: Column | int) -> Column:
    """The struct after an edit; null where there is no such state."""
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letter).alias("audit")))


def _with_insertions(s: Column, c: Costs) -> Column:
    """States that insertions lead to: a user from all but an open one, an assistant after it."""
    user = lambda x: _edit(x, "I", c.insert)
    both = lambda x: _edit(x, "II", 2 * c.insert)
    none, system, asked, told = (s[k] for k in ("none", "system", "asked", "told"))
    return F.struct(
        none.alias("none"), system.alias("system"),
        F.least(asked, user(none), user(system), user(told)).alias("asked"),
        F.least(told, user(asked), both(none), both(system)).alias("told"),
    )


def _step(s: Column, row: Column, c: Costs) -> Column:
    """The four states after a row."""
    stays = ~row["fault"].isin("blank", "duplicate") | row["fault"].isNull()
    extra = F.when(row["fault"] == "truncated", c.truncated).otherwise(0)
    gone = lambda x: _edit(x, "D", c.delete)
    kept = lambda x, initial: F.when(stays & (row["initial"] == initial), _edit(x, "K", extra + c.keep))
    # a row of the right role is never better off with another
    turned = lambda x, initial: F.when(stays, _edit(x, F.when(row["initial"] == initial, "K").otherwise("R"), extra + F.when(row["initial"] == initial, c.keep).otherwise(c.rerole)))
    return F.struct(
        gone(s["none"]).alias("none"),
        F.least(gone(s["system"]), kept(s["none"], "s")).alias("system"),
        F.least(gone(s["asked"]), turned(s["none"], "u"), turned(s["system"], "u"), turned(s["told"], "u")).alias("asked"),
        F.least(gone(s["told"]), turned(s["asked"], "a")).alias("told"),
    )


def cheapest(rows: Column, costs: Costs = Costs()) -> Column:
    """struct<cost, audit> of the cheapest edits of an array of structs with initial and fault."""
    states = f"struct<none: {_STATE}, system: {_STATE}, asked: {_STATE}, told: {_STATE}>"
    nothing = F.lit(None).cast(_STATE)
    start = F.struct(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit")).alias("none"), nothing.alias("system"), nothing.alias("asked"), nothing.alias("told")).cast(states)
    step = lambda s, row: _let(_with_insertions(s, costs), lambda w: _step(w, row, costs)).cast(states)
    return F.aggregate(rows, start, step, lambda s: _let(_with_insertions(s, costs), lambda w: F.least(w["none"], w["told"])))


def repaired_turns(rows: Column, audit: Column) -> Column:
    """array<struct<role, text>>: the rows (role, text) after the edits of an audit."""
    kind = "struct<at: int, open: boolean, turns: array<struct<role: string, text: string>>>"
    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("open"), F.array().cast("array<struct<role: string, text: string>>").alias("turns")).cast(kind)

    def step(s: Column, letter: Column) -> Column:
        row = F.try_element_at(rows, s["at"])
        role = F.when(letter == "K", row["role"]).when(s["open"], "assistant").otherwise("user")
        made = F.array(F.struct(role.alias("role"), F.when(letter == "I", "").otherwise(row["text"]).alias("text")))
        return F.struct(
            F.when(letter == "I", s["at"]).otherwise(s["at"] + 1).alias("at"),
            F.when(letter == "D", s["open"]).otherwise(F.startswith(role, F.lit("u"))).alias("open"),
            F.when(letter == "D", s["turns"]).otherwise(F.concat(s["turns"], made)).alias("turns"),
        ).cast(kind)

    letters = F.filter(F.split(audit, ""), lambda x: x != "")
    return F.aggregate(letters, start, step, lambda s: s["turns"])


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (array of role, text)."""
    row = F.struct("turn", "role", "text", "seen", "initial", "fault")
    count = lambda c: F.count_if(c).alias
    found = flagged(rows).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps"),
        count(F.col("fault") == "blank")("blank"), count(F.col("fault") == "duplicate")("duplicate"), count(F.col("fault") == "truncated")("truncated"), count(F.col("illegal"))("illegal"),
        F.sort_array(F.collect_list(row)).alias("rows"),
    )
    found = found.withColumn("best", cheapest(F.col("rows"), costs))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), repaired_turns(F.col("rows"), F.col("best.audit")).alias("repaired"))
