"""Conversation structure repair: the cheapest edits that make roles alternate, by tight arcs between costs from both ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolake.operators.ordinals import numbered

from .common import materialize

# White space, ends of sentences, costs of edits, and the letters of edits in their ASCII order.
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
LETTERS = "DIKR"

# What has been said so far: nothing, system, user, assistant; a conversation may end at nothing or at assistant.
BLOCK, MAX_CHARS, FAR = 512, 1 << 22, 1 << 40
STATES, ENTER, LEAVE = 4, np.array([0, FAR, FAR, FAR]), np.array([0, FAR, FAR, 0])
NEXT = np.array([2, 2, 3, 2])  # the state that the one role which may come next leads to, system apart
SAID = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1] * 4])  # by initial (s, u, a, another) and state
FINE, CUT, GONE, PAD = 0, 1, 2, 12  # a row's code is 3 * initial + fault; PAD stands behind the last row


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code, letter and state: cost and target of the edit (FAR and 0 where there is none); and costs of inserts alone."""
    cost, to = np.full((PAD + 1, 4, STATES), FAR), np.zeros((PAD + 1, 4, STATES), np.int64)
    states = np.arange(STATES)
    cost[:PAD, 0], to[:PAD, 0] = DELETE, states
    cost[:PAD, 1], to[:PAD, 1] = INSERT, NEXT
    for code in range(PAD):
        initial, fault = divmod(code, 3)
        if fault != GONE:
            more = TRUNCATED * (fault == CUT)
            said = SAID[initial]
            cost[code, 2], to[code, 2] = np.where(said >= 0, more, FAR), np.maximum(said, 0)
            cost[code, 3], to[code, 3] = REROLE + more, NEXT
    cost[PAD, 1], to[PAD, 1] = INSERT, NEXT
    inserts = np.full((STATES, STATES), FAR)
    for q in states:
        at, spent = q, 0
        while spent < inserts[q, at]:
            inserts[q, at] = spent
            at, spent = NEXT[at], spent + INSERT
    return cost, to, inserts


COST, TO, INSERTS = _tables()


def _steps() -> np.ndarray:
    """By code: least cost from a state before the row and before inserts to a state after the row; PAD changes nothing."""
    row = np.full((PAD + 1, STATES, STATES), FAR)
    for code in range(PAD):
        for letter in (0, 2, 3):
            for q in range(STATES):
                r = TO[code, letter, q]
                row[code, q, r] = min(row[code, q, r], COST[code, letter, q])
    row[PAD][np.diag_indices(STATES)] = 0
    return row


STEP = _steps()


def _through(costs: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    return np.minimum((costs[:, :, None] + arcs).min(1), FAR)


def _onward(arcs: np.ndarray, costs: np.ndarray) -> np.ndarray:
    return np.minimum((arcs + costs[:, None, :]).min(2), FAR)


def _padded(codes: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(codes), max(map(len, codes), default=0) + 1), PAD)
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


def forward(codes: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """(item, place, state): least cost from the beginning to the state before the row at the place, inserts there made."""
    out = np.empty((*codes.shape, STATES), np.int64)
    out[:, 0] = _through(enter, INSERTS[None])
    for i in range(codes.shape[1] - 1):
        out[:, i + 1] = _through(_through(out[:, i], STEP[codes[:, i]]), INSERTS[None])
    return out


def backward(codes: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """(item, place, state): least cost from there to the end."""
    out = np.empty((*codes.shape, STATES), np.int64)
    out[:, -1] = _onward(INSERTS[None], leave)
    for i in range(codes.shape[1] - 2, -1, -1):
        out[:, i] = _onward(INSERTS[None], _onward(STEP[codes[:, i]], out[:, i + 1]))
    return out


def walk(codes: np.ndarray, sizes: np.ndarray, ahead: np.ndarray, behind: np.ndarray, start: np.ndarray, last: np.ndarray):
    """The least letters along tight arcs: (audits, plans, states at the end) of each item.

    An arc is tight if the cost before it, its own and the cost behind it make the least cost in all. The frontier is
    the set of states that the letters so far can lead to; each step takes the least letter of a tight arc that leaves
    it. A plan has 3 * row for a row kept, 1 or 2 more for one rerolled to user or assistant, and -1 or -2 for one
    inserted. Items that are not the last of their conversation end before inserts behind their last row.
    """
    n = len(codes)
    item, place = np.arange(n), np.zeros(n, np.int64)
    frontier = np.zeros((n, STATES), bool)
    frontier[item, start] = True
    least = (ahead[item, 0, start] + behind[item, 0, start])[:, None, None]
    audits: list[list[str]] = [[] for _ in range(n)]
    plans: list[list[int]] = [[] for _ in range(n)]
    going = item[(place < sizes) | last]
    while len(going):
        i, at = going, place[going]
        code = codes[i, at]
        move = COST[code]  # (item, letter, state)
        stay = np.minimum(at + 1, codes.shape[1] - 1)
        after = np.stack([behind[i, stay], behind[i, at], behind[i, stay], behind[i, stay]], 1)
        beyond = np.take_along_axis(after, TO[code], 2)
        tight = frontier[i][:, None, :] & (move < FAR) & (ahead[i, at][:, None, :] + move + beyond == least[i])
        letters = tight.any(2)
        some = letters.any(1)
        pick = letters.argmax(1)
        i, at, pick, code = i[some], at[some], pick[some], code[some]
        arcs, targets = tight[some, pick], TO[code, pick]
        frontier[i] = False
        rows, states = np.nonzero(arcs)
        frontier[i[rows], targets[rows, states]] = True
        place[i] = at + (pick != 1)
        to = targets[np.arange(len(i)), arcs.argmax(1)]  # the letters and the rows' roles tell the state
        for x, p, a, t in zip(i.tolist(), pick.tolist(), at.tolist(), to.tolist(), strict=True):
            audits[x].append(LETTERS[p])
            if p:
                plans[x].append(1 - t if p == 1 else 3 * a + (t - 1) * (p == 3))
        going = i[(place[i] < sizes[i]) | last[i]]
    return ["".join(a) for a in audits], plans, frontier.argmax(1)


def _illegal(codes: list[np.ndarray]) -> list[int]:
    """Neighbours whose initials are not s u, u a or a u."""
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True
    return [int((~legal[c[:-1] // 3, c[1:] // 3]).sum()) for c in codes]


def _repaired(codes: pd.Series) -> pd.DataFrame:
    """Whole conversations: longer ones in batches of their own, so that little is padding."""
    each, out = [np.asarray(c, np.int64) for c in codes], [None] * len(codes)
    order = np.argsort([len(c) for c in each], kind="stable")
    for part in np.array_split(order, max(1, len(order) // 256)):
        own = [each[i] for i in part]
        grid, n = _padded(own), len(part)
        ahead, behind = forward(grid, np.tile(ENTER, (n, 1))), backward(grid, np.tile(LEAVE, (n, 1)))
        audits, plans, _ = walk(grid, np.array([len(c) for c in own]), ahead, behind, np.zeros(n, np.int64), np.ones(n, bool))
        for i, a, p, b, g in zip(part, audits, plans, behind[:, 0, 0].tolist(), _illegal(own), strict=True):
            out[i] = (b, a, p, g)
    return pd.DataFrame(out, columns=["cost", "audit", "plan", "illegal"])


def damaged(conversations: DataFrame) -> DataFrame:
    """(ck, conv_id, turn, role, text, gone): rows as damaged by their key's checksum; a dropped row stays, marked gone."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("ck"), "conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
        (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("harm"),
    )
    hurt = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "ck", "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"),
        (F.col("harm") == 0).alias("gone"), F.explode(times).alias("copy"),
    ).drop("copy")


def _fault(text: Column, repeated: Column) -> Column:
    bare = F.rtrim(text, F.lit(WHITE))
    return F.when(F.length(bare) == 0, GONE).when(repeated, GONE).when(~F.right(bare, F.lit(1)).isin(*ENDS), CUT).otherwise(FINE)


def _initial(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _line(role: Column, text: Column, plan: Column) -> Column:
    """`role:text` of one entry of a plan."""
    named = F.when((plan == -1) | ((plan >= 0) & (plan % 3 == 1)), "user").when((plan == -2) | ((plan >= 0) & (plan % 3 == 2)), "assistant").otherwise(role)
    return F.concat(named, F.lit(":"), F.when(plan >= 0, text).otherwise(""))


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size, each one row with its rows in order."""
    one = rows.groupBy("ck").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.when(~F.col("gone"), F.struct("turn", "role", "text")))).alias("rows"),
    )
    same = lambda x, i: F.exists(F.slice("rows", 1, i), lambda y: (y["text"] == x["text"]) & (y["role"] == x["role"]))
    fault = F.transform("rows", lambda x, i: F.struct(_initial(x["role"]).alias("i"), _fault(x["text"], same(x, i)).alias("f"), (F.length(F.rtrim(x["text"], F.lit(WHITE))) == 0).alias("b")))
    one = one.withColumn("found", fault)
    one = one.withColumn("r", F.pandas_udf(_repaired, "cost long, audit string, plan array<int>, illegal long")(F.transform("found", lambda x: x["i"] * 3 + x["f"])))
    turns = F.filter(F.transform("rows", lambda x: x["turn"]), lambda x: x.isNotNull())
    lines = F.transform("r.plan", lambda p: _line(F.get("rows", F.floor(p / 3).cast("int"))["role"], F.get("rows", F.floor(p / 3).cast("int"))["text"], p))
    many = lambda f: F.size(F.filter("found", f)).cast("long")
    gaps = F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns))
    return one.select(
        "conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), many(lambda x: x["b"]).alias("blank"), many(lambda x: (x["f"] == GONE) & ~x["b"]).alias("duplicate"),
        many(lambda x: x["f"] == CUT).alias("truncated"), "r.illegal", "r.cost", "r.audit", F.sha2(F.concat_ws("\n", lines), 256).alias("repaired_sha256"),
    )


def _summary(codes: pd.Series) -> pd.DataFrame:
    """A block's least costs between states, from before its first row to before the row that follows, and its ends."""
    each = [np.asarray(c, np.int64) for c in codes]
    out = []
    for c in each:
        grid = np.tile(_padded([c]), (STATES, 1))
        to = forward(grid, np.where(np.eye(STATES, dtype=bool), 0, FAR))[:, len(c)]
        out.append((to.ravel().tolist(), int(c[0] // 3), int(c[-1] // 3)))
    return pd.DataFrame(out, columns=["costs", "first", "last"]).assign(illegal=_illegal(each))


def _costs_at(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs from the beginning to each block and from behind it to the end, of one conversation's summaries."""
    pdf = pdf.sort_values("block")
    arcs = np.array(pdf["costs"].tolist()).reshape(-1, STATES, STATES)
    enter, leave = [ENTER[None]], [LEAVE[None]]
    for a in arcs[:-1]:
        enter.append(_through(enter[-1], a[None]))
    leave[0] = _onward(INSERTS[None], leave[0])
    for a in arcs[:0:-1]:
        leave.append(_onward(a[None], leave[-1]))
    legal = {(0, 1), (1, 2), (2, 1)}
    seams = [0, *[int(x not in legal) for x in zip(pdf["last"].iloc[:-1], pdf["first"].iloc[1:], strict=True)]]
    return pd.DataFrame({
        "ck": pdf["ck"], "block": pdf["block"], "enter": [x[0].tolist() for x in enter], "leave": [x[0].tolist() for x in leave[::-1]],
        "final": [False] * (len(pdf) - 1) + [True], "illegal": pdf["illegal"] + seams, "cost": int(_onward(arcs[:1], leave[-1])[0, 0]),
    })


def _walked(codes: pd.Series, enter: pd.Series, leave: pd.Series, start: pd.Series, final: pd.Series):
    grid = _padded([np.asarray(c, np.int64) for c in codes])
    sizes = np.array([len(c) for c in codes])
    behind = np.empty((*grid.shape, STATES), np.int64)
    for i, (c, b) in enumerate(zip(codes, leave, strict=True)):
        behind[i, : len(c) + 1] = backward(grid[i : i + 1, : len(c) + 1], np.asarray(b, np.int64)[None])[0]
    return walk(grid, sizes, forward(grid, np.stack([np.asarray(e, np.int64) for e in enter])), behind, np.asarray(start, np.int64), np.asarray(final, bool))


def _ends(codes: pd.Series, leave: pd.Series, final: pd.Series) -> pd.Series:
    """The state behind a block for each state before it, if the costs behind it are followed."""
    out = []
    for c, b, f in zip(codes, leave, final, strict=True):
        four = pd.Series([c] * STATES)
        enter = pd.Series(np.where(np.eye(STATES, dtype=bool), 0, FAR).tolist())
        out.append(_walked(four, enter, pd.Series([b] * STATES), pd.Series(range(STATES)), pd.Series([f] * STATES))[2].tolist())
    return pd.Series(out)


def _starts_at(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of one conversation begins."""
    pdf, state, out = pdf.sort_values("block"), 0, []
    for ends in pdf["ends"]:
        out.append(state)
        state = int(ends[state])
    return pd.DataFrame({"ck": pdf["ck"], "block": pdf["block"], "start": out})


def _letters(codes: pd.Series, enter: pd.Series, leave: pd.Series, start: pd.Series, final: pd.Series) -> pd.DataFrame:
    audits, plans, _ = _walked(codes, enter, leave, start, final)
    return pd.DataFrame({"audit": audits, "plan": plans})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's lines as they stream by in order: a digest is the one thing that no split can share."""
    key, made = None, None
    for pdf in batches:
        done = []
        for ck, line in zip(pdf["ck"], pdf["line"], strict=True):
            if ck != key:
                if made:
                    done.append((key, made.hexdigest()))
                key, made = ck, hashlib.sha256(line.encode())
            else:
                made.update(b"\n" + line.encode())
        if done:
            yield pd.DataFrame(done, columns=["ck", "repaired_sha256"])
    if made:
        yield pd.DataFrame([(key, made.hexdigest())], columns=["ck", "repaired_sha256"])


def _by_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Conversations of any size: blocks of rows are summed up as costs between states, joined, and walked on their own."""
    held = materialize(rows.where("not gone").drop("gone"), "dialogue-rows")
    own = held.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    placed = numbered(own, ["turn", "role", "text", "tie"], ["ck"], "place")
    firsts = placed.groupBy("ck", "role", "text").agg(F.min("place").alias("place")).select("ck", "place", F.lit(True).alias("first"))
    known = placed.join(firsts, ["ck", "place"], "left").withColumn("blank", F.length(F.rtrim("text", F.lit(WHITE))) == 0)
    known = known.withColumn("fault", _fault(F.col("text"), F.col("first").isNull())).withColumn("block", F.floor(F.col("place") / block))
    known = known.select("ck", "conv_id", "place", "block", "turn", "role", "text", "blank", "fault", (_initial(F.col("role")) * 3 + F.col("fault")).alias("code"))
    known = materialize(known, "dialogue-places")
    codes = known.groupBy("ck", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]).alias("codes"))
    blocks = materialize(codes.withColumn("s", F.pandas_udf(_summary, "costs array<long>, first int, last int, illegal long")("codes")), "dialogue-blocks")
    around = blocks.select("ck", "block", "s.*").groupBy("ck").applyInPandas(
        _costs_at, "ck string, block long, enter array<long>, leave array<long>, final boolean, illegal long, cost long")
    around = materialize(blocks.select("ck", "block", "codes").join(around, ["ck", "block"]), "dialogue-costs")
    starts = around.select("ck", "block", F.pandas_udf(_ends, "array<int>")("codes", "leave", "final").alias("ends")).groupBy("ck").applyInPandas(_starts_at, "ck string, block long, start int")
    done = around.join(starts, ["ck", "block"]).withColumn("r", F.pandas_udf(_letters, "audit string, plan array<int>")("codes", "enter", "leave", "start", "final"))
    done = materialize(done.select("ck", "block", "illegal", "cost", "r.*"), "dialogue-edits")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    per = done.groupBy("ck").agg(joined.alias("audit"), F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    n = lambda c: F.count_if(c).alias
    told = known.groupBy("ck").agg(
        F.first("conv_id").alias("conv_id"), (F.max("turn") - F.min("turn") + 1).alias("span"), n(F.col("blank"))("blank"),
        n((F.col("fault") == GONE) & ~F.col("blank"))("duplicate"), n(F.col("fault") == CUT)("truncated"))
    turns = known.select("ck", "turn").where("turn is not null").distinct().groupBy("ck").agg(F.count("*").alias("turns"))
    entries = done.select("ck", "block", F.posexplode("plan").alias("at", "p")).withColumn("place", F.when(F.col("p") >= 0, F.col("block") * block + F.floor(F.col("p") / 3)))
    lines = entries.join(known.select("ck", "place", "role", "text"), ["ck", "place"], "left").select("ck", "block", "at", _line(F.col("role"), F.col("text"), F.col("p")).alias("line"))
    digest = lines.repartition("ck").sortWithinPartitions("ck", "block", "at").select("ck", "line").mapInPandas(_digests, "ck string, repaired_sha256 string")
    out = told.join(per, "ck").join(turns, "ck", "left").join(digest, "ck", "left")
    return out.select(
        "conv_id", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def repair(conversations: DataFrame, block: int = BLOCK, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row a conv_id (conv_id, turn, role, text in): its faults, the cheapest edits and a digest of what they leave.

    A conversation of at most `block` rows and `max_chars` characters is one row of a task; any longer one is worked in
    blocks of rows: each block's least costs between the four states are joined along the conversation (one short row a
    block), and every block is then walked by itself. Only the digest of a long conversation streams through one task,
    row by row, as SHA-256 has it.

    Defined cases: null role or text is one space, a null conv_id is a conversation of its own, null turns come first and
    do not count as gaps; rows of one turn stand by role, then text; repeated rows are duplicates; blank texts are blank
    before they are duplicates; roles whose first letter is not s, u or a cannot stay; a conversation that loses all
    its rows has zeros, an empty audit and the empty text's digest; an empty table gives no rows; other columns do not
    matter.
    """
    rows = damaged(conversations)
    large = rows.groupBy("ck").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).where((F.col("n") > block) | (F.col("chars") > max_chars)).select("ck")
    large = materialize(large, "dialogues-long")
    if large.isEmpty():
        return _whole(rows)
    mine = rows.join(large, "ck", "left_semi")
    # A long conversation that loses every row has no blocks; one of its rows stands for it.
    lost = mine.groupBy("ck").agg(F.first("conv_id").alias("conv_id"), F.bool_and("gone").alias("gone")).where("gone")
    lost = lost.select("ck", "conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "gone")
    return _whole(rows.join(large, "ck", "left_anti").unionByName(lost)).unionByName(_by_blocks(mine, block))
