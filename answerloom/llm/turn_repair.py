"""Repairing the turn structure of conversations with the cheapest edits, by a checkpointed DP."""

from functools import lru_cache
from hashlib import sha256
from math import isqrt

from pyspark.sql import functions as F

from answerloom.session import cut_lineage, ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_BITS = 12  # a block is a run of at most 4,096 rows of one conversation
WHITE = r"' \t\n\u000B\f\r'"

# The role initials must read (s?(ua)+)?. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEEDED = (2, 2, 3, 2)  # where the one role that may follow (and is user or assistant) leads
ACCEPTS = (0, 3)
INITIALS = "sua"
KEPT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
FAR = 1 << 60

# A row is one letter: 4 * fault + initial. Faults: 0 none, 1 blank, 2 duplicate, 3 truncated;
# initials: 0 s, 1 u, 2 a, 3 any other.


def _before(code, after):
    """Least costs from the four states in front of a row, given those behind it."""
    fault, initial = divmod(code, 4)
    costs = [DELETE + c for c in after]
    if fault in (0, 3):
        extra = TRUNCATED if fault == 3 else 0
        for q in range(4):
            kept = KEPT[q][initial] if initial < 3 else None
            if kept is not None:
                costs[q] = min(costs[q], KEEP + extra + after[kept])
            costs[q] = min(costs[q], REROLE + extra + after[NEEDED[q]])
    return _with_inserts(costs)


def _with_inserts(costs):
    """Costs when turns may be inserted first; behind a user and behind an assistant they lead to each other."""
    c0, c1, c2, c3 = costs
    c2, c3 = min(c2, INSERT + c3), min(c3, INSERT + c2)
    return [min(c0, INSERT + c2), min(c1, INSERT + c2), c2, c3]


END = _with_inserts([0 if q in ACCEPTS else FAR for q in range(4)])


def _walk(codes, costs, q, last):
    """ASCII-least tight edits of some rows from state ``q``; ``costs[i]`` is the vector in front of row i."""
    edits = []
    for i, code in enumerate(codes):
        fault, initial = divmod(code, 4)
        extra = TRUNCATED if fault == 3 else 0
        while True:
            here, after = costs[i][q], costs[i + 1]
            if here == DELETE + after[q]:
                edits.append("D")
                break
            if here == INSERT + costs[i][NEEDED[q]]:
                edits.append("I")
                q = NEEDED[q]
                continue
            kept = KEPT[q][initial] if initial < 3 else None
            if kept is not None and here == KEEP + extra + after[kept]:
                edits.append("K")
                q = kept
            else:
                edits.append("R")
                q = NEEDED[q]
            break
    while last and q not in ACCEPTS:
        edits.append("I")
        q = NEEDED[q]
    return "".join(edits), q


def cheapest_edits(codes, cuts=()):
    """Cost and edits of a conversation of row codes: one edit string per part between ``cuts``, with its first state.

    Backward cost vectors are kept only at checkpoints about sqrt(n) rows apart
    (and at the cuts); walking forward, the vectors of one stretch at a time
    are computed again. Edits are D(elete), I(nsert), K(eep), R(erole); of
    equally cheap ones the ASCII-least string is taken, letter by letter, which
    is sound because no cheapest string is the beginning of another.
    """
    n = len(codes)
    step = max(isqrt(n), 1)
    marks = sorted({*range(0, n, step), *cuts, 0, n})
    vector, at_mark, due = END, {n: END}, set(marks)
    for i in range(n - 1, -1, -1):
        vector = _before(codes[i], vector)
        if i in due:
            at_mark[i] = vector
    cost, q, parts, begins = at_mark[0][0], 0, [], {0, *cuts}
    for low, high in zip(marks, marks[1:] or [n]):
        costs = [None] * (high - low) + [at_mark[high]]
        for i in range(high - low - 1, -1, -1):
            costs[i] = _before(codes[low + i], costs[i + 1])
        if low in begins:
            parts.append([q, ""])
        edits, q = _walk(codes[low:high], costs, q, high == n)
        parts[-1][1] += edits
    return cost, [tuple(p) for p in parts]


@lru_cache(maxsize=50_000)
def _short(codes):
    return cheapest_edits(codes)


def _plans(batches):
    """A row per conversation: its blocks of row codes become costs, counts and blocks of edits."""
    import pyarrow as pa

    kinds = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]))
    for batch in batches:
        out = []
        for conv, blocks in zip(*(c.to_pylist() for c in batch.columns)):
            text = "".join(b["codes"] for b in blocks).encode()
            codes = bytes(c - 65 for c in text)
            cuts, at = [], 0
            for b in blocks:
                cuts.append(at)
                at += len(b["codes"])
            cost, parts = _short(codes) if len(blocks) == 1 and at <= 64 else cheapest_edits(codes, cuts)
            faults = [sum(codes.count(4 * f + i) for i in range(4)) for f in range(4)]
            initials = bytes(c % 4 for c in codes)
            legal = sum(1 for pair in zip(initials, initials[1:]) if pair in ((0, 1), (1, 2), (2, 1)))
            out.append((
                conv, *faults[1:], max(at - 1, 0) - legal, cost, "".join(e for _, e in parts),
                [{"block": b["block"], "state": q, "edits": e} for b, (q, e) in zip(blocks, parts)]))
        columns = list(zip(*out)) or [[]] * 8
        types = [pa.int64()] * 6 + [pa.string(), kinds]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "blocks"])


def number_turns(rows, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """The rows in order, written: ``(conv_id, turn, role, text, same, code, at)``.

    ``at`` rises along a conversation's turns (NULL first; rows of one turn by
    a hash of role and text). The rows are dealt by ranges of that order, so a conversation of any
    length is spread over as many tasks as its share of the rows asks for.
    """
    turns = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    same = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    ending = F.expr(f"right(trim(TRAILING {WHITE} FROM text), 1)")
    initial = F.substring("role", 1, 1)
    initial_no = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault_no = F.when(ending == "", 1).when(ending.isin(".", "!", "?"), 0).otherwise(3)
    turns = turns.withColumns({"same": same, "code": (4 * fault_no + initial_no).cast("int")})
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "same")]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")


def plan_repairs(numbered):
    """One row per conversation: ``conv_id, blank, duplicate, truncated, illegal, cost, audit, blocks``, written.

    Rows become one letter each before they are gathered, block by block and then per
    conversation; the gathered letters are as long as the audit itself. Texts
    stay where they are. A repeated row is known by a hash of role and text, whose first
    places are found by an aggregation that combines in the map tasks.
    """
    ship_package(numbered.sparkSession)
    narrow = numbered.select("conv_id", "same", "at", "code")
    repeated = (
        narrow.groupBy("conv_id", "same").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first")
    )
    marked = narrow.join(
        repeated, narrow.conv_id.eqNullSafe(repeated.c) & (narrow.same == repeated.s), "left")
    again = (F.col("at") > F.col("first")) & (F.floor(F.col("code") / 4) != 1)
    code = F.when(again, 8 + F.col("code") % 4).otherwise(F.col("code"))
    blocks = (
        marked.groupBy("conv_id", F.shiftright("at", BLOCK_BITS).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("at", F.char((65 + code).cast("long")).alias("letter")))).alias("rows"))
        .select("conv_id", "block", F.array_join("rows.letter", "").alias("codes"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "codes"))).alias("blocks"))
    )
    plans = blocks.select("conv_id", "blocks").mapInArrow(
        _plans, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "blocks array<struct<block:long, state:int, edits:string>>")
    return cut_lineage(plans, "repairs")


def _with_edits(numbered, plans):
    """Turns and, in front of each block of them, its edits."""
    edits = plans.select("conv_id", F.inline("blocks")).select(
        "conv_id", F.shiftleft("block", BLOCK_BITS).alias("at"), "block", "edits", "state",
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turns = numbered.select(
        "conv_id", "at", F.shiftright("at", BLOCK_BITS).alias("block"), F.lit(None).cast("string").alias("edits"),
        F.lit(None).cast("int").alias("state"), "role", "text")
    return edits.unionByName(turns)


def _apply(batches):
    """Edited rows ``(conv_id, at, n, role, text, edit)`` of each input batch, in order."""
    edits, place, last, q = "", 0, 0, 0
    role_of = {2: "user", 3: "assistant"}
    for batch in batches:
        out = []
        for conv, at, block_edits, state, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if block_edits is not None:
                edits, place, last, q = block_edits, 0, len(block_edits.rstrip("I")), state
                continue
            n, waiting = 0, True
            while waiting or last <= place < len(edits):
                edit = edits[place]
                place += 1
                if edit == "I":
                    q = NEEDED[q]
                    out.append((conv, at, n, role_of[q], "", edit))
                    n += 1
                    continue
                waiting = False
                if edit == "D":
                    continue
                if edit == "R":
                    q = NEEDED[q]
                    role = role_of[q]
                else:
                    q = KEPT[q][INITIALS.index(role[0])]
                out.append((conv, at, n, role, text, edit))
                n += 1
        yield out


def _repaired(batches):
    import pyarrow as pa

    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    for out in _apply(batches):
        columns = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "at", "n", "role", "text", "edit"])


def repaired_turns(numbered, plans):
    """The rows after the edits: ``(conv_id, at, n, role, text, edit)``; ``at, n`` is their order.

    Dealt by conversation and block, so a long conversation is many tasks' work.
    """
    dealt = _with_edits(numbered, plans).repartition("conv_id", "block").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "block", "at", F.col("edits").isNull())
    return dealt.select("conv_id", "at", "edits", "state", "role", "text").mapInArrow(
        _repaired, "conv_id long, at long, n int, role string, text string, edit string")


def _digests(batches):
    import pyarrow as pa

    ids, digests = [], []

    def flush(final=False):
        keep = 0 if final else 1
        done = len(ids) - keep
        rows = pa.RecordBatch.from_arrays(
            [pa.array(ids[:done], pa.int64()), pa.array([d.hexdigest() for d in digests[:done]], pa.string())],
            ["conv_id", "repaired_sha256"])
        del ids[:done], digests[:done]
        return rows

    for out in _apply(batches):
        for conv, _, _, role, text, _ in out:
            if not ids or ids[-1] != conv:
                ids.append(conv)
                digests.append(sha256())
            else:
                digests[-1].update(b"\n")
            digests[-1].update(f"{role}:{text}".encode())
        if len(ids) > 10_000:
            yield flush()
    yield flush(final=True)


def repaired_digests(numbered, plans):
    """SHA-256 of each repaired conversation's ``role:text`` lines; conversations without any rows left are missing.

    One digest reads its conversation in order, so its rows stream through one task; nothing is held but the hash.
    """
    dealt = _with_edits(numbered, plans).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "at", F.col("edits").isNull())
    return dealt.select("conv_id", "at", "edits", "state", "role", "text").mapInArrow(
        _digests, "conv_id long, repaired_sha256 string")


def turn_gaps(numbered):
    """Missing turn numbers per conversation: largest less smallest plus one, less the distinct ones (no NULLs)."""
    turns = numbered.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"))


def repair_conversations(rows, **columns):
    """Report, repaired rows and their digests of conversations: ``(report, turns, digests)`` DataFrames.

    ``report`` has ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``. A row's first
    fault counts: blank (white space only), duplicate (role and text seen earlier), truncated
    (does not end in ``.!?``). Keep costs 0, rerole to user or assistant 1, delete
    2 (the only edit for blank and duplicate rows), an empty inserted turn 5; truncated rows that stay
    add 5. The result's role initials read ``(s?(ua)+)?``.

    NULL roles and texts count as one space, NULL turns come first, rows with
    a NULL conversation form one. Repeated rows are duplicates. Texts of any
    length pass through unread. An empty table gives empty results; a conversation without
    rows has none. Other columns are ignored, whatever their names.
    """
    numbered = number_turns(rows, **columns)
    plans = plan_repairs(numbered)
    gaps = turn_gaps(numbered).withColumnRenamed("conv_id", "c")
    report = plans.drop("blocks").join(gaps, plans.conv_id.eqNullSafe(gaps.c)).drop("c")
    return report, repaired_turns(numbered, plans), repaired_digests(numbered, plans)


def damage(rows):
    """Turns as a noisy source would give them, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes its role user.
    NULLs count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    drawn = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(
        F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return drawn.where("draw <> 0").select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(times).alias("copy")).drop("copy")
