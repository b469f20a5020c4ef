"""Conversation structure repair: the cheapest edits to alternating turns, on a graph of tight arcs cut into blocks of turns."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: What edits cost, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: White space, ends of sentences.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"

#: What has been written so far: nothing, a system turn, or ends in a user's or an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the only turn of a user or an assistant that may follow.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Costs of ending in each state, and a cost that nothing reaches.
FAR = 1 << 50
END, BEGIN = [0, FAR, FAR, 0], [0, FAR, FAR, FAR]


def arcs_of(initial: str, fault: str) -> tuple[tuple[str, int, int, int, str | None], ...]:
    """Arcs (letter, state, next state, cost, role given) over a turn, by letter."""
    out = [("D", q, q, DELETE, None) for q in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        out += [("K", q, NEXT[q], more, None) for q in range(4) if ROLES[NEXT[q]][0] == initial]
        out += [("K", START, SYSTEM, more, None)] if initial == "s" else []
        out += [("R", q, NEXT[q], REROLE + more, ROLES[NEXT[q]]) for q in range(4)]
    return tuple(out)


#: The arcs by initial and fault; other initials than these three are all alike. A plain table travels to executors with the functions.
ARCS = {(initial, fault): arcs_of(initial, fault) for initial in "sua?" for fault in ("", "blank", "duplicate", "truncated")}


def arcs(initial: str, fault: str) -> tuple[tuple[str, int, int, int, str | None], ...]:
    return ARCS[initial if initial in ("s", "u", "a") else "?", fault]


def backwards(turns: list[tuple[str, str]], end: list[int]) -> list[list[int]]:
    """Least costs from each place and state on to the end, whose costs are given; inserts come before the turn at their place."""
    out = [end]
    for turn in reversed(turns):
        v = [FAR] * 4
        for _, q, r, cost, _ in arcs(*turn):
            v[q] = min(v[q], cost + out[-1][r])
        out.append(inserted(v))
    return out[::-1]


def inserted(v: list[int]) -> list[int]:
    """Least costs on to the end where turns may be inserted first."""
    for _ in range(3):
        v = [min(v[q], INSERT + v[NEXT[q]]) for q in range(4)]
    return v


def forwards(turns: list[tuple[str, str]], begin: list[int]) -> list[list[int]]:
    """Least costs from the beginning to each place and state, inserts at the place included except at the last."""
    out, v = [], begin
    for turn in (*turns, None):
        if turn is None:
            return [*out, v]
        v = list(v)
        for _ in range(3):
            for q in range(4):
                v[NEXT[q]] = min(v[NEXT[q]], v[q] + INSERT)
        out.append(v)
        w = [FAR] * 4
        for _, q, r, cost, _ in arcs(*turn):
            w[r] = min(w[r], v[q] + cost)
        v = w


def walk(turns: list[tuple[str, str]], begin: list[int], end: list[int], state: int, last: bool) -> tuple[int, list[list[tuple[str, str | None, int]]]]:
    """(state at the end, edits (letter, role, cost) of each turn) on tight arcs from `state`, the least letter at each step.

    An arc is tight if the least cost to its tail, its own and the least cost on from its head make the least of all: then and only
    then it lies on a cheapest path. The frontier holds the states that the letters so far lead to. Inserts at the end of
    the last piece go to its last turn.
    """
    to, on = forwards(turns, begin), backwards(turns, inserted(end) if last else end)
    best = min(a + b for a, b in zip(to[0], on[0]))
    edits: list[list[tuple[str, str | None, int]]] = [[] for _ in turns]
    frontier, k = {state: ()}, 0
    if last:
        to[-1] = list(to[-1])
        for _ in range(3):
            for q in range(4):
                to[-1][NEXT[q]] = min(to[-1][NEXT[q]], to[-1][q] + INSERT)
    while k < len(turns) or last and all(END[q] for q in frontier):
        found = []
        for q, trail in frontier.items():
            if k < len(turns):
                found += [(letter, r, (trail, (k, letter, role, cost)), k + 1) for letter, p, r, cost, role in arcs(*turns[k]) if p == q and to[k][q] + cost + on[k + 1][r] == best]
            if to[k][q] + INSERT + on[k][NEXT[q]] == best:
                found.append(("I", NEXT[q], (trail, (min(k, len(turns) - 1), "I", ROLES[NEXT[q]], INSERT)), k))
        least = min(f[0] for f in found)
        frontier = {}
        for letter, r, trail, at in found:
            if letter == least:
                frontier.setdefault(r, trail)
                k = at
    state, trail = next((q, t) for q, t in sorted(frontier.items()) if not (last and END[q]))
    while trail:
        trail, (at, *edit) = trail
        edits[at].insert(0, tuple(edit))
    return state, edits


def matrix(turns: list[tuple[str, str]]) -> list[list[int]]:
    """Least costs over the turns from each state to each, without inserts at the end."""
    return [forwards(turns, [0 if q == p else FAR for q in range(4)])[-1] for p in range(4)]


def pieces(table: pa.Table) -> list[tuple[int | None, int, int]]:
    """(conversation, first row, row after the last) of a block in order."""
    conv, out = table.column("conv").to_pylist(), []
    for k, c in enumerate(conv):
        if k and c == conv[k - 1]:
            out[-1][2] = k + 1
        else:
            out.append([c, k, k + 1])
    return [tuple(x) for x in out]


def turns_of(table: pa.Table) -> list[tuple[str, str]]:
    return list(zip(table.column("initial").to_pylist(), table.column("fault").to_pylist()))


def columns(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], names=list(kinds))


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def placed(rows: DataFrame, per_block: int) -> DataFrame:
    """`rows` (conv, turn, role, text) in one order over all partitions, with seq, block, initial and fault, as a table.

    Rows are dealt by range of (conv, turn, role, digest of the text), so a conversation of any length is spread over as many partitions as it needs, and
    blocks are runs of at most `per_block` rows of a partition. A duplicate is found by the first turn that holds its role and text.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    d = rows.withColumn("digest", F.md5("text"))
    d = d.repartitionByRange(1 + rows.count() // per_block, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    d = stored(d.withColumns({"block": F.expr(f"seq div {per_block}"), "words": F.rtrim("text", F.lit(BLANK))}).withColumns({"blank": F.col("words") == "", "cut": ~F.right("words", F.lit(1)).isin(*ENDS)}).drop("words"))
    seen = d.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("seq").alias("seq"))
    first = stored(seen.select("seq", F.lit(True).alias("first")))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return stored(d.join(first, "seq", "left").select("block", "seq", "conv", "turn", "role", "text", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")))


def repair(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", per_block: int = 1 << 14) -> DataFrame:
    """Rows (conv, seq, step, edit, role, text, cost, turn, fault, illegal): the cheapest edits that make each conversation's roles
    `(s?(ua)+)?`, in the order (seq, step).

    Turns are taken by turn, nulls first, then by role and the digest of the text. A turn's fault is blank (nothing but white space), duplicate (role and text seen
    earlier), truncated (does not end in . ! or ?) or none. Edits: K keeps, R gives the role user or assistant, D deletes
    (required for blank and duplicate turns), I inserts an empty turn of a user or an assistant. Of the cheapest sequences of edits the one
    whose letters are ASCII-least is taken. Rows without the edit D, in order, are the repaired conversation; rows without I are the
    turns as they were, each once, `illegal` telling that their role can't follow the one before.

    The edits of a conversation are paths over (turns done, what was written last). Turns lie in blocks of `per_block` rows at most, in order over
    all conversations. A piece of a conversation that reaches over the end of a block is summed up by its 4 x 4 least costs; products
    of these give each piece the least costs to its first turn and from its last one on. With both, each block alone finds its tight
    arcs and walks them. So no task holds more than a block, however long a conversation is, but for one 4 x 4 table per piece.

    Null role or text count as one space, and an empty role can't stay; null conv is one conversation; other columns, whatever their names, are not read; equal rows are
    duplicates. An empty table gives no rows.
    """
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for n, c in (("role", role), ("text", text))])
    t = placed(rows, per_block)
    blocks = t.select("block", "seq", "conv", "initial", "fault")
    ordered = lambda table: table.sort_by("seq")

    def sums(table: pa.Table) -> pa.Table:
        table = ordered(table)
        turns, cut = turns_of(table), pieces(table)
        edge = cut if len(cut) == 1 else [cut[0], cut[-1]]
        data = [(table.column("block")[0].as_py(), c, [x for row in matrix(turns[a:b]) for x in row], turns[b - 1][0]) for c, a, b in edge]
        return columns(data, block=pa.int64(), conv=pa.int64(), costs=pa.list_(pa.int64()), final=pa.string())

    def bounds(batches):
        for b in batches:
            out = []
            for conv, parts in zip(b.column("conv").to_pylist(), b.column("parts").to_pylist()):
                m = [[p["costs"][4 * q : 4 * q + 4] for q in range(4)] for p in parts]
                begin, ends = [BEGIN], [inserted(END)]
                for x in m[:-1]:
                    begin.append([min(FAR, *(begin[-1][q] + x[q][r] for q in range(4))) for r in range(4)])
                for x in m[:0:-1]:
                    ends.append([min(FAR, *(x[q][r] + ends[-1][r] for r in range(4))) for q in range(4)])
                ends[0] = END
                for k, (p, e) in enumerate(zip(parts, ends[::-1])):
                    out.append((p["block"], conv, begin[k], e, k == len(parts) - 1, parts[k - 1]["final"] if k else None))
            yield from columns(out, block=pa.int64(), conv=pa.int64(), begin=pa.list_(pa.int64()), ends=pa.list_(pa.int64()), last=pa.bool_(), before=pa.string()).to_batches()

    def passes(table: pa.Table, bounds: pa.Table) -> pa.Table:
        table, out = ordered(table) if table.num_rows else table, []
        turns, known = turns_of(table), {r["conv"]: r for r in bounds.to_pylist()}
        for conv, a, b in pieces(table) if known else []:
            if r := known.get(conv):
                on = backwards(turns[a:b], inserted(r["ends"]) if r["last"] else r["ends"])[0]
                best = min(x + y for x, y in zip(r["begin"], on))
                leave = [walk(turns[a:b], r["begin"], r["ends"], q, r["last"])[0] if r["begin"][q] + on[q] == best else -1 for q in range(4)]
                out.append((r["block"], conv, leave))
        return columns(out, block=pa.int64(), conv=pa.int64(), leave=pa.list_(pa.int32()))

    def edit(table: pa.Table, bounds: pa.Table) -> pa.Table:
        if not table.num_rows:
            return edits_schema.empty_table()
        table = ordered(table)
        turns, known, done, wrong = turns_of(table), {r["conv"]: r for r in bounds.to_pylist()}, [], []
        for conv, a, b in pieces(table):
            r = known.get(conv) or {"begin": BEGIN, "ends": END, "last": True, "state": START, "before": None}
            done += walk(turns[a:b], r["begin"], r["ends"], r["state"], r["last"])[1]
            before = [r["before"], *(x for x, _ in turns[a : b - 1])]
            wrong += [p is not None and illegal(p, x) for p, (x, _) in zip(before, turns[a:b])]
        made = [[{"letter": x, "given": y, "cost": z} for x, y, z in e] for e in done]
        return pa.table([table.column("seq").combine_chunks(), pa.array(wrong), pa.array(made, edits_schema.field("edits").type)], schema=edits_schema)

    one = pa.list_(pa.struct([("letter", pa.string()), ("given", pa.string()), ("cost", pa.int64())]))
    edits_schema = pa.schema([("seq", pa.int64()), ("illegal", pa.bool_()), ("edits", one)])
    summed = blocks.groupBy("block").applyInArrow(sums, "block long, conv long, costs array<long>, final string")
    long = summed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs", "final"))).alias("parts")).where("size(parts) > 1")
    b = stored(long.mapInArrow(bounds, "block long, conv long, begin array<long>, ends array<long>, last boolean, before string"))
    left = blocks.groupBy("block").cogroup(b.groupBy("block")).applyInArrow(passes, "block long, conv long, leave array<int>")
    # The state in which each piece is entered follows from piece to piece.
    path = F.sort_array(F.collect_list(F.struct("block", "leave")))
    enter = F.aggregate("path", F.array(F.lit(START)), lambda done, x: F.concat(done, F.array(F.element_at(x["leave"], F.element_at(done, F.lit(-1)) + 1))))
    states = left.groupBy("conv").agg(path.alias("path")).select("conv", F.explode(F.arrays_zip(F.col("path.block").alias("block"), enter.alias("state"))).alias("s")).select(F.col("conv").alias("c"), F.col("s.block").alias("k"), F.col("s.state").alias("state"))
    b = b.join(states, (F.col("block") == F.col("k")) & F.col("conv").eqNullSafe(F.col("c"))).drop("c", "k")
    made = blocks.groupBy("block").cogroup(b.groupBy("block")).applyInArrow(edit, "seq long, illegal boolean, edits array<struct<letter: string, given: string, cost: long>>")
    d = t.join(stored(made), "seq").select("*", F.posexplode("edits").alias("step", "e"))
    new = F.col("e.letter") == "I"
    own = lambda c: F.when(~new, F.col(c)).alias(c)
    return d.select("conv", "seq", "step", F.col("e.letter").alias("edit"), F.coalesce("e.given", "role").alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"), F.col("e.cost").alias("cost"), own("turn"), own("fault"), own("illegal"))


def digests(edits: DataFrame) -> DataFrame:
    """Rows (conv, audit, repaired_sha256): the letters of all edits, and the digest of the repaired turns as lines `role:text`.

    A conversation's rows stream through one task in order, as a digest needs them one after another; none is held.
    """

    def stream(batches):
        now, letters, digest, none = None, [], None, True
        for b in batches:
            out = []
            for conv, letter, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "edit", "role", "text"))):
                if digest is None or conv != now:
                    if digest is not None:
                        out.append((now, "".join(letters), digest.hexdigest()))
                    now, letters, digest, none = conv, [], sha256(), True
                letters.append(letter)
                if letter != "D":
                    digest.update((b"" if none else b"\n") + role + b":" + text)
                    none = False
            yield from result(out)
        if digest is not None:
            yield from result([(now, "".join(letters), digest.hexdigest())])

    def result(out):
        return columns(out, conv=pa.int64(), audit=pa.string(), repaired_sha256=pa.string()).to_batches()

    d = edits.select("conv", "seq", "step", "edit", *[F.encode(c, "utf-8").alias(c) for c in ("role", "text")])
    return d.repartition("conv").sortWithinPartitions("conv", "seq", "step").drop("seq", "step").mapInArrow(stream, "conv long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32 of `conv_id:turn` modulo 20: dropped, emptied, without ends of sentences, doubled or given the role user.

    A null counts as one space, but a null turn stays null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    d = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return d.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def repaired(original: DataFrame, rows: DataFrame, *, per_block: int = 1 << 14) -> DataFrame:
    """A row for each conv_id of `original` on the repair of `rows`: gaps, faults, illegal pairs, cost, audit and digest; conversations without rows have zeros and empty texts."""
    e = stored(repair(rows, per_block=per_block))
    fault = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    stats = e.groupBy("conv").agg(gaps, fault("blank"), fault("duplicate"), fault("truncated"), F.count_if("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    ids = original.select(F.col("conv_id").alias("conv")).distinct()
    on = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    d = ids.alias("i").join(stats.alias("s"), on("i", "s"), "left").join(digests(e).alias("d"), on("i", "d"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select(F.col("i.conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_dialogues(spark, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(c, damaged(c))
