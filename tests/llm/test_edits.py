"""Line dedup, fill-in-middle and conversation repair against brute force and their SQL."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.llm import dialogues, infill, lines
from annulus.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_lines", "op12_infill"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(columns).collect()) == Counter(want)


# Lines.


def test_cuckoo_filter_is_a_multiset(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, size=(3000, 2)).astype(np.uint64)
    few = lines.CuckooFilter.sized(40)  # far too small: layers come
    assert not few.copies(keys).any()
    few.add(keys)
    few.add(keys[:1000])
    assert len(few.layers) > 10
    again = lines.CuckooFilter(few.to_bytes())
    assert (again.copies(keys) >= np.where(np.arange(3000) < 1000, 2, 1)).all()
    again.remove(keys[:1000])
    again.remove(keys[500:])
    assert (again.copies(keys[:500]) >= 1).all()
    again.remove(keys[:500])
    assert sum(np.count_nonzero(x) for x in again.layers) == 0
    with pytest.raises(ValueError, match="can't be removed"):
        again.remove(keys[:1])
    wide = lines.CuckooFilter.sized(3000)
    wide.add(keys)
    assert len(wide.layers) == 1
    other = rng.integers(0, 1 << 63, size=(50_000, 2)).astype(np.uint64)
    assert (wide.copies(other) > 0).mean() < 0.001
    same = np.repeat(keys[:1], 50, axis=0)  # more than two buckets hold
    wide.add(same)
    assert wide.copies(keys[:1])[0] == 51


def stripped(docs, least=10):
    """Brute force over rows (id, text)."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is not None, i or 0)
    first = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                first[key(x)] = min(first.get(key(x), order(i)), order(i))
    out = []
    for i, t in docs:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if len(key(x)) < least or first[key(x)] == order(i)]
        out.append((i, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=lambda r: (order(r[0]), *r[1:]))


LINES = ["a common line", "  A COMMON line \t", "short", "", "ÄÖÜäöüßßßß", "äöüäöüßßßß", "İİİİİİİİİİ once", "eleven char", "zehn Zeich", "neun Zeic", "\x0bA common line\x0c", " a common line", "ＡＢＣ wide letters"]


def line_docs(seed, n):
    r = random.Random(seed)
    docs = [(r.choice([None, *range(30)]), r.choice([None, "", *["\n".join(r.choice([*LINES, f"line number {r.randrange(40)}"]) for _ in range(r.randrange(1, 12))) for _ in range(8)]])) for _ in range(n)]
    return [*docs, docs[-1], (7, "a common line\n" * 3000 + "x" * 50_000)]


def test_line_dedup_against_brute_force(spark):
    docs = line_docs(1, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("k"), "content": F.lit(1), "gone": F.lit(2)}).repartition(3)
    kept, _ = lines.dedup_lines(df, carry=("key", "gone"), per_shard=20)
    rows = kept.collect()
    order = lambda i: (i is not None, i or 0)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows), key=lambda r: (order(r[0]), *r[1:])) == stripped(docs)
    assert {(r.key, r.gone) for r in rows} == {("k", 2)}
    empty, _ = lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []


def test_documents_that_leave_the_index_leave_no_trace(spark):
    docs = [(i, t) for i, (_, t) in enumerate(line_docs(2, 90))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    early, late = table.where("doc_id % 3 <> 1"), table.where("doc_id % 3 = 1")
    new = lines.LineIndex(spark, 3)
    refs = {k: lines.stored(new.references(d, "doc_id", "text")) for k, d in (("early", early), ("late", late), ("all", table))}

    def state(x):
        counts = {bytes(r.key): (r.documents, r.first) for r in lines.counted(x.log).collect()}
        return counts

    def answers(x, which):
        return sorted((r.id, tuple(sorted(r.gone))) for r in x.repeats(refs[which]).collect())

    first = new.insert(refs["early"])
    both = first.insert(refs["late"])
    whole = new.insert(refs["all"])
    assert state(both) == state(whole) and answers(both, "all") == answers(whole, "all")
    assert answers(first, "early") != [a for a in answers(whole, "early") if a]
    back = both.delete(late.select("doc_id"))
    assert state(back) == state(first) and answers(back, "early") == answers(first, "early")
    assert sum(len(r.cuckoo) and sum(np.count_nonzero(x) for x in lines.CuckooFilter(bytes(r.cuckoo)).layers) for r in spark.read.parquet(back.filters).collect()) == sum(
        np.count_nonzero(x) for r in spark.read.parquet(first.filters).collect() for x in lines.CuckooFilter(bytes(r.cuckoo)).layers
    )
    again = back.insert(refs["late"])
    assert state(again) == state(whole) and answers(again, "all") == answers(whole, "all")
    # A line that only the smallest document held moves on to the next.
    gone = whole.delete(table.where("doc_id < 20").select("doc_id"))
    kept = lines.strip_lines(table.where("doc_id >= 20"), gone.repeats(refs["all"].where("id >= 20"))).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in kept) == stripped([d for d in docs if d[0] >= 20])


# Fill-in-middle.


def cut_at(i, text, units, salt="1"):
    h = hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", "a", "né", "𝒳𝒴𝒵 astral\r\n", "x\ny z\x85", "holds <S> a mark", "almost <S <P M> <<", "<", "ends in <P", "long " * 7001, "𝄞é" * 5000, " lead and trail  "]


@pytest.mark.parametrize("unit, run", [(infill.CODE_POINT, 256), (infill.CODE_POINT, 1), (infill.CODE_POINT, 7), (r"[ \n\r]*[^ \n\r]+|[ \n\r]+", 3)])
def test_infill_against_brute_force(spark, unit, run):
    docs = [(i % 40 if i % 11 else None, TEXTS[i % len(TEXTS)]) for i in range(140)]
    docs += docs[:9]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "output": F.lit("x"), "content": F.lit("c")})
    got = infill.infilled(df, unit=unit, run=run).withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    pattern = "(?s)." if unit == infill.CODE_POINT else unit
    want = [(i, *cut_at(i, t or "", re.findall(pattern, t or "")), t or "") for i, t in docs]
    key = lambda r: [(x is None, x if x is not None else 0) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.infilled(df.where("false")).collect() == []


# Conversations.


def cheapest(turns):
    """Cost and letters of the cheapest, then ASCII-least edits, and the roles they give, of all that are worth trying."""
    best = [10**9, "~", None]

    def go(k, letters, out, cost, run):
        roles = "".join(r[:1] or "?" for r, _ in out)  # an empty role can't stay
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", roles):
            return
        if k == len(turns) and re.fullmatch("(s?(ua)+)?", roles) and (cost, letters) < (best[0], best[1]):
            best[:] = [cost, letters, out]
        if run < 2:
            for r in ("user", "assistant"):
                go(k, letters + "I", [*out, (r, "")], cost + 3, run + 1)
        if k < len(turns):
            role, text, fault = turns[k]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                go(k + 1, letters + "K", [*out, (role, text)], cost + more, 0)
                for r in ("user", "assistant"):
                    go(k + 1, letters + "R", [*out, (r, text)], cost + more + 3, 0)
            go(k + 1, letters + "D", out, cost + 4, 0)

    go(0, "", [], 0, 0)
    return best


def repaired(rows):
    """Brute force of the whole query over rows (conv, turn, role, text)."""
    out = {c: [] for c, *_ in rows}
    one = lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        h = zlib.crc32(f"{one(c)}:{one(turn)}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", one(text)) if h == 2 else one(text)
        out[c] += [(turn, "user" if h == 4 else one(role), text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for c, turns in out.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, found = set(), []
        for _, role, text in turns:
            last = text.rstrip(" \t\n\x0b\x0c\r")
            found.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""))
            seen.add((role, text))
        known = [t for t, *_ in turns if t is not None]
        cost, audit, roles = cheapest(found)
        count = [sum(f == x for *_, f in found) for x in ("blank", "duplicate", "truncated")]
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        yield (c, max(known) - min(known) + 1 - len(set(known)) if known else 0, *count, bad, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in roles)))


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "well", "and so on", "Why? ", "…", "", "  \n", None, "ok\x0b.", "Ende。"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "speaker"]
    out = []
    for c in [None, *range(n)]:
        turns = list(range(r.randrange(1, 6)))
        if r.random() < 0.3:
            turns[r.randrange(len(turns))] = None
        out += [(c, t, r.choice(roles) if r.random() < 0.5 else ("user", "assistant")[k % 2], r.choice(texts)) for k, t in enumerate(turns)]
    return [*out, *out[:3]]


@pytest.mark.parametrize("per_block", [1 << 14, 4, 2, 1])
def test_repair_against_brute_force(spark, per_block):
    rows = conversations(per_block, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "block": F.lit("b"), "edits": F.lit(0)}).repartition(2)
    got = dialogues.repaired(df, dialogues.damaged(df), per_block=per_block).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(repaired(rows), key=key)


def test_repair_of_no_rows_and_of_rows_that_all_go(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogues.repaired(none, dialogues.damaged(none)).collect() == []
    drop = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    lone = spark.createDataFrame([(5, drop, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in dialogues.repaired(lone, dialogues.damaged(lone)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_repair_of_a_long_conversation_in_pieces_is_that_of_the_whole(spark):
    r = random.Random(9)
    rows = [(1, k, r.choice(["user", "assistant", "system", "tool"]), r.choice(["So it is.", "half a", f"Turn {k}!", ""])) for k in range(700)]
    df = spark.createDataFrame([*rows, (2, 0, "user", "A long text. " * 20_000)], "conv_id long, turn long, role string, text string")
    whole, cut = (sorted(map(tuple, dialogues.repaired(df, df, per_block=n).collect())) for n in (1 << 14, 16))
    assert whole == cut and len(whole) == 2
    edits = dialogues.repair(df, per_block=16).where("conv = 1").orderBy("seq", "step").collect()
    roles = "".join(e.role[0] for e in edits if e.edit != "D")
    assert re.fullmatch("s?(ua)+", roles) and sum(e.cost for e in edits) == whole[0][6]


def test_query_of_conversations_keeps_every_conversation(spark):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    got = QUERIES["op13_dialogues"](spark, SF).collect()
    assert sorted(r.conv_id for r in got) == sorted(r.conv_id for r in c.select("conv_id").distinct().collect())
    few = {r.conv_id: r.n for r in dialogues.damaged(c).groupBy("conv_id").agg(F.count("*").alias("n")).where("n <= 6").collect()}
    rows = [tuple(r) for r in c.select("conv_id", "turn", "role", "text").collect()]
    want = {r[0]: r for r in repaired([x for x in rows if x[0] in few])}
    assert want and all(tuple(r) == want[r.conv_id] for r in got if r.conv_id in want)
