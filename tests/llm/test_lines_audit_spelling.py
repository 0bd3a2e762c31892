"""Line dedup, filter audit and spelling variants against brute force, on small made
tables that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from stepwise.llm import filter_audit, line_runs, queries, spelling

R = random.Random(11)
BLANK = " \t\n\x0b\x0c\r"
CLASH = ("id", "h", "key", "n_docs", "keeper", "batch", "part", "mask", "digest", "first", "good", "toxic", "n", "word", "prefix", "kind", "rank", "_text", "_gone")


def prose(n):
    return " ".join(R.choice(("the", "Of", "lamp", "é", "ßx", "river", "STONE", "a", "cloud", "pebbles")) for _ in range(n))


def frame(spark, rows, columns="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, columns).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# ---- 11 ----

def name_of(k, t):
    """Order of the documents; those without an id stand below, by their text's digest."""
    return (0, 0, hashlib.md5((t or "").encode()).hexdigest()) if k is None else (1, k, "")


def lines_by_hand(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            holders[lower(line.strip(BLANK))].add(name_of(k, t))
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            key = lower(line.strip(BLANK))
            if len(key) < min_chars or len(holders[key]) < min_docs or max(holders[key]) == name_of(k, t):
                kept.append(line)
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept).encode()))
    return sorted(out, key=str)


def line_rows():
    common = ["This line is in very many of the documents.", "  another Line, WITH blanks around it\t\r", "äöü äöü äöü äöü äöü", "äöü äöü äöü äöü äöüx",
              "short", "no break here, nineteen", "x" * 5000]
    rows = []
    for i in range(120):
        own = [R.choice(common) if R.random() < 0.5 else prose(R.randint(0, 12)) for _ in range(R.randint(1, 9))]
        rows.append((i * 3 - 40, "\n".join(own)))
    rows += [(7, None), (1000, ""), (1001, "\n\n"), (1002, common[0] + "\n" + common[0]), (1003, common[0].upper()), (1003, common[0] + "\nother row of the same id"),
             (None, common[0] + "\na line that only rows without an id have"), (None, common[0] + "\na line that only rows without an id have"),
             (None, "a line that only rows without an id have"), (None, "A LINE that only rows without an id have\n"), (None, None)]
    rows += [(2000 + i, "in two documents, each has it\nin two of them, each twice") for i in range(2)]
    rows += [(3000, "\n".join([common[0], "in a very long text " * 40] * 20000))]
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_equal_brute_force(spark, batches, fanout):
    rows = line_rows()
    got = line_runs.drop_repeated_lines(frame(spark, [(*r, None) for r in rows]), batches=batches, fanout=fanout).collect()
    assert sorted(((r.key, r.n_lines, r.n_dropped, bytes(r.kept)) for r in got), key=str) == lines_by_hand(rows)


def test_lines_other_limits_and_types(spark):
    rows = [(f"d{i}", R.choice(["a b", "c d e", "f"]) + "\n" + prose(3)) for i in range(30)]
    got = line_runs.drop_repeated_lines(frame(spark, [(*r, None) for r in rows], "doc_id string, text string, source string").drop("id"), min_chars=3, min_docs=2,
                                        batches=1).collect()
    keep = defaultdict(set)
    for k, t in rows:
        for x in t.split("\n"):
            keep[lower(x)].add(k)
    for r in got:
        want = [x for x in dict(rows)[r.key].split("\n") if len(x) < 3 or len(keep[lower(x)]) < 2 or max(keep[lower(x)]) == r.key]
        assert bytes(r.kept).decode() == "\n".join(want)


def test_line_runs_are_disjoint_and_levelled(spark):
    index = line_runs.LineRuns(fanout=2)
    per_batch = []
    for b in range(5):
        rows = [(bytes([h]), 100 - b) for h in R.sample(range(60), 25)]
        per_batch.append({h for h, _ in rows})
        own = index.add(spark.createDataFrame(rows, "h binary, id long")).collect()
        before = set().union(*per_batch[:-1]) if b else set()
        assert {bytes(r.h) for r in own if r.fresh} == per_batch[-1] - before  # what the runs lacked
    assert [len(x) for x in index.levels] == [1, 0, 1]  # five runs: one of four, one of one
    seen = [bytes(r.h) for run in index.runs() for r in run.collect()]
    assert len(seen) == len(set(seen)) == len(set().union(*per_batch))
    totals = {bytes(r.h): (r.n_docs, r.keeper) for r in index.totals().collect()}
    assert totals == {h: (sum(h in x for x in per_batch), 100 - min(i for i, x in enumerate(per_batch) if h in x)) for h in set(seen)}


def test_lines_of_an_empty_table(spark):
    assert line_runs.drop_repeated_lines(frame(spark, [])).collect() == []


# ---- 12 ----

def audit_by_hand(rows, labels):
    good, toxic = ({k for k, *v in labels if k is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    docs = []
    for k, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and k > first[t]}
        docs.append((s or "", {f for f, x in fails.items() if x}, k in good, k in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed_at, shapley = {}, Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed_at[order, step] = (f, len(left), gone)
                shapley[f] += len(gone)
        for (order, step), (f, kept, gone) in removed_at.items():
            out[part, "".join(order), step] = (kept, len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                                               sum(d[2] for d in gone), sum(d[3] for d in gone), shapley[f])
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SLICE", 700)
    wide = [f"w{i}" for i in range(400)]
    made = [" ".join(R.choice(wide) for _ in range(R.randint(0, 120))) for _ in range(60)]
    made += [prose(R.randint(0, 90)) for _ in range(30)] + [x.upper() for x in made[:6]] + [x + " #" for x in made[3:9]] + [" \x0b\n" + "é" * 30, "A" * 3 + "é" * 57, "a" * 19 + "B"]
    rows = [(i, R.choice(made), R.choice(["web", "hot", "hot", "", None])) for i in range(200)]
    rows += [(500, None, "web"), (501, "", "web"), (502, None, None), (None, made[0], "web"), (None, made[0], "web"), (3, made[1], "hot"), (3, made[1], "hot"),
             (900, "Long text of One word " * 9000, "only")]
    labels = [(i, R.choice([0, 1, None]), R.choice([0, 1, None])) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (None, 1, 1)]
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("x") for c in ("id", "mask", "part", "n")})
    got = filter_audit.filter_audit(frame(spark, rows), tags).collect()
    want = audit_by_hand(rows, labels)
    assert len(got) == len(want) == 4 * 600
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want


def test_intervals_cover_each_order_once_per_mask():
    orders = ["".join(o) for o in permutations(filter_audit.LETTERS)]
    spans = defaultdict(list)
    for mask, step, lo, hi in filter_audit.removal_intervals():
        for rank in range(lo, hi):
            spans[mask, rank].append(step)
    for mask in range(1, 32):
        for rank, order in enumerate(orders):
            first = next(i for i, f in enumerate(order, 1) if mask >> "ABCDE".index(f) & 1)
            assert spans[mask, rank] == [first]


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(frame(spark, []), none).collect() == []
    one = filter_audit.filter_audit(frame(spark, [(1, "", None)]), none).where("removed > 0").collect()
    assert len(one) == 120 and {r.shapley for r in one} == {120}


# ---- 13 ----

def variants_by_hand(rows):
    n = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        around = [v for v in n if near(v, w)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w], count[w] = best if best and n[best] >= 2 * n[w] else None, len(around)
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n.get(form[w])))
    return out


def spelled_rows():
    base = ["pebble", "stone", "rivers", "ÉCLAIR", "naïveté", "aaaaa", "aaaaaa", "aaaab", "baaaa", "abcde", "abcdef", "bcdef", "abxde", "straße", "ab×cd÷ef"]
    near = [w[:i] + c + w[i + d:] for w in base for i in range(len(w)) for c in ("", "a", "q", "é") for d in (0, 1)]
    rows = []
    for i in range(150):
        words = [R.choice(base) for _ in range(30)] + [R.choice(near) for _ in range(25)]
        rows.append((i, R.choice([" ", ", ", "1", "\n"]).join(words)))
    chain = [("chain", 3), ("chaim", 6), ("chaxm", 12), ("cyaxm", 24), ("cyaxmz", 48), ("cyaqmz", 96), ("ciaqmz", 200)]
    rows += [(500 + i, (w + " ") * k) for i, (w, k) in enumerate(chain)]
    return rows + [(None, "pebble pebbel"), (None, "pebble pebbel"), (800, None), (801, ""), (802, "1 2 3"), (803, "a" * 3000 + "é" + " stone" * 30000),
                   (804, "pebbel"), (804, "pebbel"), (805, "\U0001f600stoneĀstone")]


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_brute_force(spark, monkeypatch, small):
    if small:  # many windows and flushes
        monkeypatch.setattr(spelling, "SLICE", 300)
        monkeypatch.setattr(spelling, "HELD", 20)
    rows = spelled_rows()
    got = [tuple(r) for r in spelling.variants(frame(spark, [(*r, None) for r in rows])).collect()]
    want = variants_by_hand(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert max(len([1 for x in want if x[2] == r]) for r in {x[2] for x in want}) > 2


def test_a_chain_of_forms_ends_at_its_last_word(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w7")]
    got = {r.word: r.root for r in spelling.follow(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w40" for w, _ in links}


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(frame(spark, [])).collect() == []


# ---- as registered ----

def test_registered_queries_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, d).collect()), key=str)
    assert got == [(k, a, b, hashlib.sha256(x).hexdigest()) for k, a, b, x in lines_by_hand([r[:2] for r in docs])]
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in queries.op12_filter_audit(spark, d).collect()}
    assert got == audit_by_hand(docs, labels)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling_variants(spark, d).collect()}
    assert got == variants_by_hand([r[:2] for r in docs])
