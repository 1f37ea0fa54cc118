"""Operators 11 to 13 against brute force."""
import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corridor.llm import conversation_repair as C
from corridor.llm import decontamination as D
from corridor.llm import registry, spelling
from corridor.plans.check import duck

# --- 11 --------------------------------------------------------------------


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def counted(docs):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def grouped(n):
    out, form = {}, {}
    for w in n:
        near_ = [v for v in n if near(w, v)]
        best = min(near_, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(near_)

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], out[w], n.get(form[w])) for w in n}


def rows(df):
    return [tuple(r) for r in df.collect()]


def sample_words(rng):
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 11))) for _ in range(150)}
    for w in list(words):
        for _ in range(3):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + rng.choice("abÿ") + w[k + 1:], w[:k] + w[k + 1:] if len(w) > 7 else w, w[:k] + rng.choice("ab") + w[k:]]))
    words |= {"a" * k for k in range(7, 30)} | {"ab" * k for k in range(4, 12)} | {"h" + "a" * 60, "h" + "a" * 61, "a" * 60, "a" * 30 + "b" + "a" * 30}
    return {w: rng.choice([2, 3, 20, 31, 400]) for w in words}


@pytest.mark.parametrize("longest", [40, 9, 7])
def test_spelling_groups(spark, longest):
    """Both ways of finding neighbours, and the border between them."""
    n = sample_words(random.Random(longest))
    got = rows(spelling.groups(spark.createDataFrame(list(n.items()), "word string, n long"), longest=longest))
    assert len(got) == len(n) and set(got) == grouped(n)


def test_spelling_pairs_come_once(spark):
    n = sample_words(random.Random(5))
    got = rows(spelling.neighbours(spark.createDataFrame(list(n.items()), "word string, n long"), longest=20))
    assert len({frozenset((a, b)) for a, _, b, _ in got}) == len(got)


def test_spelling_of_documents(spark, edge, empty):
    rng = random.Random(2)
    words = list(sample_words(rng))
    docs = [(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=80)).title()) for i in range(60)]
    docs += [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()] + [(3, "Straßenbahn Straßenbahn straßenbahn"), (None, "WORDSHERE wordshere")]
    got = rows(spelling.groups(spelling.occurrences(spark.createDataFrame(docs, "doc_id long, text string"))))
    assert set(got) == grouped(counted(docs)) and len(got) == len(set(got))
    assert rows(spelling.groups(spelling.occurrences(empty))) == []
    assert set(rows(spelling.occurrences(edge))) == set(counted(rows(edge.select("doc_id", "text"))).items())  # with clashing names beside


# --- 12 --------------------------------------------------------------------

SPACE = r"[\x20\x09-\x0D]"


def cheapest(faults, initials):
    """(cost, audit, states) by a plain forward search over all edits."""
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(0, ""): (0, "", ())}
    for i in range(len(faults) + 1):
        for _ in range(4):  # inserts
            for s in ("", "s", "u", "a"):
                if (i, s) not in best:
                    continue
                c, e, t = best[(i, s)]
                for x in "ua":
                    if (s, x) in go:
                        new = (c + 2, e + "I", (*t, (None, x)))
                        k = (i, go[(s, x)])
                        best[k] = min(best.get(k, (10 ** 9,)), new, key=lambda z: z[:2])
        if i == len(faults):
            break
        for s in ("", "s", "u", "a"):
            if (i, s) not in best:
                continue
            c, e, t = best[(i, s)]
            moves = [(3, "D", s, t)]
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if (s, initials[i]) in go:
                    moves.append((extra, "K", go[(s, initials[i])], (*t, (i, None))))
                for x in "ua":
                    if (s, x) in go:
                        moves.append((2 + extra, "R", go[(s, x)], (*t, (i, x))))
            for dc, letter, s2, t2 in moves:
                k, new = (i + 1, s2), (c + dc, e + letter, t2)
                best[k] = min(best.get(k, (10 ** 9,)), new, key=lambda z: z[:2])
    return min((best[(len(faults), s)] for s in ("", "a") if (len(faults), s) in best), key=lambda z: z[:2])


def repaired(convs):
    """Expected rows for {conv: [(turn, role, text), ...]} in order."""
    out = set()
    for conv, rs in convs.items():
        rs = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rs), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        faults, seen = [], set()
        for t, r, x in rs:
            kept = re.sub(SPACE, "", x)
            faults.append("blank" if not kept else "duplicate" if (r, x) in seen else "truncated" if kept[-1] not in ".!?" else None)
            seen.add((r, x))
        cost, audit, done = cheapest(faults, [r[1][:1] for r in rs])
        name = {"u": "user", "a": "assistant"}
        lines = [(name[x] + ":") if i is None else f"{name[x] if x else rs[i][1]}:{rs[i][2]}" for i, x in done]
        turns = [r[0] for r in rs if r[0] is not None]
        n = collections.Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        out.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal,
                 cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def python_damage(rs):
    out = []
    for conv, turn, role, text in rs:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        out += [row] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def conversations(rs, ids=()):
    d = {c: [] for c in ids}
    for conv, *rest in rs:
        d.setdefault(conv, []).append(tuple(rest))
    return d


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [1, 2, 7, 1024])
def test_repair_of_random_conversations(spark, segment):
    rng = random.Random(segment)
    rs = []
    for conv in [*range(60), None]:
        for k in range(rng.choice([0, 1, 2, 3, 8, 40])):
            rs.append((conv, rng.choice([k, k, k, None, 3]), rng.choice(["user", "assistant", "system", "User", "s", "", None, "a bot"]),
                       rng.choice(["Yes.", "No", "", " \t", None, f"line {k}!", f"cut {k}", "Ünï? \n"])))
    got = rows(C.repair(spark.createDataFrame(rs, SCHEMA).repartition(5), segment=segment))
    want = repaired(conversations(rs))
    assert len(got) == len(want) and set(got) == want


def test_repair_query(spark, sf_small):
    rs = rows(spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    want = repaired(conversations(python_damage(rs), {r[0] for r in rs}))
    got = rows(registry.QUERIES["op12_conversation_repair"](spark, sf_small))
    assert len(got) == len(want) and set(got) == want


def test_repair_edges(spark):
    rng = random.Random(9)
    rs = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["Hi.", None, "", "x"])) for c in (1, 2, None) for t in [*range(12), None, 3, 3]]
    rs += [(7, t, "user", "long " * 40000 + ".") for t in (1, 1, 2)] + [(8, 1, "system", "Only this."), (9, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rs], SCHEMA + ", conv long, row string, kind int, codes int")
    want = repaired(conversations(python_damage(rs), {r[0] for r in rs}))
    assert set(rows(C.repair(C.damaged(df), every=df))) == want
    assert rows(C.repair(C.damaged(df.limit(0)), every=df.limit(0))) == []


# --- 13 --------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(lowered(t or ""))


def judged(docs, items, width):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - width + 1, 1) if w else 0):
            windows[tuple(w[i:i + width])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contamination_case(rng):
    some = [f"w{i}" for i in range(12)]
    items = [(k if k % 7 else None, " ".join(rng.choices(some, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(40)]
    items += [(5, None), (5, "Extra-words. of ITEM five"), (6, "--- !")]
    docs = []
    for i in range(80):
        t = rng.choices(some + [f"v{k}" for k in range(30)], k=rng.randint(0, 60))
        if rng.random() < 0.7:
            k = rng.randrange(len(t) + 1)
            t[k:k] = words(rng.choice(items)[1])[:rng.choice([5, 10, 30])]
        docs.append((i, rng.choice([" ", ", ", "\n", "_"]).join(t).title()))
    return docs + [(None, None), (3, ""), (4, "..."), (4, "..."), (9, "é" * 50)], items


@pytest.mark.parametrize("width,block,shard", [(10, 8 << 20, 4 << 20), (10, 300, 100), (3, 200, 4 << 20), (1, 8 << 20, 50)])
def test_contamination(spark, width, block, shard):
    """One block of items and several, large and small shards."""
    docs, items = contamination_case(random.Random(width * block))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    how = dict(width=width, block_chars=block, shard_bytes=shard)
    want = judged(docs, items, width)
    assert sorted(rows(D.contamination(d, b, **how)), key=str) == want
    clean = [(i, t) for i, t in docs if not judged([(i, t)], items, width)[0][-1]]
    assert sorted(rows(D.decontaminate(d, b, **how)), key=str) == sorted(clean, key=str)


def test_longest_matches(spark):
    """All runs of words that document and item share and that no word more prolongs."""
    width, rng = 4, random.Random(1)
    docs, items = contamination_case(rng)
    items = [(str(i), t) for i, (_, t) in enumerate(items)]
    d, b = spark.createDataFrame(docs[:40], "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = rows(D.matches(d, b, width=width, block_chars=500))
    want = set()
    for doc_id, text in docs[:40]:
        w = words(text)
        for item, t in items:
            v = words(t)
            for i in range(len(w)):
                for j in range(len(v)):
                    if w[i] == v[j] and not (i and j and w[i - 1] == v[j - 1]):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        if n >= min(width, len(v)):
                            want.add((doc_id, i, item, j, n))
    assert len(got) == len(set(got)) and set(got) == want


def test_contamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "password hunter2hunter2 which has"), (2, "w5 x5. w6 x6"), (3, None)], "item_id long, text string")
    got = sorted(rows(D.contamination(edge, items, width=2)), key=str)
    docs = rows(edge.select("doc_id", "text"))
    assert got == judged(docs, rows(items), 2)
    assert D.decontaminate(edge, items, width=2).columns == edge.columns
    assert rows(D.contamination(empty, items)) == [] and not any(r[-1] for r in rows(D.contamination(edge, items.limit(0))))


@pytest.mark.parametrize("name", ["op11_spelling", "op13_decontamination"])
def test_sql(spark, sf_small, name):
    got = registry.QUERIES[name](spark, sf_small)
    names = got.columns
    want = duck(sf_small).execute(f"select {', '.join(names)} from ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
