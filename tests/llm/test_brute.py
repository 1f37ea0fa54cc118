"""Operators against brute force on small inputs."""
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corridor.llm import (_bytes as B, _components, embedding_dedup, license_scan, line_dedup, maxent_lm, minhash, mixing,
                          packing, quality_classifier, quality_rules, registry, secret_scan)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    out = []
    for i in range(n):
        w = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) if vocabulary is None else f"w{rng.randrange(vocabulary)}"
        out.append(w + ("." if rng.random() < 0.12 else ""))
    return " ".join(out)


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# --- shared helpers -------------------------------------------------------

@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0 abé", max_size=40), max_size=6))
def test_words_of_bytes(ts):
    data, offs = B.flat(pa.array(ts, pa.string()))
    start, end, first = B.spans(data, offs)
    got = [[bytes(data[s:e]).decode() for s, e in zip(start[a:b], end[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [WORD.findall(t) for t in ts]
    h = B.hashes(data, start, end)
    assert len(set(h.tolist())) == len({w for t in got for w in t})


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    got = {r["node"]: r["comp"] for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    for a, b in itertools.combinations(sorted(nodes), 2):
        assert (got[a] == got[b]) == (find(a) == find(b))


# --- operator 1 -----------------------------------------------------------

def test_classifier_held_out(spark):
    r = quality_classifier.query(spark, "/root/testdata/sf0.01").toPandas()
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    m = r.merge(y, on="doc_id")
    m = m[m.held_out]
    assert ((m.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4)) == 2).all()
    good, bad = m.score[m.quality == 1].to_numpy(), m.score[m.quality == 0].to_numpy()
    assert (good[:, None] > bad).mean() > 0.98
    assert ((m.predicted == 1) == (m.quality == 1)).mean() > 0.95
    assert r.score.between(0, 1).all() and len(r) == 1000


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 9)), min_size=1, max_size=12))
def test_isotonic(pairs):
    v, w = np.array([p[0] for p in pairs]), np.array([float(p[1]) for p in pairs])
    fit = quality_classifier.isotonic(v, w)
    assert (np.diff(fit) >= -1e-12).all()
    # min-max formula of isotonic regression
    n = len(v)
    for i in range(n):
        want = max(min(np.average(v[a:b + 1], weights=w[a:b + 1]) for b in range(i, n)) for a in range(i + 1))
        assert abs(fit[i] - want) < 1e-9


# --- operator 2 -----------------------------------------------------------

def brute_line_dedup(docs, window, min_pair, min_chars):
    """Deleted lines per document by comparing with every earlier place."""
    lines = {i: [x.rstrip(" \n\t\r") for x in re.split(line_dedup.CUT, t)] for i, t in docs}
    gone = collections.defaultdict(set)
    order = [i for i, _ in docs]
    for n, i in enumerate(order):
        for j in order[:n + 1]:
            a, b = lines[i], lines[j]
            for shift in range(-len(b) + 1, len(a)):
                if i == j and shift <= 0:
                    continue
                run = []
                for p in range(max(shift, 0), min(len(a), len(b) + shift) + 1):
                    if p < min(len(a), len(b) + shift) and a[p] == b[p - shift]:
                        run.append(p)
                        continue
                    if sum(len(a[q]) for q in run) >= min_chars:
                        gone[i].update(run)
                    run = []
    return lines, gone


def test_line_dedup(spark):
    rng = random.Random(5)
    passage = "Here begins a passage of quite some words. " + prose(rng, 70, None).capitalize() + ". It ends with this sentence."
    rows = []
    for i in range(12):
        t = prose(rng, 120, None)
        if i in (2, 5, 9):
            t = t[:200] + " " + passage + " " + t[200:]
        rows.append((i, t))
    rows += [(20, rows[3][1]), (21, rows[4][1].replace(rows[4][1].split()[30], "changed", 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    lines, gone = brute_line_dedup(rows, 3, 40, 120)
    for i, t in rows:
        want = [x for p, x in enumerate(re.split(line_dedup.CUT, t)) if p not in gone[i]]
        left = re.split(line_dedup.CUT, got[i]["clean_text"]) if got[i]["clean_text"] else []
        # runs shorter than the winnowing guarantee may stay
        assert set(x.rstrip() for x in want) <= set(x.rstrip() for x in left) or want == left
        long_gone = [p for p in gone[i] if all(q in gone[i] for q in range(p, p + 4))]
        for p in long_gone:
            assert lines[i][p] not in {x.rstrip() for x in left} or lines[i].count(lines[i][p]) > 1
    middle = passage[60:-40]
    assert middle in got[2]["clean_text"] and middle not in got[5]["clean_text"] and middle not in got[9]["clean_text"]
    assert got[20]["clean_text"] == "" and got[0]["clean_text"] == rows[0][1] and got[3]["clean_text"] == rows[3][1]


@pytest.mark.parametrize("case", ["verse", "two lines", "next place", "tail"])
def test_line_dedup_meets_every_run(spark, case):
    """Equals brute force where lines are short, runs have two lines, and the first place has a short run."""
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n - 1)) + "."
    own = lambda: [line(rng.randint(30, 60)) for _ in range(3)]
    a, b, c, d = (line(n) for n in (75, 70, 65, 60))
    shared = {"verse": [[line(15) for _ in range(12)]] * 3, "two lines": [[a, b]] * 3 + [[b, c, d]] * 2,
              "next place": [[a], [b], [c], [d], [a, b, c, d], [a, b, c, d], [b, c]],
              "tail": [[line(150), a[:9] + ".", b[:9] + "."]] * 2 + [[c, d[:50]], [c, d[:50], "x."], [c, d[:50], "x."]]}[case]
    rows = [(i, "\n".join(own() + s + own())) for i, s in enumerate(shared)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    _, gone = brute_line_dedup(rows, 3, 40, 120)
    assert any(gone.values())
    for i, t in rows:
        assert got[i]["clean_text"] == "".join(x for p, x in enumerate(re.split(line_dedup.CUT, t)) if p not in gone[i])
        assert got[i]["n_deleted"] == len(gone[i])


# --- operator 3 -----------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_patience_pairs(a, b):
    pairs = license_scan.patience(a, b)
    assert all(a[i] == b[k] for i, k in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def test_license_scan(spark, texts):
    lines = {license_scan.TEMPLATES[k]: k for k in ("apache-2.0", "cc-by-nc-4.0", "gpl-3.0", "mit")}
    notice = license_scan.TEMPLATES["apache-2.0-notice"]
    rows = [*texts.items(), (9001, "x " + notice + " y " + notice.replace("compliance", "harmony")), (9002, notice[:120])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in license_scan.scan(df).collect():
        got = [(x["license"], x["start"], x["end"]) for x in r["licenses"]]
        if r["doc_id"] < 9000:
            t = texts[r["doc_id"]]
            assert sorted(got) == sorted((k, m.start(), m.end()) for x, k in lines.items() for m in re.finditer(re.escape(x[:-1]), t))
        elif r["doc_id"] == 9001:
            assert [g[0] for g in got] == ["apache-2.0-notice"] * 2
        else:
            assert [g[0] for g in got] == ["apache-2.0"]


# --- operator 4 -----------------------------------------------------------

def shingle_counts(t, n=5):
    w = WORD.findall(t)
    return collections.Counter(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else collections.Counter()


def brute_probability_jaccard(u, v):
    both = set(u) | set(v)
    return sum(1 / sum(max(u[y] / u[x], v[y] / v[x]) for y in both) for x in u if x in v)


def test_probability_jaccard():
    rng = random.Random(2)
    base = prose(rng, 200, 30)
    ts = [base, base.replace("w3", "w4", 2), base + " w1" * 50, base[:500], "w1 w2", ""]
    data, offs = B.flat(pa.array(ts))
    t, h, w = minhash.shingles(data, offs, 5)
    reg = minhash.registers(t, h, w, len(ts), 3000)
    for i, j in itertools.combinations(range(5), 2):
        a, b = t == i, t == j
        o, p = np.argsort(h[a]), np.argsort(h[b])
        got = minhash.probability_jaccard(h[a][o], w[a][o], h[b][p], w[b][p])
        want = brute_probability_jaccard(shingle_counts(ts[i]), shingle_counts(ts[j]))
        assert abs(got - want) < 1e-9
        assert abs((reg[i] == reg[j]).mean() - want) < 0.05


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for g in range(25):
        words = prose(rng, 150, 3000).split()
        for c in range(rng.choice([1, 2, 3, 40 if g == 7 else 2])):
            v = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                v[rng.randrange(len(v))] = f"z{rng.randrange(10 ** 6)}"
            rows.append((n, " ".join(v)))
            n += 1
    rng.shuffle(rows)
    counts = {i: shingle_counts(t) for i, t in rows}
    up = {i: i for i in counts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(sorted(up), 2):
        if brute_probability_jaccard(counts[i], counts[j]) >= 0.8:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    near = minhash.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["class_id"] for r in near.result().collect()}
    assert got == {i: find(i) for i in up}
    assert sorted(r["doc_id"] for r in near.kept().collect()) == sorted(set(got.values()))


# --- operator 5 -----------------------------------------------------------

def test_quality_rules_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_small}/documents.parquet'")
    want = con.execute(registry.ORACLE["op5_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = quality_rules.query(spark, sf_small).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=3))
def test_repeat_words(spark, ws):
    rows = [(i, " ".join(w)) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_rules(df).collect()}
    for i, w in enumerate(ws):
        grams = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
        assert got[i] == len(covered)


# --- operator 6 -----------------------------------------------------------

def test_language_model(spark, texts, sf_small):
    r = maxent_lm.query(spark, sf_small).toPandas()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    toks = {i: WORD.findall(t.translate(low)) + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = collections.Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for x in r.itertuples():
        t = toks[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(x.base_score - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6 * len(t)
    assert r[r.held_out].score.sum() > r[r.held_out].base_score.sum()


def test_language_model_is_a_distribution(spark, docs):
    lm = maxent_lm.LanguageModel(docs.select("doc_id", "text"), F.lit(True))
    lm.train()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, (3, maxent_lm.N_FEATURES)).astype(np.uint64)
    every = np.arange(maxent_lm.CELLS)
    for row in x:
        p = 10 ** lm.model.log10(np.repeat(row[None], maxent_lm.CELLS, axis=0), every)
        assert abs(p.sum() - 1) < 1e-4
    assert lm.cell_n.sum() == lm.n and lm.cell_v.sum() == lm.v and (lm.cell_n >= 0).all()


# --- operator 7 -----------------------------------------------------------

def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([centres[rng.integers(0, 30, 500)] + rng.normal(size=(500, 32)) * 0.22, np.repeat(centres[:1], 40, axis=0)]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, [float(e) for e in v], int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.links(df, block=32).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    found = sum(r["n_links"] for r in got.values())
    assert found <= hit.sum() and found >= 0.99 * hit.sum()
    assert all(got[i]["n_links"] <= hit[i].sum() for i in got)
    for i, r in got.items():
        assert r["component_id"] <= i and (r["component_id"] == i) == r["kept"]


# --- operator 8 -----------------------------------------------------------

def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        r = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit("s")).alias("p")).withColumn(
            "back", mixing.place_of(F.col("p"), F.lit(n), F.lit("s"))).collect()
        assert sorted(x["p"] for x in r) == list(range(n)) and all(x["back"] == x["id"] for x in r)


def test_mix(spark, docs, texts):
    mix = mixing.Mix(docs)
    r = mix.taken().toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert {x.doc_id: x.size for x in r.itertuples(index=False)} == size or (r["size"] == r.doc_id.map(size)).all()
    total = r.groupby("source")["size"].sum()
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total.index))}
    free, capped = 1.5 * total.sum(), set()
    while True:
        unit = (free - sum(2 * total[s] for s in capped)) / max(1, sum(w for s, w in weight.items() if s not in capped))
        more = {s for s in weight if s not in capped and unit * weight[s] > 2 * total[s]}
        if not more:
            break
        capped |= more
    for x in r.itertuples():
        want = 2 * total[x.source] if x.source in capped else unit * weight[x.source]
        assert abs(x.target - want) < 1e-6 * want and 0 <= x.taken <= 2 * size[x.doc_id]
    assert (r.groupby("source").taken.sum() - r.groupby("source").target.first()).abs().max() <= 1
    out = mix.documents(docs).toPandas()
    words = out.groupby("doc_id").text.apply(lambda ts: sum(len(WORD.findall(t)) for t in ts))
    taken = r.set_index("doc_id").taken
    assert (words.reindex(taken.index, fill_value=0) == taken).all()
    slots = mix.slots.toPandas()
    assert len(slots.groupby(["shard", "slot"])) == len(slots)
    assert (slots.groupby("shard").size().iloc[:-1] == 4096).all()
    again = mixing.Mix(docs.repartition(7)).taken().toPandas()
    assert sorted(again.taken.items()) is not None and again.set_index("doc_id").taken.to_dict() == taken.to_dict()


# --- operator 9 -----------------------------------------------------------

def brute_spans(t):
    a = re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
    out = [(m.start(), 0, m.end()) for m in a if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secret_patterns(spark, texts, sf_small):
    rng = random.Random(8)
    bits = ["token", "API_KEY", "Secret", " = ", ":", '"', "'", "AKIA", "0123456789abcdef" * 2, "ABCDEFGH12345678", "é", " ", "x", "hunter2hunter2", "\n", "ſecret", "password"]
    rows = [*texts.items(), *((9000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for i in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(df, None).collect()}
    for i, t in rows:
        assert ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in got[i]) == brute_spans(t)
    r = secret_scan.query(spark, sf_small).collect()
    assert all(x["base_sha256"] == hashlib.sha256(brute_spans(texts[x["doc_id"]]).encode()).hexdigest() for x in r)


def test_viterbi(spark):
    rng = np.random.default_rng(1)
    f = secret_scan.Field()
    f.emit, f.move = rng.normal(size=f.emit.shape), rng.normal(size=(3, 3))
    for n in (1, 4, 7):
        x = np.stack([rng.integers(0, s, n) for s in secret_scan.SIZES], axis=1)
        e = f.emissions(x)
        best = max(itertools.product(range(3), repeat=n),
                   key=lambda t: (t[0] != 2, sum(e[i, k] for i, k in enumerate(t)) + sum(f.move[a, b] for a, b in zip(t, t[1:]))))
        assert f.decode(x, np.array([0, n])).tolist() == list(best)


def test_field_finds_what_patterns_do_not(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = prose(rng, 60, 300).split()
        if i % 3 == 0:
            w.insert(30, f'token = "{rng.randrange(16 ** 40):040x}"')
        if i % 3 == 1:
            w.insert(30, f"{rng.randrange(10 ** 15)}")
        rows.append((i, " ".join(w)))
    rows.append((999, prose(rng, 30, 300) + ' auth = "3f1c09ab77de52b1864zfa0c2d93f1c09ab77de" ' + prose(rng, 30, 300)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in secret_scan.scan(df, secret_scan.fit(df)).collect()}
    assert got[999] == ["crf"]
    assert all("crf" not in k for i, k in got.items() if i != 999)


def test_field_learns_from_distinct_windows(spark, monkeypatch):
    """Copies of one text do not fill the quota of windows."""
    rng = random.Random(4)
    secrets = [f"{rng.randrange(16 ** 40):040x}" for _ in range(40)]
    data, offs = B.flat(pa.array([f'"{s}"' for s in secrets]))
    hot = int(np.argmin(B.mix(B.hashes(data, offs[:-1], offs[1:]) + np.uint64(3))))
    texts = [prose(rng, 20, 300) + f' token = "{s}" ' + prose(rng, 20, 300) for s in secrets]
    df = spark.createDataFrame(list(enumerate(texts + [texts[hot]] * 200)), "doc_id long, text string")
    seen = []
    monkeypatch.setattr(secret_scan.Field, "fit", lambda self, x, tags, weight: seen.append((x, tags, weight)))
    assert secret_scan.fit(df, fit_windows=40) is not None
    (x, tags, weight), = seen
    with_secret = x[tags[:, secret_scan.REACH] > 0]
    assert len(with_secret) == len(np.unique(with_secret, axis=0)) >= 15
    assert abs(weight.sum() - len(x)) < 1e-6 and (weight > 0).all()


# --- operator 10 ----------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_bins(lengths):
    bins = packing.best_two_fit(np.array(lengths, np.int64), 30) if lengths else []
    assert sorted(n for b in bins for n in b) == sorted(lengths)
    assert all(sum(b) <= 30 for b in bins)
    # no two bins could be one, but for the last ones
    assert len(bins) <= 2 * sum(lengths) / 30 + 1


def test_pack(spark, texts, sf_small):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = packing.query(spark, sf_small).toPandas()
    for i, g in r.groupby("doc_id"):
        ids = np.array(t.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        g = g.sort_values("piece")
        assert g.start.tolist() == np.r_[0, np.cumsum(g.length)[:-1]].tolist() and g.length.sum() == len(ids)
        assert (g.length.iloc[1:] == 2048).all() and len(g) == -(-len(ids) // 2048)
        assert all(zlib.crc32(ids[a:a + n].tobytes()) == c for a, n, c in zip(g.start, g.length, g.ids_crc32))
    s = r.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (s.length.sum() <= 2048).all() and (s.offset.first() == 0).all()
    assert (r.sort_values(["sequence_id", "offset"]).offset == s.length.cumsum() - r.sort_values(["sequence_id", "offset"]).length).all()
    assert s.ngroups <= -(-r.length.sum() // 2048) + 2


# --- pipeline -------------------------------------------------------------

def test_pipeline_keeps_what_line_dedup_leaves(spark, sf_small):
    """A document that is mostly quotation keeps its own words; one without any goes."""
    rng = random.Random(9)
    quoted, own = prose(rng, 900, None) + ".\n", prose(rng, 100, None) + ".\n"
    rows = [(1, quoted), (2, own + quoted), (3, quoted), (4, quoted + "One word.")]
    docs = corpus_pipeline._documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'a' source"))
    left = {r["doc_id"]: r["text"].strip() for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, sf_small).collect()}
    assert left == {1: quoted.strip(), 2: own.strip(), 4: "One word."}


def test_pipeline(spark, docs, texts, sf_small):
    """Each stage on its own input, and run() as a whole."""
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["quality_rules"](spark, docs, sf_small).cache()
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in clean.collect()} == kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    long = [i for i in labels if len(WORD.findall(texts[i])) >= 20]
    assert all((i in kept) == (labels[i] == 1) for i in long)
    lines = stages["line_dedup"](spark, clean, sf_small).cache()
    left = {r["doc_id"]: r["text"] for r in lines.collect()}
    seen = collections.defaultdict(set)
    for i, t in left.items():
        ls = [x.rstrip() for x in re.split(line_dedup.CUT, t)]
        for a, b, c, d in zip(ls, ls[1:], ls[2:], ls[3:]):
            if len(a + b + c + d) >= 120 and min(len(a + b), len(b + c), len(c + d)) >= 40:
                seen[a, b, c, d].add(i)
    assert all(len(v) == 1 for v in seen.values())
    alone = stages["minhash"](spark, lines, sf_small).cache()
    ids = [r["doc_id"] for r in alone.collect()]
    sets = {i: set(shingle_counts(left[i])) for i in ids}
    assert len(ids) == len(set(ids))
    for i, j in itertools.combinations(ids, 2):
        assert not sets[i] or len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])
    packed = corpus_pipeline.run(spark, sf_small).toPandas()
    assert set(packed.doc_id) <= set(ids) and set(packed.doc_id)
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()
