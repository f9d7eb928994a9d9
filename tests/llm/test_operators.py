"""The ten operators against brute force, exact round trips and odd rows."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import bits, bpe, components, exact, golay, media, mixing, ppm, shards, similar, simhash, substrings, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, size string"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words_of(rng, n, k=40):
    return [f"w{rng.randrange(k)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Ties, repeats, nulls, empty and long texts, copies, near copies and shared passages; a column named like a result."""
    rng = random.Random(5)
    out = [(None, "no id at all", None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", "b"), (4, "one", "b"), (4, "one", "b"), (5, "O ne", "c"), (6, "ONE", None)]
    passage = words_of(rng, 60)
    for i in range(10, 60):
        body = words_of(rng, rng.randrange(1, 120))
        if i % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = passage[rng.randrange(4) :]
        out.append((i, " ".join(body), f"s{i % 3}"))
    for i in range(60, 90):
        out.append((i, out[20][1] + (" " if i % 2 else "  "), "s0"))
    for i in range(90, 100):
        w = out[30][1].split()
        w[i % len(w)] = "changed"
        out.append((i, " ".join(w), "s1"))
    out.append((100, " ".join(words_of(rng, 20_000, 3000)), "s2"))
    return [(i, t, "en", s, "x") for i, t, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_those_of_the_contract():
    import re

    text = "a\x1cb\x85c\xa0d \t\n\x0b\x0c\r e\u2003f"
    assert text.encode().split() == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


# ---- 1
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("a*c.org/x*z/", "block")]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for rule, verdict in RULES[:3]:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best and best[0], best[1] if best else "allow"


URLS = [None, "", "no url", "http://EXAMPLE.com/en/712?x", "https://a.example.com/en/8", "http://xcom/en/1", "http://com/en/", "http://b.net/de/1#t", "http://net?de/", "x://h", "http://É.net/de/", "http://a.b.com/en", "http://example.com:80/en/7", "a://b://c.com/en/1", "http://h\nx.com/en/1"]


def test_url_rules(spark, empty, monkeypatch):
    df = spark.createDataFrame([(i % 9, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    want = sorted(((i % 9, *judged(u)) for i, u in enumerate(URLS * 2)), key=str)
    got = lambda: sorted((tuple(r) for r in urls.judge(df, RULES[:3]).collect()), key=str)
    assert got() == want
    monkeypatch.setattr(urls, "LITERAL_RULES", 1)
    assert got() == want


def test_url_wildcards_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://abc.org/x1z/k"), (2, "http://abd.org/x1z/"), (3, "http://www.ac.org/xz/")], "page_id long, url string")
    assert [r["rule"] for r in urls.judge(df, RULES).orderBy("page_id").collect()] == ["a*c.org/x*z/", None, "a*c.org/x*z/"]
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}
    assert urls.judge(df.limit(0), RULES).count() == 0


def test_op1_judges_by_the_rules_of_the_contract(spark, tmp_path):
    import duckdb

    from tidemark.llm import queries

    want = [
        (1, "com/en/", "block", "http://a.com/en/1"), (2, "example.com/en/7", "allow", "http://www.example.com/en/71"), (3, "net/de/", "allow", "http://b.net/de/8"),
        (4, "example.net/de/8", "block", "http://x.example.net/de/81"), (5, "org/es/", "block", "http://c.org/es/"), (6, None, "allow", "http://c.org/en/"),
    ]
    spark.createDataFrame([(i, url) for i, _, _, url in want], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op1_url_filters(spark, str(tmp_path)).select("page_id", "rule", "verdict").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [w[:3] for w in want]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert con.execute(f"SELECT page_id, rule, verdict FROM ({queries.ORACLES['op1_url_filters']}) ORDER BY page_id").fetchall() == [w[:3] for w in want]


def test_url_plan_has_no_shuffle_and_no_python(spark):
    plan = urls.judge(spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string"), RULES)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


# ---- 2
def fingerprint(text, size=3):
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def united(prints, ids):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            r = find(i)
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_golay_keys_meet_within_two_bits():
    tables, rng = golay.tables(), np.random.default_rng(3)
    assert sorted({len(set(x)) for x in tables[1].tolist()}) == [1, 6]
    x = rng.integers(0, 1 << 23, 3000)
    for a in range(23):
        b = (a * 7 + 3) % 23
        y = x ^ (1 << a) ^ (1 << b)
        near = golay.indices(x, tables)[:, :, None] == golay.indices(y, tables)[:, None, :]
        assert near.any(axis=(1, 2)).all()


def test_wide_fingerprints():
    """Sums of bits are those of a plain count, and the two codewords those that agree best of all 4,096."""
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 254, 255, 256, 700)]
    sums = similar.wide_sums(sets)
    for s, got in zip(sets, sums, strict=True):
        h = [similar.mixed(s * np.uint64(2 * lane + 0x9E3779B97F4A7C15)) for lane in range(similar.LANES)]
        want = sorted(2 * sum(int(x) >> b & 1 for x in lane) - len(s) for lane in h for b in range(64))
        assert sorted(got.tolist()) == want
    code = golay.signs()
    words = {tuple(c) for c in code.T.astype(int).tolist()}
    assert len(words) == 4096 and min(sum(a != b for a, b in zip(x, code[:, 0], strict=True)) for x in words if x != tuple(code[:, 0].astype(int))) == 7
    x = sums[:, : similar.SEGMENTS * 23].reshape(-1, 23)
    agree = x @ code.astype(int)
    first, second = golay.two_nearest(x, code).T
    best = np.sort(agree, axis=1)[:, ::-1]
    rows_ = np.arange(len(x))
    assert (agree[rows_, first] == best[:, 0]).all() and (agree[rows_, second] == best[:, 1]).all() and (first != second).all()


def test_near_groups(docs, rows, empty):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect()), key=str)
    prints = [fingerprint(t or "") for _, t, *_ in rows]
    comps = united(prints, [r[0] for r in rows])
    assert got == sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, comps, strict=True)), key=str)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("crowd", [0, 2, 48])
def test_links_of_dense_clusters(spark, crowd, monkeypatch):
    """Thousands of fingerprints in one ball: the same components whatever counts as a crowd."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng, prints = random.Random(8), set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for b in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["u"]: r["v"] for r in components.components(simhash.links(df)).collect()}
    want = united(prints, list(range(len(prints))))
    groups = defaultdict(set)
    for i, x in enumerate(signed):
        groups[roots.get(x, x)].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i, c in enumerate(want) if c == k) for k in set(want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (7, 3)], "u long, v long")
    got = {r["u"]: r["v"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)}


def test_near_dedup_keeps_one(docs, rows):
    kept = [r["doc_id"] for r in simhash.deduplicate(docs).collect()]
    comps = united([fingerprint(t or "") for _, t, *_ in rows], [r[0] for r in rows])
    assert sorted(x for x in kept if x is not None) == sorted({c for c in comps if c is not None})


def test_near_dedup_keeps_one_of_null_and_repeated_ids(spark):
    rows_ = [(None, "One two three four"), (None, "one  two three four"), (None, "one two three four"), (None, "quite another text here"), (7, "the third text of all"), (7, "The third  text of all"), (None, "THE third text of all")]
    got = simhash.deduplicate(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], " ".join(r["text"].lower().split())) for r in got), key=str) == sorted([(None, "one two three four"), (None, "quite another text here"), (7, "the third text of all")], key=str)


# ---- 3
def test_exact_decisions(docs, rows, empty):
    def norm(t):
        return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")

    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    got = exact.decisions(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(g for k, g in groups.items() if sha(k) == r["text_sha256"])
        assert (r["keep_id"], r["group_size"]) == (min(own)[3], len(own))
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact.decisions(empty).count() == 0
    assert exact.deduplicate(docs).count() == len(groups)
    assert exact.deduplicate(docs).columns == docs.columns


@pytest.mark.parametrize("parts", [1, 3])
def test_filter_has_no_false_negatives(spark, parts):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    n = bits.shards_for(len(h))
    rows_ = list(bits.packed(np.concatenate([h, h[:100]]), n, parts))
    df = spark.createDataFrame([(s, p, bytearray(a), bytearray(b)) for s, p, a, b in rows_], bits.SENT)
    once, twice = bits.filled(df, n, "once", "twice", parts=parts)
    assert bits.passes(once, n, h).all() and bits.passes(twice, n, h[:100]).all()
    assert bits.passes(twice, n, h[100:]).mean() < 0.01


@pytest.mark.parametrize("few", [0, 4096])
def test_most_frequent_is_exact(spark, few, monkeypatch):
    """Ties, counts of millions, and limits below the first tie: always as many rows as asked for, the greatest ones."""
    from tidemark.llm import common

    monkeypatch.setattr(common, "FEW", few)
    for counts in ([5_000_000, 4_000_000, 2_000_000], [7] * 10, [1] * 50 + [2] * 30 + [9, 1 << 40], [3]):
        df = spark.createDataFrame(list(enumerate(counts)), "key long, n long").repartition(3).cache()
        for most in (0, 1, 2, 5, len(counts), 99):
            got = sorted((r["n"] for r in common.most_frequent(df, most).collect()), reverse=True)
            assert got == sorted(counts, reverse=True)[:most]
    assert common.most_frequent(spark.createDataFrame([], "key long, n long"), 3).count() == 0


# ---- 4
def test_repeats(docs, rows, empty):
    texts = [(t or "").encode().split() for _, t, *_ in rows]
    n = substrings.WINDOW
    seen = Counter(tuple(w[p : p + n]) for w in texts for p in range(len(w) - n + 1))
    want = []
    for (i, *_), w in zip(rows, texts, strict=True):
        gone = {q for p in range(len(w) - n + 1) if seen[tuple(w[p : p + n])] > 1 for q in range(p, p + n)}
        want.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 500
    assert substrings.remove_repeats(empty).count() == 0


def test_a_text_may_repeat_itself(spark):
    w = [f"x{i}" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(w + ["-"] * 3 + w)), (2, " ".join(["same"] * 50)), (3, " ".join(w[:34]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(df).collect()}
    assert got == {1: 80, 2: 50, 3: 0}


# ---- 5
ODD = [None, "", "a <|endoftext|>  b\n\n c", "<|endoftext|>" * 3, "it's    x y ̀é 日本語 ٣٤ \U0001f600", "   ", "\x85\x1c a\x00b", "x" * 3000, " don't 'S we'll\t\tq", "<|endof", "one two one two"]


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_bpe_is_that_of_the_library(spark, common):
    tokens = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokens.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(ODD)] + [(2, ODD[2], "r")], "doc_id long, text string, ids string").repartition(3)
    got = bpe.decode(bpe.encode(df, path, common=common), path).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        want = t.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["text"] == t.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), path).count() == 0


def test_decoding_broken_bytes(spark):
    tokens = pytest.importorskip("public_tokenizers")
    path = tokens.path("byte_bpe_50k.json")
    ids = [i for i, b in bpe.vocabulary(path) if len(b) == 1 and b[0] >= 0xC0][:3]
    got = bpe.decode(spark.createDataFrame([(1, ids + [10**6, -1]), (2, None)], "doc_id long, ids array<int>"), path).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["\ufffd" * 3, ""]


# ---- 6
def test_grammar_reads_scopes():
    g, state, out = toxicity.grammar(), 0, []
    for s in ("insult", "target", "insult", "negation", "other", "insult", "other", "insult", "report", "other", "insult"):
        x, state = g.step(state, s)
        out.append(x)
    assert out[0] == "insult" and out[2].endswith("|aimed") and out[5].endswith("|negated") and not out[7].endswith("negated") and out[10].endswith("|reported")


@pytest.mark.parametrize("seed", range(20))
def test_readings_are_those_of_a_plain_reader(seed):
    """Aimed: a target within reach on either side; negated: a negation within reach before; reported: any report before."""
    rng = random.Random(seed)
    words_ = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(1, 30))]
    want = []
    for i, x in enumerate(words_):
        if x not in toxicity.HITS:
            want.append(None)
            continue
        near = words_[max(0, i - toxicity.AIMED) : i] + words_[i + 1 : i + 1 + toxicity.AIMED]
        want.append("reported" if "report" in words_[:i] else "negated" if "negation" in words_[max(0, i - toxicity.NEGATED) : i] else "aimed" if "target" in near else "bare")
    assert toxicity.readings(words_, toxicity.grammar(), toxicity.aim()) == want


def test_features_by_hand_and_the_order_of_readings():
    lexicon, machines = toxicity.Lexicon({"grob$": 4.0, "zzfi": 2.0}), (toxicity.grammar(), toxicity.aim())
    got = toxicity.features("You grob zzfies! A plain clause. He said you grob; not grob\nI will kill", lexicon, machines)
    first, second, third = 1.5 * (4 + 2), 0.5 * 4, 0.25 * 4
    assert got == pytest.approx([math.log1p(first + second + third), math.log1p(1.5 * 2 + 0.5 + 0.25), math.log1p(1.0), first])
    assert toxicity.features("no word of it", lexicon, machines).tolist() == [0, 0, 0, 0]
    rng = np.random.default_rng(3)
    x = rng.random((200, 4)) * [2, 1, 1, 6]
    for y in ((x[:, 0] > 1).astype(float), (x[:, 0] < 1).astype(float), rng.integers(0, 2, 200).astype(float)):
        w = toxicity.monotone(x, y)
        assert (w[:-1] >= 0).all()
    w = toxicity.monotone(x, (x[:, 3] + x[:, 0] > 4).astype(float))
    score = [toxicity.features(t, lexicon, machines) @ w[:-1] + w[-1] for t in ("you grob", "some grob", "he said some grob", "it is not grob", "some words")]
    assert score == sorted(score, reverse=True) and len(set(score)) == 5


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(4)
    rows_, labels = [], []
    for i in range(600):
        w = words_of(rng, 40, 300)
        toxic = i % 6 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["zzgrob", "qqfies" + rng.choice(["ig", "er", "en"])])
        rows_.append((i, ". ".join(" ".join(w[k : k + 8]) for k in range(0, 40, 8)), 1))
        labels.append((i, int(toxic)))
    rows_ += [(None, None, 0), (1001, "", 0), (1001, "", 0)]
    docs_ = spark.createDataFrame(rows_, "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs_, toxicity.learn(docs_, lab)).collect()
    assert len(got) == len(rows_)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert {r["predicted"] for r in got if r["doc_id"] == 1001} == {0} and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.reject(docs, model).columns == docs.columns


# ---- 7
def test_targets_fill_up():
    assert mixing.targets([10, 10], [3, 1], 30) == [20.0, 10.0]
    assert mixing.targets([100, 10, 50], [3, 1, 2], 240) == pytest.approx([132.0, 20.0, 88.0])
    assert mixing.targets([], [], 0) == [] and mixing.targets([0, 0], [3, 1], 0) == [0.0, 0.0]


@pytest.mark.parametrize("seed", range(5))
def test_sainte_lague_is_by_highest_quotients(seed):
    rng = random.Random(seed)
    votes = np.array([float(rng.randrange(1, 50)) for _ in range(8)])
    most, seats, want = np.array([rng.randrange(1, 9) for _ in range(8)]), 23, [0] * 8
    for _ in range(min(seats, int(most.sum()))):
        q = [v / (2 * s + 1) if s < m else -1 for v, s, m in zip(votes, want, most, strict=True)]
        want[q.index(max(q))] += 1
    got = mixing.sainte_lague(votes, seats, most)
    assert got.sum() == sum(want) and (got <= most).all()
    key = lambda s: sorted(round(v / (2 * x - 1), 9) for v, x in zip(votes, s, strict=True) if x)
    assert key(got.tolist()) == key(want)


@pytest.mark.parametrize("seed", range(2))
def test_quotas_of_cells_are_those_of_the_rule(spark, seed):
    rng = random.Random(seed)
    votes = [float(rng.randrange(0, 9)) for _ in range(60)]
    most, seats = [rng.randrange(0, 9) for _ in votes], 97
    df = spark.createDataFrame([(0, i, v, m) for i, (v, m) in enumerate(zip(votes, most, strict=True))], "number int, shard int, votes double, most long").cache()
    got = {r["shard"]: r["quota"] for r in mixing.quotas(df, seats).collect()}
    want = mixing.sainte_lague(np.array(votes), seats, np.array(most)).tolist()
    key = lambda s: sorted(round(v / (2 * k + 1), 9) for v, x in zip(votes, s, strict=True) for k in range(x))  # the quotients that won
    mine = [got[i] for i in range(60)]
    assert sum(mine) == sum(want) and all(x <= m for x, m in zip(mine, most, strict=True)) and key(mine) == key(want)
    assert {r["quota"] for r in mixing.quotas(df.limit(0), 5).collect()} == set()


def test_mixed_documents_keep_clashing_columns(spark):
    rows_ = [(i % 7, "a b c", "s", i, i, i) for i in range(20)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string, _copies int, times int, document int")
    got = mixing.mixed_documents(df).collect()
    assert got and set(map(tuple, got)) <= set(rows_) and sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(df.repartition(3)).collect()))
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_mixture(docs, rows, empty):
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes = {}
    for r in got:
        sizes[r["source_size"]] = r["target"]
    taken = Counter()
    for r in got:
        taken[r["source_size"]] += r["taken"]
    for s, t in sizes.items():
        assert abs(taken[s] - t) <= max(64, 0.02 * t)
    again = mixing.mixture(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixture(empty).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0


# ---- 8
def test_media_round_trip(docs, rows):
    got = media.text_media(docs).collect()
    want = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes((-len(b)) % 64 if b else 64)
        want[len(b), len(p), sha(p), zlib.crc32(p[-64:])] += 1
    assert Counter((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want


def test_netpbm_and_bmp():
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.write_pgm(a)) == a).all()
    assert (media.decode(b"P2 # plain\n4 3\n255\n" + b" ".join(b"%d" % x for x in range(12))) == a).all()
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0, 1, 1, 1, 1, 1, 1, 1, 0]]
    assert media.decode(b"P1 3 1 101").tolist() == [[0, 1, 0]]
    assert media.decode(b"P5 2 1 65535\n\x01\x00\x00\x02").tolist() == [[256, 2]]
    rgb = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(b"P6 3 2 255\n" + rgb.tobytes()) == rgb).all()
    line = lambda row: row[:, ::-1].tobytes() + b"\0" * 3
    import struct

    head = b"BM" + struct.pack("<IHHI", 78, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, 24, 0, 0, 0, 0)
    assert (media.decode(head + line(rgb[1]) + line(rgb[0])) == rgb).all()


def test_resize_is_the_mean_area():
    a = np.random.default_rng(2).random((6, 10))
    assert np.allclose(media.resize(a, 3, 5), a.reshape(3, 2, 5, 2).mean(axis=(1, 3)))
    assert np.allclose(media.resize(a, 7, 3).mean(), a.mean())
    assert (np.load(io.BytesIO(media.npy(a))) == a).all()


def test_tiles_say_what_is_wrong(spark):
    df = spark.createDataFrame([(1, b"P5 2 2 255\nabcd", "t"), (2, b"junk", "t"), (3, None, "t"), (4, b"P5 9 9 255\nab", "t")], "id long, media binary, tile string")
    got = {r["id"]: r for r in media.tiles(df, "id", "media").collect()}
    assert np.load(io.BytesIO(got[1]["tile"])).shape == (32, 32) and got[2]["error"] and got[4]["error"] and got[3]["error"] is None


def bmp(width, height, depth, body, masks=(), palette=b""):
    import struct

    start = 54 + 4 * len(masks) + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 3 if masks else 0, len(body), 0, 0, len(palette) // 4, 0) + struct.pack(f"<{len(masks)}I", *masks) + palette + body


def test_bmp_depths_and_masks():
    import struct

    grey2 = bytes([0, 0, 0, 0, 255, 255, 255, 0])
    assert media.decode(bmp(9, -1, 1, b"\xaa\x80\0\0", palette=grey2)).tolist() == [[255, 0, 255, 0, 255, 0, 255, 0, 255]]
    assert media.decode(bmp(3, -1, 4, b"\x10\x10\0\0", palette=bytes([9, 0, 0, 0, 0, 8, 7, 0]))).tolist() == [[[7, 8, 0], [0, 0, 9], [7, 8, 0]]]
    assert media.decode(bmp(2, 1, 16, struct.pack("<HH", 0x7C00, 0x3FF))).tolist() == [[[255, 0, 0], [0, 255, 255]]]
    assert media.decode(bmp(2, 1, 16, struct.pack("<HH", 0xF800, 0x7E0), masks=(0xF800, 0x7E0, 0x1F))).tolist() == [[[255, 0, 0], [0, 255, 0]]]
    assert media.decode(bmp(1, 1, 32, struct.pack("<I", 0x11223344), masks=(0xFF, 0xFF00, 0xFF0000))).tolist() == [[[0x44, 0x33, 0x22]]]
    for bad in (bmp(0, 1, 24, b""), bmp(2, 1, 2, b"\0" * 4), bmp(5, 5, 24, b"\0" * 8)):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_bad_samples_never_fail_the_job_and_greys_are_spread(spark):
    bad = [b"P2 1 1 255 300", b"P2 1 1 255 -3", b"P2 1 1 255 x", b"P1 2 1 17", b"P5 1 1 99999 a", b"P2 1 1 255 99999999999999999999", b"P5 99999999999 99999999999 255\n", b"P5 1 1 15 \x20", b""]
    good = {b"P2 1 1 15 15": 255, b"P5 1 1 1023 \x03\xff": 255, b"P5 1 1 1023 \x00\x00": 0, b"P1 1 1 0": 255, b"P1 1 1 1": 0, b"P4 1 1 \x00": 255, b"P2 1 1 3 1": 85, b"P5 1 1 255 \x07": 7}
    rows_ = list(enumerate([*bad, *good]))
    got = {r["id"]: r for r in media.tiles(spark.createDataFrame([(i, bytearray(x)) for i, x in rows_], "id long, media binary"), "id", "media", 2).collect()}
    for i, x in rows_:
        if x in good:
            assert np.load(io.BytesIO(got[i]["tile"])).tolist() == [[good[x]] * 2] * 2, x
        else:
            assert got[i]["error"] is not None and got[i]["tile"] is None, x


def test_stored_form_feature_and_tile_by_hand(docs, rows):
    """The picture, its difference hash and its tile from plain loops over samples and areas."""

    def area(a, height, width):
        out = []
        for i in range(height):
            line = []
            for j in range(width):
                total, weight = 0.0, 0.0
                top, bottom, left, right = i * len(a) / height, (i + 1) * len(a) / height, j * 64 / width, (j + 1) * 64 / width
                for y in range(int(top), min(len(a), math.ceil(bottom))):
                    for x in range(int(left), min(64, math.ceil(right))):
                        w = (min(bottom, y + 1) - max(top, y)) * (min(right, x + 1) - max(left, x))
                        total, weight = total + w * a[y][x], weight + w
                line.append(total / weight)
            out.append(line)
        return out

    by = {(r["doc_id"], r["n_bytes"]): r for r in media.text_media(docs).collect()}
    for i, t, *_ in rows[:14]:
        b = (t or "").encode()
        p = b + bytes((-len(b)) % 64 if b else 64)
        a = [list(p[k : k + 64]) for k in range(0, len(p), 64)]
        r = by[i, len(b)]
        stored = b"P5\n64 %d\n255\n" % len(a) + p
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), sha(stored))
        small = [[round(x, 6) for x in line] for line in area(a, 8, 9)]
        bits_ = "".join("1" if x < y else "0" for line in small for x, y in zip(line, line[1:], strict=False))
        assert r["feature"] == f"{int(bits_, 2):016x}"
        tile = np.clip(np.rint(np.round(np.array(area(a, 32, 32)), 9)), 0, 255).astype(np.uint8)
        mine = np.clip(np.rint(media.resize(np.array(a), 32, 32)), 0, 255).astype(np.uint8)
        assert np.abs(tile.astype(int) - mine).max() <= 1 and r["tile_sha256"] == sha(media.npy(mine))


# ---- 9
def test_ppm_is_a_distribution():
    text = b"abracadabra\nabra\n"
    g, _ = ppm.grams_of([text])
    keys, n = np.unique(g, return_counts=True)
    tables = []
    for k in range(ppm.ORDER + 1):
        u, w = np.unique(keys & ppm._mask(k), return_inverse=True)
        tables.append((u, np.bincount(w, n, len(u))))
    model = ppm.levels(tables)
    for ctx in (b"abrac", b"zzzra", b"\xff\xff\xff\xff\xff", b"cadab"):
        base = np.uint64(int.from_bytes(ctx, "big") << 8)
        p = 10 ** ppm.log10_probability(model, base | np.arange(256, dtype=np.uint64))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()


def test_scores(docs, rows, empty):
    count, trie = Counter(), defaultdict(Counter)
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        if zlib.crc32((str(i) if i is not None else "").encode()) % 7 != 2:
            count.update(w)
            count[b"\n"] += 1
            x = b"\n" * 5 + ppm.normal(w)
            for j in range(5, len(x)):
                for k in range(6):
                    trie[x[j - k : j]][x[j]] += 1
    n, v = sum(count.values()), len(count)

    def scored(w):
        x, total = b"\n" * 5 + ppm.normal(w), 0.0
        for j in range(5, len(x)):
            seen, p = set(), 1.0
            for k in range(5, -1, -1):
                c = trie.get(x[j - k : j])
                left = c and {s: m for s, m in c.items() if s not in seen}
                if not left:
                    continue
                if x[j] in left:
                    p *= (left[x[j]] - 0.5) / sum(left.values())
                    break
                p *= 0.5 * len(left) / sum(left.values())
                seen |= set(c)
            else:
                p /= 256 - len(seen)
            total += math.log10(p)
        return total

    got = {(r["doc_id"], r["n_tokens"], r["n_known"]): r for r in ppm.score(docs).collect()}
    for i, t, *_ in rows[:50]:
        w = (t or "").encode().lower().split()
        tokens = [*w, b"\n"]
        r = got[i, len(tokens), sum(count[x] > 0 for x in tokens)]
        assert r["train_tokens"] == n and r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens))
        assert r["score"] == pytest.approx(scored(w))
    assert ppm.score(empty).count() == 0


def test_rare_words_and_pruned_tries_still_count(docs, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in ppm.score(docs).collect()}
    monkeypatch.setattr(ppm, "COMMON", 5)
    monkeypatch.setattr(ppm, "LEVEL", 50)
    few = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in ppm.score(docs).collect()}
    assert whole == few


@pytest.mark.parametrize("most", [700, 1 << 20])
def test_scores_are_those_of_the_whole_trie(spark, monkeypatch, most):
    """However few grams a worker may hold at once."""
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(60)) for _ in range(40)]
    held_out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(40)]
    part = [b" ".join(t.encode().split()) + b"\n" for t in texts]
    keys, n = np.unique(ppm.grams_of([p for p, h in zip(part, held_out, strict=True) if not h])[0], return_counts=True)
    assert len(keys) > 2 * 700
    tables = []
    for k in range(ppm.ORDER + 1):
        u, w = np.unique(keys & ppm._mask(k), return_inverse=True)
        tables.append((u, np.bincount(w, n, len(u))))
    model = ppm.levels(tables)
    monkeypatch.setattr(ppm, "LEVEL", most)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    got = {r["doc_id"]: (r["held_out"], r["score"]) for r in ppm.score(docs).collect()}
    assert set(held_out) == {True, False} and len(got) == 40
    for i, p in enumerate(part):
        assert got[i][0] == held_out[i]
        assert got[i][1] == pytest.approx(ppm.log10_probability(model, ppm.grams_of([p])[0]).sum())


# ---- 10
def test_shards(docs, rows, empty, spark):
    got = shards.shard(docs, 8).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, sums = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert shards.shard(empty, 8).count() == 0


def test_shards_are_near_equal(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"text {i} " * (i % 7)) for i in range(4000)], "doc_id long, text string")
    got = shards.shard(df, 8).groupBy("shard").agg({"size": "sum"}).collect()
    sums = [r[1] for r in got]
    assert len(sums) == 8 and max(sums) - min(sums) <= 2 * 60


def test_shards_of_odd_tables(spark):
    """Equal rows, one huge row, fewer rows than shards; and each row where plain sums over the sorted line put it."""
    tables = [[(1, "same")] * 100, [(i, "x" * (50_000 if i == 7 else 3)) for i in range(60)], [(1, "a"), (2, None)], [(i, f"t{i % 50} " * (i % 9)) for i in range(900)]]
    for rows_ in tables:
        df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
        got = shards.shard(df, 8).collect()
        sizes = [len(t or "") + 1 for _, t in rows_]
        sums = Counter()
        for r in got:
            sums[r["shard"]] += r["size"]
        assert len(got) == len(rows_) and sum(sums.values()) == sum(sizes)
        assert max(sums.values()) <= sum(sizes) / 8 + max(sizes)
        # the line: by checksum of the text, then hash of the id; a row's shard is that of its middle
        line = sorted(((r["text_crc32"], r["shard"], r["slot"], r["size"]) for r in got), key=lambda r: (r[1], r[2]))
        assert [x[0] for x in line] == sorted(x[0] for x in line)
        upto = 0
        for _, shard_, _, size in line:
            assert shard_ == min(7, (2 * upto + size) * 8 // (2 * sum(sizes)))
            upto += size


# ---- all
def test_stages_of_empty_tables_and_of_null_ids(spark, empty):
    """Filtering operators give back docs' own columns, nothing of nothing, and treat rows without ids as rows."""
    none = spark.createDataFrame([(None, "a b c d e f", "en", None, None), (None, "a b  c d e f", "en", "s", "x"), (None, None, None, None, None)], SCHEMA)
    model = toxicity.Model({}, np.array([1.0, 0, 0, 0, -3.0]))
    steps = {
        "reject": (lambda d: toxicity.reject(d, model), 3), "exact": (exact.deduplicate, 2), "bits": (simhash.deduplicate, 2), "similar": (simhash.deduplicate_similar, 2),
    }
    for name, (step, left) in steps.items():
        assert step(empty).count() == 0 and step(empty).columns == empty.columns, name
        got = step(none)
        assert got.count() == left and got.columns == none.columns, name
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mixed_documents(none).columns == none.columns


def test_rules_beyond_the_literal_table_without_tokens(spark, monkeypatch):
    monkeypatch.setattr(urls, "LITERAL_RULES", 1)
    df = spark.createDataFrame([(1, "http://abc.org/x1z/k"), (2, "http://b.net/"), (2, "http://b.net/"), (3, None)], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"]) for r in urls.judge(df, [("a*c.org/x*z/", "block"), ("*b*/", "block"), ("q.com/y/", "block")]).collect() if r["page_id"] < 3)
    assert got == [(1, "a*c.org/x*z/"), (2, "*b*/"), (2, "*b*/")]
