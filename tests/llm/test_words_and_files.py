"""Token files, phrases and spelling variants against brute force, and over odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import idfiles, mph, phrases, simple8b, spelling
from tidemark.llm.common import stage_folder

SCHEMA = "doc_id long, text string, lang string, source string, n string, ids string"
ODD = ["", " \n\t", "It's 9 o'clock, Ünïcode ÉTÉ ÀÉ; naïve… x\x7fy z\x1cw", "ábc ΣΣ İ", "<|endoftext|> A<|STARTOFTEXT|>b <|startoftext|>x", "line\r\nline", " sep nbsp　wide", "日本語 text!!", "word. word, word; word?! (word)"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "the", "of", "'s"]
    out = [(None, "no id", None), (3, None, "en"), (3, "twice", "en"), (3, "twice", "en")]
    out += [(10 + i, t, "en") for i, t in enumerate(ODD)]
    out += [(100 - i, " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    out.append((1000, " ".join(rng.choice(words) for _ in range(30_000)), "fr"))
    return [(i, t, lang, "s", "x", "y") for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=3000), st.integers(0, 200))
def test_simple8b_gives_back_all_values(values, repeats):
    v = np.array(values + values[-1:] * repeats * 5, np.uint64)
    coded = simple8b.encode(v)
    assert (simple8b.decode(coded, len(v)) == v).all()
    for i in range(len(coded.starts) - 1):
        assert (simple8b.decode(coded, len(v), i, i + 1) == v[i * simple8b.BLOCK : (i + 1) * simple8b.BLOCK]).all()


def test_simple8b_words_are_those_of_the_coding():
    assert simple8b.encode(np.array([1] * 60 + [2])).words.tolist() == [(2 << 60) | ((1 << 60) - 1), (3 << 60) | 2]
    assert simple8b.encode(np.array([9] * 61)).words.tolist() == [(1 << 60) | (61 << 32) | 9]
    assert simple8b.encode(np.array([1 << 19, 3, 5, 1 << 50])).words.tolist() == [(13 << 60) | (5 << 40) | (3 << 20) | (1 << 19), (15 << 60) | (1 << 50)]
    assert simple8b.encode(np.array([2**63])).raw.tolist() == [2**63]


def test_simple8b_is_as_small_as_its_selectors_allow():
    v = np.random.default_rng(1).integers(0, 1 << 15, 4096)
    assert len(simple8b.encode(v).words) <= 4096 / 4 + 8


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public.path("word_bpe_49k.json"), Tokenizer.from_file(public.path("word_bpe_49k.json"))


def test_token_files_hold_what_the_library_gives(spark, docs, rows, tokenizer):
    path, library = tokenizer
    folder = stage_folder(spark)
    files = idfiles.write(idfiles.encoded(docs, path, end=1), folder, most=500)
    assert files.count() > 2 and files.agg({"documents": "sum"}).first()[0] == len(rows)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in rows]
    got = idfiles.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in want), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(r.ids) for r in got])])[:-1].tolist()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    digests = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in idfiles.digests(spark, folder).collect()}
    assert digests == {(r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_files_that_the_table_does_not_name_are_not_read(spark, docs, tokenizer):
    folder = stage_folder(spark)
    idfiles.write(idfiles.encoded(docs, tokenizer[0]), folder)
    before = idfiles.digests(spark, folder).count()
    store, path = idfiles._file_system(folder)
    with store.open_output_stream(f"{path}/data/000000-000000-lost.ids") as out:
        out.write(b"half a file")
    assert idfiles.digests(spark, folder).count() == before
    with pytest.raises(ValueError, match="not a file"):
        idfiles.unpacked(b"half a file" * 8)


def test_token_files_of_no_rows_and_of_wide_values(spark, empty, tokenizer):
    folder = stage_folder(spark)
    idfiles.write(idfiles.encoded(empty, tokenizer[0], end=1), folder)
    assert idfiles.digests(spark, folder).count() == 0 and idfiles.read(spark, folder).count() == 0
    odd = spark.createDataFrame([(1, [2**62, None, 0], "z"), (2, None, "z"), (None, [], "z")], "k long, v array<long>, start string")
    folder = stage_folder(spark)
    idfiles.write(idfiles.in_order(odd, "k"), folder, "k", "v")
    assert [(r.k, r.ids) for r in idfiles.read(spark, folder, "k").orderBy("start", "k").collect()] == [(None, []), (1, [2**62, 0, 0]), (2, [])]


# ---- 12
def test_perfect_hash_is_minimal_and_compares_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    table = mph.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys))) and (table.keys[table.slots(keys)] == keys).all()
    assert (table.slots(np.setdiff1d(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), keys)) == mph.NONE).all()
    assert len(mph.PerfectHash(np.empty(0, np.uint64))) == 0 and mph.PerfectHash(np.empty(0, np.uint64)).slots(keys[:2]).tolist() == [-1, -1]


def mined(rows, least, longest, top, percent):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        best = []
        for p, a in frequent.items():
            inside = any(100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items() if len(q) > len(p))
            if len(p) > 1 and not inside:
                score, k = min((1000 * a * n[lang] // (frequent[p[:k]] * frequent[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), frequent[p[:k]], frequent[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "top", "percent", "most"), [(5, 5, 50, 100, 1 << 20), (3, 3, 7, 60, 1 << 20), (5, 5, 50, 100, 0), (3, 4, 20, 60, 30)])
def test_phrases_are_those_of_brute_force_with_and_without_broadcasts(docs, rows, least, longest, top, percent, most):
    got = sorted(tuple(r) for r in phrases.mine(docs, least=least, longest=longest, top=top, drop_percent=percent, most=most).collect())
    assert got == mined(rows, least, longest, top, percent)


def test_phrases_of_no_rows_and_of_one_word(empty, docs):
    assert phrases.mine(empty).count() == 0 and phrases.mine(docs, longest=1).count() == 0
    assert phrases.mine(docs, least=10**6).count() == 0


# ---- 13
def spelled(rows, lose, least):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if not lose or h % lose else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        return a != b and (a in {b[:i] + b[i + 1 :] for i in range(len(b))} if len(a) < len(b) else len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)

    links = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in links.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


@pytest.fixture(scope="module")
def misspelt():
    """Chains of forms, words with one beginning, repeats within words, ties, letters beyond ASCII."""
    rng = random.Random(9)
    stems = ["interval", "banana", "aaaaaa", "misspell", "naïveté", "ÀÉÎÕÜß", "letters"] + ["prefix" + "".join(rng.choice("abcd") for _ in range(rng.randrange(4))) for _ in range(60)]
    rows = []
    for i in range(400):
        out = []
        for _ in range(60):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :]])
            out.append(rng.choice([w, w, w.capitalize(), w + "’s"]))
        rows.append((i if i else None, "-".join(out) if i % 3 else " ".join(out), "en", "s", "x", "y"))
    return [*rows, (5, None, "en", "s", "x", "y"), (6, "", "en", "s", "x", "y"), (7, "× ÷ 日本語", "en", "s", "x", "y")]


@pytest.mark.parametrize(("hot", "cell"), [(64, 1 << 16), (4, 1 << 16), (1000, 1 << 16), (0, 7), (64, 7)])
def test_spelling_variants_are_those_of_brute_force_however_words_are_parted(spark, misspelt, monkeypatch, hot, cell):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "CELL", cell)
    docs = spark.createDataFrame(misspelt, SCHEMA)
    got = spelling.group(spelling.words_of(docs, lose=19, least=2)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = spelled(misspelt, 19, 2)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want
    assert any(r[1] and r[2] != r[1] for r in want) and sum(r[4] for r in want) > 500


@given(st.text("abé", max_size=6), st.text("abé", max_size=6))
def test_one_edit(a, b):
    edits = {a[:i] + c + a[j:] for i in range(len(a) + 1) for j in (i, i + 1) for c in ("", "a", "b", "é")} - {a}
    assert spelling.one_edit(a, b) == (b in edits)


def test_spelling_of_no_rows(empty):
    assert spelling.group(spelling.words_of(empty)).count() == 0


def test_sums_of_arrays_come_in_few_jobs(spark):
    """The driver gets an array's ranges in a few jobs, not one for each partition of the shuffle."""
    from tidemark.llm import phrases

    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    rows = spark.createDataFrame([(0, m, bytes([1, 1, m])) for m in range(20)], "place int, mapper int, counts binary")
    tracker = spark.sparkContext._jsc.sc().dagScheduler()
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        first = tracker.numTotalJobs()
        assert phrases._tree_sum(rows, 20, 2).tolist() == [20, sum(range(20))]
        assert tracker.numTotalJobs() - first < 32
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_words_are_split_once_and_as_the_tokenizer_would():
    """Texts as stretches have the pieces of whole texts, whatever white space and marks there are, and wherever in a batch
    they begin; words that stand often are split once."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import bpe

    rng = random.Random(3)
    pool = ["a", "b", "'s", "'", "'ll", " ", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\u00e9", "\u00df", "\u00b2", "1", "\u0153", "\u6f22", ".", ",", "<|e|>", "\x1c", "\x85", "\u200b", "_", "^", "]", "-"]
    rows = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(4000)]
    split = bpe.Pieces(["<|e|>"])
    column = pa.array([*rows, None]).slice(7)
    found = bpe.stretches(column, ["<|e|>"])
    flat, sizes = bpe.pieces_of(found, split)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for i, text in enumerate(column.to_pylist()):
        assert [p for c in found.codes[found.bounds[i] : found.bounds[i + 1]] for p in flat[ends[c] : ends[c + 1]]] == split(text or ""), repr(text)
    flat, _ = bpe.pieces_of(bpe.stretches(pa.array(["ab cd, " * 500 + "e"]), []), split)
    assert len(flat) < 10
    batch = pa.RecordBatch.from_arrays([pa.array(["x y x", "y", "y  z"])], ["text"])
    (made,) = bpe._count([batch], [])
    assert dict(zip(made.column("piece").to_pylist(), made.column("n").to_pylist(), strict=True)) == {"x": 1, " y": 1, " x": 1, "y": 2, " ": 1, " z": 1}


def test_kept_words_fill_what_there_is(monkeypatch):
    """Of more new words than may be kept, those that are there again are kept first, and the rest as far as there is room;
    ids are the tokenizer's whatever is kept."""
    tokens = pytest.importorskip("public_tokenizers")
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import bpe, idfiles

    monkeypatch.setattr(idfiles, "KEPT", 3)
    content, added = bpe._settings(tokens.path("word_bpe_49k.json"))
    words, plain = idfiles._Words(content, added), bpe._tokenizer(content)
    for text in ("once twice \u00df\u00e0\u00ed\u00ff, twice Thrice! thrice! thrice! it's 12", "new Once <|endoftext|> \u0153uf \u6f22 a\u00b7b", ""):
        _, codes, distinct = words.split(pa.array([text]))
        ids, _ = words(distinct, codes)
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(words.number) == 3 and {b"twice", b"thrice!"} < set(words.number)
    assert len(words.offsets) == 4 and words.offsets[-1] == len(words.values) and isinstance(words.values, np.ndarray)


def test_pairs_that_buckets_let_through_cost_no_broadcast(spark, monkeypatch):
    """Buckets so few that all pairs pass, more of them than may be broadcast: only the frequent ones count against that."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, 90)) + ". high tide mark. high tide mark", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(phrases, "MOST_POWER", 4)
    monkeypatch.setattr(phrases, "LEAST_POWER", 4)
    monkeypatch.setattr(phrases, "_by_shuffle", None)
    got = sorted(tuple(r) for r in phrases.mine(docs, least=30, most=64).collect())
    assert got == mined(rows, 30, 5, 2000, 100) and got
