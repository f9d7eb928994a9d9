"""The pipeline against what each of its stages must do, over small tables."""

import random
from collections import Counter

import pytest


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(400):
        body = [word() for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            body[7] = body[33] = "zzgrobian"
        docs.append((i, " ".join(body), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i + 1][1].replace(" ", "  "), "en", "s9", 1) for i in range(0, 40, 8)]
    docs += [(2000, docs[3][1].upper(), "en", "s9", 1), (2001, None, None, None, None), (2002, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages(spark, sf_dir):
    tokens = pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, seen = docs, []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, first.schema)
        seen.append(rows)
    clean, unique, near, mixed = seen
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in first.collect() if "zzgrobian" not in (r["text"] or "")}
    norm = lambda t: "".join((t or "").split())
    assert len(unique) == len({norm(r["text"]) for r in clean}) and len({norm(r["text"]) for r in unique}) == len(unique)
    assert {r["doc_id"] for r in unique} - {r["doc_id"] for r in near} == {2000}  # differs in case alone
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in near} and max(copies.values()) <= 2
    ids = {r["doc_id"]: r["ids"] for r in p.STAGES[-1][1](spark, docs, sf_dir).collect()}
    t = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    for r in mixed:
        assert ids[r["doc_id"]] == t.encode(r["text"] or "", add_special_tokens=False).ids


def test_run_is_its_stages(spark, sf_dir):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), "doc_id long, n_tokens long, ids array<int>" if name == "bpe" else docs.schema)
    assert sorted(map(str, p.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("crowd", [8, 48])
def test_near_copies_go(spark, crowd, monkeypatch):
    """Copies of similarity 0.8 and more over five words go, those below stay; chains, a crowd and null ids; whatever the
    size of a group that is compared in pairs."""
    import corpus_pipeline as p

    from tidemark.llm import similar

    monkeypatch.setattr(similar, "CROWD", crowd)

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = []

    def add(words):
        docs.append((None if len(docs) % 9 == 5 else len(docs), " ".join(words), "en", "s", 1))

    for i in range(40):
        body = [word() for _ in range(120)]
        add(body)
        for changed in (1, 2, 3, 4, 8):
            copy = list(body)
            for at in range(changed):
                copy[10 + at * 13] = word()
            add(copy)
        if i % 8 == 0:  # each like the one before it
            for at in range(6):
                body = list(body)
                body[15 + at * 15] = word()
                add(body)
    crowd = [word() for _ in range(200)]
    for i in range(80):
        add([*crowd[:i], word(), *crowd[i + 1 :]])
    docs += [(5000, "", "en", "s", 0), (5001, None, None, None, None), (5002, "a few words", "en", "s", 1), (5003, "A  few words", "en", "s", 1)]
    rng.shuffle(docs)
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else {()} for _, t, *_ in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    between = 0
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            s = both / (len(sets[i]) + len(sets[j]) - both)
            between += 0.8 <= s <= 0.95
            if s >= 0.8:
                root[top(i)] = top(j)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(top(i), []).append(d)
    assert between > 100
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = {(r["doc_id"], r["text"]) for r in p.drop_near_copies(spark, spark.createDataFrame(docs, schema).repartition(3), "").collect()}
    for g in groups.values():
        own = [d[:2] for d in g if d[:2] in kept]
        assert len(own) == 1
        ids = [d[0] for d in g if d[0] is not None]
        assert own[0][0] == (min(ids) if ids else None)
    assert len(kept) == len(groups)


def test_keys_of_strangers_do_not_shuffle(spark, monkeypatch):
    """Nodes that share a key of two segments and no third one are in no group; copies are, with all of their keys."""
    from tidemark.llm import similar

    def held(source, nodes):
        seen = []

        def stop(keyed, *_):
            seen.append(keyed.select("own.node").collect())
            raise InterruptedError

        monkeypatch.setattr(similar, "_with_hub", stop)
        with pytest.raises(InterruptedError):
            similar.links(source, nodes)
        return Counter(r["node"] for r in seen[0])

    code = lambda a, b: a << 12 | b
    rows = [(i, 9, i, [code(4000, 4001)] * 2 + [code(2 * i, 2 * i + 1)] * (similar.SEGMENTS - 2)) for i in range(30)]
    rows += [(100 + i, 9, 0, [code(900 + j, 950 + j) for j in range(similar.SEGMENTS)]) for i in range(2)]
    nodes = spark.createDataFrame(rows, "node long, size long, short long, codes array<int>")
    assert held(None, nodes) == {100: 4 * similar.SEGMENTS, 101: 4 * similar.SEGMENTS}


def test_filters_come_in_few_jobs(spark, tmp_path):
    """A filter comes to the driver in a few jobs however many partitions a shuffle has, and what it shuffled is dropped."""
    from tidemark.llm import bits

    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    tracker = spark.sparkContext._jsc.sc().dagScheduler()
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        hashes = spark.range(1000).selectExpr("xxhash64(id % 900) h")
        first = tracker.numTotalJobs()
        found = bits.among(hashes, 1000, "twice")
        jobs = tracker.numTotalJobs() - first
        from pyspark.sql import functions as F

        assert hashes.filter(found(F.col("h"))).count() >= 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert jobs < 32


def test_workers_give_back_what_they_held(monkeypatch):
    """What a task held is free, and given back, when its worker waits for the next one."""
    import weakref

    import pyarrow as pa

    from tidemark.llm import bpe, similar, toxicity
    from tidemark.llm.common import lean

    class Table:
        pass

    class Pool:
        released: list = []

        def release_unused(self):
            self.released.append([x() for x in refs])

    refs: list = []
    monkeypatch.setattr(pa, "system_memory_pool", lambda: Pool())
    monkeypatch.setattr(pa, "set_memory_pool", lambda pool: None)

    def work(batches, n):
        table = Table()
        refs.append(weakref.ref(table))
        for batch in batches:
            yield batch * n

    assert list(lean(work)([1, 2], n=3)) == [3, 6] and Pool.released == [[None]]
    stopped = lean(work)([1, 2], 3)
    next(stopped)
    stopped.close()
    assert len(Pool.released) == 2
    for own in (bpe._count, bpe._encode, bpe._lookup, toxicity._lexicon_rows, toxicity._featurize, similar._nodes, similar._sets, similar._alike, similar._passing, similar._supported, similar._parted):
        assert own.__wrapped__


def test_a_task_of_filters_needs_one_worker(spark, monkeypatch):
    """Keys are made and packed in one Python worker, so that no executor keeps two for each of its cores."""
    from pyspark.sql import functions as F

    from tidemark.llm import bits, similar

    plans, filled = [], bits.filled

    def seen(rows, *args, **more):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return filled(rows, *args, **more)

    monkeypatch.setattr(bits, "filled", seen)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0] + " more"])], "doc_id long, text string")
    monkeypatch.setattr(similar, "CROWD", 0)
    monkeypatch.setattr(similar, "_near", lambda a, b, least: F.lit(False))  # nothing is linked, so that the pair's groups count as crowds
    assert {r["doc_id"] for r in similar.deduplicate(docs).collect()} == set(range(31))
    kinds = [p.count("MapInArrow") + p.count("ArrowEvalPython") for p in plans]
    assert len(plans) >= 3 and max(kinds) == 1


def test_mixing_starts_no_other_workers(spark, sf_dir, monkeypatch):
    """The table of sources is read without Python: workers for rows of a list are of another kind, and stay beside the others."""
    from pyspark import SparkContext

    from tidemark.llm import mixing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(SparkContext, "parallelize", None)
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count() and sum(r["taken"] for r in rows) > 0


def test_roots_are_looked_up_once_a_node(spark, monkeypatch):
    """No join of a crowd with its components has a row for each of its keys or hubs, and small tables are in few partitions."""
    from tidemark.llm import components, similar

    held = []
    keyed = similar._keyed
    monkeypatch.setattr(similar, "_keyed", lambda nodes: held.append(keyed(nodes)) or held[0])
    rng = random.Random(6)
    body = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = [(i, " ".join([*body[:i], "other", *body[i + 1 :]])) for i in range(60)]
    assert [r["doc_id"] for r in similar.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    assert held[0].count() == 60 and {len(r["keys"]) > 40 for r in held[0].collect()} == {True}
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        chain = spark.range(40).selectExpr("id u", "id + 1 v")
        found = components.components(chain)
        assert found.rdd.getNumPartitions() == 1 and {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, 41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
