"""Operators over whole tables against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import chat, itq, mixing, ngram_join
from tessera.llm.common import n_words
from tessera.llm.graph import components


def roots(n, links):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(5, 5), (7, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    nodes = {x for p in real for x in p}
    assert got == roots(nodes, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_join(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = [None, "", " \t", "one two", "One TWO", "one two three"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        if rng.random() < 0.5:
            base = base + passage
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            edit = list(base)
            for _ in range(rng.randint(0, 5)):
                edit[rng.randrange(len(edit))] = rng.choice(vocabulary)
            texts.append("\n".join(edit))
    hot = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(80):
        edit = list(hot)
        for _ in range(rng.randint(0, 3)):
            edit[rng.randrange(len(edit))] = rng.choice(vocabulary)
        texts.append(" ".join(edit))
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shingles int")
    sets = {i: shingle_set(t) for i, t, _ in rows}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = roots(sets, links)
    got = {r["doc_id"]: r for r in ngram_join.join(df).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())
    assert ngram_join.join(df.limit(0)).count() == 0
    odd = [(1, texts[6]), (1, texts[6]), (None, texts[6]), (2, None), (None, "alone here"), (7, "word " * 50_000), (3, "word " * 60_000)]
    got = ngram_join.join(spark.createDataFrame(odd, "a long, b string").withColumn("set", F.lit("clash")), "a", "b").collect()
    assert sorted(str(r["component_id"]) for r in got) == sorted(["1", "1", "1", "2", "None", "3", "3"])


def test_tile_product():
    """Counts and chains of one tile against all pairs, for columns dense and not, within a part and between two."""
    rng = np.random.default_rng(1)
    for dense, cells in ((48, 4_000_000), (2, 40), (10_000, 7)):
        ngram_join.DENSE, kept = dense, ngram_join.CELLS
        ngram_join.CELLS = cells
        matrix = rng.random((30, 25)) < 0.4
        row, column = np.nonzero(matrix)
        order = rng.permutation(len(row))
        both = matrix.astype(int) @ matrix.T.astype(int)
        for left, right in ((np.arange(30), np.arange(30)), (np.arange(0, 30, 2), np.arange(1, 30, 2))):
            links = [(a, b) for a in left for b in right if a != b and both[a, b] >= 8]
            got = ngram_join.product(column[order], row[order], left, right, lambda a, b, counts: counts >= 8)
            expected = roots(range(30), links)
            assert [int(x) for x in got] == [expected[i] for i in range(len(got))]
        ngram_join.CELLS, ngram_join.DENSE = kept, 48


def test_candidates_grow_with_rows(spark, monkeypatch):
    """Near copies that don't link come out of a tile as one row each at most, however many pairs they make."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10_000)}" for _ in range(80)]

    def given(n):
        rows = []
        for i in range(n):
            at = 5 + i % 8 * 10  # copies with the same word changed link, others don't
            rows.append((i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])))
        return spark.createDataFrame(rows, "doc_id long, text string")

    sizes = []
    plain = ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda *a: (lambda e: sizes.append(e.count()) or e)(plain(*a)))
    for n in (100, 200):
        assert ngram_join.join(given(n)).count() == n
    assert 0 < sizes[0] <= 100 and 0 < sizes[1] <= 200


def test_itq(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        center = rng.standard_normal(64)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), [float(x) for x in center + rng.standard_normal(64) * rng.choice([0.0, 0.1, 0.3, 0.5])], int(c % 3)))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(5)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, [float("nan")] * 64, 0), (n + 3, rows[0][1], None), (n + 4, [1.0, 2.0], 0), (n + 5, [2.0, 4.0], 0), (n + 6, [None] + [1.0] * 63, 0), (n + 7, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    valid = {i: np.array(v) / np.linalg.norm(v) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: y for i, _, y in rows}
    links = {(i, j) for i in valid for j in valid if i < j and label[i] == label[j] and len(valid[i]) == len(valid[j]) and float(valid[i] @ valid[j]) >= 0.93}
    got = {r["vec_id"]: r for r in itq.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    degree = {i: sum(i in p for p in links) for i in label}
    assert all(got[i]["n_links"] <= degree[i] for i in label)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * 2 * len(links) > 0
    assert got[n + 4]["n_links"] == 1 and got[n + 5]["component_id"] == n + 4 and all(got[n + k]["n_links"] == 0 and got[n + k]["kept"] for k in (0, 1, 2, 3, 6, 7))
    assert itq.near_duplicates(df.limit(0)).count() == 0
    other = df.select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<float>").alias("e"), F.col("label").cast("string").alias("root"), F.lit(1).alias("node"))
    assert itq.near_duplicates(other, "v", "e", "root").where("n_links > 0").count() > 0


def test_itq_narrows(spark, monkeypatch):
    """The share of pairs that meet in a bucket falls as a label grows; recall of links stays at nine tenths; parts change nothing."""
    rng = np.random.default_rng(5)

    def given(n):
        x = rng.standard_normal((n, 64))
        x[n // 2 :] = x[: n - n // 2] / np.linalg.norm(x[: n - n // 2], axis=1, keepdims=True) + rng.standard_normal((n - n // 2, 64)) * 0.045
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    shares = [itq.n_tables(itq.key_width(n)) / 2 ** itq.key_width(n) for n in (1000, 10_000, 100_000, 10**7)]
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.01 * shares[0]
    x = given(3000)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = x @ x.T >= 0.93
    np.fill_diagonal(links, False)
    first = {r["vec_id"]: tuple(r) for r in itq.near_duplicates(df).collect()}
    got = sum(r[1] for r in first.values())
    assert 500 < links.sum() >= got >= 0.9 * links.sum()
    monkeypatch.setattr(itq, "PART", 10)
    monkeypatch.setattr(itq.in_tiles, "__defaults__", (10, 64))
    assert {r["vec_id"]: tuple(r) for r in itq.near_duplicates(df).collect()} == first


def test_budget_fit():
    rng = random.Random(5)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 6))), np.int64)
        counts = np.array([rng.randint(0, 4) for _ in sizes], np.int64)
        budget = rng.randint(0, int((sizes * counts).sum()) + 3)
        take = mixing.fit(sizes, counts, budget)
        assert ((0 <= take) & (take <= counts)).all() and (take * sizes).sum() <= max(budget, 0)
        reach = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            reach = {r + k * s for r in reach for k in range(c + 1)}
        whole = mixing._program(sizes, counts, budget)
        assert int((whole * sizes).sum()) == max(r for r in reach if r <= budget)


def test_budget_fit_of_long_documents():
    def taken(sizes, counts, budget):
        take = mixing.fit(np.array(sizes, np.int64), np.array(counts, np.int64), budget)
        assert ((0 <= take) & (take <= np.array(counts))).all()
        return int((take * np.array(sizes)).sum())

    assert taken([90_000, 95_000, 100_000], [1, 1, 1], 185_000) == 185_000
    rng = random.Random(8)
    for _ in range(100):
        sizes = sorted(rng.sample(range(66_000, 3_000_000), rng.randint(1, 7)))
        counts = [rng.randint(0, 3) for _ in sizes]
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts, strict=True)))
        reach = {0}
        for s, c in zip(sizes, counts, strict=True):
            reach = {r + k * s for r in reach for k in range(c + 1)}
        best = max(r for r in reach if r <= budget)
        assert taken(sizes, counts, budget) == best
        if budget < 1 << 22:
            dense = mixing._dense(np.array(sizes, np.int64), np.array(counts, np.int64), budget)
            assert int((dense * np.array(sizes)).sum()) == best and (dense <= np.array(counts)).all()
    sizes = sorted(rng.sample(range(66_000, 200_000), 150))
    for budget in (9_000_001, sum(sizes) // 3):
        assert taken(sizes, [1] * len(sizes), budget) == budget
    sizes = sorted(rng.sample(range(660_000, 2_000_000), 60))
    assert taken(sizes, [1] * len(sizes), sum(sizes) // 2) == sum(sizes) // 2  # beyond CORE_UNITS


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]) if i % 3 else "a", rng.randint(0, 30), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, _bucket int")
    got = mixing.mix(df).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600)) and all(r["_bucket"] == 0 and 0 <= r["copies"] <= 2 for r in got)
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert abs(mine[0]["target"] - target[s]) < 1e-6 and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target[s]) <= 1
    assert {(r["doc_id"], r["copies"]) for r in mixing.mix(df.repartition(7)).collect()} == {(r["doc_id"], r["copies"]) for r in got}
    assert mixing.mix(df.limit(0)).count() == 0


def test_chat_paths(spark):
    rng = random.Random(7)
    rows, best = [], {}
    for tree in range(6):
        n = rng.randint(1, 40)
        parent = {i: None if i == 0 else rng.randrange(max(0, i - 3), i) for i in range(n)}
        score = {i: float(rng.randint(0, 5)) for i in range(n)}
        rows += [(tree, i, parent[i], score[i], "assistant" if i % 2 else "user", f"t{i} </s>[INST]\\|<") for i in range(n)]
        leaves = [i for i in range(n) if i not in parent.values()]

        def path(i, parent=parent):
            return [] if i is None else [*path(parent[i]), i]

        best[tree] = path(min(leaves, key=lambda i: (-sum(score[k] for k in path(i)), i)))
    df = spark.createDataFrame(rows, "conv long, node long, parent long, score double, role string, text string")
    paths = chat.best_paths(df, "conv", "node", "parent", "score")
    made = {r["tree"]: r for r in chat.format_paths(paths, df, "conv", "node", "role", "text").collect()}
    texts = {(t, i): (role, text) for t, i, _, _, role, text in rows}
    for tree, nodes in best.items():
        turns = [texts[tree, i] for i in nodes]
        assert chat.parse(made[tree]["formatted"]) == turns
        learned = [chat.unescape(made[tree]["formatted"][s["start"] : s["end"]]) for s in made[tree]["loss_spans"]]
        assert learned == [t for r, t in turns if r == "assistant"]
    assert chat.best_paths(df, "conv", "node", "parent", "score", branches=2).select("tree", "leaf").distinct().count() >= 6
    assert chat.best_paths(df.limit(0), "conv", "node", "parent", "score").count() == 0


def test_chat_escapes():
    for text in ("", "\\", "\\x3c", "<|end|>", "</s>[INST] ok [/INST]", "a|>b", "\\\\x5b["):
        assert chat.unescape(chat.escape(text)) == text and not set("<[|") & set(chat.escape(text))
        assert chat.parse(chat.render([(text, text), ("assistant", text)])[0]) == [(text, text), ("assistant", text)]


def test_linear_threads(spark):
    df = spark.createDataFrame([(1, 2, "assistant", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 1, "user", "y")], "c long, t long, r string, x string")
    given = chat.linear(df, "c", "t", "r", "x")
    got = given.orderBy("conv", "node").collect()
    assert [(r["conv"], r["node"], r["parent"], r["score"]) for r in got] == [(None, 0, None, 1.0), (1, 0, None, 1.0), (1, 1, 0, 1.0), (1, 2, 1, 0.0)]
    paths = chat.best_paths(given, "conv", "node", "parent", "score")
    made = {r["tree"]: chat.parse(r["formatted"]) for r in chat.format_paths(paths, df.withColumn("node", F.lit("clash")), "c", None, "r", "x", turn="t").collect()}
    assert made == {None: [("user", "y")], 1: [("", "x"), ("", "x"), ("assistant", "")]}


def test_odd_trees(spark):
    """Repeated ids count once, a lost parent makes a root, cycles and what hangs below them give no path."""
    rows = [("t", 1, None, 1.0, "user", "a"), ("t", 2, 1, 1.0, "assistant", "b")] * 2 + [("lost", 5, 99, 2.0, "user", "c"), ("lost", 6, 5, 1.0, "user", "d")]
    rows += [("cycle", i, i % 70 + 1, 1.0, "user", "e") for i in range(1, 71)] + [("cycle", 80, 3, 1.0, "user", "f"), ("self", 1, 1, 1.0, "user", "g"), (None, 1, None, None, None, None), ("t", None, 1, 9.0, "user", "no id")]
    rows += [("tie", 1, None, 1.0, "user", "r"), ("tie", 3, 1, 2.0, "user", "later"), ("tie", 2, 1, 2.0, "user", "first")]
    rows += [("long", i, i - 1 if i else None, 0.0, "user", str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string").withColumn("leaf", F.lit("clash"))
    paths = chat.best_paths(df, "tree", "node", "parent", "score")
    made = {r["tree"]: chat.parse(r["formatted"]) for r in chat.format_paths(paths, df, "tree", "node", "role", "text").collect()}
    assert made == {"t": [("user", "a"), ("assistant", "b")], "lost": [("user", "c"), ("user", "d")], None: [("", "")], "tie": [("user", "r"), ("user", "first")], "long": [("user", str(i)) for i in range(200)]}


def test_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline

    copy, clean, other = (" ".join(f"{w}{k}" for k in range(30)) for w in ("copy", "clean", "other"))
    rows = [(1, copy), (2, copy), (2, clean), (2, clean), (None, other), (None, other), (None, copy), (3, ""), (3, ""), (3, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, copy), (2, clean), (None, other), (3, ""), (3, None), (None, "")]))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, toxic), (_, near), (_, secrets), (_, mixture), (_, tokens) = corpus_pipeline.STAGES
    kept = toxic(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = near(spark, docs, sf)
    joined = ngram_join.join(docs)
    assert {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in joined.select("component_id").distinct().collect()}
    clean = secrets(spark, docs, sf)
    assert clean.count() == docs.count() and clean.where("n_chars <> char_length(text)").count() == 0
    mixed = mixture(spark, docs, sf)
    key = [F.xxhash64("text"), F.col("doc_id")]
    repeated = docs.unionAll(docs.limit(40)).unionAll(docs.limit(40))
    given = repeated.select("doc_id", "source", F.xxhash64("text").alias("h"), n_words(F.col("text")).alias("size"))
    wanted = {tuple(r)[:2]: r["n"] for r in mixing.mix(given).groupBy("doc_id", "h").agg(F.sum("copies").alias("n")).where("n > 0").collect()}
    assert {tuple(r)[:2]: r["count"] for r in mixture(spark, repeated, sf).groupBy(key[1], key[0].alias("h")).count().collect()} == wanted
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where(F.col("count") > 2).count() == 0
    assert tokens(spark, docs.limit(5), sf).count() == 5


def test_pipeline_stages_against_plain_versions(spark):
    """Toxicity by the model's own score, secrets by a plain procedure, tokens by the tokenizers library."""
    import corpus_pipeline
    from tessera.llm import secret_scan
    from tessera.llm.queries import tokenizer_path, toxicity_model
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, toxic), _, (_, secrets), _, (_, tokens) = corpus_pipeline.STAGES
    model = toxicity_model(spark, docs, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in toxic(spark, docs, sf).collect()} == {i for i, t in texts.items() if model.score(t)[0] < 0.5}
    found = {i: secret_scan.find(t or "") for i, t in texts.items()}
    steps = {}
    for _, tested in found.values():
        for _, _, kind, step, _ in tested:
            steps.setdefault(kind, []).append(step)
    least = {}
    for kind, of in steps.items():  # Benjamini and Hochberg, run by run
        ranked = sorted(of, reverse=True)
        passing = [x for r, x in enumerate(ranked, 1) if x >= 0 and 10 ** (-x / secret_scan.STEPS) <= secret_scan.FDR * sum(y >= x for y in ranked) / len(ranked)]
        if passing:
            least[kind] = min(passing)

    def cut(i):
        plain, tested = found[i]
        more = [(a, b, "random") for a, b, kind, step, _ in tested if kind in least and step >= least[kind] and not any(x < b and a < y for x, y, _ in plain)]
        return secret_scan.cut(texts[i], sorted(plain + more)) if texts[i] is not None else None

    assert {r["doc_id"]: r["text"] for r in secrets(spark, docs, sf).collect()} == {i: cut(i) for i in texts}
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for r in tokens(spark, docs.limit(50), sf).collect():
        assert r["ids"] == lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_pipeline_of_odd_tables(spark):
    """Nulls everywhere, repeated rows, an empty table, and columns named like results."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = docs.unionAll(docs.limit(2)).unionAll(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")))
    odd = odd.unionAll(docs.limit(3).select("doc_id", F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars")))
    odd = odd.withColumns({c: F.col("doc_id") for c in ("score", "copies", "ids", "component_id", "spans", "row", "h")})
    for given in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, given, sf)
            if name == "bpe":
                assert got.columns == ["doc_id", "source", "n_tokens", "ids"] and got.count() == given.count()
            else:
                assert got.columns == given.columns and got.where("not doc_id <=> score or not score <=> ids").isEmpty()
                assert got.count() == given.count() if name == "secrets" else True
