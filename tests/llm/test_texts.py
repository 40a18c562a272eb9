"""Operators on single texts against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, licenses, quality, secret_scan, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [None, "", " ", "Hello world's <|endoftext|> x", "aaaaaaa aaa Σίσυφος ΣΑΣ İstanbul ﬁ é naïve ½ ²x 中文 \x1c a\x1fb \x00 can't I'LL", "a’s €5 “q” 😀", "x" * 5000, "Y z " * 3000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in enumerate(texts)], "doc_id long, text string, _text string, _row int")


def test_bpe(spark):
    rng = random.Random(0)
    pool = "abcABC 'sSΣéÉ½²\x00\x1c\x85\xa0̇ſ中😀<|>endoftext\n\t"
    texts = HARD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    lib = Tokenizer.from_file(PATH)
    df = bpe.encode(frame(spark, texts), PATH, decoded="decoded")
    for r in df.collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False) and r["_text"] == "extra"
    again = bpe.decode(df.drop("decoded"), PATH)
    assert again.join(df.select("doc_id", F.col("decoded").alias("d")), "doc_id").where("decoded <> d").count() == 0
    assert bpe.encode(frame(spark, texts).limit(0), PATH).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_licenses(spark):
    body = "lorem the a of " * 40
    texts = HARD + ["Released under the MIT License.", "MIT LICENSE mit-license", "cc by cc-by CC", "éMIT license", "Licensed under the Apache License, Version 2.0.\n" + body, body + "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction " + body, "redistribution and use in source and binary forms", "same", "same"]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, starts, labels, best, more = words_of(t), [], set(), 0.0, set()
        for p, label in licenses.PHRASES.items():
            p = p.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += here
            labels |= {label} if here else set()
        v = words_of((t or "").lower())
        for at in range(0, max(len(v) - 33, 0) + 1, 32):
            block = v[at : at + 64]
            for label, sentence in licenses.TEMPLATES:
                s = set(sentence.split())
                n = max((len(s & set(block[k : k + licenses.span(sentence)])) for k in range(len(block))), default=0)
                if n >= licenses.needed(len(s)):
                    more.add(label)
                    best = max(best, n / len(s))
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and r["labels"] == ",".join(sorted(labels | more))
        assert r["score"] == pytest.approx(1.0 if starts else best)
    assert licenses.scan(frame(spark, texts).limit(0)).count() == 0


#: The notices as they are published, in lines.
NOTICES = {
    "mit": '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights''',
    "apache": '''# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0''',
    "gpl": ''' * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or''',
    "bsd": '''// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:''',
}


def test_published_notices(spark):
    rng = random.Random(4)
    lorem = lambda n: " ".join(rng.choice(["lorem", "ipsum", "the", "of", "a"]) for _ in range(n))
    texts = [f"{lorem(k)}\n{notice}\n{lorem(50)}" for notice in NOTICES.values() for k in (0, 31, 45, 200)]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, label in enumerate(x for x in NOTICES for _ in range(4)):
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= 0.8


def test_wrapped_licenses(spark):
    comment = lambda words, n: "\n".join(" * " + " ".join(words[k : k + n]) for k in range(0, len(words), n))
    texts, expected = [], []
    for label, sentence in licenses.TEMPLATES:
        words = sentence.split()
        if len(words) >= 14:
            texts += ["/*\n" + comment(["lorem"] * k + words + ["ipsum"] * 70, n) + "\n */" for k, n in ((0, 7), (29, 9), (61, 10))]
            expected += [label] * 3
    texts += ["one line of text\nand another", "this program is free software\n" + "lorem " * 80 + "\nyou can redistribute it and or modify it under the terms of the", "released mit\n" + "lorem " * 5 + "\nunder the license"]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, label in enumerate(expected):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0 and got[i]["n_blocks"] > 0
    assert all((got[i]["labels"], got[i]["score"], got[i]["n_blocks"]) == ("", 0.0, 0) for i in range(len(expected), len(texts)))


def test_quality_counts(spark):
    texts = HARD + ["a b c d e f g h " * 3, "x\nx\n \n\nx y\nx y", "# * $ % & | < > #", "\v\f\r\t"]
    df = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    rows = {r["doc_id"]: r for r in quality.judge(quality.with_counts(df)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = {}
        for k in range(len(w) - 7):
            windows.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = rows[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not r["base_failed"] or not r["kept"])
    assert quality.judge(quality.with_counts(df.limit(0))).count() == 0


def test_jensen_shannon(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 3.0], [2.0, 6.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    assert [r[0] for r in df.select(quality.jensen_shannon(F.col("p"), F.col("q"))).collect()] == [pytest.approx(1.0), pytest.approx(0.0, abs=1e-7), None]


def plain_secrets(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_secrets(spark):
    rng = random.Random(1)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    planted = [f"see {key(48)} there" for _ in range(30)]
    plain = ["token=password:abcdefghijklmnop", "API_KEY = 'abcdefghijkl' secret:short", "paſſword=abcdefghijklmnop", "AKIA" + "A" * 14 + " AKIA123", "0123456789abcdef", "énté " + "deadbeef" * 4, "donaudampfschifffahrtsgesellschaftskapitaen " * 3]
    texts = HARD + plain + planted
    found = secret_scan.discoveries(secret_scan.candidates(frame(spark, texts)))
    hits = 0
    for r in found.collect():
        t = texts[r["doc_id"]] or ""
        assert [tuple(s) for s in r["plain"]] == plain_secrets(t)
        assert {tuple(s) for s in r["plain"]} <= {tuple(s) for s in r["spans"]}
        added = [s for s in r["spans"] if s["kind"] == "random"]
        if t in planted:
            hits += len(added) == 1
        else:
            assert not added
    assert hits >= 28
    clean = [r["text"] for r in secret_scan.redact_all(frame(spark, texts)).orderBy("doc_id").collect()]
    assert clean[0] is None and clean[len(HARD) + 1] == "[assign secret]' secret:short" and clean[len(HARD) + 4] == "[hex secret]"
    assert sum("[random secret]" in (c or "") for c in clean) == hits


def test_toxicity_marginals():
    model = toxicity.Field(weight={"bad": 5.0, "vile": 3.0}, base=-4.0, step=[[0.0, -1.0], [-0.5, 0.7]])
    text = "x bad y y vile bad z"
    tokens = [w for w, _, _ in toxicity.words(text)]
    total, marginal = 0.0, np.zeros(len(tokens))
    for code in range(2 ** len(tokens)):  # all taggings
        tags = [code >> i & 1 for i in range(len(tokens))]
        s = sum(t * (model.base + model.weight.get(w, 0.0)) for t, w in zip(tags, tokens, strict=True)) + sum(model.step[a][b] for a, b in zip(tags, tags[1:], strict=False))
        total += np.exp(s)
        marginal += np.exp(s) * np.array(tags)
    expected = [m for m, w in zip(marginal / total, tokens, strict=True) if w in model.weight]
    assert [p for _, _, p in model.evidence(text)[0]] == pytest.approx(expected)


def test_toxicity_likelihood():
    parsed = [("x bad y y vile bad z".split(), 1), ("bad x x".split(), 0), ("vile vile".split(), 1), ("y x y x".split(), 0), ("bad".split(), 1), ("x vile".split(), 0)]
    place = {"bad": 0, "vile": 1}
    theta = np.array([0.7, -0.4, -1.3, -0.6, 0.3, 0.9])  # bad, vile, base, plain to toxic, toxic to plain, toxic to toxic

    def plain(theta):
        total, step = 0.0, [[0.0, theta[3]], [theta[4], theta[5]]]
        for ws, y in parsed:
            score = lambda tags: sum(t * (theta[place[w]] if w in place else theta[2]) for t, w in zip(tags, ws, strict=True)) + sum(step[a][b] for a, b in zip(tags, tags[1:], strict=False))  # noqa: B023, E731
            total += score([int(y and w in place) for w in ws]) - np.log(sum(np.exp(score([c >> i & 1 for i in range(len(ws))])) for c in range(2 ** len(ws))))
        return total

    value, gradient = toxicity.Chains([(toxicity.chain(' '.join(ws), place), y) for ws, y in parsed], len(place)).likelihood(theta)
    assert value == pytest.approx(plain(theta))
    assert gradient == pytest.approx([(plain(theta + e) - plain(theta - e)) / 2e-5 for e in np.eye(6) * 1e-5], abs=1e-6)


def test_toxicity_learns_transitions():
    rng = random.Random(9)
    mild = ["lamp", "river", "stone", "green", "walk", "seven"]
    rows = []
    for i in range(400):
        words = [rng.choice(mild) for _ in range(rng.randint(10, 30))]
        at = rng.randrange(5, len(words) - 1)
        # in toxic texts the two stand side by side, in others apart
        words[at:at] = ["vile", "crow"] if i % 2 else [rng.choice(["vile", "crow"])] if i % 3 else []
        rows.append((" ".join(words), i % 2))
    model = toxicity.fit(rows)
    assert model.step[1][1] - model.step[0][1] - model.step[1][0] > 1
    assert all(p >= 0.5 for _, _, p in model.score("lamp river vile crow stone walk")[1])
    assert all(p < 0.5 for _, _, p in model.score("lamp river vile stone crow walk")[1])
    place = {w: i for i, w in enumerate(model.weight)}
    chains = toxicity.Chains([(toxicity.chain(t, place), y) for t, y in rows], len(place))
    theta = np.array([*(model.base + w for w in model.weight.values()), model.base, model.step[0][1], model.step[1][0], model.step[1][1]])
    assert chains.likelihood(theta)[1] - toxicity.PRIOR * theta == pytest.approx(np.zeros(len(theta)), abs=2 * toxicity.GRADIENT)


def test_toxicity(spark):
    rng = random.Random(2)
    mild = ["lamp", "river", "stone", "green", "walk", "seven"]
    rows = []
    for i in range(300):
        words = [rng.choice(mild) for _ in range(rng.randint(5, 60))]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty"]))
        rows.append((i, " ".join(words), y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = docs.select("doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.train(docs.drop("toxic"), labels)
    known = {r["doc_id"] for r in labels.collect()}
    local = toxicity.fit([(t, y) for i, t, y in rows if i in known])
    assert model.weight == pytest.approx(local.weight, abs=0.05) and model.step[1] == pytest.approx(local.step[1], abs=0.05)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((scored[i]["score"] >= 0.5) == bool(y) for i, _, y in rows if i in held)
    r = scored[0]
    assert {r["text"][s["start"] : s["end"]] for s in r["toxic_spans"]} <= {"vile", "nasty"} and r["toxic_spans"]
    odd = toxicity.score(frame(spark, HARD), model).collect()
    assert len(odd) == len(HARD) and all(0 <= x["score"] < 0.5 for x in odd)
    assert toxicity.train(docs.drop("toxic"), labels.limit(0)).score("vile")[0] == 0.0


def test_hashes_are_of_utf8(spark):
    df = bpe.encode(frame(spark, ["é"]), PATH, decoded="d").select(F.sha2("d", 256)).first()
    lib = Tokenizer.from_file(PATH)
    assert df[0] == hashlib.sha256(lib.decode(lib.encode("é", add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()
