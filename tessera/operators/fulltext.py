"""Ranked full-text search.

Index answers boolean and phrase queries by one condition on one scan, for texts that are searched now and then.
StoredIndex keeps an inverted index (words with documents and places) as Parquet, clustered by word, so that a
query reads the postings of its own words alone; documents are added and removed as they come.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import discard, materialize

#: Stop words, and the longest word that is indexed.
STOP_WORDS = ["a", "the", "at", "on", "of", "to", "an"]
MAX_WORD = 100
WORD = r"[\p{L}\p{Nd}]+"
#: Fixed values of the ranking: weight of nearness against words, and the penalty of words out of order.
NEARNESS_WEIGHT, SWAP_PENALTY = 10.0, 10


def has(lowered: Column, word: str) -> Column:
    """Whether a lower-case text holds a word: a substring test, and a pattern where that hits."""
    return F.contains(lowered, F.lit(word)) & lowered.rlike(rf"(?<![\p{{L}}\p{{Nd}}])\Q{word}\E(?![\p{{L}}\p{{Nd}}])")


def places(lowered: Column, word: str) -> Column:
    """Character offsets of a word in a lower-case text, in order."""
    around = F.split(lowered, rf"(?<![\p{{L}}\p{{Nd}}])\Q{word}\E(?![\p{{L}}\p{{Nd}}])")
    before = F.transform(around, lambda x: F.char_length(x))
    steps = F.when(F.size(around) > 1, F.sequence(F.lit(1), F.size(around) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.aggregate(F.slice(before, 1, k), F.lit(0), lambda s, x: s + x) + (k - 1) * len(word))


def word_list(text: Column) -> Column:
    """The indexed words of a text, without positions."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: (F.char_length(w) <= MAX_WORD) & ~w.isin(STOP_WORDS))


@dataclass
class Term:
    kind: str  # match, phrase, and, or, not
    parts: list = field(default_factory=list)
    word: str = ""
    at: int = 0


def parse(query: str) -> Term | None:
    """AND, OR and NOT in capitals, juxtaposition as AND, parentheses, quotes for phrases.

    An operator binds all that follows it up to the end of its parentheses: `a AND b OR c` is `a AND (b OR c)`.
    So one pass collects operands with the operators before them, level by level, and folds each from the right.
    """
    tokens = [(m[0], m.start()) for m in re.finditer(r'[()"]|[^\W_]+', query)]
    levels: list[list[tuple[str, Term | None]]] = [[]]
    operator, negations, opened, at = "and", 0, [], 0

    def put(term: Term | None) -> None:
        nonlocal operator, negations
        for _ in range(negations):
            term = term and Term("not", [term])
        levels[-1].append((operator, term))
        operator, negations = "and", 0

    def close() -> None:
        nonlocal operator, negations
        inner = _fold(levels.pop())
        operator, negations = opened.pop()
        put(inner)

    while at < len(tokens):
        text, place = tokens[at]
        at += 1
        expected = bool(negations) or not levels[-1]
        if text == "(":
            opened.append((operator, negations))
            operator, negations = "and", 0
            levels.append([])
        elif text == ")":
            if opened:
                close()
            else:  # more closed than opened: what stands before is one operand
                levels[-1] = [("and", _fold(levels[-1]))] if levels[-1] else []
        elif text == "NOT":
            negations += 1
        elif text in ("AND", "OR") and not expected:
            operator = text.lower()
            if at < len(tokens) and tokens[at][0] in ("AND", "OR"):  # an operator where an operand is asked for is a word
                put(Term("match", word=tokens[at][0].lower(), at=tokens[at][1]))
                at += 1
        elif text == '"':
            end = next((i for i in range(at, len(tokens)) if tokens[i][0] == '"'), len(tokens))
            inside = [Term("match", word=w.lower(), at=p) for w, p in tokens[at:end] if w.lower() not in STOP_WORDS and w not in "()"]
            put(None if not inside else inside[0] if len(inside) == 1 else Term("phrase", inside))
            at = end + 1
        else:
            put(None if text.lower() in STOP_WORDS else Term("match", word=text.lower(), at=place))
    while opened:
        close()
    return _fold(levels[0])


def _fold(operands: list[tuple[str, Term | None]]) -> Term | None:
    """Operands from the right, each joined to what follows by the operator before that; those left out take theirs along."""
    out, operator = None, ""
    for before, term in reversed(operands):
        if term is not None:
            out = term if out is None else Term(operator, [term, out])
        operator = before
    return out


#: A word's other forms that count as the same (a stem, say): a function of a lower-case word, from one word to the word that stands for all.
NormalForm = Callable[[str], str]
PYTHON_WORD = re.compile(r"[^\W_]+")


def tokens(low: str) -> list[tuple[str, int]]:
    """The indexed words of a lower-case text and the offsets where they begin."""
    return [(m[0], m.start()) for m in PYTHON_WORD.finditer(low) if len(m[0]) <= MAX_WORD and m[0] not in STOP_WORDS]


class Index:
    """Full-text search over documents.

    A query is one condition on the lower-case text, so it costs one scan and no join or shuffle. The
    inverted index (postings) is built where words are asked for that no query names. With a normal form,
    words of texts and of queries are compared by it.
    """

    def __init__(self, docs: DataFrame, doc: str, text: str, normal_form: NormalForm | None = None):
        low = docs.select(F.col(doc).alias("doc"), F.coalesce(F.lower(text), F.lit("")).alias("low"))
        self.normal_form = normal_form
        self.docs = low if normal_form is None else low.mapInArrow(_normalized(normal_form), T.StructType([*low.schema, *FORMS]))

    @property
    def _words(self) -> Column:
        return word_list(F.col("low")) if self.normal_form is None else F.transform("forms", lambda f: f["word"])

    def _has(self, word: str) -> Column:
        return has(F.col("low"), word) if self.normal_form is None else F.exists("forms", lambda f: f["word"] == self.normal_form(word))

    def _places(self, word: str) -> Column:
        if self.normal_form is None:
            return places(F.col("low"), word)
        return F.transform(F.filter("forms", lambda f: f["word"] == self.normal_form(word)), lambda f: f["at"])

    @property
    def postings(self) -> DataFrame:
        """doc, word, tf."""
        return self.docs.select("doc", F.explode(self._words).alias("word")).groupBy("doc", "word").agg(F.count(F.lit(1)).alias("tf"))

    def keywords(self, prefix: str = "") -> DataFrame:
        """word, occurrences, documents for the words with a prefix."""
        return self.postings.where(F.startswith("word", F.lit(prefix))).groupBy("word").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("documents"))

    def counts(self) -> DataFrame:
        """words and documents: how many there are."""
        words = self.docs.select(F.explode(self._words).alias("word")).agg(F.count_distinct("word").alias("words"))
        return words.crossJoin(self.docs.agg(F.count(F.lit(1)).alias("documents")))

    def condition(self, term: Term | None) -> Column:
        return condition(term, self._has, self._places)

    def match(self, term: Term | None) -> DataFrame:
        """The documents (doc) that a query selects."""
        return self.docs.where(self.condition(term)).select("doc")

    def prefix(self, start: str) -> DataFrame:
        return self.docs.where(F.exists(self._words, lambda w: F.startswith(w, F.lit(start.lower())))).select("doc").distinct()

    def search(self, query: str, limit: int | None = None, nearness: bool = True) -> DataFrame:
        """doc and rank of a query's documents, the best first (see ranked)."""
        term = parse(query)
        asked = _asked(term)
        found = [F.count_if(self._has(w)).alias(f"df{i}") for i, w in enumerate(asked)]
        stats = self.docs.agg(F.count(F.lit(1)).alias("_n"), *found).crossJoin(self.counts().select((F.col("words") / F.col("documents")).alias("_avg")))
        hits = self.docs.where(self.condition(term)).select("doc", F.size(self._words).alias("n_words"), *[self._places(w).alias(f"p{i}") for i, w in enumerate(asked)])
        return ranked(hits.crossJoin(F.broadcast(stats)), term, limit, nearness)


FORMS = [T.StructField("forms", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("at", T.IntegerType())])))]


def _normalized(form: NormalForm) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("word", pa.string()), ("at", pa.int32())]))
        for batch in batches:
            made = [[{"word": form(w), "at": at} for w, at in tokens(low)] for low in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*batch.schema.names, "forms"])

    return run


class StoredIndex:
    """An inverted index in a folder: postings (bucket, word, doc, n_words, places), documents (doc, n_words), removed (doc, batch).

    Postings are dealt by word into BUCKETS folders and sorted by word within files, so that a query reads the
    row groups of its words only. Each add() is a batch of files beside those that are there; remove() writes
    marks that hold for earlier batches; compact() takes them away and clusters anew. A document that is added
    again must be removed first. Readers of a running query keep the files that they have listed.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, normal_form: NormalForm | None = None):
        self.spark, self.path, self.normal_form = spark, path, normal_form

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the index; nothing if no batch has been written."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _schema(self, rest: str) -> str:
        return f"doc {self._kind()}, {rest}, batch long"

    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.path}/documents").schema["doc"].dataType.simpleString()

    def add(self, docs: DataFrame, doc: str, text: str) -> None:
        """Indexes documents: one pass over their texts, one shuffle of their postings by word."""
        given = docs.select(F.col(doc).alias("doc"), F.coalesce(F.lower(text), F.lit("")).alias("low"))
        form, kind = self.normal_form, given.schema["doc"].dataType.simpleString()

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, low in enumerate(batch.column(1).to_pylist()):
                    found: dict[str, list[int]] = {}
                    every = tokens(low)
                    for w, at in every:
                        found.setdefault(form(w) if form else w, []).append(at)
                    one = batch.column(0).slice(i, 1)
                    rows = one.take(pa.array([0] * (len(found) + 1)))
                    # the first row is the document's own
                    yield pa.RecordBatch.from_arrays([rows, pa.array([None, *found], pa.string()), pa.array([len(every)] * len(rows), pa.int32()), pa.array([None, *found.values()], pa.list_(pa.int32()))], ["doc", "word", "n_words", "places"])

        batch = F.lit(self._next()).alias("batch")
        made = materialize(given.mapInArrow(post, f"doc {kind}, word string, n_words int, places array<int>"), "postings")
        made.where("word is null").select("doc", "n_words", batch).write.mode("append").parquet(f"{self.path}/documents")
        postings = made.where("word is not null").select("doc", "word", "n_words", "places", batch, self._bucket(F.col("word")).alias("bucket"))
        postings.repartition(self.BUCKETS, "bucket").sortWithinPartitions("bucket", "word", "doc").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        discard(made)

    def remove(self, ids: DataFrame, doc: str) -> None:
        ids.select(F.col(doc).alias("doc"), F.lit(self._next()).alias("batch")).write.mode("append").parquet(f"{self.path}/removed")

    def compact(self) -> StoredIndex:
        """The same index without removed documents, in a new folder beside this one."""
        other = StoredIndex(self.spark, f"{self.path}-{uuid.uuid4().hex}", self.normal_form)
        self.documents.withColumn("batch", F.lit(0).cast("long")).write.parquet(f"{other.path}/documents")
        live = self.postings().withColumn("batch", F.lit(0).cast("long"))
        live.repartition(self.BUCKETS, "bucket").sortWithinPartitions("bucket", "word", "doc").write.partitionBy("bucket").parquet(f"{other.path}/postings")
        return other

    def _next(self) -> int:
        """Batches are numbered in order: marks hold for documents of lesser numbers."""
        last = [self._read(t, "batch long").agg(F.max("batch")).first()[0] for t in ("documents", "removed")]
        return max([n for n in last if n is not None], default=0) + 1

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.BUCKETS)).cast("int")

    def _live(self, df: DataFrame) -> DataFrame:
        gone = self._read("removed", self._schema("x int")).groupBy(F.col("doc").alias("_d")).agg(F.max("batch").alias("_b"))
        return df.join(gone, (F.col("doc") == F.col("_d")) & (F.col("batch") < F.col("_b")), "left_anti")

    @property
    def documents(self) -> DataFrame:
        """doc, n_words."""
        return self._live(self._read("documents", self._schema("n_words int"))).select("doc", "n_words")

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """doc, word, n_words, places, bucket of some words (in their normal form) or of all."""
        rows = self._read("postings", self._schema("word string, n_words int, places array<int>, bucket int"))
        if words is not None:
            test = F.lit(False)
            for w in words:
                test = test | ((F.col("bucket") == self._bucket(F.lit(w))) & (F.col("word") == w))
            rows = rows.where(test)
        return self._live(rows).select("doc", "word", "n_words", "places", "bucket")

    def keywords(self, prefix: str = "") -> DataFrame:
        """word, occurrences, documents for the words with a prefix."""
        rows = self.postings().where(F.startswith("word", F.lit(prefix)))
        return rows.groupBy("word").agg(F.sum(F.size("places")).cast("long").alias("occurrences"), F.count(F.lit(1)).alias("documents"))

    def _hits(self, query: str) -> tuple[Term | None, list[str], DataFrame]:
        term = parse(query)
        every = list(dict.fromkeys(t.word for t in _words_of(term)))
        form = self.normal_form or (lambda w: w)
        rows = self.postings(sorted({form(w) for w in every}))
        at = {w: f"w{i}" for i, w in enumerate(every)}
        by_doc = rows.groupBy("doc").agg(F.max("n_words").alias("n_words"), *[F.first(F.when(F.col("word") == form(w), F.col("places")), ignorenulls=True).alias(c) for w, c in at.items()])
        by_doc = by_doc.select("doc", "n_words", *[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in at.values()])
        hits = by_doc.where(condition(term, lambda w: F.size(at[w]) > 0, lambda w: F.col(at[w])))
        asked = _asked(term)
        return term, asked, hits.select("doc", "n_words", *[F.col(at[w]).alias(f"p{i}") for i, w in enumerate(asked)])

    def match(self, query: str) -> DataFrame:
        """The documents (doc) that a query selects."""
        return self._hits(query)[2].select("doc")

    def search(self, query: str, limit: int | None = None, nearness: bool = True) -> DataFrame:
        """doc and rank of a query's documents, the best first (see ranked)."""
        term, asked, hits = self._hits(query)
        form = self.normal_form or (lambda w: w)
        found = self.postings([form(w) for w in asked]).agg(*[F.count_if(F.col("word") == form(w)).alias(f"df{i}") for i, w in enumerate(asked)] or [F.lit(0).alias("_none")])
        words = self.postings().agg(F.count_distinct("word").alias("_w"))
        stats = found.crossJoin(words).crossJoin(self.documents.agg(F.count(F.lit(1)).alias("_n"))).withColumn("_avg", F.col("_w") / F.col("_n"))
        return ranked(hits.crossJoin(F.broadcast(stats)), term, limit, nearness)


def condition(term: Term | None, has_word: Callable[[str], Column], places_of: Callable[[str], Column]) -> Column:
    """A query as a condition on what tells of a word whether and where it is there. A query of nothing but NOT selects none."""
    if term is None or term.kind == "not":
        return F.lit(False)
    if term.kind == "match":
        return has_word(term.word)
    if term.kind in ("or", "and"):
        a, b = term.parts
        if term.kind == "or":
            return condition(a, has_word, places_of) | condition(b, has_word, places_of)
        if b.kind == "not":
            return condition(a, has_word, places_of) & ~condition(b.parts[0], has_word, places_of)
        if a.kind == "not":
            return condition(b, has_word, places_of) & ~condition(a.parts[0], has_word, places_of)
        return condition(a, has_word, places_of) & condition(b, has_word, places_of)
    ends, last = places_of(term.parts[0].word), term.parts[0]
    for t in term.parts[1:]:
        ends, last = F.filter(places_of(t.word), _follows(ends, t.at - last.at)), t
    every = has_word(term.parts[0].word)
    for t in term.parts[1:]:
        every = every & has_word(t.word)
    return F.when(every, F.size(ends) > 0).otherwise(False)


def ranked(hits: DataFrame, term: Term | None, limit: int | None, nearness: bool) -> DataFrame:
    """doc and rank of hits (doc, n_words, p0.. places of the words asked for, df0.. their documents, _n documents, _avg words a document).

    A word's rank is ln(1 + density * idf) with density tf * ln(1 + 2 * average / n_words); AND adds the
    parts, OR takes the larger. Nearness raises the rank by up to NEARNESS_WEIGHT times itself.
    """
    asked, scores = _asked(term), {}
    for i, w in enumerate(asked):
        tf = F.size(f"p{i}")
        scores[w] = F.when(tf > 0, F.log1p(tf * F.log1p(2 * F.col("_avg") / F.col("n_words")) * F.ln(F.col("_n") / F.greatest(F.col(f"df{i}"), F.lit(1))))).otherwise(0.0)
    rank = _score(term, scores) if asked else F.lit(0.0)
    words = [t.word for t in _matches(term)]
    if nearness and len(words) > 1:
        rank = rank * (1 + NEARNESS_WEIGHT * near([F.col(f"p{asked.index(w)}") for w in words], [len(w) for w in words]))
    out = hits.select("doc", rank.alias("rank")).orderBy(F.desc("rank"), "doc")
    return out if limit is None else out.limit(limit)


def _follows(ends: Column, offset: int):
    return lambda q: F.exists(ends, lambda p: (q - p).between(offset, offset + 1))


def _matches(t: Term | None) -> list[Term]:
    if t is None or t.kind == "not":
        return []
    return [t] if t.kind == "match" else [m for p in t.parts for m in _matches(p)]


def _words_of(t: Term | None) -> list[Term]:
    """All words of a query, those under NOT too."""
    if t is None:
        return []
    return [t] if t.kind == "match" else [m for p in t.parts for m in _words_of(p)]


def _asked(t: Term | None) -> list[str]:
    return list(dict.fromkeys(m.word for m in _matches(t)))


def _score(t: Term, scores: dict[str, Column]) -> Column:
    if t.kind == "match":
        return scores[t.word]
    parts = [_score(p, scores) for p in t.parts if p.kind != "not"]
    if t.kind == "or" and len(parts) > 1:
        return F.greatest(*parts)
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def near(found: list[Column], lengths: list[int]) -> Column:
    """The nearness of a query's words in a text: the largest, over all places, of a sum over neighbouring words.

    From a place on, each word counts where it stands next; words that don't follow any more are passed over. A
    neighbour adds 1 / sqrt of the gap between the two, gaps up to 2 counting as 1, and as SWAP_PENALTY times as
    long where the query's later word comes first. 0 if any word is missing. All places are walked once, from the
    last back to the first, so that what comes next is known at each.
    """
    n = len(found)

    def named(i: int) -> Callable[[Column], Column]:
        return lambda at: F.struct(at.cast("int").alias("at"), F.lit(i).alias("w"))

    every = F.array_sort(F.concat(*[F.transform(p, named(i)) for i, p in enumerate(found)]))
    start = F.struct(F.array(*[F.lit(None).cast("int")] * n).alias("next"), F.lit(0.0).alias("best"))

    def gap(first: Column, last: Column) -> Column:
        step = F.when(last["at"] < first["at"], (first["at"] - last["at"] - last["n"]) * SWAP_PENALTY).otherwise(last["at"] - first["at"] - first["n"])
        return 1 / F.sqrt(F.when(step <= 2, 1).otherwise(step))

    def walk(state: Column, event: Column) -> Column:
        following = F.transform(state["next"], lambda x, i: F.when(i == event["w"], event["at"]).otherwise(x))
        there = F.filter(F.zip_with(following, F.array(*map(F.lit, lengths)), lambda at, k: F.struct(at.alias("at"), k.alias("n"))), lambda x: x["at"].isNotNull())
        steps = F.zip_with(F.slice(there, 1, F.greatest(F.size(there) - 1, F.lit(0))), F.slice(there, 2, F.greatest(F.size(there) - 1, F.lit(0))), gap)
        total = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
        return F.struct(following.alias("next"), F.greatest(state["best"], total).alias("best"))

    missing = F.lit(False)
    for p in found:
        missing = missing | (F.size(p) == 0)
    return F.when(missing, 0.0).otherwise(F.aggregate(F.reverse(every), start, walk, lambda s: s["best"]))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of both results, their ranks added."""
    return a.join(b.withColumnRenamed("rank", "_r"), "doc").select("doc", (F.col("rank") + F.col("_r")).alias("rank")).orderBy(F.desc("rank"), "doc")


def optimized(term: Term | None, documents: dict[str, int]) -> Term | None:
    """The same query with the operands of each AND in order of how few documents they can select (by documents: word -> number), as a reader of postings wants them."""

    def most(t: Term) -> float:
        if t.kind == "match":
            return documents.get(t.word, 0)
        parts = [most(p) for p in t.parts]
        return {"and": min, "phrase": min, "or": sum, "not": lambda _: float("inf")}[t.kind](parts)

    if term is None or term.kind in ("match", "phrase"):
        return term
    parts = [optimized(p, documents) for p in term.parts]
    return Term(term.kind, sorted(parts, key=most) if term.kind == "and" else parts)
