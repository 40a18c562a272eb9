"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Every run of 20 or more key characters gets an encoding by its alphabet (hex, base32, base64, ...).
Under that alphabet three tests ask if its symbols could be independent and uniform: chi-squared on the
symbol counts, Wald-Wolfowitz runs about the middle of the alphabet, and serial correlation at lag 1; the
smallest of the three p-values, times three, is p_random. A fourth p-value, p_text, asks how likely so few
coinciding symbol pairs (the chi-squared statistic's lower tail) are in text, whose letters repeat far more
often; it falls with the length, so that short runs can't pass by chance. Runs with p_random of at least
MIN_RANDOM are secrets if p_text passes the Benjamini-Hochberg procedure at level FDR, within their
encoding and power-of-two length class, over the runs of all documents. p_text is rounded up to a grid of
1/20 decades, so the procedure needs counts by grid step only.

Rows: a null or empty text has no spans. Rows are scanned one by one, repeated rows alike (each counts in
the procedure). Empty tables give empty results. Texts are scanned whole. Input columns named as results
are replaced; others pass through. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import from_text, materialize

#: The plain patterns; re.A keeps letters beyond ASCII from matching ASCII ones in either case.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12
KINDS = ("assign", "access", "hex", "random")
#: Runs that the battery tests, and its encodings: pattern, alphabet, and the chance that two symbols of text coincide.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}=*")
ENCODINGS = [
    ("decimal", re.compile(r"[0-9]+"), "0123456789", 0.16),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef", 0.18),
    ("lower", re.compile(r"[a-z]+|[A-Z]+"), "abcdefghijklmnopqrstuvwxyz", 0.066),
    ("base32", re.compile(r"[A-Z2-7]+|[a-z2-7]+"), "abcdefghijklmnopqrstuvwxyz234567", 0.066),
    ("base36", re.compile(r"[A-Z0-9]+|[a-z0-9]+"), "0123456789abcdefghijklmnopqrstuvwxyz", 0.066),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.062),
]
MIN_RANDOM, FDR, STEPS = 0.001, 0.01, 20


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_upper(x: float, df: int) -> float:
    """By Wilson and Hilferty's cube-root approximation."""
    z = ((max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _poisson_lower(k: int, mean: float) -> float:
    """P(X <= k): summed where small, else normal with continuity correction."""
    if mean > 400:
        return 0.5 * math.erfc((mean - k - 0.5) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return min(1.0, total)


def battery(run: str) -> tuple[str, float, float]:
    """A run's encoding, p_random and p_text."""
    body = run.rstrip("=")
    name, _, alphabet, coincide = next(e for e in ENCODINGS if e[1].fullmatch(body))
    body = body.replace("-", "+").replace("_", "/") if name == "base64" else body.lower()
    x = np.array([alphabet.index(c) for c in body], float)
    n, k = len(x), len(alphabet)
    counts = np.bincount(x.astype(int), minlength=k)
    chi = _chi_squared_upper(float((counts**2).sum()) * k / n - n, k - 1)
    high = x >= k / 2
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        run_p = _normal_two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        run_p = 2.0 ** (1 - n)
    d = x - (k - 1) / 2
    serial = _normal_two_sided(float((d[1:] * d[:-1]).sum()) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    pairs = int((counts * (counts - 1) // 2).sum())
    return name, min(1.0, 3 * min(chi, run_p, serial)), _poisson_lower(pairs, coincide * n * (n - 1) / 2)


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int, bool]]]:
    """The plain spans of a text, and the runs tested: (start, end, class, grid step of p_text, free of plain spans)."""
    plain = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    plain += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    plain += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    plain.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    tested, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        while at < len(plain) and plain[at][0] < m.end():  # both stand in order: one walk
            reach, at = max(reach, plain[at][1]), at + 1
        name, p_random, p_text = battery(m[0])
        if p_random >= MIN_RANDOM:
            step = math.floor(-math.log10(max(p_text, 1e-300)) * STEPS)
        else:
            step = -1  # counted as a run that can't be a discovery
        tested.append((m.start(), m.end(), f"{name}{len(m[0]).bit_length()}", step, reach <= m.start()))
    return plain, tested


PLACE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
FOUND = T.StructType([T.StructField("plain", T.ArrayType(PLACE)), T.StructField("tested", T.ArrayType(T.StructType([*PLACE, T.StructField("step", T.IntegerType()), T.StructField("free", T.BooleanType())])))])


def candidates(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all) of df, with plain (spans) and tested (runs with class and grid step)."""

    def compute(t: str) -> tuple:
        plain, tested = find(t)
        return [{"start": s, "end": e, "kind": k} for s, e, k in plain], [{"start": s, "end": e, "kind": k, "step": x, "free": free} for s, e, k, x, free in tested]

    return from_text(df, text, df.columns if keep is None else keep, compute, FOUND)


def thresholds(found: DataFrame) -> DataFrame:
    """One row per class of runs with a discovery: the least grid step (largest p_text) that passes."""
    counts = found.select(F.explode("tested").alias("t")).groupBy(F.col("t.kind").alias("_class"), F.col("t.step").alias("step")).count()
    by_class = W.partitionBy("_class")
    up_to = by_class.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("m", F.sum("count").over(by_class)).withColumn("r", F.sum("count").over(up_to))
    p = F.pow(F.lit(10.0), -F.col("step") / F.lit(float(STEPS)))
    return ranked.where((F.col("step") >= 0) & (p <= FDR * F.col("r") / F.col("m"))).groupBy("_class").agg(F.min("step").alias("_least"))


def discoveries(found: DataFrame) -> DataFrame:
    """Replaces tested by spans: the plain ones and the runs found random that overlap none of them, by start, then kind."""
    limits = thresholds(found)
    # classes are encoding times bit length of the run: some 200 rows at the very most
    limit = limits.agg(F.map_from_entries(F.collect_list(F.struct("_class", "_least"))).alias("_limit"))
    out = found.crossJoin(F.broadcast(limit))
    added = F.filter("tested", lambda t: t["free"] & (t["step"] >= F.try_element_at("_limit", t["kind"])))
    added = F.transform(added, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind")))
    order = {k: i for i, k in enumerate(KINDS)}
    place = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(F.concat("plain", added), lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.sort_array(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return out.withColumn("spans", spans).drop("tested", "_limit")


def cut(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span (sorted by start) gives way to its kind in brackets; overlapping spans become one, named by the first."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind} secret]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact_all(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every secret in column text cut out: one pass for the counts of the procedure, one that finds again and cuts.

    The limits between them are classes with a discovery, some 200 rows at the very most.
    """
    limits = {r["_class"]: r["_least"] for r in thresholds(materialize(candidates(df, text, keep=[]), "secrets")).collect()}

    def compute(t: str) -> tuple:
        plain, tested = find(t)
        added = [(s, e, "random") for s, e, c, x, free in tested if free and x >= limits.get(c, math.inf)]
        return (cut(t, sorted(plain + added)),)

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"))
    made = from_text(rows, "text", ["row"], compute, T.StructType([T.StructField("cut", T.StringType())]))
    kept = F.col(f"row.`{text}`")
    return made.select(*[F.when(kept.isNotNull(), F.col("cut")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
