"""Secret scans: fixed patterns, and a battery of randomness tests for what no pattern names.

Candidates are runs of at least 20 characters of the base-64 alphabets, or pieces of them (candidate_runs). The encoding is the smallest of the known alphabets that holds
the run. Chi-squared uniformity over that alphabet gives a p-value under "this is ordinary text": prose is not uniform, so its statistic
is noncentral chi-squared with a noncentrality in proportion to the length; a small value speaks for randomness, and the more the longer
the run. A runs test about the alphabet's middle and a lag-one serial correlation test veto runs whose order is not random. Discoveries
are those that Benjamini-Hochberg accepts within the run's length band, over the p-values of all documents. p-values are counted in bins
of a tenth of a decade, rounded up, so what the driver gets is bounded by bands times bins.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import col, cut, fresh, narrow

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX, RUN = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}"), re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
WHOLE, BETWEEN_SLASHES, BETWEEN_MARKS = re.compile(r"[^=]+={0,2}"), re.compile(r"[^/=]+={0,2}"), re.compile(r"[A-Za-z0-9]+={0,2}")
#: Alphabets by size, and what a character of ordinary text adds to the noncentrality in each: size times the chance that two characters agree, less one.
ALPHABETS = [
    ("0123456789abcdef", 0.6),
    ("0123456789ABCDEF", 0.6),
    ("abcdefghijklmnopqrstuvwxyz", 0.72),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.0),
    ("0123456789abcdefghijklmnopqrstuvwxyz", 1.3),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.3),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 2.8),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.9),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 2.9),
]
PLACES = [({c: i for i, c in enumerate(a)}, extra) for a, extra in ALPHABETS]
BANDS, BINS, VETO = (20, 24, 32, 40, 48, 64, 96, 128), 400, 1e-4


def _normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi_squared_below(x: float, degrees: float, noncentral: float) -> float:
    """P(noncentral chi-squared <= x), by Patnaik's two moments and Wilson and Hilferty's cube root."""
    scale = (degrees + 2 * noncentral) / (degrees + noncentral)
    free = (degrees + noncentral) ** 2 / (degrees + 2 * noncentral)
    ratio = max(x, 1e-9) / scale / free
    return _normal_below((ratio ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))


def text_p_value(run: str) -> float:
    """Probability that ordinary text of this length looks as uniform; 1 where the order of the characters is not random or no alphabet holds it."""
    run = run.rstrip("=")
    for places, extra in PLACES:
        if all(c in places for c in run):
            break
    else:
        return 1.0
    n, k = len(run), len(places)
    statistic = sum(c * c for c in Counter(run).values()) * k / n - n
    at = [places[c] for c in run]
    high = [2 * i >= k for i in at]
    ups, downs = sum(high), n - sum(high)
    if not ups or not downs:
        return 1.0
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 1 + 2 * ups * downs / n
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    middle = sum(at) / n
    around = sum((i - middle) ** 2 for i in at)
    serial = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:], strict=False)) / around if around else 1.0
    for z in ((runs - mean) / spread, (serial + 1 / n) * math.sqrt(n)):
        if 2 * _normal_below(-abs(z)) < VETO:
            return 1.0
    return chi_squared_below(statistic, k - 1, n * extra)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns match, by start, then kind."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _left(start: int, end: int, taken: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """The parts of start to end outside the disjoint, ascending spans taken, of which those before number `at` end before start; the next such number."""
    while at < len(taken) and taken[at][1] <= start:
        at += 1
    parts, k = [], at
    while k < len(taken) and taken[k][0] < end:
        parts.append((start, taken[k][0]))
        start, k = taken[k][1], k + 1
    return [*parts, (start, end)], at


def candidate_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, length band, bin of the p-value) of the runs that the base spans leave; both lists are walked once.

    A run may be one secret, or a path or name that holds some: it is read whole, as the pieces between slashes, and as those between all
    separators. The reading with the least p-value counts; its p-values are multiplied by the number of readings (Bonferroni).
    """
    taken: list[tuple[int, int]] = []
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out, at = [], 0
    for m in RUN.finditer(text):
        parts, at = _left(*m.span(), taken, at)
        for a, b in parts:
            readings = []
            for split in (WHOLE, BETWEEN_SLASHES, BETWEEN_MARKS):
                found = [x.span() for x in split.finditer(text, a, b) if x.end() - x.start() >= BANDS[0]]
                if found and found not in readings:
                    readings.append(found)
            tested = [[(text_p_value(text[x:y]) * len(readings), x, y) for x, y in spans] for spans in readings]
            for p, x, y in min(tested, key=lambda spans: min(spans)[0], default=[]):
                band = sum(y - x >= low for low in BANDS) - 1
                out.append((x, y, band, min(BINS, max(0, math.floor(-10 * math.log10(min(1.0, max(p, 1e-300))))))))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def accepted_bins(counts: list[tuple[int, int, int]], rate: float) -> list[int]:
    """For each band the least bin that Benjamini-Hochberg accepts (BINS + 1: none); counts: (band, bin, candidates)."""
    out = []
    for band in range(len(BANDS)):
        bins = Counter({b: n for at, b, n in counts if at == band})
        total, above, least = sum(bins.values()), 0, BINS + 1
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if 10 ** (-b / 10) <= rate * above / total:
                least = b
        out.append(least)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.001) -> DataFrame:
    """One row for every row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (array of (start, kind, end)) and text_hash.

    Places are code points, ends exclusive. Null and empty texts have no spans (spans is ""). Repeated rows give repeated rows and weigh
    as often in the false-discovery rate; an empty table gives no rows. `rate`: false discoveries that the added kind may hold.
    """

    def scanned(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                line = joined(base)
                kinds = Counter(k for _, k, _ in base)
                out.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(line.encode()).hexdigest(), [{"start": a, "kind": k, "end": b} for a, k, b in base], [{"start": a, "end": b, "band": x, "bin": p} for a, b, x, p in candidate_runs(text or "", base)]))
            columns = [*zip(*out, strict=True)] or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([(f, pa.int32()) for f in ("start", "kind", "end")])), pa.list_(pa.struct([(f, pa.int32()) for f in ("start", "end", "band", "bin")]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"])

    rows = narrow(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    first = cut(rows.mapInArrow(scanned, f"doc_id {kind}, text_hash long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, runs array<struct<start:int,end:int,band:int,bin:int>>"), "scanned")
    counts = first.select(F.explode("runs").alias("r")).groupBy("r.band", "r.bin").count().collect()  # at most len(BANDS) * (BINS + 1) rows
    least = F.array(*(F.lit(b) for b in accepted_bins([tuple(r) for r in counts], rate)))
    added = F.transform(F.filter("runs", lambda r: r["bin"] >= F.get(least, r["band"])), lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return first.withColumn("found", F.sort_array(F.concat("base", added))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), "found", "text_hash")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with the found spans of each document replaced by mark (overlapping ones by one mark); other columns and rows as they are.

    Spans are matched by id, null like any other, and a hash of the text, so rows that share an id share their spans only if their texts
    are the same. Null and empty texts stay as they are; repeated rows are all masked. Columns of docs may have any names.
    """

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, places in zip(texts, spans, strict=True):
            if text is None or places is None:
                out.append(text)
                continue
            parts, at = [], 0
            for a, b in sorted((s["start"], s["end"]) for s in places):
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    place, spans = fresh(docs, "place"), fresh(docs, "spans")
    held = found.where(F.size("found") > 0).select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("other"), F.col("found").alias(spans)).dropDuplicates(["other"])
    marked = docs.withColumn(place, F.struct(col(docs, id_col).alias("id"), F.xxhash64(col(docs, text_col)).alias("hash")))
    both = marked.join(held.withColumnRenamed("other", fresh(marked, "other")).hint("merge"), F.col(place) == F.col(fresh(marked, "other")), "left")
    changed = F.coalesce(masked(F.when(F.col(spans).isNotNull(), col(both, text_col)), F.col(spans)), col(both, text_col))
    return both.select(*((changed if c == text_col else col(both, c)).alias(c) for c in docs.columns))
