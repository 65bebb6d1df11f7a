"""Per-document text statistics and whether a text is natural prose.

Each text is read whole and once for its statistics. Every statistic is then
ranked within its language: equal values are counted in the batches and map-side, the distinct
ones are range-partitioned and sorted, and partition offsets give each value, unrounded, its
exact rank among all documents, so a language or value that a third of all documents share stays
distributed. From the ranks come both empirical tail
probabilities of each statistic. The outlier score of a document is the weighted sum of
their logarithms; above the cut it is no prose. Weights are never negative. They are fitted on a
bounded sample of labelled documents, drawn towards equal weights, which are those without
labels; ranks, tails and scores cover all documents.

Defined results: NULL and blank texts have zero words and are no prose; NULL
languages are one group 'und'; a NULL id is -1; texts of any length are read whole; repeated
rows get equal scores; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import running_total, small_rows, spread, stage

#: At most so many labelled documents take part in fitting the weights.
LABEL_SAMPLE = 20_000
#: Common words of all languages, at most.
MAX_COMMON = 1_000_000
#: Ranks of distinct values that may be sent to every worker, some 32 MB; where there are more,
#: ranks are joined instead.
RANK_LIMIT = 1_000_000

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SYMBOL, _DIGIT = re.compile(r"[\W_]"), re.compile(r"\d")
_ODD = re.compile("[^\x00-\u024f–—‘’“”„…•]")
_STOP, _FULL_STOP, _END = re.compile(r"[.!?…](?:\s|$|[\"”»)])"), re.compile(r"[.!?…](?:\s|$)"), re.compile(r"[.!?]+(?:\s|$)")
_COLUMN, _COLUMN_OR_PAIR = re.compile(r"\t|\||\S {2,}\S"), re.compile(r"\t|\||\S {2,}\S|\S=\S")
_MARK = re.compile(r"^\s*(?:[-*+•‣◦–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s")
_COLS = re.compile(r"\t|\s{2,}|\||,(?=\S)|=")
_CODE = re.compile(r"\w*(?:\d\w*[^\W\d]|[^\W\d]\w*\d|__|/|\\|=|[a-z][A-Z])\S*|\d[\d.,:%]*%?$")

STATISTICS = (
    "word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words",
    "words_per_line", "listed_lines", "plain_tokens", "column_breaks", "distinct_words", "repeated_pairs",
    "common_pairs", "running_share", "capital_starts", "strange_letters", "longest_token", "sentence_length", "letter_share",
    "longest_gap", "short_lines", "comma_ends", "known_pairs", "sentence_words",
    "known_words", "top_word", "running_words", "sentence_marks", "line_spread", "lower_starts", "median_line", "known_floor",
)


def language(c: str = "lang"):
    """A language code: lower case, without region; '' and NULL are 'und'."""
    x = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), r"^([a-z]+)", 1)
    return F.when(x == "", "und").otherwise(x)


#: A pair of neighbouring words is known if it is in so large a share of a language's documents, and in three at least.
KNOWN_SHARE, KNOWN_LEAST = 0.001, 3
#: Most known pairs that may be sent to the workers. By their definition there are at most
#: 1 / KNOWN_SHARE times as many per language as an average document has pairs.
KNOWN_LIMIT = 5_000_000


#: Distinct pairs that a worker holds before it passes their counts on, some 20 MB.
HELD_PAIRS = 100_000


def known_pairs(docs: DataFrame) -> dict[str, frozenset[str]]:
    """The known pairs of each language: documents are counted in the batches first, then map-side, then by pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda c: pd.DataFrame([(*k, n) for k, n in c.items()], columns=["lang", "pair", "n"])
        c: Counter = Counter()
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                ws = list(map(str.lower, _WORD.findall(text))) if isinstance(text, str) else []
                c.update({(lang, f"{x} {y}") for x, y in zip(ws, ws[1:])})
                if len(c) > HELD_PAIRS:
                    yield frame(c)
                    c = Counter()
        yield frame(c)

    base = spread(docs.select(language().alias("lang"), "text")).mapInPandas(run, "lang string, pair string, n bigint")
    sizes = docs.groupBy(language().alias("lang")).agg(F.count(F.lit(1)).alias("n_docs"))  # one row per language
    counts = base.groupBy("lang", "pair").agg(F.sum("n").alias("n"))
    least = F.greatest(F.lit(KNOWN_LEAST), F.ceil(F.col("n_docs") * KNOWN_SHARE))
    known = counts.join(sizes, "lang").where(F.col("n") >= least).select("lang", "pair").limit(KNOWN_LIMIT + 1)
    out: dict[str, set[str]] = {}
    n = 0
    for r in known.toLocalIterator():
        out.setdefault(r["lang"], set()).add(r["pair"])
        n += 1
    if n > KNOWN_LIMIT:
        raise ValueError(f"more than {KNOWN_LIMIT} known pairs: raise KNOWN_SHARE")
    return {k: frozenset(v) for k, v in out.items()}


@lru_cache(maxsize=64)
def _vocabulary(known: frozenset[str]) -> frozenset[str]:
    """The words of the known pairs."""
    return frozenset(w for pair in known for w in pair.split(" "))


@lru_cache(maxsize=200_000)
def _plain(token: str) -> bool:
    """Whether a token is a word of letters only, apart from punctuation around it; tokens repeat, so results are kept."""
    return not _CODE.match(token.strip(".,;:!?()\"'")) and bool(_WORD.fullmatch(token.strip(".,;:!?()[]\"'“”«»¿¡")))


@lru_cache(maxsize=50_000)
def _character(c: str) -> tuple[bool, bool, bool]:
    """Whether a character is a symbol, a digit, an odd one."""
    return bool(_SYMBOL.match(c)), bool(_DIGIT.match(c)), bool(_ODD.match(c))


def codes(values: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct ones of its column, from 0: the same order, and no two values are one."""
    return np.stack([np.unique(c, return_inverse=True)[1] for c in values.T], axis=1).astype(np.int32)


def statistics(text: str, lists: dict[str, frozenset[str]], lang: str, known: frozenset[str] = frozenset()) -> list[float]:
    """The values of STATISTICS. The share of common words is that of the best language where the own has no list."""
    tokens = text.split()
    nt = len(tokens)
    if not nt:
        return [0.0] * len(STATISTICS)
    solid = "".join(tokens)
    # one pass over the lines; blank ones part paragraphs
    words: list[str] = []
    lines: list[tuple[str, list[str], int, bool]] = []  # text, words, tokens, column-like or listed
    paragraphs: list[list[int]] = [[]]
    for x in text.splitlines():
        if not x.strip():
            paragraphs.append([])
            continue
        ws = [w.lower() for w in _WORD.findall(x)]
        words += ws
        paragraphs[-1].append(len(lines))
        lines.append((x, ws, len(x.split()), bool(_MARK.match(x))))
    nw, nl, nc = len(words), max(1, len(lines)), max(1, len(solid))
    seen = Counter(words)
    own = lists[lang] if lang in lists else max(lists.values(), key=lambda v: sum(n for w, n in seen.items() if w in v), default=frozenset())
    common = [w in own for w in words]
    pairs = Counter(zip(words, words[1:]))
    run = flowing = breaks = punctuated = commas = upper = lower = marked = short = 0
    per_line = []
    for x, ws, n, listed in lines:
        per_line.append(n)
        breaks += len(_COLS.findall(x.strip()))
        first, end = x.lstrip()[0], x.rstrip()[-1]
        punctuated += end in ".!?…:\"”»"
        commas += end in ",;"
        upper += first.isupper()
        lower += first.islower()
        marked += listed
        short += n <= 12
        if not listed:
            if end not in ",;:" and (end in ".!?…" or len(ws) > 12) and len(ws) >= 0.7 * n:
                flowing += len(ws)
            if n >= 4 and len(ws) >= 0.75 * n and not _COLUMN.search(x):
                run += len(ws)
    vocabulary = _vocabulary(known)
    running = 0
    floor: list[float] = []
    for par in paragraphs:
        rest = [lines[k] for k in par if not lines[k][3] and not _COLUMN_OR_PAIR.search(lines[k][0])]
        ws = [w for _, own_words, _, _ in rest for w in own_words]
        if len(ws) < 4:
            continue
        near = sum(f"{a} {b}" in known for a, b in zip(ws, ws[1:])) / (len(ws) - 1)
        floor.append(near)
        marks = sum(len(_STOP.findall(x)) for x, *_ in rest)
        lone = len(par) == 1 or len(ws) / len(rest) > 12
        if near >= 0.5 and len(set(ws)) > 0.25 * min(len(ws), 60) and (marks * 45 >= len(ws) or lone):
            running += len(ws)
    sentences = sum(1 for x in _END.split(text) if x.strip())
    gap = most = 0
    for c in common:
        gap = 0 if c else gap + 1
        most = max(most, gap)
    mean_line = nt / nl
    # by kind of character, from the counts of the distinct ones
    symbols = digits = letters = odd = 0
    for c, n in Counter(solid).items():
        symbol, digit, strange = _character(c)
        symbols += n * symbol
        digits += n * digit
        letters += n * (not symbol and not digit)
        odd += n * strange
    if not text.isascii():
        odd += sum(text.count(x) for x in ("Ã", "â€", "�", "Â"))
    return [
        float(nw),
        sum(map(len, words)) / max(1, nw),
        symbols / nc,
        digits / nc,
        punctuated / nl,
        sum(common) / max(1, nw),
        mean_line,
        marked / nl,
        sum(map(_plain, tokens)) / nt,
        breaks / nt,
        len(seen) / math.sqrt(nw) if nw else 0.0,
        1 - len(pairs) / max(1, nw - 1) if nw > 1 else 0.0,
        sum(a and b for a, b in zip(common, common[1:])) / max(1, nw - 1),
        run / max(1, nw),
        upper / nl,
        odd / nc,
        float(max(map(len, tokens))),
        nt / max(1, sentences),
        letters / nc,
        most / max(1, nw),
        short / nl,
        commas / nl,
        sum(n for (a, b), n in pairs.items() if f"{a} {b}" in known) / max(1, nw - 1),
        flowing / max(1, nw),
        sum(n for w, n in seen.items() if w in vocabulary) / max(1, nw),
        max(seen.values(), default=0) / max(1, nw),
        running / nt,
        len(_FULL_STOP.findall(text)) / nt,
        math.sqrt(sum((n - mean_line) ** 2 for n in per_line) / nl) / mean_line,
        lower / nl,
        float(sorted(per_line)[len(per_line) // 2]) if per_line else 0.0,
        min(floor, default=0.0),
    ]


def measure(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, lang and one column per statistic; one row per row."""
    rows = small_rows(common_words.select("lang", "word").where("lang is not null and word is not null"), MAX_COMMON, "common words")
    lists: dict[str, set[str]] = {}
    for r in rows:
        lists.setdefault(r["lang"], set()).add(r["word"].lower())
    shared = docs.sparkSession.sparkContext.broadcast(({k: frozenset(v) for k, v in lists.items()}, known_pairs(docs)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            common, known = shared.value
            got = [statistics(t if isinstance(t, str) else "", common, g, known.get(g, frozenset())) for t, g in zip(b["text"], b["lang"])]
            v = np.array(got, dtype=float).reshape(len(b), len(STATISTICS))
            yield pd.concat([b[["doc_id", "lang"]].reset_index(drop=True), pd.DataFrame(v, columns=list(STATISTICS))], axis=1)

    return spread(docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), language().alias("lang"), "text")).mapInPandas(
        run, "doc_id bigint, lang string, " + ", ".join(f"{s} double" for s in STATISTICS)
    )


def _stacked(c: pd.Series) -> np.ndarray:
    return np.stack(c.to_list()) if len(c) else np.zeros((0, len(STATISTICS)))


def counts(measured: DataFrame) -> DataFrame:
    """stat, lang, code, n: how often each value in the array ``codes`` occurs in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _stacked(b["codes"])
            for lang, rows in b.reset_index(drop=True).groupby("lang").indices.items():
                own, place = v[rows], codes(v[rows])
                parts = []
                for k in range(own.shape[1]):
                    n = np.bincount(place[:, k])
                    code = np.empty(len(n))
                    code[place[:, k]] = own[:, k]
                    parts.append(pd.DataFrame({"stat": k, "lang": lang, "code": code, "n": n}))
                yield pd.concat(parts)

    return measured.select("lang", "codes").mapInPandas(run, "stat int, lang string, code double, n bigint")


def ranks(measured: DataFrame) -> DataFrame:
    """stat, lang, code, low, high: minus the logarithms of P(X <= x) and P(X >= x) within the language, for every distinct value."""
    distinct = counts(measured).groupBy("stat", "lang", "code").agg(F.sum("n").alias("n"))
    ranked = running_total(distinct, ["stat", "lang"], ["code"], "n", "below")
    total = measured.groupBy("lang").agg(F.count(F.lit(1)).alias("all_n"))  # one row per language
    return ranked.join(total, "lang").select(
        "stat",
        "lang",
        "code",
        (-F.log((F.col("below") + F.col("n")) / F.col("all_n"))).alias("low"),
        (-F.log(1 - F.col("below") / F.col("all_n"))).alias("high"),
    )


def tails(measured: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds the arrays low and high by a join with the ranks, for as many ranks as there may be.

    Rows get a number of their own before they are staged, so a repeated doc_id stays two rows.
    """
    numbered = stage(measured.drop("_row", "_r").withColumn("_row", F.monotonically_increasing_id()))
    long = numbered.select("_row", "lang", F.posexplode("codes").alias("stat", "code"))
    of_row = (
        long.join(ranked, ["stat", "lang", "code"])
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("stat", "low", "high"))).alias("t"))
        .select(F.col("_row").alias("_r"), F.transform("t", lambda x: x["low"]).alias("low"), F.transform("t", lambda x: x["high"]).alias("high"))
    )
    return numbered.join(of_row, numbered["_row"] == of_row["_r"]).drop("_row", "_r")


class Table:
    """The ranks of all distinct values, for looking up the tails of many documents at once."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.parts: dict[str, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for (lang, stat), g in rows.sort_values("code").groupby(["lang", "stat"], sort=False, observed=True):
            self.parts.setdefault(lang, {})[int(stat)] = g["code"].to_numpy(), g["low"].to_numpy(), g["high"].to_numpy()

    def tails(self, langs: pd.Series, code: np.ndarray) -> np.ndarray:
        """One row per document: the low tails of all statistics, then the high ones."""
        n = code.shape[1]
        out = np.zeros((len(langs), 2 * n))
        for lang, rows in langs.groupby(langs, sort=False).indices.items():
            for k, (known, low, high) in self.parts[lang].items():
                i = np.searchsorted(known, code[rows, k])
                out[rows, k], out[rows, n + k] = low[i], high[i]
        return out


class Weights:
    """Non-negative weights of the tails and a cut, by ridge-penalised logistic regression.

    Without labels every tail weighs START, and the cut is where the mean of all tails, which is 1 if
    they were uniform, exceeds USUAL; labels pull away from there. Accelerated projected gradient steps, no sampling.
    """

    START, USUAL, RIDGE = 0.05, 1.25, 2.0

    def __init__(self, n: int) -> None:
        self.w = np.full(n, self.START)
        self.bias = -self.START * self.USUAL * n

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 3000) -> Weights:
        """y is 1 for what is no prose."""
        if not len(y):
            return self
        scale = np.append(np.maximum(x.std(axis=0), 1e-6), 1.0)
        a = np.column_stack([x, np.ones(len(x))]) / scale
        start = np.append(self.w, self.bias) * scale
        ridge = np.append(np.full(x.shape[1], self.RIDGE), 1e-2)
        size = 0.25 * np.linalg.norm(a, 2) ** 2 + self.RIDGE
        w = z = start
        t = 1.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ z, -500, 500)))
            step = z - (a.T @ (p - y) + ridge * (z - start)) / size
            step[:-1] = np.maximum(step[:-1], 0)
            u = (1 + np.sqrt(1 + 4 * t * t)) / 2
            done = np.abs(step - w).max() < 1e-7
            z, w, t = step + (t - 1) / u * (step - w), step, u
            if done:
                break
        w = w / scale
        self.w, self.bias = w[:-1], float(w[-1])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.bias


def judge(docs: DataFrame, common_words: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, the statistics, outlier (the score, above 0 for what is no prose) and is_prose.

    labels: doc_id, is_prose; a document's majority counts, ties don't.
    """
    spark = docs.sparkSession
    measured = stage(measure(docs, common_words)).withColumn("codes", F.array(*STATISTICS))
    ranked = stage(ranks(measured))
    n = len(STATISTICS)
    few = ranked.limit(RANK_LIMIT + 1).count() <= RANK_LIMIT
    table = spark.sparkContext.broadcast(Table(ranked.toArrow().to_pandas(categories=["lang"])) if few else None)
    rows = measured if few else tails(measured, ranked)
    inputs = [] if few else ["low", "high"]

    def tails_of(b: pd.DataFrame, look_up: Table | None) -> np.ndarray:
        if look_up:
            return look_up.tails(b["lang"].reset_index(drop=True), b[list(STATISTICS)].to_numpy(float))
        return np.column_stack([_stacked(b["low"]), _stacked(b["high"])])

    marks = (
        labels.where("is_prose is not null")
        .groupBy(F.col("doc_id").alias("_d"))
        .agg(F.avg(F.col("is_prose").cast("double")).alias("y"))
        .where("y <> 0.5")
        .orderBy(F.xxhash64("_d"))
        .limit(LABEL_SAMPLE)  # a documented bound on what is fitted; scores cover all documents
    )
    sample = rows.join(marks, rows["doc_id"] == marks["_d"]).select("doc_id", "lang", *(inputs or STATISTICS), "y").toPandas().sort_values("doc_id", kind="stable")
    model = spark.sparkContext.broadcast(Weights(2 * n).fit(tails_of(sample, table.value), (sample["y"] < 0.5).to_numpy(float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look_up, m = table.value, model.value
        for b in batches:
            score = m.score(tails_of(b, look_up))
            empty = b["word_count"].to_numpy() <= 0
            yield b.drop(columns=inputs).assign(outlier=score, is_prose=(score <= 0) & ~empty)

    schema = "doc_id bigint, lang string, " + ", ".join(f"{x} double" for x in STATISTICS)
    return rows.select("doc_id", "lang", *STATISTICS, *inputs).mapInPandas(run, schema + ", outlier double, is_prose boolean")
