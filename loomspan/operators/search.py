"""Full-text search: tokens, stored postings, query grammar, BM25 over all branches, snippets, one envelope.

An index is two tables: postings (term, doc, tf, positions, len), partitioned by the hash of a
term's first two letters, so a word or a prefix reads one partition, and the corpus
(doc, len). A query reads the postings of its own words only, puts them together per
document and counts every phrase; texts are read for the snippets of a page alone.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.filters import BadRequest
from loomspan.runtime import stage

K1, B = 1.2, 0.75
#: Partitions of the stored postings.
BUCKETS = 64
# Letters with their plain forms.
_ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column | str) -> Column:
    """Lower-case words without diacritics; every other character parts them."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.translate(F.lower(t), _ACCENTS, _PLAIN), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def op_document(ops: DataFrame) -> Column:
    """The text of an operation: its names and error."""
    return F.concat_ws(" ", *[F.expr(f"nullif({c}, '')") for c in ("kind", "model", "provider", "namespace", "tool", "error_text") if c in ops.columns])


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """term, doc, tf, positions, len of documents with at least one token."""
    t = docs.select(F.col(id_col).alias("doc"), tokens(text).alias("w")).where(F.size("w") > 0)
    return (
        t.select("doc", F.size("w").alias("len"), F.posexplode("w").alias("pos", "term"))
        .groupBy("term", "doc", "len")
        .agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    )


def reindexed(index: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The postings with those of changed documents replaced: an anti-join on the touched ids and an append."""
    dirty = docs.select(F.col(id_col).alias("doc")).distinct()
    return index.join(dirty, "doc", "left_anti").unionByName(postings(docs, id_col, text))


# ---- query grammar ----------------------------------------------------------------------------------------
class Phrase(NamedTuple):
    """Words in a row, the last of them maybe a prefix, maybe in one column only."""

    words: tuple[str, ...]
    prefix: bool = False
    column: str = ""


class Query(NamedTuple):
    """A tree of ("and" | "or" | "not", left, right) over the numbers of its phrases."""

    phrases: tuple[Phrase, ...]
    tree: object


_LEX = re.compile(r'\s*(?:(?P<str>"(?:[^"]|"")*")|(?P<op>AND|OR|NOT)\b|(?P<col>\w+)\s*:|(?P<word>\w+)|(?P<mark>[()*])|(?P<bad>\S))')


def _words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(_ACCENTS, _PLAIN))))


def parse_query(text: str, columns: tuple[str, ...] = ()) -> Query:
    """Bare words are AND, quotes a phrase, ``*`` a prefix, ``col:`` a column, AND, OR, NOT and parentheses as usual.

    NOT binds closest, then AND, then OR; anything else is a ``BadRequest``.
    """
    if any(ord(c) < 0x20 for c in text):
        raise BadRequest("control character")
    lexed: list[tuple[str, str]] = []
    at, text = 0, text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        kind = m.lastgroup if m else "bad"
        if kind == "bad":
            raise BadRequest(f"malformed query at {at}")
        lexed.append((kind, m[kind]))
        at = m.end()
    phrases: list[Phrase] = []
    k = 0

    def peek() -> tuple[str, str]:
        return lexed[k] if k < len(lexed) else ("end", "")

    def term() -> object:
        nonlocal k
        kind, v = peek()
        k += 1
        if (kind, v) == ("mark", "("):
            inner = either()
            nonlocal_close()
            return inner
        column = ""
        if kind == "col":
            if v not in columns:
                raise BadRequest(f"no column {v}")
            column = v
            kind, v = peek()
            k += 1
        if kind not in ("str", "word"):
            raise BadRequest("a term is missing")
        words, prefix = _words(v), False
        if peek() == ("mark", "*"):
            k += 1
            prefix = True
        if not words:
            raise BadRequest("a term is missing")
        phrases.append(Phrase(words, prefix, column))
        return len(phrases) - 1

    def nonlocal_close() -> None:
        nonlocal k
        if peek() != ("mark", ")"):
            raise BadRequest("a parenthesis is missing")
        k += 1

    def less() -> object:
        nonlocal k
        left = term()
        while peek() == ("op", "NOT"):
            k += 1
            left = ("not", left, term())
        return left

    def both() -> object:
        nonlocal k
        left = less()
        while peek()[0] in ("word", "str", "col") or peek() in (("op", "AND"), ("mark", "(")):
            if peek() == ("op", "AND"):
                k += 1
            left = ("and", left, less())
        return left

    def either() -> object:
        nonlocal k
        left = both()
        while peek() == ("op", "OR"):
            k += 1
            left = ("or", left, both())
        return left

    tree = either()
    if k < len(lexed):
        raise BadRequest("malformed query")
    return Query(tuple(phrases), tree)


def _condition(tree: object, hit) -> Column:
    if isinstance(tree, int):
        return hit(tree)
    op, a, b = tree  # type: ignore[misc]
    left, right = _condition(a, hit), _condition(b, hit)
    return left & right if op == "and" else left | right if op == "or" else left & ~right


# ---- index ------------------------------------------------------------------------------------------------
class Index(NamedTuple):
    postings: DataFrame
    corpus: DataFrame
    docs: DataFrame  # doc, text


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, id_col: str, text: str, path: str) -> None:
    """Writes the postings by partition, sorted by term, and the corpus."""
    p = postings(docs, id_col, text).withColumn("bucket", _bucket(F.col("term")))
    p.repartition("bucket", F.pmod(F.xxhash64("term", "doc"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs.select(F.col(id_col).alias("doc"), F.size(tokens(text)).cast("bigint").alias("len")).where("len > 0").write.mode("overwrite").parquet(f"{path}/corpus")


def open_index(docs: DataFrame, id_col: str, text: str, path: str) -> Index:
    spark = docs.sparkSession
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"), docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text")))


def _moved(places: str, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _hits(index: Index, q: Query) -> DataFrame:
    """doc, len and tf0, tf1, ... of every document with any of the query's words."""
    words = [(k, j, w, p.prefix and j == len(p.words) - 1) for k, p in enumerate(q.phrases) for j, w in enumerate(p.words)]
    meets = lambda w, prefix: F.col("term").startswith(w) if prefix else F.col("term") == w
    wanted = F.lit(False)
    for _, _, w, prefix in words:
        # the partition is known where two letters are, or the whole word
        part = F.lit(True) if prefix and len(w) < 2 else F.col("bucket") == _bucket(F.lit(w))
        wanted = wanted | (part & meets(w, prefix))
    slot = F.filter(F.array(*[F.when(meets(w, prefix), F.lit(i)) for i, (_, _, w, prefix) in enumerate(words)]), lambda x: x.isNotNull())
    read = index.postings.where(wanted).select("doc", "len", F.explode(slot).alias("slot"), "positions")
    at = read.groupBy("doc", "len").agg(*[F.flatten(F.collect_list(F.when(F.col("slot") == i, F.col("positions")))).alias(f"p{i}") for i in range(len(words))])
    frequency = []
    for k, p in enumerate(q.phrases):
        mine = [i for i, (n, *_) in enumerate(words) if n == k]
        # where the phrase begins: places of its words, moved back by their number in it
        begins = F.col(f"p{mine[0]}")
        for j, i in enumerate(mine[1:], 1):
            begins = F.array_intersect(begins, _moved(f"p{i}", j))
        frequency.append(F.size(begins).alias(f"tf{k}"))
    return at.select("doc", "len", *frequency)


def ranked(index: Index, q: Query) -> DataFrame:
    """doc, rank of every match; lower is better. All phrases of the query count, in every branch, prefixes as one term."""
    hits = stage(_hits(index, q))
    n = len(q.phrases)
    size = index.corpus.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    have = hits.agg(*[F.sum((F.col(f"tf{k}") > 0).cast("bigint")).alias(f"df{k}") for k in range(n)])
    score: Column = F.lit(0.0)
    for k in range(n):
        df = F.coalesce(f"df{k}", F.lit(0))
        idf = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        tf = F.col(f"tf{k}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    facts = size.join(have)  # one row each
    return hits.where(_condition(q.tree, lambda k: F.col(f"tf{k}") > 0)).join(F.broadcast(facts)).select("doc", F.round(-score, 9).alias("rank"))


def page(index: Index, q: Query, limit: int, offset: int = 0) -> DataFrame:
    """doc, rank, snippet, has_more: one page of matches by rank and id; texts are read for its rows only."""
    # the row behind the page tells that there is more
    top = stage(ranked(index, q).orderBy("rank", "doc").offset(offset).limit(limit + 1))
    more = top.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    rows = top.orderBy("rank", "doc").limit(limit).join(F.broadcast(more))  # one row
    return rows.join(index.docs, "doc").select("doc", "rank", snippet(F.col("text"), q).alias("snippet"), "has_more")


def snippet(text: Column, q: Query, width: int = 60) -> Column:
    """The text around the first hit, hits in brackets, cut ends as dots."""
    words = sorted({re.escape(w) + (r"[\p{L}\p{N}]*" if p.prefix and w == p.words[-1] else "") for p in q.phrases for w in p.words})
    alt = "|".join(words)
    edge = lambda x: rf"(?<![\p{{L}}\p{{N}}])({x})(?![\p{{L}}\p{{N}}])"
    plain = F.translate(F.lower(text), _ACCENTS, _PLAIN)
    at = F.greatest(F.coalesce(F.length(F.regexp_extract(plain, rf"(?s)^(.*?){edge(alt)}", 1)) + 1, F.lit(1)) - width, F.lit(1))
    cut = F.substring(text, at, F.lit(2 * width))
    marked = F.regexp_replace(cut, "(?iu)" + edge(alt), "[$1]")
    return F.concat(F.when(at > 1, "...").otherwise(""), marked, F.when(F.length(text) >= at + 2 * width, "...").otherwise(""))


def match(docs: DataFrame, id_col: str, text: str, q: Query) -> DataFrame:
    """Documents that satisfy the query, without an index: doc."""
    w = docs.select(F.col(id_col).alias("doc"), tokens(text).alias("w"))

    def hit(k: int) -> Column:
        p = q.phrases[k]
        same = lambda x, j: x.startswith(p.words[j]) if p.prefix and j == len(p.words) - 1 else x == p.words[j]
        at = F.sequence(F.lit(1), F.greatest(F.size("w") - len(p.words) + 1, F.lit(1)))
        if len(p.words) == 1:
            return F.exists("w", lambda x: same(x, 0))

        def here(i: Column) -> Column:
            c = same(F.get("w", i - 1), 0)
            for j in range(1, len(p.words)):
                c = c & same(F.get("w", i - 1 + j), j)
            return F.coalesce(c, F.lit(False))

        return F.exists(at, here)

    return w.where(_condition(q.tree, hit)).select("doc")


def logged(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """The texts of sources that index their logs; texts: doc, source_id, text."""
    on = sources.where("fts5_index_logs = 1").select(F.col("id").alias("source_id"))
    return texts.join(on, "source_id", "left_semi")


def envelope(indexes: dict[str, Index], q: Query, limit: int, offset: int = 0) -> DataFrame:
    """scope, doc, rank, snippet, has_more over operations, logs and contents; there is more if any scope has more."""
    out = None
    for scope, index in indexes.items():
        p = page(index, q, limit, offset).select(F.lit(scope).alias("scope"), F.col("doc").cast("string").alias("doc"), "rank", "snippet", "has_more")
        out = p if out is None else out.unionByName(p)
    out = stage(out)
    return out.drop("has_more").join(F.broadcast(out.agg(F.max("has_more").alias("has_more"))))  # one row
