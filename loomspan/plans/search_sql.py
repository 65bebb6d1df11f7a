"""BM25 over token arrays in SQL, for the checks of the search queries."""

from __future__ import annotations

from loomspan.operators.search import Phrase, Query

_TOKENS = "list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _same(x: str, p: Phrase, j: int) -> str:
    return f"starts_with({x}, '{p.words[j]}')" if p.prefix and j == len(p.words) - 1 else f"{x} = '{p.words[j]}'"


def _tf(p: Phrase) -> str:
    if len(p.words) == 1:
        return f"len(list_filter(w, lambda x: {_same('x', p, 0)}))"
    here = " and ".join(_same(f"w[i + {j}]", p, j) for j in range(len(p.words)))
    return f"len(list_filter(range(1, greatest(len(w) - {len(p.words) - 2}, 1)), lambda i: {here}))"


def _holds(tree: object) -> str:
    if isinstance(tree, int):
        return f"tf{tree} > 0"
    op, a, b = tree  # type: ignore[misc]
    return f"({_holds(a)} {'and not' if op == 'not' else op} {_holds(b)})"


def ranked(docs: str, q: Query, name: str) -> str:
    """CTEs ending in ``name`` (doc, rank) of the texts in ``docs`` (doc, text)."""
    n = range(len(q.phrases))
    idf = lambda k: f"case when ln((n - df{k} + 0.5) / (df{k} + 0.5)) <= 0 then 1e-6 else ln((n - df{k} + 0.5) / (df{k} + 0.5)) end"
    score = " + ".join(f"i{k} * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * len / al))" for k in n)
    return f"""{name}_w as (select doc, {_TOKENS} as w from ({docs}) where text is not null),
{name}_c as (select doc, len(w) as len, {', '.join(f'{_tf(p)} as tf{k}' for k, p in enumerate(q.phrases))} from {name}_w where len(w) > 0),
{name}_f as (select count(*) as n, avg(len) as al, {', '.join(f'sum((tf{k} > 0)::int) as df{k}' for k in n)} from {name}_c),
{name}_i as (select al, {', '.join(f'{idf(k)} as i{k}' for k in n)} from {name}_f),
{name} as (select doc, round(-({score}), 9) as rank from {name}_c, {name}_i where {_holds(q.tree)})"""


def page(name: str, limit: int) -> str:
    """CTE ``name_page`` (doc, rank, has_more)."""
    return f"{name}_page as (select doc, rank, (select count(*) > {limit} from {name}) as has_more from {name} order by rank, doc limit {limit})"
