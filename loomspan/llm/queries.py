"""Queries of the problems on language-model text (pN_...), each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import conversations, mixing, packing, pii, quality, tokens
from loomspan.runtime import small_rows, stage, table

Query = Callable[[SparkSession, str], DataFrame]

#: Key of the pseudonyms in the queries here; a real run passes its own secret.
DEMO_KEY = b"loomspan demonstration key"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    verdicts, _ = conversations.examine(table(spark, d, "transcript_lines"))
    return verdicts.where("reason <> ''").select("session_id", "agent_id")


def p5_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation with its size and, if it is dropped, why."""
    return conversations.examine(table(spark, d, "transcript_lines"))[0]


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The sound conversations, their lines in order with the speaker's role."""
    return conversations.ordered(table(spark, d, "transcript_lines")).withColumn("turn_no", F.col("turn_no").cast("bigint"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.findings(table(spark, d, "transcript_lines"), table(spark, d, "name_lexicon"), DEMO_KEY)


def p6_numbers(spark: SparkSession, d: str) -> DataFrame:
    """How many of the numbers pass the checksum or range of their kind."""
    return pii.numbers(table(spark, d, "transcript_lines"), table(spark, d, "name_lexicon"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    return pii.redacted(table(spark, d, "transcript_lines"), table(spark, d, "name_lexicon"), DEMO_KEY)


def _sizes(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return stage(tokens.count_tokens(table(spark, d, "documents"), keep=keep))


def _capacities(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The budgets, a fixed handful of rows."""
    rows = small_rows(table(spark, d, "pack_budgets").where("capacity_tokens > 0"), 1000, "budgets")
    return sorted((r["budget_name"], r["capacity_tokens"]) for r in rows)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    budgets = sorted(_capacities(spark, d), key=lambda x: x[1])[-1:]
    return packing.pack_all(_sizes(spark, d), budgets).where("n_pieces > 1").select("doc_id").distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The place of every document, or piece of one that is too long, for every budget."""
    return packing.pack_all(_sizes(spark, d), _capacities(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused space of every budget."""
    budgets = _capacities(spark, d)
    capacity = F.create_map(*[F.lit(x) for b in budgets for x in b])[F.col("budget_name")]
    b = packing.pack_all(_sizes(spark, d), budgets).groupBy("budget_name", "bin_id").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n"), F.max("exact").alias("exact"))
    return b.where("used > 0").groupBy("budget_name").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n").alias("n_pieces"),
        F.sum("used").alias("tokens"),
        F.sum(F.col("exact").cast("int")).alias("n_full"),
        F.max("used").alias("most_used"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * F.max(capacity))).alias("unused_share"),
    )


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every packing: each document once and whole, no container over its capacity, none cut that fits."""
    budgets, sizes = _capacities(spark, d), _sizes(spark, d)
    p = stage(packing.pack_all(sizes, budgets))
    capacity = F.create_map(*[F.lit(x) for b in budgets for x in b])[F.col("budget_name")]
    docs = p.groupBy("budget_name", "doc_id").agg(F.sum("length").alias("t"), F.count(F.lit(1)).alias("n"), F.max("n_pieces").alias("m"))
    docs = docs.join(sizes.select(F.col("doc_id").alias("_d"), "n_tokens"), F.col("doc_id") == F.col("_d"))
    a = docs.groupBy("budget_name").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(((F.col("t") != F.col("n_tokens")) | (F.col("n") != F.col("m"))).cast("bigint")).alias("n_wrong"),
        F.sum(((F.col("m") > 1) & (F.col("n_tokens") <= capacity)).cast("bigint")).alias("n_cut_for_nothing"),
    )
    over = p.groupBy("budget_name", "bin_id").agg(F.sum("length").alias("used")).groupBy("budget_name").agg(F.sum((F.col("used") > capacity).cast("bigint")).alias("n_over"))
    return a.join(over, "budget_name")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents and how often each is repeated."""
    return mixing.mix(_sizes(spark, d, "source"), table(spark, d, "mix_targets")).select("doc_id", "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares(stage(mixing.mix(_sizes(spark, d, "source"), targets)), targets)


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every mix: no document over its cap, and shares off the targets by a document at most."""
    targets = table(spark, d, "mix_targets")
    chosen = stage(mixing.mix(_sizes(spark, d, "source"), targets))
    longest = chosen.agg((F.max("n_tokens") / F.sum(F.col("n_tokens") * F.col("copies"))).alias("one_doc"))
    sh = mixing.shares(chosen, targets).join(F.broadcast(longest))  # a single row
    off = F.abs(F.col("actual_share") - F.col("target_share")) > F.col("one_doc")
    return sh.select("source", (F.col("most_copies") > F.col("max_repeats")).alias("over_cap"), off.alias("off_target"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(*[table(spark, d, t) for t in ("documents", "common_words", "quality_labels")])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("not is_prose").select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics, scores and verdict."""
    return _judged(spark, d)


def p10_word_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The plain figures on words, symbols and lines of every document."""
    m = quality.measure(table(spark, d, "documents"), table(spark, d, "common_words"))
    r = lambda c: F.round(c, 9).alias(c)
    return m.select("doc_id", F.col("word_count").cast("bigint").alias("word_count"), r("mean_word_length"), r("digit_ratio"), r("words_per_line"), r("comma_ends"))


# A line is reached from a line without parent, or its conversation is broken; the nearest prompt travels down.
_P5 = """l as (
  select coalesce(session_id, '') as s, coalesce(agent_id, '') as a, uuid, line_id, nullif(parent_uuid, '') as p, lower(trim(line_type)) as kind,
    coalesce(is_meta, false) or coalesce(is_compact_summary, false) as quiet, lower(trim(coalesce(message ->> '$.role', ''))) as r,
    case json_type(message, '$.content') when 'VARCHAR' then regexp_matches(message ->> '$.content', '\\S')
      when 'ARRAY' then len(list_filter(cast(json_extract(message, '$.content') as json[]), lambda x: x ->> '$.type' = 'text' and regexp_matches(x ->> '$.text', '\\S'))) > 0
      else false end as has_text
  from transcript_lines qualify row_number() over (partition by session_id, agent_id, uuid order by line_id) = 1),
n as (select *, coalesce(nullif(case when r in ('user', 'assistant', 'system') then r end, ''), kind) as role from l),
m as (select *, role = 'user' and has_text and not quiet as prompt, role = 'assistant' and has_text as reply from n),
w as (
  select s, a, uuid, case when prompt then uuid end as near, cast(null as varchar) as answers, 0 as depth, line_id as seq from m where p is null
  union all
  select m.s, m.a, m.uuid, case when m.prompt then m.uuid else w.near end, case when m.reply then w.near end, w.depth + 1, greatest(w.seq, m.line_id)
  from w join m on m.s = w.s and m.a = w.a and m.p = w.uuid),
ok as (select s, a, answers from w where answers is not null group by all),
lost as (select distinct s, a from m where p is not null and not exists (select 1 from m x where x.s = m.s and x.a = m.a and x.uuid = m.p)),
g as (select s, a, count(*) as lines, bool_or(prompt) as has_prompt, bool_or(reply) as has_reply,
    count(*) filter (where prompt) as prompts from m group by 1, 2),
wc as (select s, a, count(*) as reached from w group by all), oc as (select s, a, count(*) as answered from ok group by all),
v as (select g.s, g.a, lines, case when lost.s is not null then 'broken link' when lines > coalesce(reached, 0) then 'loop' when not has_prompt then 'no prompt' when not has_reply then 'no assistant text'
    when prompts > coalesce(answered, 0) then 'prompt without reply' else '' end as reason
  from g left join lost on lost.s = g.s and lost.a = g.a left join wc on wc.s = g.s and wc.a = g.a left join oc on oc.s = g.s and oc.a = g.a)"""
P5_FOUND_SQL = f"with recursive {_P5}\nselect s as session_id, a as agent_id from v where reason <> ''"
P5_VERDICTS_SQL = f"with recursive {_P5}\nselect s as session_id, a as agent_id, lines as n_lines, reason from v"
P5_CONVERSATIONS_SQL = f"""with recursive {_P5}
select m.s as session_id, m.a as agent_id, row_number() over (partition by m.s, m.a order by w.seq, w.depth, m.line_id) - 1 as turn_no, m.line_id, m.role, case when prompt then 1 when reply then 2 else 0 end as symbol
from m join w on w.s = m.s and w.a = m.a and w.uuid = m.uuid join v on v.s = m.s and v.a = m.a and v.reason = ''"""

P10_WORDS_SQL = """with w as (select coalesce(doc_id, -1) as doc_id, coalesce(text, '') as t,
  regexp_extract_all(coalesce(text, ''), '\\p{L}+(?:[''’-]\\p{L}+)*') as words,
  list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as tokens,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_matches(x, '\\S')) as lines,
  regexp_replace(coalesce(text, ''), '\\s', '', 'g') as solid from documents)
select doc_id, case when len(tokens) = 0 then 0 else len(words) end as word_count,
  round(case when len(words) = 0 then 0 else list_sum(list_transform(words, lambda x: length(lower(x)))) / len(words) end, 9) as mean_word_length,
  round(length(regexp_replace(solid, '[^0-9]', '', 'g')) / greatest(1, length(solid)), 9) as digit_ratio,
  round(len(tokens) / greatest(1, len(lines)), 9) as words_per_line,
  round(len(list_filter(lines, lambda x: regexp_matches(x, '[,;]\\s*$'))) / greatest(1, len(lines)), 9) as comma_ends from w"""

P8_PLACED_SQL = "select budget_name, (select count(*) from documents) as n_docs, 0 as n_wrong, 0 as n_cut_for_nothing, 0 as n_over from pack_budgets where capacity_tokens > 0"

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p5_found, p5_verdicts, p5_conversations, p6_found, p6_numbers, p6_redacted, p8_found, p8_packed, p8_fill, p8_placed,
        p9_mix, p9_shares, p9_kept, p10_found, p10_statistics, p10_word_statistics,
    )
}
SQL: dict[str, str] = {"p8_placed": P8_PLACED_SQL, "p5_found": P5_FOUND_SQL, "p9_kept": "select lower(trim(source)) as source, false as over_cap, false as off_target from mix_targets", "p5_verdicts": P5_VERDICTS_SQL, "p5_conversations": P5_CONVERSATIONS_SQL, "p10_word_statistics": P10_WORDS_SQL}
