"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe,
    conversation_repair,
    exact_dedup,
    html_text,
    language,
    merkle,
    mixing,
    ngram_join,
    personal_data,
    substring,
    token_files,
    url_filter,
    whitening,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
REPEAT_WORDS = 35
#: Weights of the domains that the labels tell apart; clean text keeps its own total.
TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe_tree")
def op1(spark, sf_dir):
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        bpe.token_count("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


WORDS_SQL = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
with recursive words as (
  select doc_id, {WORDS_SQL.format(text=LOWER_SQL)} as w from documents
), tokens as (
  select distinct doc_id, unnest(
    case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as token
  from words
), sizes as (
  select words.doc_id, count(token) as n from words left join tokens using (doc_id) group by 1
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from tokens a join tokens b on a.token = b.token and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 75 * (x.n + y.n - c)
), both_ways as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id, doc_id as seen from sizes
  union
  select r.doc_id, e.b from reach r join both_ways e on e.a = r.seen
)
select doc_id, n as n_shingles, component_id
from sizes join (select doc_id, min(seen) as component_id from reach group by 1) using (doc_id)
"""


@query("op2_ngram_join", OP2_SQL)
def op2(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


OP2_LINKS_SQL = (
    OP2_SQL.partition("), both_ways as")[0]
    + """), ways as (
  select a as doc_id, b from links union all select b, a from links
)
select doc_id, count(b) as n_links from sizes left join ways using (doc_id) group by 1
"""
)


@query("op2_link_counts", OP2_LINKS_SQL)
def op2_links(spark, sf_dir):
    return ngram_join.link_counts(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
with norm as (select doc_id, {LOWER_SQL} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from norm
"""


@query("op4_exact_dedup", OP4_SQL)
def op4(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def held_out(doc_id) -> F.Column:
    """A fifth of the documents by checksum; those without identifier are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def language_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    return language.fit_dictionaries(docs.filter(~held_out(docs["doc_id"])))


@query("op6_language")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.predict_language(docs, language_dictionaries(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "told")


@query("op9_token_files")
def op9(spark, sf_dir):
    return token_files.write_and_read(table(spark, sf_dir, "documents"), WORD_TOKENIZER, END_ID)


OP10_SQL = f"""
with words as (
  select doc_id, {WORDS_SQL.format(text="coalesce(text, '')")} as w from documents
), starts as (
  select doc_id, unnest(range(1, len(w) - {REPEAT_WORDS} + 2)) as i, w from words
), windows as (
  select doc_id, i, md5(array_to_string(w[i:i + {REPEAT_WORDS - 1}], ' ')) as h from starts
), again as (
  select h from windows group by 1 having count(*) > 1
), gone as (
  select distinct doc_id, unnest(range(i, i + {REPEAT_WORDS})) as p from windows where h in (select h from again)
), places as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words
), kept as (
  select doc_id, string_agg(word, ' ' order by p) as body, count(*) as n
  from places anti join gone using (doc_id, p) group by 1
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(body, '')) as kept_sha256
from words left join kept using (doc_id)
"""


@query("op10_substring", OP10_SQL)
def op10(spark, sf_dir):
    found = substring.remove_repeats(table(spark, sf_dir, "documents"), REPEAT_WORDS)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_mixing")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixture, members = mixing.fit(docs, table(spark, sf_dir, "labels"), TARGETS, anchor="clean")
    return mixture.rated(members).select(
        "doc_id",
        F.col("mix_n").alias("n_tokens"),
        *(f"p_{d}" for d in TARGETS),
        "rate",
        mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"),
    )


@query("op5_merkle")
def op5(spark, sf_dir):
    found = merkle.compare_with_next(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op7_html_text")
def op7(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query("op8_personal_data")
def op8(spark, sf_dir):
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


@query("op11_whitening")
def op11(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))



#: Rules of the registered query: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

OP13_SQL = f"""
with rules(rule_host, rule_path, says) as (values {", ".join(map(str, URL_RULES))}),
split as (
  select row_number() over () as r, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path
  from pages
), fits as (
  select r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(says, length(rule_host || rule_path)) as says
  from split join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by r
)
select page_id, host, path, rule, coalesce(says, case when list_has_any(
    regexp_split_to_array(host, '[\\x00-/:-@\\[-`{{-\\x7f]+'), {list(url_filter.WORDS)}) then 'block' else 'allow' end) as verdict
from split left join fits using (r)
"""


@query("op13_url_filter", OP13_SQL)
def op13(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


OP12_SQL = """
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), coded as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
        string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: unicode(ch)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as code
  from conversations, crc_table
), damaged as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case code when 0 then [] when 3 then [1, 2] else [1] end) as copy
  from coded
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
  from damaged
), marked as (
  select *, body = '' as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    right(body, 1) not in ('.', '!', '?') as cut_off, left(role, 1) as z,
    lag(left(role, 1)) over (partition by conv_id order by i) as y
  from placed
), faults as (
  select conv_id, i, turn, role, text, z, blank or again as m,
    blank, again and not blank as duplicate, cut_off and not again and not blank as truncated,
    (y is not null and y || z not in ('su', 'ua', 'au'))::int as bad
  from marked
), ends as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int)::bigint as blank,
    sum(duplicate::int)::bigint as duplicate, sum(truncated::int)::bigint as truncated, sum(bad)::bigint as illegal, max(i) as n
  from faults group by conv_id
), ways as (
  select conv_id, 0::bigint as i, {'c': 0::bigint, 'a': '', 't': ''} as s0, {'c': 1000000000::bigint, 'a': '', 't': ''} as s1,
    {'c': 3::bigint, 'a': 'I', 't': chr(10) || 'user:'} as s2,
    {'c': 6::bigint, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} as s3
  from ends
  union all
  select conv_id, i, s0, s1, u, list_min([v, {'c': u.c + 3, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}]) from (
    select conv_id, i, s0, s1, v, list_min([r2, {'c': s0.c + 3, 'a': s0.a || 'I', 't': s0.t || chr(10) || 'user:'},
      {'c': s1.c + 3, 'a': s1.a || 'I', 't': s1.t || chr(10) || 'user:'},
      {'c': v.c + 3, 'a': v.a || 'I', 't': v.t || chr(10) || 'user:'}]) as u
    from (
      select f.conv_id, f.i, {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t} as s0,
        list_min([{'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t},
          {'c': s0.c + k.cost + case when f.z = 's' then 0 else 1000000000 end, 'a': s0.a || 'K', 't': s0.t || k.line}]) as s1,
        list_min(list_concat([{'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t}],
          list_transform([s0, s1, s3], lambda x: {'c': x.c + k.cost + case when f.z = 'u' then 0 else 1000000000 end, 'a': x.a || 'K', 't': x.t || k.line}),
          list_transform([s0, s1, s3], lambda x: {'c': x.c + k.cost + 3, 'a': x.a || 'R', 't': x.t || chr(10) || 'user:' || f.text}))) as r2,
        list_min([{'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t},
          {'c': s2.c + k.cost + case when f.z = 'a' then 0 else 1000000000 end, 'a': s2.a || 'K', 't': s2.t || k.line},
          {'c': s2.c + k.cost + 3, 'a': s2.a || 'R', 't': s2.t || chr(10) || 'assistant:' || f.text}]) as v
      from ways w join faults f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1,
        lateral (select case when f.m then 1000000000 when f.truncated then 3 else 0 end as cost, chr(10) || f.role || ':' || f.text as line) k
    )
  )
), best as (
  select e.*, list_min([s0, s3]) as b from ends e join ways w on e.conv_id is not distinct from w.conv_id and e.n = w.i
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.c, 0) as cost, coalesce(b.a, '') as audit,
  sha256(coalesce(substr(b.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join best on o.conv_id is not distinct from best.conv_id
"""


@query("op12_conversation_repair", OP12_SQL)
def op12(spark, sf_dir):
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, F.col("present"))
