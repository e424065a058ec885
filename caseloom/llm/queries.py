"""The queries of this folder; importing the module registers them."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from caseloom.llm import (
    attention_lm,
    bloom_cascade,
    byte_cnn,
    chunk_table,
    count_viterbi,
    edit_embedding,
    ngram_join,
    permutation_index,
    pii_bootstrap,
    prefix_trie,
    range_coder,
    temperature_mixing,
    token_alignment,
)
from caseloom.llm.common import table
from caseloom.llm.registry import ORACLES, QUERIES, query  # noqa: F401

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Fixed rules of the URL query: action, host, path.
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

_RULES_SQL = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
OP2_SQL = f"""
with rules(action, rule_host, rule_path) as (values {_RULES_SQL}),
cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut)
select page_id, host, path,
  (select max_by(rule_host || rule_path, length(rule_host || rule_path)) from rules
   where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as rule,
  coalesce((select max_by(action, length(rule_host || rule_path)) from rules
   where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)), 'allow') as verdict
from parts
"""

# DuckDB has no CRC-32; bit by bit over the ids' decimal digits.
OP11_SQL = """
with t as (
  select conv_id as c, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as d, length(coalesce(text, '')) as n
  from conversations where conv_id is not null),
o as (select c, d, n, row_number() over (partition by c order by turn nulls first, d) as pos from t),
k as (
  select c, c - c % 100 as f, xor(list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint),
    lambda s, b: list_reduce([xor(s, b)] || range(8), lambda a, j: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 as h
  from (select distinct c from t)),
e as (select f, count(*) as lent from k join o using (c) where c = f and pos <= 5 group by f),
r as (
  select k.c, o.pos as i, o.d, o.n from k join o on o.c = k.f and o.pos <= k.h
  union all
  select k.c, o.pos - k.h + least(k.h, coalesce(e.lent, 0)), o.d, o.n from k join o on o.c = k.c and o.pos > k.h left join e on e.f = k.f),
p as (
  select c, i as depth, n, string_agg(d, ',') over w as key, coalesce(string_agg(d, ',') over (partition by c order by i rows between unbounded preceding and 1 preceding), '') as above
  from r window w as (partition by c order by i rows between unbounded preceding and current row)
  union all select c, 0, 0, '', null from k),
l as (select c, max(depth) as len from p group by c),
v as (
  select key, min(c) as conv_id, min(depth) as depth, count(*) as n_convs, max(n) as n, min(above) as above,
    string_agg(c::varchar, ',' order by c) filter (where depth = len) as ends
  from p join l using (c) group by key),
q as (select above, count(*) as kids from v where depth > 0 group by above),
u as (select v.*, coalesce(kids, 0) as kids from v left join q on q.above = v.key),
s as (
  select a.key, sum((u.kids = 0)::int) as leaves, sum((u.n_convs - 1) * u.n) as saved
  from u join p as a on a.c = u.conv_id and a.depth <= u.depth group by a.key)
select u.conv_id, u.depth, b.conv_id as parent_conv_id, u.n_convs, u.kids as n_children, s.leaves::bigint as n_leaves,
  s.saved::bigint as saved_tokens, sha256(coalesce(u.ends, '')) as ends_sha256
from u join s using (key) left join u as b on b.key = u.above
"""


@query("op1_permutation_index")
def op1_permutation_index(spark, sf_dir):
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op2_bloom_cascade", OP2_SQL)
def op2_bloom_cascade(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return bloom_cascade.judge(table(spark, sf_dir, "pages"), rules)


@query("op3_pii_bootstrap")
def op3_pii_bootstrap(spark, sf_dir):
    return pii_bootstrap.digests(pii_bootstrap.find(table(spark, sf_dir, "documents")))


@query("op4_range_coder")
def op4_range_coder(spark, sf_dir, tokenizer_file=WORD_TOKENIZER):
    written = range_coder.write_ids(table(spark, sf_dir, "documents"), tokenizer_file, end_id=2)
    return range_coder.read_ids(written)


@query("op5_chunk_table")
def op5_chunk_table(spark, sf_dir, model_file=PIECE_MODEL):
    return chunk_table.round_trip_digests(table(spark, sf_dir, "documents"), model_file)


@query("op6_byte_cnn")
def op6_byte_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.classify(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_count_viterbi")
def op7_count_viterbi(spark, sf_dir, model_file=PIECE_MODEL):
    return count_viterbi.count_tokens(table(spark, sf_dir, "documents"), model_file)


@query("op8_temperature_mixing")
def op8_temperature_mixing(spark, sf_dir):
    return temperature_mixing.mixture(table(spark, sf_dir, "documents"), repetition_limit=2.0)


@query("op9_edit_embedding")
def op9_edit_embedding(spark, sf_dir):
    return edit_embedding.with_classes(table(spark, sf_dir, "documents"))


@query("op10_ngram_join")
def op10_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir, a_file=BYTE_TOKENIZER, b_file=PIECE_MODEL):
    return token_alignment.align(table(spark, sf_dir, "documents"), a_file, b_file)


@query("op13_attention_lm")
def op13_attention_lm(spark, sf_dir, model_file=PIECE_MODEL):
    return attention_lm.log_probability(table(spark, sf_dir, "documents"), model_file)


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
