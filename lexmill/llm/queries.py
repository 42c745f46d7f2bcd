"""The queries op1 to op13, each a thin layer over its operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import bpe, chat, classifier, embeddings, exactdedup, hardneg, lexical, linededup, minhash, mixing, quality_rules, urlfilter, warc
from lexmill.llm.common import read_table, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def multi_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = multi_vocabulary()
    coded = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(read_table(spark, sf_dir, "pages"), rules)


ORACLES["op2_url_filter"] = r"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
r(h, s, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (
  select page_id, host, path, h || s as rule, v,
         row_number() over (partition by page_id order by length(h || s) desc nulls last) as k
  from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where k = 1
"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.length("text").cast("bigint").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


PLANTED_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = said.unionByName(spark.createDataFrame(PLANTED_TURNS, "conv_id bigint, turn bigint, role string, text string"))
    # a plain conversation is a tree without branches: each turn replies to the one before it
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    nodes = said.withColumn("node", place).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
    out = chat.format_trees(nodes)
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLES["op5_chat"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(role) + length(text) + length('<|turn|><|text|><|end|>')
         + len(regexp_extract_all(role || chr(0) || text, '<\\*(?:\||/?s>|</?SYS>>)|\[\\*(?:\||/?s>|</?SYS>>|/?INST\])|<\\*/?INST\]')) as n
  from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(n)::bigint as formatted_chars
from e group by conv_id
"""


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


ORACLES["op6_minhash"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) < 2 then [array_to_string(w, ' ')] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g
  from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
e2 as (select a, b from e union all select b, a from e),
r(id, root) as (select doc_id, doc_id from documents union select e2.b, r.root from r join e2 on r.id = e2.a),
c as (select id, min(root) as component_id from r group by id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents left join n using (doc_id) join c on c.id = doc_id
"""


@query
def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return classifier.classify(read_table(spark, sf_dir, "documents"), trusted)


@query
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLES["op8_embeddings"] = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
n as (select a as vec_id, count(*) as n_links from l group by a),
r(id, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from r join l on r.id = l.a),
c as (select id, min(root) as component_id from r group by id)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join n using (vec_id) join c on c.id = vec_id
"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"), statistics=True)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept")


ORACLES["op9_quality_rules"] = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
t as (select doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select doc_id, unnest([i, i + 1, i + 2]) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as n from t) where n > 1),
cov as (select doc_id, count(distinct p) as n_repeat_words from rep group by doc_id),
s as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
         len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, length(regexp_replace(text, '\P{Lu}+', '', 'g')) as n_upper
  from d left join cov using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > 10 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words
            or 100 * n_dup_lines > 50 * n_lines or 100 * n_upper > 50 * word_chars) as kept
from b
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lexmill-warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.page_records(read_table(spark, sf_dir, "pages")), path)
    own = F.regexp_extract("record_id", r"^<urn:page:(-?\d*)>$", 1)
    # responses are read whole and measured; of revisits, whose payload is elsewhere, only the headers are
    whole = warc.read_warc(spark, path).where("record_type = 'response'")
    whole = whole.select(own.alias("id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    again = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select(own.alias("id"), F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", "refers_to")
    to = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
    return whole.unionByName(again).select(F.col("id").try_cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", to.alias("refers_to"))


ORACLES["op10_warc"] = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha256(h) as digest from p),
f as (select *, min(page_id) over (partition by digest) as first from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> first then first end as refers_to
from f
"""


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


ORACLES["op12_exact_dedup"] = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select doc_id, t, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from d)
select doc_id, keep_id, group_size::bigint as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", label))


ORACLES["op11_hard_negatives"] = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from v where id % 100 = 0),
s as (select a.id as a, v.id as b, a.label = v.label as same, list_inner_product(a.e, v.e)::bigint as s from a join v on a.id <> v.id and len(a.e) = len(v.e)),
p as (select a, b as p, s as ps from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p, ps, b, s, row_number() over (partition by p.a, p order by s desc, b) as k from p join s on s.a = p.a and not same and 30 * ps <= 100 * s and 100 * s <= 90 * ps)
select a as anchor_id, p as positive_id, k::int as rank, b as negative_id, ps as positive_score, s as negative_score from n where k <= 10
"""


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical_search"] = r"""
with t as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
d as (select doc_id, count(*) as n from t group by 1),
g as (select count(*) as n_docs, sum(n)::bigint as l from d),
f as (select doc_id, term, count(*) as tf from t group by 1, 2),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, g group by 1),
i as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
s as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l))))::bigint as score
  from i join f using (term) join w using (term) join d using (doc_id), g group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""
