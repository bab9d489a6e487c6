"""The dealt operators as queries over the test tables, with the SQL each must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.llm import conversation_repair, licenses, quality_classifier, quality_rules, sentencepiece_codec
from fleetsift.llm.common import table
from fleetsift.llm.mixing import POWERS, mix
from fleetsift.llm.ngram_join import jaccard_join
from fleetsift.llm.sharding import assign_shards
from fleetsift.llm.source_audit import audit
from fleetsift.llm.substring_dedup import deduplicate
from fleetsift.llm.url_filters import judge_urls
from fleetsift.llm.vector_join import vector_join
from fleetsift.llm.warc_archive import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


_COMPONENTS = """
reach(x, c) as (select distinct a, a from links union select l.a, r.c from links l join reach r on l.b = r.x),
lowest as (select x, min(c) c from reach group by x)"""


@query("op3_ngram_jaccard_join", r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') w from documents),
s as (
  select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end) s from w),
n as (select doc_id, count(*) n from s group by doc_id),
shared as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from shared join n p on p.doc_id = a join n q on q.doc_id = b where k * 5 >= (p.n + q.n - k) * 4),
""" + _COMPONENTS + r"""
select d.doc_id, coalesce(n.n, 0)::integer n_shingles, (select count(*) from links where a = d.doc_id) n_links,
  coalesce(c, d.doc_id) class_id, coalesce(c, d.doc_id) = d.doc_id kept
from documents d left join lowest on x = d.doc_id left join n on n.doc_id = d.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_links", "class_id", "kept")


@query("op4_embedding_near_dedup", """
with recursive e as (
  select vec_id, label, embedding::double[] v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) n
  from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
links as (
  select x.vec_id a, y.vec_id b from e x join e y on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v)
  where x.n > 0 and y.n > 0 and list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.93),
""" + _COMPONENTS + """
select e.vec_id, (select count(*) from links where a = e.vec_id) n_links, coalesce(c, e.vec_id) component_id, coalesce(c, e.vec_id) = e.vec_id kept
from embeddings e left join lowest on x = e.vec_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join(table(spark, sf_dir, "embeddings"))


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).drop("key")


def _mix_sql(sweeps: int) -> str:
    """The same raking, its sweeps written out."""
    steps, last = [], "r0"
    for k in range(sweeps):
        for m in ("source", "lang", "topic"):
            name = f"{m}{k}"
            steps.append(f"{name} as materialized (select source, lang, topic, tokens, w * t_{m} / sum(w) over (partition by {m}) w, t_source, t_lang, t_topic from {last})")
            last = name
    shares = ", ".join(
        f"a_{m} as materialized (select {m}, pow(sum(tokens)::double, {POWERS[m]}) / (select sum(p) from (select pow(sum(tokens)::double, {POWERS[m]}) p from cells group by {m})) t_{m} from cells group by {m})"
        for m in ("source", "lang", "topic"))
    return rf"""
with d as materialized (
  select doc_id, source, lang, case when regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]') then 'contacts'
    when regexp_matches(text, '(?i)licen[cs]e') then 'licences' when contains(text, ' | ') then 'tables'
    when length(text) >= 4000 then 'long prose' else 'short prose' end topic,
    len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) tokens from documents),
cells as materialized (select source, lang, topic, sum(tokens) tokens from d group by all having sum(tokens) > 0),
{shares},
r0 as materialized (select cells.*, tokens / sum(tokens) over () w, t_source, t_lang, t_topic
  from cells join a_source using (source) join a_lang using (lang) join a_topic using (topic)),
{", ".join(steps)},
p as materialized (select source, lang, topic, w weight, (w / tokens) / max(w / tokens) over () probability from {last})
select doc_id, source, lang, topic, tokens::bigint tokens, round(weight, 4) weight, round(probability, 4) probability,
  ('0x' || substr(md5('mix|' || doc_id), 1, 13))::bigint / pow(16.0, 13) < probability kept
from d join p using (source, lang, topic)"""


@query("op7_mixing", _mix_sql(20))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("weight", F.round("weight", 4)).withColumn("probability", F.round("probability", 4))


URL_RULES = [("org/", "org", "/", "allow"), ("example.org/es/", "example.org", "/es/", "block"), ("example.org/en/1", "example.org", "/en/1", "block"),
             ("com/fr/", "com", "/fr/", "allow"), ("com/de/", "com", "/de/", "block")]


@query("op9_url_filters", """
with u as (select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
r as (select * from (values """ + ", ".join(str(r) for r in URL_RULES) + """) r(rule, rhost, rpath, verdict)),
m as (select page_id, rule, verdict, row_number() over (partition by page_id order by length(rule) desc) k
  from h join r on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from h left join (select * from m where k = 1) using (page_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op10_warc", """
with p as (select page_id, coalesce(html, '') html from pages),
g as (select html, max(page_id) last from p where strlen(html) >= 1000 group by html having count(*) > 1)
select page_id, strlen(p.html)::bigint payload_bytes, sha1(p.html) payload_digest,
  case when last is null or last = page_id then 'response' else 'revisit' end record_type,
  case when last <> page_id then last end refers_to from p left join g on p.html = g.html""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), spark)


TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@query("op1_license_scans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.load_model(spark, TOKENIZER)
    coded = sentencepiece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, checked_col="round_trip")
    return coded.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", "round_trip")


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, quality_classifier.grades(table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model, level=2)


@query("op13_source_audit", r"""
with t as (
  select row_number() over () k, coalesce(lang, '') lang, coalesce(source, '') source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) terms from documents),
g as (select distinct lang, source from t),
o as materialized (select k, lang, source, unnest(terms) term from t),
v as materialized (select lang, term from o group by 1, 2 having count(distinct k) >= 30),
n as materialized (select lang, source, term, count(*) n from o join v using (lang, term) group by 1, 2, 3),
z as (select lang, count(*) z from v group by 1),
s as (select g.lang, g.source, coalesce(sum(n), 0) s from g left join n using (lang, source) group by 1, 2),
p as materialized (select s.lang, s.source, v.term, coalesce(n.n, 0) n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 5)) // (s.s + 5 * z)::hugeint p
  from s join z using (lang) join v using (lang) left join n using (lang, source, term)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(l.s) + 5 * any_value(z))::hugeint q
  from p join (select lang, sum(s) s from s group by 1) l using (lang) join z using (lang) group by 1, 2),
d as (select x.lang, x.source, y.source item, sum(abs(x.p - y.p)) f from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3),
r as (
  select x.lang, x.source, 'pair' part, y.source item, coalesce(f, 0)::bigint f from g x join g y on x.lang = y.lang and x.source <> y.source
    left join d on d.lang = x.lang and d.source = x.source and d.item = y.source
  union all select lang, source, 'term', term, (p - q)::bigint from p join q using (lang, term) where n > 0 and p > q),
k as (select *, row_number() over (partition by lang, source, part order by f desc, encode(item)) rank from r)
select lang, source, part, item, f as value, rank::integer rank from k where part = 'pair' or rank <= 50""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: crc32 of the bytes of an ASCII text: eight steps of one bit for each.
_CRC32 = ("xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda r, b: "
          + "list_reduce(list_prepend(xor(r, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)))")


@query("op11_conversation_repair", rf"""
with recursive c as materialized (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as body,
    {_CRC32.format("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 fault from conversations),
d as materialized (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(body, '[.!?]', '', 'g') else body end body,
    unnest(case when fault = 3 then [1, 2] else [1] end) copy from c where fault <> 0),
f as materialized (
  select conv_id, turn, role, body, rtrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ending,
    row_number() over (partition by conv_id order by turn nulls first, role, body) i from d),
h as materialized (select *, row_number() over (partition by conv_id, role, body order by i) seen from f),
k as materialized (
  select conv_id, turn, i, role, body, case when ending = '' then 'blank' when seen > 1 then 'duplicate' when right(ending, 1) not in ('.', '!', '?') then 'truncated' else '' end fault,
    substr(role, 1, 1) initial, lag(substr(role, 1, 1)) over (partition by conv_id order by i) before from h),
-- States: 0 nothing, 1 system, 2 user, 3 assistant; moves with up to two insertions before the row's own edit.
fill(state, after) as (values (0, 2), (1, 2), (2, 3), (3, 2)),
ins as (select state low, state high, '' fills, 0 price from fill union all select state, after, 'I', 2 from fill
  union all select x.state, y.after, 'II', 4 from fill x join fill y on x.after = y.state),
keeps(initial, low, high) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
moves as materialized (
  select low, high, '*' initial, fills || 'D' edits, price + 3 price from ins
  union all select ins.low, keeps.high, initial, fills || 'K', price from ins join keeps on ins.high = keeps.low
  union all select ins.low, after, '+', fills || 'R', price + 2 from ins join fill on ins.high = fill.state),
walk(conv_id, i, state, cost, audit) as (
  select distinct conv_id, 0::bigint, 0, 0, '' from k
  union all
  select conv_id, i, state, price, audit from (
    select w.conv_id, k.i, m.high state, w.cost + m.price + case when fault = 'truncated' and not ends_with(edits, 'D') then 1 else 0 end price, w.audit || m.edits audit,
      row_number() over (partition by w.conv_id, m.high order by w.cost + m.price + case when fault = 'truncated' and not ends_with(edits, 'D') then 1 else 0 end, w.audit || m.edits) best
    from walk w join k on k.conv_id is not distinct from w.conv_id and k.i = w.i + 1
      join moves m on m.low = w.state and (m.initial = '*' or fault not in ('blank', 'duplicate') and (m.initial = '+' or m.initial = k.initial))) x where best = 1),
e as (select w.conv_id, w.cost + price as cost, w.audit || fills audit,
    row_number() over (partition by w.conv_id order by w.cost + price, w.audit || fills) best
  from walk w join (select conv_id, max(i) n from k group by 1) t on t.conv_id is not distinct from w.conv_id and w.i = n
    join ins on ins.low = w.state and ins.high in (0, 3)),
o as materialized (select conv_id, cost, audit from e where best = 1),
steps as (select conv_id, unnest(string_split(audit, '')) edit, unnest(range(1, length(audit) + 1)) pos from o where audit <> ''),
placed as (select *, sum(case when edit <> 'I' then 1 else 0 end) over (partition by conv_id order by pos) i from steps),
stays as (select *, row_number() over (partition by conv_id order by pos) r, first_value(case when edit = 'K' then initial else '' end) over (partition by conv_id order by pos) head
  from (select p.conv_id, pos, edit, k.role, k.body, k.initial from placed p left join k on k.conv_id is not distinct from p.conv_id and k.i = p.i and edit <> 'I' where edit <> 'D') x),
whole as (select conv_id, sha256(string_agg(case when edit = 'K' then role when (r - case when head = 's' then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end
    || ':' || case when edit = 'I' then '' else body end, chr(10) order by pos)) digest from stays group by 1),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 'blank') blank, count(*) filter (where fault = 'duplicate') duplicate,
    count(*) filter (where fault = 'truncated') truncated, count(*) filter (where before is not null and concat(before, initial) not in ('su', 'ua', 'au')) illegal from k group by 1)
select a.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, coalesce(o.cost, 0)::bigint as cost, coalesce(audit, '') audit, coalesce(digest, sha256('')) repaired_sha256
from (select distinct conv_id from conversations) a left join n on n.conv_id is not distinct from a.conv_id
  left join o on o.conv_id is not distinct from a.conv_id left join whole on whole.conv_id is not distinct from a.conv_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    turns = conversation_repair.repair(conversation_repair.damage(given))
    return conversation_repair.all_conversations(given, conversation_repair.summaries(turns))


@query("op12_substring_dedup", r"""
with w as materialized (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') w from documents),
s as materialized (select doc_id, unnest(range(1, len(w) - 18)) i, w from w where len(w) >= 20),
h as materialized (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) h from s),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) k from h) x where k > 1),
gone as (select doc_id, list_distinct(flatten(list(range(i, i + 20)))) g from again group by 1),
kept as (select w.doc_id, len(w) n, coalesce(len(g), 0) m, list_filter(w, lambda x, i: g is null or not list_contains(g, i)) k from w left join gone using (doc_id))
select doc_id, n::bigint n_words, m::bigint n_removed, sha256(array_to_string(k, ' ')) kept_sha256 from kept""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
