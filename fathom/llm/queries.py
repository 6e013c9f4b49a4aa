"""The corpus operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bagminhash, dialogue, exponion, langid, lbl, linededup, mixing, quality, rangejoin, secrets, warc, wrapper, wumanber


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_gam(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op2_bagminhash(spark, sf_dir):
    return bagminhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_metric_range_join(spark, sf_dir):
    return rangejoin.near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_warc_splittable(spark, sf_dir):
    records = warc.read_archives(spark, warc.write_archives(_read(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language_fusion(spark, sf_dir):
    return langid.identify(_read(spark, sf_dir, "documents"), host="source")


def language_of_pages(spark, sf_dir):
    """The same operator with all its evidence: text, the language that markup declares, address suffix and host."""
    pages = _read(spark, sf_dir, "pages")
    text = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)\\b.*?</\\1\\s*>", " "), "<[^<>]*>", " ")
    rows = pages.select(F.col("page_id"), text.alias("text"), langid.markup_language(F.col("html")).alias("declared"), "url")
    return langid.identify(rows, "page_id", declared="declared", url="url").withColumnRenamed("doc_id", "page_id")


def op6_wu_manber(spark, sf_dir):
    return wumanber.find_windows(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items")


def op7_mix_sources(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark, sf_dir):
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def secret_patterns(spark, sf_dir):
    """What the fixed patterns of the operator find, which SQL can express."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def unigram_scores(spark, sf_dir):
    """The base score of the language model, which SQL can express."""
    return op9_log_bilinear(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def op9_log_bilinear(spark, sf_dir):
    return lbl.score(_read(spark, sf_dir, "documents"))


def op10_wrapper_induction(spark, sf_dir):
    return wrapper.main_text(_read(spark, sf_dir, "pages"))


def op11_line_dedup(spark, sf_dir):
    return linededup.drop_repeated_lines(_read(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def op12_exponion(spark, sf_dir):
    return exponion.described(spark, *exponion.cluster(_read(spark, sf_dir, "embeddings")))


def op13_dial_repair(spark, sf_dir):
    conversations = _read(spark, sf_dir, "conversations")
    return dialogue.digests(conversations, dialogue.repair(dialogue.damaged(conversations)))


def queries() -> dict:
    found = [op1_quality_gam, op2_bagminhash, op3_metric_range_join, op4_warc_splittable, op5_language_fusion, op6_wu_manber, op7_mix_sources, op8_secret_scan, op9_log_bilinear, op10_wrapper_induction, op11_line_dedup, op12_exponion, op13_dial_repair, language_of_pages, secret_patterns, unigram_scores]
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# rows are told apart by number, as ids may repeat
_REACH = """
edges as (select a, b from links union all select b, a from links),
reach as (select a as node, a as root from edges union select r.node, e.b from reach r join edges e on e.a = r.root)"""

_OP2 = rf"""
with recursive d as materialized (select row_number() over () as k, doc_id, text from documents),
words as (select k, text, {_WORDS} as w from d),
pieces as (
  select k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0),
bags as (select k, array_to_string(w[i:i+4], ' ') as s, count(*) as n from pieces group by all),
sizes as (select k, sum(n) as total from bags group by all),
shared as (select x.k as a, y.k as b, sum(least(x.n, y.n)) as n from bags x join bags y on x.s = y.s and x.k > y.k group by all),
links as (
  select a, b from shared join sizes p on p.k = a join sizes q on q.k = b where n >= 0.8 * (p.total + q.total - n) - 1e-9
  union select x.k, y.k from words x join words y on x.text = y.text and x.k > y.k where len(x.w) = 0
  union select x.k, y.k from d x join d y on x.doc_id = y.doc_id and x.text is null and y.text is null and x.k > y.k),{_REACH},
roots as (select node, min(doc_id) as root from reach join d on k = reach.root group by node)
select doc_id, coalesce(least(root, doc_id), doc_id) as class_id, coalesce(least(root, doc_id), doc_id) = doc_id as kept from d left join roots on node = k
"""

_OP3 = f"""
with recursive d as materialized (select row_number() over () as k, vec_id, embedding from embeddings),
v as (
  select k, embedding, list_transform(embedding, lambda x: x::double) as e from d where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
u as (select k, embedding, e, len(e) as dim, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v where list_sum(list_transform(e, lambda x: x * x)) > 0),
links as (select x.k as a, y.k as b from u x join u y on x.k <> y.k and x.dim = y.dim where x.embedding = y.embedding or list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
counted as (select a, count(*) as n from links group by a),{_REACH},
roots as (select node, min(vec_id) as root from reach join d on k = reach.root group by node)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(least(root, vec_id), vec_id) as component_id, coalesce(least(root, vec_id), vec_id) is not distinct from vec_id as kept
from d left join counted on a = k left join roots on node = k
"""

_OP4 = """
with bits as (
  select page_id, sha1(coalesce(html, '')) as hex, octet_length(encode(coalesce(html, ''))) as n,
    list_reduce(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1)::int + 1, 4)), lambda x, y: x || y) as b
  from pages),
digests as (
  select page_id, hex, n, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * i::int + 1, 1)::int + 8 * substr(b, 5 * i::int + 2, 1)::int
    + 4 * substr(b, 5 * i::int + 3, 1)::int + 2 * substr(b, 5 * i::int + 4, 1)::int + substr(b, 5 * i::int + 5, 1)::int, 1)), lambda x, y: x || y) as digest,
    min(page_id) over (partition by hex, n) as first
  from bits)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from digests
"""

_OP6 = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
windows as (select distinct item_id, len(w[j:j+9]) as m, array_to_string(w[j:j+9], ' ') as s from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as j from i where len(w) > 0)),
lengths as (select distinct m from windows),
starts as (select doc_id, m, j, array_to_string(w[j:j+m-1], ' ') as s from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as j from d, lengths where len(w) >= m)),
hits as (select doc_id, item_id, j, m from starts join windows using (m, s)),
marked as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(j, j + m)) as k from hits) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as told from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(marked.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items, sha256(coalesce(told, '')) as items_sha256, coalesce(marked.n, 0) > 0 as contaminated
from d left join marked using (doc_id) left join items using (doc_id)
"""

_OP7 = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 12) as spot, row_number() over () as k from documents),
s as (select source, source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1) as weight from (select source, sum(size)::bigint as source_size from d group by source)),
t as (select source, source_size, weight, row_number() over (order by source_size::double / weight, source) as r, sum(source_size) over () as total from s),
levels as (select *, (total - coalesce(sum(3 * source_size) over (order by r rows between unbounded preceding and 1 preceding), 0))::double / sum(weight) over (order by r rows between current row and unbounded following) as level from t),
one as (select arg_min(level, r) filter (where 3 * source_size > weight * level) as level from levels),
goals as (select source, source_size, case when 3 * source_size <= weight * level then (3 * source_size)::double else weight * level end as target from t, one),
parts as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole, target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size as rest from goals),
sums as (select *, sum(size) over (partition by source order by spot, k) as upto, row_number() over (partition by source order by spot, k) as n from d),
edges as (select sums.source, min(n) filter (where size > 0 and upto >= rest) as n, arg_min(upto - rest <= rest - (upto - size), n) filter (where size > 0 and upto >= rest) as closed
  from sums join parts on sums.source is not distinct from parts.source where rest > 0 group by sums.source)
select doc_id, size, p.source_size::bigint as source_size, target,
  (size * (whole + case when sums.n < e.n or (sums.n = e.n and closed) then 1 else 0 end))::bigint as taken
from sums join parts p on sums.source is not distinct from p.source left join edges e on sums.source is not distinct from e.source
"""


_EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_ASSIGN = f"({_EITHER})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
# matches are set apart by a character of private use, so that they are every second part and their places are sums of lengths
_PATTERNS = f"""
with d as materialized (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
kinds(no, kind) as (values (0, 'assign'), (1, 'access'), (2, 'hex')),
parts as ({" union all ".join(f"select k, {no} as no, string_split(regexp_replace(text, '{pattern}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) as p from d" for no, pattern in enumerate((_ASSIGN, "AKIA[A-Z0-9]+", "[0-9a-f]+")))}),
rows_ as (select k, no, unnest(p) as p, unnest(range(1, len(p) + 1)) as i from parts),
placed as (select *, sum(length(p)) over (partition by k, no order by i) as e from rows_),
found as (
  select k, no, e - length(p) as s, e from placed where i % 2 = 0 and case no when 0 then length(regexp_extract(p, '{_ASSIGN}', 2)) >= 6 when 1 then length(p) >= 20 else length(p) >= 24 end),
told as (
  select k, count(*) filter (where no = 0) as a, count(*) filter (where no = 1) as b, count(*) filter (where no = 2) as c, string_agg(kind || ':' || s || ':' || e, ',' order by s, no, e) as spans
  from found join kinds using (no) group by k)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join told using (k)
"""

# a CRC-32 bit by bit
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)), lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, y: xor(c >> 1, (c & 1) * 3988292384))), 4294967295::bigint)"
_UNIGRAMS = rf"""
with d as materialized (select row_number() over () as k, doc_id, {_CRC.format("doc_id::varchar")} % 10 = 0 as held_out, list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), chr(57344)) as w from documents),
t as materialized (select k, held_out, unnest(w) as token from d),
c as materialized (select token, count(*) as c from t where not held_out group by token),
s as (select sum(c) as n, count(*) as v from c),
scored as (select k, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens, sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))) as base_score from t left join c using (token), s group by k)
select doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 3) as base_score from d join scored using (k)
"""


_OP11 = """
with d as materialized (select row_number() over () as k, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select k, doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from d),
keyed as materialized (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
found as (select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) + max((doc_id is null)::int) >= 3),
kept as (select k, i, line, keeper is null or coalesce(doc_id = keeper, false) as stays from keyed left join found using (key))
select doc_id, n_lines, n_dropped, kept_sha256
from d join (
  select k, count(*) as n_lines, count(*) filter (where not stays) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where stays), '')) as kept_sha256 from kept group by k) using (k)
"""

_ROUNDS = "".join(f"""
a{r} as materialized (
  select vec_k, arg_min(c, (d, c)) as c, min(d) as d
  from (select v.k as vec_k, c.c as c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{r} c) group by vec_k),
m{r} as (select c, i, sum(v[i]) as s, count(*) as n from (select a.c, v.v, unnest(range(1, 65)) as i from a{r} a join v on v.k = a.vec_k) group by c, i),
c{r + 1} as materialized (
  select c, coalesce(means.v, o.v) as v from c{r} o left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from m{r} group by c) means using (c)),""" for r in range(10))
_OP12 = f"""
with d as materialized (select row_number() over () as k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as f from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as materialized (select k, vec_id, list_transform(f, lambda x: x::bigint) as v from d where len(list_filter(f, lambda x: abs(x) >= 134217728)) = 0),
c0 as materialized (select row_number() over (order by sha256('3:' || vec_id) nulls last, v) - 1 as c, v from v order by c limit 8),{_ROUNDS}
l as (
  select vec_k, arg_min(c, (d, c)) as c, min(d) as d
  from (select v.k as vec_k, c.c as c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c10 c) group by vec_k)
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c10.v, ',')) as centroid_sha256
from l join v on v.k = vec_k join c10 using (c)
"""


# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; the cheapest way, then the least audit, for each state after each row
_OP13 = rf"""
with recursive ids as materialized (select conv_id, row_number() over () as k from (select distinct conv_id from conversations)),
o as materialized (
  select k, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format("(coalesce(o.conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as kind
  from conversations o join ids on o.conv_id is not distinct from ids.conv_id),
x as (
  select k, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(0, case when kind = 3 then 2 else 1 end)) as copy
  from o where kind <> 0),
n as materialized (select *, row_number() over (partition by k order by turn nulls first, role, sha256(text), copy) as i from x),
g as (select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by k, role, text order by i) > 1 as seen, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as unended from n),
f as materialized (select k, i, turn, role, text, role[1] as r, blank, seen and not blank as again, unended and not seen and not blank as cut_off, lag(role[1]) over (partition by k order by i) as before from g),
acts(letter) as (values ('D'), ('K'), ('R')),
s as (
  select k, 0::bigint as i, 0 as q, struct_pack(cost := 0, audit := '', said := ''::varchar) as best from ids
  union all
  select k, i, q, arg_min(best, (best.cost, best.audit)) from (
    select k, i, case when letter = 'D' then p when letter = 'R' then case p when 2 then 3 else 2 end else case r when 's' then 1 when 'u' then 2 else 3 end end as q,
      struct_pack(cost := cost + 3 * m + case letter when 'D' then 4 when 'R' then 3 else 0 end + case when cut_off and letter <> 'D' then 3 else 0 end, audit := audit || repeat('I', m) || letter,
        said := said || put || case letter when 'D' then '' when 'K' then chr(10) || role || ':' || text else chr(10) || case p when 2 then 'assistant' else 'user' end || ':' || text end) as best
    from (
      select s.k, f.i, s.best.cost as cost, s.best.audit as audit, s.best.said as said, m, role, text, r, cut_off, blank or again as dead, case m when 0 then q when 1 then case q when 2 then 3 else 2 end else case q when 2 then 2 else 3 end end as p,
        case m when 0 then '' when 1 then chr(10) || case q when 2 then 'assistant:' else 'user:' end else chr(10) || case q when 2 then 'assistant:' || chr(10) || 'user:' else 'user:' || chr(10) || 'assistant:' end end as put
      from s join f on f.k = s.k and f.i = s.i + 1, (values (0), (1), (2)) t(m)), acts
    where letter = 'D' or not dead and (letter = 'R' or p = 0 and r in ('s', 'u') or p in (1, 3) and r = 'u' or p = 2 and r = 'a'))
  group by k, i, q),
ends as (
  select s.k, arg_min(struct_pack(cost := best.cost + 3 * m, audit := best.audit || repeat('I', m), said := best.said || put), (best.cost + 3 * m, best.audit || repeat('I', m))) as best
  from s join (select ids.k, coalesce(max(f.i), 0) as i from ids left join f using (k) group by ids.k) z on z.k = s.k and z.i = s.i
    join (values (0, 0, ''), (1, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 1, chr(10) || 'assistant:'), (3, 0, '')) e(q, m, put) on e.q = s.q group by s.k),
told as (
  select ids.k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where blank) as blank, count(*) filter (where again) as duplicate, count(*) filter (where cut_off) as truncated,
    count(*) filter (where before || r not in ('su', 'ua', 'au')) as illegal
  from ids left join f using (k) group by ids.k)
select conv_id, gaps, blank, duplicate, truncated, illegal, best.cost::bigint as cost, best.audit as audit, sha256(substr(best.said, 2)) as repaired_sha256 from ids join told using (k) join ends using (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": _OP11, "op12_exponion": _OP12, "op13_dial_repair": _OP13, "op2_bagminhash": _OP2, "op3_metric_range_join": _OP3, "op4_warc_splittable": _OP4, "op6_wu_manber": _OP6, "op7_mix_sources": _OP7, "secret_patterns": _PATTERNS, "unigram_scores": _UNIGRAMS}
