"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {shift} & 31)::int + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0)
)

SQL: dict[str, str] = {
    "op5_url_filter": r"""
with recursive p as (
  select page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path
  from pages),
tags as (
  select host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) tag from p where url is not null),
hrefs as (
  select host, path, case
    when regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    when regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') then regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^"''\s>]+)', 1) end x
  from tags),
links as (
  select host || path src, case when starts_with(x, '//') then 'http:' || x when starts_with(x, '/') then 'http://' || host || x else x end u
  from hrefs where x <> ''),
edges as (
  select distinct src, dst from (select src, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) dst
  from links where contains(u, '://')) where src <> dst and src <> '' and dst <> ''),
both_ways as (select src a, dst b from edges union select dst, src from edges),
reach as (select a, a b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
nodes as (select distinct a k, regexp_extract(a, '^[^/]*') h, regexp_extract(a, '^[^/]*(.*)$', 1) t from both_ways),
keys as (select host h, path t from p union select h, t from nodes),
rules as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(act, rh, rp)),
best as (
  select h, t, arg_max(rh || rp, length(rh || rp)) rule, arg_max(act, length(rh || rp)) act
  from keys join rules on (h = rh or ends_with(h, '.' || rh)) and starts_with(t, rp) group by all),
class as (
  select r.a k, coalesce(bool_or(act = 'block'), false) and not coalesce(bool_or(act = 'allow'), false) blocked
  from reach r join nodes n on n.k = r.b left join best using (h, t) group by all)
select p.page_id, p.host, p.path, b.rule, coalesce(b.act, case when c.blocked then 'block' end, 'allow') verdict
from p left join best b on p.host = b.h and p.path = b.t left join class c on c.k = p.host || p.path""",
    "op7_warc": f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
g as (select h, max(page_id) original from p group by h)
select page_id, strlen(html)::bigint payload_bytes, {_BASE32} payload_digest,
  case when page_id = original then 'response' else 'revisit' end record_type,
  case when page_id <> original then original end refers_to
from p join g using (h)""",
    "op8_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, vec_id, score, (row_number() over (partition by query_id order by score desc, vec_id))::int rank from s
qualify rank <= 5""",
    "op9_secrets": r"""
with d as (select doc_id, coalesce(text, '') t from documents),
hits as (
  select doc_id, t, kind, ord, regexp_extract_all(t, p, 0) m, regexp_extract_all(t, p, g) v, regexp_split_to_array(t, p) gaps
  from d, (values ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
    ('access', 1, 'AKIA[A-Z0-9]+', 0), ('hex', 2, '[0-9a-f]{16,}', 0), ('entropy', 3, '[A-Za-z0-9+/_=-]+', 0)) k(kind, ord, p, g)),
spans as (
  select doc_id, kind, ord, unnest(range(1, len(m) + 1)) i, m, v, gaps, list_transform(m, lambda x: length(x)) lm, list_transform(gaps, lambda x: length(x)) lg from hits),
flat as (
  select doc_id, kind, ord, m[i] m, v[i] v, (coalesce(list_sum(lg[1:i]), 0) + coalesce(list_sum(lm[1:i - 1]), 0))::bigint s from spans
  where (kind = 'assign' and length(v[i]) >= 12) or (kind = 'access' and length(m[i]) >= 18) or kind = 'hex'
    or (kind = 'entropy' and length(m[i]) >= 20 and regexp_matches(m[i], '[0-9]'))),
high as (
  select * replace (case when h then 'entropy_hex' else 'entropy_base64' end as kind, case when h then 3 else 4 end as ord) from (
    select *, regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') h from flat where kind = 'entropy' and not regexp_matches(m, '(?i)example|sample|dummy|placeholder|changeme|test|0123456789|abcdefghij|^d41d8cd98f00b204e9800998ecf8427e$|^da39a3ee5e6b4b0d3255bfef95601890afd80709$|^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$'))
  where list_max(list_transform(range(1, length(m) - 18), lambda j: list_aggregate(string_split(substr(m, j, 20), ''), 'entropy'))) >= case when h then 3.0 else 3.8 end),
found as (
  select doc_id, kind, ord, s, kind || ':' || s || ':' || (s + length(m)) x from flat where kind <> 'entropy'
  union all select doc_id, kind, ord, s, kind || ':' || s || ':' || (s + length(m)) from high),
g as (
  select doc_id, count(*) filter (kind = 'assign') a, count(*) filter (kind = 'access') b, count(*) filter (kind = 'hex') c,
    string_agg(x, ',' order by s, ord) filter (ord < 3) base, string_agg(x, ',' order by s, ord) spans from found group by 1)
select doc_id, coalesce(a, 0) n_assign, coalesce(b, 0) n_access, coalesce(c, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join g using (doc_id)""",
}


def mixing_sql(targets) -> str:
    """Proportional fitting as a chain of windows over the cells, then bisection for the scale."""
    dims = ("source", "lang", "topic")
    named = {d: getattr(targets, d) for d in dims}
    listed = lambda d: ", ".join(f"'{k}'" for k in named[d])
    goals = {d: ", ".join(f"('{k}', {float(v)!r}::double)" for k, v in {**named[d], "other": targets.other}.items()) for d in dims}
    ctes = [
        r"k as (select doc_id, case when source in (" + listed("source") + r") then source else 'other' end source_key, case when lang in (" + listed("lang") + r") then lang else 'other' end lang_key, "
        r"case when topic in (" + listed("topic") + r") then topic else 'other' end topic_key, tokens from (select *, case when text is null then 'general' when regexp_matches(text, '(?i)licen[cs]ed? under|copyright|licence|license') then 'legal' "
        r"when contains(text, '|') then 'tables' when regexp_matches(text, '[0-9]{4}') then 'numbers' else 'general' end topic, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint tokens from documents))",
        "c as materialized (select source_key, lang_key, topic_key, sum(tokens)::double / (select sum(tokens) from k) a from k group by 1, 2, 3 having sum(tokens) > 0)",
    ]
    for d in dims:
        ctes.append(f"g_{d} as materialized (select v.k, v.t / sum(v.t) over () t from (values {goals[d]}) v(k, t) where v.k in (select {d}_key from c))")
    ctes.append("w0 as (select c.*, a w, g_source.t t_source, g_lang.t t_lang, g_topic.t t_topic from c join g_source on g_source.k = source_key join g_lang on g_lang.k = lang_key join g_topic on g_topic.k = topic_key)")
    steps = 3 * targets.rounds
    for i in range(steps):
        d = dims[i % 3]
        kind = " materialized" if i % 10 == 9 or i == steps - 1 else ""
        ctes.append(f"w{i + 1} as{kind} (select * replace (w * t_{d} / sum(w) over (partition by {d}_key) as w) from w{i})")
    ctes.append("b0 as (select -30::double lo, 30::double hi)")
    for i in range(60):
        ctes.append(f"b{i + 1} as materialized (select case when s < {targets.tokens_kept!r} then m else lo end lo, case when s < {targets.tokens_kept!r} then hi else m end hi from (select lo, hi, (lo + hi) / 2 m, sum(a * least(1, exp((lo + hi) / 2) * w / a)) s from b{i}, w{steps} group by lo, hi))")
    ctes.append(f"p as (select source_key, lang_key, topic_key, w / a weight, least(1, exp(hi) * w / a) probability from w{steps}, b60)")
    return "with " + ",\n".join(ctes) + f"""
select doc_id, source_key, lang_key, topic_key, tokens, round(coalesce(weight, 1), 6) weight, round(coalesce(probability, 1), 6) probability,
  ('0x' || substr(md5('{targets.seed}:' || doc_id), 1, 8))::bigint / 4294967296.0 < coalesce(probability, 1) kept
from k left join p using (source_key, lang_key, topic_key)"""
