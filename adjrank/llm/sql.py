"""DuckDB SQL for the queries that SQL can express, written from the contract."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def url_rules() -> str:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    return f"""with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rule_host, rule_path, rule_verdict) as (values {rules}),
judged as (
  select page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    max_by(rule_verdict, length(rule_host || rule_path)) as own
  from parts left join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by all)
select page_id, host, path, rule, case
  when own is not null then own
  when regexp_matches('.' || host, '[.](doubleclick[.]net|googlesyndication[.]com)$')
    or host <> '' and regexp_matches(path, '/(ads|adserver|banners|casino|porn|tracking)/|/wp-login[.]php')
  then 'block' else 'allow' end as verdict
from judged"""


def warc_revisits() -> str:
    return """with p as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
top as (select payload, max(page_id) as original from p group by payload)
select page_id, strlen(payload)::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 10 * (i // 8) + 1, 10))::bigint >> (35 - 5 * (i % 8))) & 31) + 1)::int, 1) for i in range(32)], '')
    as payload_digest,
  case when page_id = original then 'response' else 'revisit' end as record_type,
  case when page_id = original then null else original end as refers_to
from p join top using (payload)"""


def ngram_join() -> str:
    return f"""with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') as words
  from documents),
s as (
  select distinct doc_id, unnest(case when len(words) = 0 then []
    when len(words) < 4 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) as shingle
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
both_have as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from both_have join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * shared >= 85 * (x.n + y.n - shared)),
ways as (select a, b from links union all select b, a from links),
reached as (
  select doc_id, doc_id as place from documents
  union
  select r.doc_id, w.b from reached r join ways w on w.a = r.place)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.least as component_id
from documents d left join n using (doc_id)
join (select doc_id, min(place) as least from reached group by doc_id) r using (doc_id)"""


def statements() -> dict[str, str]:
    return {
        "op2_url_rules": url_rules(),
        "op3_warc_revisits": warc_revisits(),
        "op4_ngram_join": ngram_join(),
    }
