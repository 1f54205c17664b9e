"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""

ORACLES: dict[str, str] = {}

ORACLES["op6_url_reputation"] = r"""
with seen as (
  select page_id, coalesce(translate(regexp_extract(url, '^(?s:.)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
         coalesce(regexp_extract(url, '^(?s:.)*?://[^/?#]*([^?#]*)', 1), '') path
  from pages),
marks as (
  select doc_id, count(toxic) n, sum(case when toxic = 1 then 1 else 0 end) bad from labels where doc_id is not null and toxic is not null group by 1),
named as (
  select s.*, coalesce(n, 0) n, coalesce(bad, 0) bad, string_split(rtrim(regexp_replace(host, ':[0-9]*$', ''), '.'), '.') parts
  from seen s left join marks on page_id = doc_id),
cut as (
  select host, n, bad, array_to_string(parts, '.') name, regexp_full_match(array_to_string(parts, '.'), '[0-9]{1,3}([.][0-9]{1,3}){3}|\[.*') address, parts,
         array_to_string(parts[-2:], '.') in ('ac.uk','co.in','co.jp','co.kr','co.nz','co.uk','co.za','com.au','com.br','com.cn','com.mx','com.tr','gov.uk','net.au','or.jp','org.au','org.uk') two
  from named),
hosts as (
  select host, case when address then name else array_to_string(parts[-(case when two then 2 else 1 end):], '.') end suffix,
         case when address then name else array_to_string(parts[-(case when two then 3 else 2 end):], '.') end domain,
         sum(n)::double n, sum(bad)::double bad from cut group by all),
h_p as (select domain, (sum(bad) + 0.5e0) / (sum(n) + 1) p from hosts group by 1),
h_k as (
  select case when g = 0 or nt - nn / nt - (g - 1) <= 0 then 1e0 when s - (g - 1) <= 0 then 10000e0 else least(greatest((nt - nn / nt - (g - 1)) / (s - (g - 1)) - 1, 1e0), 10000e0) end k
  from (select sum(n * pow(bad / n - p, 2) / (p * (1 - p))) s, count(*) g, sum(n) nt, sum(n * n) nn from hosts join h_p using (domain) where n > 0)),
h_e as (select hosts.*, n / (1 + greatest(n - 1, 0) / (k + 1)) e_n, bad / (1 + greatest(n - 1, 0) / (k + 1)) e_bad from hosts, h_k),
domains as (select domain, suffix, sum(e_n) n, sum(e_bad) bad from h_e group by all),
d_p as (select suffix, (sum(bad) + 0.5e0) / (sum(n) + 1) p from domains group by 1),
d_k as (
  select case when g = 0 or nt - nn / nt - (g - 1) <= 0 then 1e0 when s - (g - 1) <= 0 then 10000e0 else least(greatest((nt - nn / nt - (g - 1)) / (s - (g - 1)) - 1, 1e0), 10000e0) end k
  from (select sum(n * pow(bad / n - p, 2) / (p * (1 - p))) s, count(*) g, sum(n) nt, sum(n * n) nn from domains join d_p using (suffix) where n > 0)),
d_e as (select domains.*, n / (1 + greatest(n - 1, 0) / (k + 1)) e_n, bad / (1 + greatest(n - 1, 0) / (k + 1)) e_bad from domains, d_k),
suffixes as (select suffix, sum(e_n) n, sum(e_bad) bad from d_e group by all),
s_p as (select (sum(bad) + 0.5e0) / (sum(n) + 1) p from suffixes),
s_k as (
  select case when g = 0 or nt - nn / nt - (g - 1) <= 0 then 1e0 when s - (g - 1) <= 0 then 10000e0 else least(greatest((nt - nn / nt - (g - 1)) / (s - (g - 1)) - 1, 1e0), 10000e0) end k
  from (select sum(n * pow(bad / n - p, 2) / (p * (1 - p))) s, count(*) g, sum(n) nt, sum(n * n) nn from suffixes , s_p where n > 0)),
s_e as (select suffixes.*, n / (1 + greatest(n - 1, 0) / (k + 1)) e_n, bad / (1 + greatest(n - 1, 0) / (k + 1)) e_bad from suffixes, s_k),
tops as (select sum(e_n) n, sum(e_bad) bad from s_e),
s_prior as (
  select suffix, s.n, s.bad, (t.bad - e_bad + 0.5e0) / (t.n - e_n + 1) m, greatest(1 / (1 / (k + 1) + 1 / (t.n - e_n + 2)) - 1, 1e0) c from s_e s, tops t, s_k),
d_prior as (
  select domain, d.n, d.bad, (s.bad - e_bad + c * m) / (s.n - e_n + c) m, greatest(1 / (1 / (k + 1) + 1 / (s.n - e_n + c + 1)) - 1, 1e0) c from d_e d join s_prior s using (suffix), d_k),
h_prior as (
  select host, h.n, h.bad, (d.bad - e_bad + c * m) / (d.n - e_n + c) m, greatest(1 / (1 / (k + 1) + 1 / (d.n - e_n + c + 1)) - 1, 1e0) c from h_e h join d_prior d using (domain), h_k),
known as (select host, (bad + c * m) / (n + c) r, n + c w from h_prior),
rules(h, pre, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (
  select host, path, h || pre as rule, verdict, row_number() over (partition by host, path order by length(h || pre) desc, length(h) desc) nth
  from (select distinct host, path from seen) u join rules on (u.host = h or u.host like '%.' || h) and starts_with(u.path, pre))
select page_id, s.host, s.path, f.rule, coalesce(f.verdict, case when greatest(r - 1.645e0 * sqrt(r * (1 - r) / (w + 1)), 0e0) > 0.5e0 then 'block' else 'allow' end) verdict
from seen s left join known using (host) left join fit f on f.host = s.host and f.path = s.path and f.nth = 1
"""

ORACLES["op10_ngram_join"] = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
grams as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) g from words where len(w) > 0),
sizes as (select doc_id, count(*) n from grams group by 1),
met as (select a.doc_id a, b.doc_id b, count(*) common from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
reach(a, b) as (select doc_id, doc_id from sizes union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, min(b) m from reach group by 1)
select d.doc_id, coalesce(n, 0) n_shingles, coalesce(m, d.doc_id) component_id from documents d left join sizes s on s.doc_id = d.doc_id left join least on a = d.doc_id
"""

ORACLES["op11_chat_format"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
known as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) before,
         length(regexp_replace(text, '([<\[])(\\*)(INST\]|/INST\]|SAYS\]|NEXT\]|s>|/s>)', '\1\\\2\3', 'g')) text_chars,
         length(regexp_replace(role, '([<\[])(\\*)(INST\]|/INST\]|SAYS\]|NEXT\]|s>|/s>)', '\1\\\2\3', 'g')) role_chars
  from turns)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) loss_sha256,
       (7 + sum(text_chars + case when role is not distinct from before then 6 else role_chars + 19 end))::bigint formatted_chars
from known group by conv_id
"""
