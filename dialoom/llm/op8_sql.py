"""DuckDB SQL of the line dedup, for whole tables and for a stage of the pipeline."""

SQL = r"""
with raw as (
  select row_number() over () as r, doc_id, text, case when text is null then [] else string_split(text, chr(10)) end as a from {docs}
), masked as (
  select r, doc_id, list_transform(a, lambda x: regexp_replace(trim(x, ' '), '[0-9]+', '0', 'g')) as m from raw
), lines as (
  select r, doc_id, i - 1 as pos, m[i] as masked, len(string_split(m[i], ' ')) as n_tokens,
    array_to_string(string_split(m[i], ' ')[1:2], ' ') as lead,
    list_min(list_filter(hashes, lambda x: x <> md5(m[i]))) as rest
  from (
    select r, doc_id, m, list_transform(list_filter(m, lambda x: x <> ''), lambda x: md5(x)) as hashes, unnest(generate_series(1, len(m))) as i from masked
  ) where m[i] <> ''
), kinds as (
  select * from (
    select *, sum(n) over (partition by n_tokens, lead) as in_leaf from (
      select n_tokens, lead, masked, count(*) as n from lines group by all
    )
  ) where in_leaf >= 10
), tokens as (
  select n_tokens, lead, spot, t[spot] as token, sum(n) as n from (
    select n_tokens, lead, n, string_split(masked, ' ') as t, unnest(generate_series(1, n_tokens)) as spot from kinds
  ) group by all
), shape as (
  select n_tokens, lead, spot, max({{'n': n, 'token': token}}) as top from tokens group by all
), total as (
  select n_tokens, lead, sum(n) as total from kinds group by all
), constant as (
  select n_tokens, lead, spot, top.token as token from shape join total using (n_tokens, lead) where top.n * 2 >= total
), agreed as (
  select k.n_tokens, k.lead, k.masked, count(c.token) as agreed from (
    select n_tokens, lead, masked, string_split(masked, ' ') as t, unnest(generate_series(1, n_tokens)) as spot from kinds
  ) k left join constant c on c.n_tokens = k.n_tokens and c.lead = k.lead and c.spot = k.spot and c.token = k.t[k.spot] group by all
), judged as (
  select l.*, case when agreed >= 0.8 * l.n_tokens then '' else l.masked end as template from lines l join agreed using (n_tokens, lead, masked)
), held as (
  select n_tokens, lead, template, rest, count(*) as n from (select distinct n_tokens, lead, template, doc_id, rest from judged) group by all
), recurs as (
  select n_tokens, lead, template from held group by all having count(*) >= 10 and count(*) >= 0.25 * sum(n)
), gone as (
  select r, list(distinct pos) as gone from judged semi join recurs using (n_tokens, lead, template) group by all
)
select doc_id, len(list_filter(a, lambda x: trim(x, ' ') <> '')) as n_lines, coalesce(len(gone), 0) as n_dropped,
  case when gone is null then text else array_to_string(list_transform(list_filter(generate_series(1, len(a)), lambda i: not list_contains(gone, i - 1)), lambda i: a[i]), chr(10)) end as text
from raw r left join gone g using (r)
"""


def line_dedup(docs: str = "documents") -> str:
    return SQL.format(docs=docs)
