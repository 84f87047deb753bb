"""DuckDB SQL for the registered queries."""

from ..operators import pii
from ..operators.score import TEMPLATE
from ..operators.types import pairs
from .queries import EN_CUT, EN_SKIP, MATCH, MERGE, WORDS


def _list(names):
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


C = f"""c as (
  select conv_id as chat, turn as ord, case when role = 'system' then 'system notification' else 'text' end as type_name,
    cast(role = 'assistant' as int) as is_sender, role as talker, coalesce(text, '') as msg,
    epoch_us(timestamp '2024-01-01') + (conv_id * 86400 + turn * 60) * 1000000 as t from conversations
)"""
E = """e as (
  select user_id as chat, event_id, epoch_us(ts) as t, event_type || ':' || cast(cast(floor(value) as bigint) as varchar) as msg,
    case event_type when 'error' then 'cut' when 'signup' then 'sticker' else 'text' end as type_name,
    case when event_type = 'click' then 0 else 1 end as is_sender, case when event_type = 'click' then 'peer' else 'me' end as talker,
    event_type = 'purchase' and user_id % 2 = 0 as is_forward from events
)"""
D = "d as (select doc_id, coalesce(text, '') as msg from documents)"
G = f"""r as (
  select *, type_name in {_list(EN_CUT)} as is_cut from e where type_name not in {_list(EN_SKIP)}
), l as (
  select *, lag(is_cut) over w as b, is_cut or lag(is_cut) over w is null or lag(is_cut) over w or is_sender <> lag(is_sender) over w
    or talker is distinct from lag(talker) over w or abs(t - lag(t) over w) > {MERGE}000000 as fresh
  from r window w as (partition by chat order by t, event_id)
), n as (
  select *, sum(cast(fresh as int)) over (partition by chat order by t, event_id rows unbounded preceding) as gid from l
), k as (select * from n where not is_cut or b = false), s as (
  select *, case when lag(msg) over v is null or right(lag(msg) over v, 1) in ('。', '.', '！', '!', '？', '?', '…', '，', ',') then '' else chr(10) end as sep
  from k window v as (partition by chat, gid order by t, event_id)
), g as (
  select chat, gid, count(*) as n, arg_min(event_id, (t, event_id)) as first_id, min((t, event_id)) as ord, first(is_cut) as is_cut, first(is_sender) as is_sender,
    first(talker) as talker, max(t) as t, string_agg(sep || msg, '' order by t, event_id) as msg from s group by chat, gid
)"""
_CLASS = """q0 as (select *, sum(cast(is_cut as int)) over (partition by chat order by ord rows unbounded preceding) as seg from {g}),
q1 as (
  select *, lag(is_sender) over v as s1, lag(t) over v as t1, lag(t, 2) over v as t2, lag(msg) over v as m1, lag(ord) over v as o1,
    last_value(case when is_sender = 0 then talker end ignore nulls) over (partition by chat, seg order by ord rows unbounded preceding) as peer
  from q0 where not is_cut window v as (partition by chat, seg order by ord)
), q2 as (
  select *, coalesce(is_sender = 1 and s1 = 0, false) as paired, coalesce(is_sender = 1 and s1 = 0 and abs(t - t1) > {w}000000, false) as dropped from q1
), q3 as (
  select *, case when coalesce(lag(dropped) over v, false) then t2 else t1 end as ref from q2 window v as (partition by chat, seg order by ord)
), q as (
  select *, sum(cast(coalesce(not paired and abs(t - ref) > {w}000000, false) as int)) over (partition by chat, seg order by ord rows unbounded preceding) as conv,
    is_sender = 1 and not dropped as is_turn, case when paired then m1 else '<begin_chat>' end as question from q3
), dl as (
  select chat, seg, conv, min(ord) as first_ord, count(*) filter (is_turn) as n_turns, arg_max(t, ord) filter (not dropped) as time_us, coalesce(arg_max(peer, ord), '') as talker,
    string_agg(question || '>' || msg, '|' order by ord) filter (is_turn) as text, sum(length(question) + length(msg)) filter (is_turn) as chars,
    string_agg('Q: ' || question || chr(10) || 'A: ' || msg, chr(10) order by ord) filter (is_turn) as prompt,
    string_agg(replace(question, '<begin_chat>', '<begin_chat>你应该说：' || msg || '</begin_chat>') || chr(31) || msg, chr(31) order by ord) filter (is_turn) as contents,
    arg_min(question, ord) filter (is_turn) as opener
  from q group by chat, seg, conv having count(*) filter (is_turn) > 0
)"""
Q = _CLASS.format(g="g", w=MATCH)
T = f"ct as (select *, false as is_cut from c where type_name not in {_list(EN_SKIP)}), " + _CLASS.format(g="ct", w=300)
PICTURED = f"""ct as (
  select * exclude (msg), case when (ord + chat) % 2 = 0 and is_sender = 0 then '<image>' || msg else msg end as msg, false as is_cut from c where type_name not in {_list(EN_SKIP)}
), """ + _CLASS.format(g="ct", w=300) + """, im as (
  select chat, seg, conv, count(*) filter (is_turn and question like '<image>%') as n_images,
    string_agg(replace(question, '<image>', chr(10) || '[图片描述: seen img' || o1 || ']' || chr(10)) || '>' || msg, '|' order by ord) filter (is_turn) as captioned
  from q group by all
)"""
LONE = "not (n_turns = 1 and opener = '<begin_chat>')"
LUHN = "list_sum(list_transform(range(1, length(x) + 1), lambda i: case when (length(x) - i) % 2 = 1 then case when cast(x[i] as int) * 2 > 9 then cast(x[i] as int) * 2 - 9 else cast(x[i] as int) * 2 end else cast(x[i] as int) end)) % 10 = 0"
SCORED = "sc as (select d.doc_id as id, cast(coalesce(l.score, 0) as int) as score from d left join (select doc_id, max(quality * 2 + toxic) as score from labels group by doc_id) l using (doc_id))"


def _m(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def _where(check):
    return f"with {D} select doc_id from d where {check}"


NUMERIC = f"(regexp_matches(msg, {_m(pii.bounded(pii.NUMERIC_ID))}) or regexp_matches(msg, {_m(chr(92) * 2 + 'u[0-9A-Fa-f]{4}|' + chr(92) * 2 + 'xa0')}))"
TYPE_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in pairs().items())
MOVED = "substr(x, 5) || substr(x, 1, 4)"
MOD97 = f"list_reduce(list_concat([0], list_transform(range(1, length(x) + 1), lambda i: case when ascii(substr({MOVED}, i, 1)) >= 65 then ascii(substr({MOVED}, i, 1)) - 55 else ascii(substr({MOVED}, i, 1)) - 48 end)), lambda a, c: (case when c >= 10 then a * 100 + c else a * 10 + c end) % 97) = 1"
CHECK = {"CREDIT_CARD": f"(select {LUHN} from (select regexp_replace(y, '[^0-9]', '', 'g') as x))", "IBAN_CODE": f"(select {MOD97} from (select y as x))"}


def _spans(kind):
    """Matches between edges, one after the other: the next is looked for from the edge behind the last."""
    score, pattern = pii.PATTERNS[kind]
    edge = r"[^\p{L}\p{N}_]"
    whole, first = _m(edge + "(" + pattern + ")" + edge), _m("(?s)^(.*?)" + edge + "(" + pattern + ")" + edge)
    surer = f"case when contains(string_split(y, '@')[1], '+') then {pii.PLUS} else {score} end" if kind == "EMAIL_ADDRESS" else score
    return f"""select doc_id, msg, '{kind}' as entity_type, start, start + length(y) as stop, {surer} as score, y as text from (
      with recursive x as (
        select doc_id, msg, cast(null as varchar) as y, cast(null as bigint) as start, cast(-1 as bigint) as base, ' ' || msg || ' ' as rest from d
        union all
        select doc_id, msg, m.hit, base + length(m.pre) + 1, base + length(m.pre) + 1 + length(m.hit), substr(rest, length(m.pre) + length(m.hit) + 2) from (
          select *, regexp_extract(rest, {first}, ['pre', 'hit']) as m from x where regexp_matches(rest, {whole})
        )
      ) select * from x where y is not null
    ) where {CHECK.get(kind, 'true')}"""


def _sp(kinds):
    return "sp as (" + " union all ".join(map(_spans, kinds)) + ")"


ANON = f"""with {D}, {_sp(pii.PATTERNS)}, o as (
  select *, max(stop) over (partition by doc_id order by start, stop, -score, entity_type rows between unbounded preceding and 1 preceding) as reach from sp
), i as (
  select *, sum(cast(reach is null or reach <= start as int)) over (partition by doc_id order by start, stop, -score, entity_type rows unbounded preceding) as gid from o
), r as (
  select doc_id, gid, any_value(msg) as msg, min(start) as start, max(stop) as stop, arg_min(entity_type, {{'a': -score, 'b': start, 'c': entity_type}}) as kind from i group by doc_id, gid
), z as (
  select *, coalesce(lag(stop) over (partition by doc_id order by start), 0) as prev from r
), t as (
  select doc_id, string_agg(substr(msg, prev + 1, start - prev) || '<' || kind || '>', '' order by start) as head, max(stop) as prev from z group by doc_id
)
select d.doc_id, case when head is null then msg else head || substr(msg, prev + 1) end as text from d left join t using (doc_id)"""
STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\x0b\\x85\\p{{Z}}]+|[\\s\\x0b\\x85\\p{{Z}}]+$', '', 'g')"
def _telegram(chat, order):
    return f"""with m as (
  select {chat} as chat, {order} as seq, turn, role, turn % 6 as k, replace(case when turn % 6 < 4 then coalesce(text, '') else '' end, chr(92) || '"', '') as text from conversations
), n as (
  select *, {STRIP("replace(" + STRIP("text") + ", chr(10), ' ')")} as said, ['text', 'image', 'sticker', 'video', 'file', 'location'][k + 1] as type_name,
    ['', 'p.jpg', 'f.bin', 'f.bin', 'f.bin', 'lat:1.5,lng:2.5'][k + 1] as src, ['', '', '', '', 'notes.txt', 'HereThere'][k + 1] as other from m
), w as (
  select *, k <> 0 and said <> '' as caption, 1 + coalesce(sum(1 + cast(k <> 0 and said <> '' as int)) over (partition by chat order by seq rows between unbounded preceding and 1 preceding), 0) as id from n
), x as (
  select chat, cast(id as bigint) as id, type_name, role, case when said <> '' then said when other <> '' then other else type_name end as msg, src, k from w where said <> '' or src <> ''
  union all select chat, cast(id + 1 as bigint), 'text', role, said, '', k from w where caption
)
select chat, id, type_name, cast(role = 'assistant' as int) as is_sender, role as talker, msg, src, k = 3 as is_forward, 1704067200250000 as t_us from x"""


SQL = {
    "skip_type_filter": f"with {C} select chat, count(*) as n from c where type_name not in {_list(EN_SKIP)} group by chat",
    "own_forward_filter": f"with {E} select chat, type_name, count(*) as n from e where not (is_sender = 1 and is_forward) group by all",
    "text_predicate": f"with {E} select event_id, lower(type_name) in ('文本', 'text') as is_text from e",
    "blocked_word_filter": _where(" and ".join(f"not contains(replace(msg, chr(10), ''), '{w}')" for w in WORDS)),
    "blocked_word_list": f"with {D}, w as (select distinct unnest(string_split(coalesce(text, ''), ' ')) as w from benchmark) select doc_id from d where not exists (select 1 from w where length(w) >= 9 and contains(replace(msg, chr(10), ''), w))",
    "pii_numeric_id": _where(NUMERIC),
    "pii_email": _where(f"regexp_matches(msg, {_m(pii.EMAIL)})"),
    "pii_ipv4": _where(f"regexp_matches(msg, {_m(pii.bounded(pii.IPV4))})"),
    "pii_credit_card": f"with {D}, f as (select doc_id, regexp_replace(unnest(regexp_extract_all(msg, {_m(pii.CARD)})), '[^0-9]', '', 'g') as x from d) select distinct doc_id from f where {LUHN}",
    "pii_any_flag": f"with d as (select doc_id, replace(coalesce(text, ''), chr(10), '') as msg from documents), {_sp([k for k in pii.entities('zh') if k not in ('NUMERIC_ID', 'EMAIL_ADDRESS')])}, h as (select distinct doc_id from sp) select d.doc_id, {NUMERIC} or regexp_matches(msg, {_m(pii.EMAIL)}) or h.doc_id is not null as has_pii from d left join h using (doc_id)",
    "pii_span_table": f"with {D}, {_sp(pii.PATTERNS)} select doc_id, entity_type, start, stop, text from sp",
    "pii_anonymize": ANON,
    "cut_collapse": f"with {E}, {G} select chat, cast(sum(cast(is_cut as int)) as bigint) as cuts, count(distinct gid) as items from k group by chat",
    "merge_consecutive": f"with {E}, {G} select chat, first_id, n, is_cut, is_sender, talker, t as last_us, left(msg, 2048) as msg from g",
    "merge_truncate": f"with {E}, {G} select chat, first_id, case when n > 1 then left(msg, 25) else msg end as msg from g",
    "qa_turns": f"with {E}, {G}, {Q} select chat, first_id as reply_id, question, msg as answer from q where is_turn",
    "qa_dialogues": f"with {E}, {G}, {Q} select chat, first_ord[2] as first_id, n_turns, time_us, talker, text from dl",
    "qa_sliced": f"with {E}, {G}, {Q} select chat, first_ord[2] as first_id, n_turns, time_us, talker, text from dl",
    "qa_global": f"with {E}, {G}, gg as (select * replace (0 as chat) from g), {_CLASS.format(g='gg', w=MATCH)} select first_ord[2] as first_id, n_turns, time_us, talker, text, cast(row_number() over (order by first_ord) - 1 as varchar) as id from dl",
    "qa_dropped_replies": f"with {E}, {G}, {Q} select chat, first_id as reply_id from q where dropped",
    "qa_filters": f"with {E}, {G}, {Q} select chat, first_ord[2] as first_id, cast(chars as bigint) as chars from dl where chars <= 120 and {LONE}",
    "qa_system_prompt": f"with {C}, {T} select chat, 'sys' || chr(10) || ' 现在时间是' || strftime(make_timestamp(time_us), '%m-%d %H:%M') || case when chat % 3 = 0 then chr(10) || ' 对方是你的friend，你们正在聊天' else '' end as system from dl",
    "qa_begin_chat_rewrite": f"with {E}, {G}, {Q}, x as (select dl.chat, first_ord[2] as first_id, q.question, q.msg, row_number() over (partition by dl.chat, dl.seg, dl.conv order by q.ord) - 1 as i from dl join q on q.chat = dl.chat and q.seg = dl.seg and q.conv = dl.conv and q.is_turn) "
    "select chat, first_id, i * 2 as pos, 'user' as role, replace(question, '<begin_chat>', '<begin_chat>你应该说：' || msg || '</begin_chat>') as content from x union all select chat, first_id, i * 2 + 1, 'assistant', msg from x",
    "qa_numbered": f"with {E}, {G}, {Q} select cast(row_number() over (order by chat, first_ord) - 1 as varchar) as id, chat, first_ord[2] as first_id from dl where chars <= 2048 and {LONE}",
    "image_count_filter": f"with {C}, {PICTURED} select chat, first_ord as first_turn, n_images as n from dl join im using (chat, seg, conv) where n_images <= 1 and {LONE}",
    "caption_replace": f"with {E} select event_id, msg || chr(10) || '[图片描述: pic' || chat || ']' || chr(10) || 'b' || chr(10) || '[图片描述缺失]' || chr(10) || 'b' as text from e",
    "prompt_render": f"with {C}, {T} select chat, prompt from dl",
    "judge_parse": "select event_id, case when event_id % 8 between 1 and 5 then cast(event_id % 8 as int) end as score from events",
    "score_join_default0": f"with {D}, {SCORED} select id, score from sc",
    "score_distribution": f"with {D}, {SCORED} select score, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as percent from sc group by score",
    "accept_score": f"with {D}, {SCORED} select id, score from sc where score >= 2",
    "accept_fallback": f"with {D}, {SCORED} select id, score from sc",
    "length_histogram": f"with {D} select length(msg) // 512 * 512 as bucket, count(*) as n from d group by all",
    "length_cdf": f"with {D}, h as (select length(msg) // 512 * 512 as bucket, count(*) as n from d group by all) select '< ' || (bucket + 512) as label, bucket, n, cast(sum(n) over (order by bucket rows unbounded preceding) as bigint) as running, round(100.0 * sum(n) over (order by bucket rows unbounded preceding) / sum(n) over (), 2) as percent from h",
    "type_translate": f"with {E}, v(en, zh) as (values {TYPE_VALUES}) select event_id, v.zh as zh_cn from e left join v on v.en = lower(e.type_name)",
    "translation_pair": f"with {E}, v(en, zh) as (values {TYPE_VALUES}) select n, v.en, v.zh as zh_cn from (select type_name, count(*) as n from e group by all) t left join v on v.en = lower(t.type_name)",
    "relation_lookup": f"with {C}, {T} select chat, first_ord as first_turn, 'sys' || case when coalesce(n_name, '') <> '' then chr(10) || ' 对方是你的' || n_name || '，你们正在聊天' else '' end as system from dl left join nation on n_nationkey = chat",
    "image_exists_lookup": f"""with {E}, x as (
      select event_id, msg, is_sender, event_id % 2 = 0 as image, 'C:' || chr(92) || 'pics' || chr(92) || 'img' || (event_id % 9) || '.dat' as src, 'images/img' || r_regionkey || '.png' as hit,
      from e left join region on r_regionkey = event_id % 9
    ) select event_id, case when not image then 'text' when hit is not null and is_sender = 0 then 'image' else 'Cut' end as type_name, case when image and hit is not null and is_sender = 0 then hit else src end as src,
      case when image and hit is not null and is_sender = 0 then '<image>' else msg end as msg, case when image and hit is not null and is_sender = 0 then 'image' else '' end as modality from x""",
    "sharegpt_export": f"with {C}, {T} select chat || ':' || seg || ':' || conv as id, strftime(make_timestamp(time_us), '%Y-%m-%dT%H:%M:%S') as time, 0 as score, n_turns * 2 as n_messages, contents, '' as system from dl where {LONE}",
    "pii_any_flag_en": f"with {D}, {_sp([k for k in pii.entities('en') if k != 'NUMERIC_ID'])}, h as (select distinct doc_id from sp) select d.doc_id, {NUMERIC} or h.doc_id is not null as has_pii from d left join h using (doc_id)",
    "captioned_dialogues": f"with {C}, {PICTURED} select chat, first_ord as first_turn, captioned as text from dl join im using (chat, seg, conv)",
    "captioned_sequence": f"""with {C}, {PICTURED}, o as (
      select *, question like '<image>%' as pic, question like '<image>%' and chat % 5 <> 0 as mark from q where is_turn
    ), p as (select row_number() over (order by chat, seg, conv, ord) as k, 'seen img' || o1 as caption from o where pic),
    m as (select chat, seg, conv, ord, row_number() over (order by chat, seg, conv, ord) as k from o where mark),
    f as (
      select o.*, case when mark then replace(question, '<image>', case when caption is null then chr(10) || '[图片描述缺失]' || chr(10) else chr(10) || '[图片描述: ' || caption || ']' || chr(10) end) else replace(question, '<image>', '') end as said
      from o left join m using (chat, seg, conv, ord) left join p using (k)
    )
    select chat, dl.first_ord as first_turn, x.text from dl join (select chat, seg, conv, string_agg(said || '>' || msg, '|' order by ord) as text from f group by all) x using (chat, seg, conv)""",
    "judge_flow": f"with {C}, {PICTURED} select chat, first_ord as first_turn, cast(case when n_images > 0 then 6 else 1 + ({len(TEMPLATE.format(id='', chat=''))} + 2 * length(chat || ':' || seg || ':' || conv) + length(prompt)) % 5 end as int) as score from dl join im using (chat, seg, conv)",
    "dataset_cleaned": f"with {C}, {PICTURED}, sc as (select chat || ':' || seg || ':' || conv as id, n_turns * 2 as n_messages, contents, cast(case when n_images > 0 then 6 else 1 + ({len(TEMPLATE.format(id='', chat=''))} + 2 * length(chat || ':' || seg || ':' || conv) + length(prompt)) % 5 end as int) as score from dl join im using (chat, seg, conv)) select id, score, n_messages, contents from sc where score >= 4 or not exists (select 1 from sc where score >= 4)",
    "array_export": f"with {C}, {T} select chat || ':' || seg || ':' || conv as id, strftime(make_timestamp(time_us), '%Y-%m-%dT%H:%M:%S') as time, 0 as score, n_turns * 2 as n_messages, contents, '' as system from dl where {LONE}",
    "capped_conversations": f"with {E}, r as (select chat, event_id, (row_number() over (partition by chat order by t, event_id) - 1) // 6 as conversation from e) select chat, conversation, count(*) as n, min(event_id) as least_id from r group by all",
    "telegram_parse": _telegram("cast(conv_id as varchar)", "turn"),
    "telegram_files": _telegram("'part ' || (conv_id % 8)", "(conv_id, turn)"),
    "token_length_cdf": f"with {D}, w as (select len(list_filter(string_split_regex(msg, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as n from d), h as (select n // 256 * 256 as bucket, count(*) as n from w group by all) select '< ' || (bucket + 256) as label, bucket, n, cast(sum(n) over (order by bucket rows unbounded preceding) as bigint) as running, round(100.0 * sum(n) over (order by bucket rows unbounded preceding) / sum(n) over (), 2) as percent from h",
    "conversation_strategy": f"with {E}, l as (select *, lag(t) over w as b, lag(type_name) over w as k from e window w as (partition by chat order by t, event_id)) select chat, 1 + sum(cast(b is not null and not (abs(t - b) <= 86400000000 and type_name = k) as int)) :: bigint as conversations, count(*) as n from l group by chat",
    "row_counts": f"with {E} select 'cuts' as name, count(*) filter (type_name = 'cut') as n from e union all select 'own', count(*) filter (is_sender = 1) from e union all select 'rows', count(*) from e",
}
