"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from . import decontamination as dc
from . import license_scan as ls
from . import quality_rules as qr
from . import url_filters as uf
from .common import WORD
from .substring_dedup import WINDOW


def _text(s: object) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def op1() -> str:
    return rf"""
with a as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
g as (select rid, doc_id, unnest(range(1, len(words) - {WINDOW - 2})) as i, words from a),
h as (select rid, i, doc_id, min(doc_id) over (partition by words[i:i + {WINDOW - 1}]) as first from g),
r as (select rid, list(distinct i + k) as gone from h, range({WINDOW}) as x(k) where first < doc_id group by rid),
k as (
  select rid, doc_id, len(words) as n, len(coalesce(gone, [])) as m,
    list_filter(words, lambda w, i: not list_contains(coalesce(gone, []), i)) as kept
  from a left join r using (rid))
select doc_id, cast(n as bigint) as n_words, cast(m as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""


def op2() -> str:
    return f"""
with a as (select row_number() over () as rid, coalesce(doc_id, 9223372036854775807) as d, doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (select rid, d, unnest(lines) as line, unnest(range(len(lines))) as i from a where text is not null),
p as (select *, lead(line) over (partition by rid order by i) as next from l),
f as (select rid, i, line, d, min((d, i)) over (partition by line, next) as first from p where next is not null),
o as (select rid, i, i - row_number() over (partition by rid order by i) as run from f where first[1] < d or (first[1] = d and first[2] + 2 <= i)),
r as (select rid, min(i) as low, max(i) + 1 as high from o group by rid, run),
g as (
  select r.rid, r.low, r.high from r join l on l.rid = r.rid and l.i between r.low and r.high
  group by r.rid, r.low, r.high having bool_or(regexp_matches(l.line, '{WORD}'))),
x as (select distinct l.rid, l.i from g join l on l.rid = g.rid and l.i between g.low and g.high),
k as (
  select l.rid, count(*) as n_lines, count(x.i) as n_removed, string_agg(line, chr(10) order by l.i) filter (x.i is null) as kept
  from l left join x on l.rid = x.rid and l.i = x.i group by l.rid)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
  case when text is not null then sha256(coalesce(kept, '')) end as kept_sha256
from a left join k using (rid)
"""


def _shingled(table: str, id: str) -> str:
    """(rid, id, pos, sh): five-word shingles of lower-cased words without ASCII punctuation."""
    return rf"""
  select rid, {id}, pos, array_to_string(words[pos + 1:pos + {dc.SHINGLE}], ' ') as sh, len(words) - {dc.SHINGLE - 1} as n
  from (select rid, {id}, words, unnest(range(len(words) - {dc.SHINGLE - 1})) as pos
    from (select row_number() over () as rid, {id}, regexp_extract_all(lower(coalesce(text, '')), '{ls.IS_WORD}') as words from {table}))"""


def op3() -> str:
    return f"""
with d as ({_shingled('documents', 'doc_id')}),
i as ({_shingled('benchmark', 'item_id')}),
ic as (select rid as irid, any_value(item_id) as item_id, sh, count(*) as c, any_value(n) as n from i group by rid, sh),
pairs as (select distinct d.rid, irid, ic.n as m, d.n as dn, doc_id, item_id from d join ic on d.sh = ic.sh where d.n >= ic.n),
w as (select *, unnest(range(dn - m + 1)) as start from pairs),
s as (
  select w.rid, w.irid, start, m, any_value(w.doc_id) as doc_id, any_value(w.item_id) as item_id, d.sh, count(*) as c
  from w join d on d.rid = w.rid and d.pos >= start and d.pos < start + m group by w.rid, w.irid, start, m, d.sh),
j as (
  select s.rid, s.irid, start, any_value(s.doc_id) as doc_id, any_value(s.item_id) as item_id, cast(sum(least(s.c, ic.c)) as bigint) as low, any_value(m) as m
  from s join ic on s.irid = ic.irid and s.sh = ic.sh group by s.rid, s.irid, start),
v as (select *, low / (2 * m - low) as similarity from j),
b as (select *, row_number() over (partition by rid, irid order by similarity desc, start) as k from v where similarity >= 0.8)
select doc_id, item_id, cast(similarity as double) as similarity, start as first_word from b where k = 1
"""


def op7() -> str:
    return f"""
with recursive t as (select text, min(doc_id) as rep from documents where text is not null group by text),
u as (select row_number() over () as k, text, rep, regexp_extract_all(text, '{WORD}') as words from t),
s as (select distinct k, words[p + 1:p + 5] as sh from (select k, words, unnest(range(len(words) - 4)) as p from u)),
n as (select k, count(*) as n from s group by k),
l as (
  select a.k as x, b.k as y from s a join s b on a.sh = b.sh and a.k <> b.k join n na on na.k = a.k join n nb on nb.k = b.k
  group by a.k, b.k, na.n, nb.n having count(*) >= 0.8 * (na.n + nb.n - count(*))),
c(x, y) as (select k, k from u union select c.x, l.y from c join l on c.y = l.x),
g as (select c.x as k, min(v.rep) as class_id from c join u v on v.k = c.y group by c.x),
o as (select x, count(*) as n_links from l group by x),
m as (select u.text, u.rep, class_id, n_links from u join g on g.k = u.k left join o on o.x = u.k)
select doc_id, case when d.text is null then doc_id else class_id end as class_id, case when d.text is null then doc_id else m.rep end as text_id, coalesce(n_links, 0) as n_links
from documents d left join m on m.text = d.text
"""


def op4() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    five = "cast('0x' || substr(h, 5 * i + 1, 5) as int)"
    quad = " || ".join(f"substr({letters}, (({five} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
with a as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
b as (select *, max(page_id) over (partition by h) as newest from a)
select page_id, cast(octet_length(encode(t)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(8), lambda i: {quad}), '') as payload_digest,
  case when newest is null or page_id = newest then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from newest then newest end as refers_to
from b
"""


def op5() -> str:
    rules = ",\n".join(
        f"({i}, {_text(r.label)}, {_text(' ' + r.keyword + ' ')}, {_text(r.regex)}, {r.priority}, {r.confidence}, {r.base})" for i, r in enumerate(ls.RULES)
    )
    return rf"""
with recursive rules(id, label, keyword, regex, priority, confidence, base) as (values
{rules}),
a as (select row_number() over () as rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ls.NOT_WORD}', '  ', 'g'), ' ') as t from documents),
b as (select rid, doc_id, t, ' ' || t || ' ' as norm from a),
m as (
  select rid, id, label, priority, confidence, base, regexp_extract_all(norm, regex) as found, string_split_regex(norm, regex) as gaps
  from b join rules on contains(norm, keyword)),
n as (
  select * exclude (found, gaps),
    list_transform(found, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) as found,
    list_transform(gaps, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) as gaps
  from m where len(found) > 0),
u as (select * exclude (found, gaps), found, gaps, unnest(range(1, len(found) + 1)) as k from n),
s as (
  select rid, id, label, priority, confidence, base, coalesce(list_sum(gaps[1:k]), 0) + coalesce(list_sum(found[1:k - 1]), 0) as pos, found[k] as n from u),
e as (select *, pos + n as upto, row_number() over (partition by rid order by pos, -(pos + n), priority, id) as k from s),
w(rid, k, last, upto, priority, stays) as (
  select rid, k, k, upto, priority, cast([] as bigint[]) from e where k = 1
  union all
  select w.rid, e.k,
    case when e.pos >= w.upto or (e.upto > w.upto and e.priority < w.priority) then e.k else w.last end,
    case when e.pos >= w.upto or (e.upto > w.upto and e.priority < w.priority) then e.upto else w.upto end,
    case when e.pos >= w.upto or (e.upto > w.upto and e.priority < w.priority) then e.priority else w.priority end,
    case when e.pos >= w.upto then list_append(w.stays, w.last) else w.stays end
  from w join e on e.rid = w.rid and e.k = w.k + 1),
f as (select rid, list_append(arg_max(stays, k), arg_max(last, k)) as stays from w group by rid),
d as (
  select e.rid, count(*) filter (base) as n_base, min(pos) filter (base) as first_word, max(pos) filter (base) as last_word,
    list_sort(list_distinct(list(label) filter (base))) as base_labels,
    list_sort(list_distinct(list(label) filter (base or list_contains(f.stays, e.k)))) as labels,
    max(confidence) filter (list_contains(f.stays, e.k)) as score
  from e join f on f.rid = e.rid group by e.rid)
select doc_id, cast((length(norm) - length(replace(norm, ' ', ''))) // 2 - (case when t = '' then 1 else 0 end) as bigint) as n_words,
  cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(array_to_string(base_labels, ','), '') as base_labels, coalesce(array_to_string(labels, ','), '') as labels,
  cast(coalesce(score, 0) as double) as score
from b left join d using (rid)
"""


def op8() -> str:
    rules = ", ".join(f"({_text(v)}, {_text(h)}, {_text(p)})" for v, h, p in uf.RULES)
    return rf"""
with rules(verdict, rhost, rpath) as (values {rules}),
p as (
  select row_number() over () as rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
f as (
  select rid, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) as rule, arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) as verdict
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by rid)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join f using (rid)
"""


def _failed(thresholds: tuple[qr.Threshold, ...]) -> str:
    tests = []
    for x in thresholds:
        metric = x.metric.replace(" / ", " / nullif(") + ", 0)" * x.metric.count(" / ")
        tests += [f"{metric} {op} {v}" for op, v in (("<", x.low), (">", x.high)) if v is not None]
    return "coalesce(" + ", false) or coalesce(".join(tests) + ", false)"


def op9() -> str:
    stop = ", ".join(map(_text, sorted(set(qr.STOP_WORDS))))
    return rf"""
with a as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{qr.WORD}') as words from documents),
b as (select rid, words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{qr.WORD}')) as lines from a),
g as (select rid, unnest(range(1, len(words) - {qr.WINDOW - 2})) as i, words from a),
h as (select rid, i, count(*) over (partition by rid, words[i:i + {qr.WINDOW - 1}]) as n from g),
r as (select rid, count(distinct i + k) as n from h, range({qr.WINDOW}) as x(k) where h.n > 1 group by rid),
m as (
  select a.doc_id, cast(len(a.words) as bigint) as n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^{qr.SYMBOLS}]+', '', 'g')) as bigint) as n_symbols,
    cast(length(regexp_replace(t, '[^!?]+', '', 'g')) as bigint) as n_marks,
    cast(len(list_filter(a.words, lambda w: lower(w) in ({stop}))) as bigint) as n_stop_words,
    cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(r.n, 0) as bigint) as n_repeat_words
  from a join b using (rid) left join r using (rid)),
v as (select *, {_failed(qr.BASE)} as base_failed from m)
select *, not base_failed and not ({_failed(qr.METHOD)}) as kept from v
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": op1(), "op2_line_dedup": op2(), "op3_benchmark_decontamination": op3(), "op4_warc": op4(), "op5_license_scans": op5(), "op7_ngram_jaccard_join": op7(), "op8_url_filters": op8(), "op9_quality_rules": op9()}
