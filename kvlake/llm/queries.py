"""The operators' queries, and their SQL where SQL can express them."""

from .classifier import op3_quality_classifier
from .decontamination import op2_benchmark_decontamination
from .html_text import op10_html_extraction
from .jaccard_join import op4_ngram_jaccard_join
from .licenses import op7_license_scans
from .packing import op6_packing
from .pii import op5_pii
from .quality import op9_quality_rules
from .sharding import op1_sharding
from .urls import op8_url_filters

QUERIES = {f.__name__: f for f in (op1_sharding, op2_benchmark_decontamination, op3_quality_classifier, op4_ngram_jaccard_join, op5_pii, op6_packing, op7_license_scans, op8_url_filters, op9_quality_rules, op10_html_extraction)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

_OP4 = f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as sh from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l),
r(id, other) as (select doc_id, doc_id from w union select r.id, e.b from r join e on e.a = r.other)
select id as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other) as component_id from r left join n on n.doc_id = id group by id
"""

#: Distinct texts that make a line of n words frequent.
_LIMIT = "case when max(n) >= 25 then 10 when max(n) >= 8 then 25 else 100 end"

_OP9 = f"""
with d as (select doc_id, coalesce(text, '') as t, md5(coalesce(text, '')) as th, coalesce(source, '') as host from documents),
w as (select doc_id, host, t, {_WORDS.format("t")} as ws from d),
lines as (select doc_id, host, th, unnest(string_split(t, chr(10))) as raw from d),
l as (select doc_id, host, th, raw, {_WORDS.format("regexp_replace(" + _LOWER.format("raw") + ", '[0-9]', '0', 'g')")} as ws from lines where regexp_matches(raw, '[^\\x20\\x09-\\x0D]')),
k as (select doc_id, host, th, array_to_string(ws, ' ') as line, len(ws) as n from l),
dup as (select doc_id, count(*) - count(distinct raw) as n_dup_lines from l group by doc_id),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as x from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, x) > 1),
rep as (select doc_id, count(distinct i + o) as n_repeat_words from twice, range(8) r(o) group by doc_id),
often as (select host, line from k group by 1, 2 having count(distinct th) >= {_LIMIT}),
touched as (select k.doc_id, sum(n) as gone from k join often on often.host = k.host and often.line = k.line group by k.doc_id),
voting as (select w.doc_id from touched join w on w.doc_id = touched.doc_id where len(ws) - gone >= 5 and gone <= 0.5 * len(ws)),
freq as (select k.host, k.line from k join often on often.host = k.host and often.line = k.line join voting on voting.doc_id = k.doc_id group by 1, 2 having count(distinct th) >= {_LIMIT}),
gone as (select doc_id, sum(n) as n_removed_words from k join freq on freq.host = k.host and freq.line = k.line group by doc_id),
f as (
  select w.doc_id, len(ws) as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_removed_words, 0) as gone
  from w left join dup on dup.doc_id = w.doc_id left join rep on rep.doc_id = w.doc_id left join gone on gone.doc_id = w.doc_id
),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and n_words - gone >= 5 and gone <= 0.75 * n_words as kept, cast(gone as bigint) as n_removed_words
from b
"""

ORACLES: dict[str, str] = {"op4_ngram_jaccard_join": _OP4, "op9_quality_rules": _OP9}
