"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

MIXING = rf"""
with recursive sizes as (select doc_id, source, len({WORDS}) as size, md5('42:' || coalesce(cast(doc_id as varchar), '')) as place from documents),
s0 as (select source, sum(size)::bigint as source_size from sizes group by source),
s1 as (select *, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as total from s0),
-- Reshare until no target is above its cap.
fill(round, source, source_size, w, cap, total, target, stopped) as (
 select 0, source, source_size, w, cap, total, total * w / sum(w) over (), false from s1
 union all
 select round + 1, source, source_size, w, cap, total,
  case when stopped or target > cap then cap else w * ((total - coalesce(sum(case when stopped or target > cap then cap end) over (), 0)) / sum(case when stopped or target > cap then 0 else w end) over ()) end,
  stopped or target > cap
 from fill where round < (select count(*) from s1)),
goal as (select source, source_size, w, target from fill where round = (select max(round) from fill)),
seats as (select round(sum(target) / 8)::bigint as n from goal),
quotients as (select source, target / (2 * k + 1) as q from goal, range(0, (select n from seats) + 1) t(k) where target / (2 * k + 1) >= (select sum(target) / n / 2.2 from goal, seats group by n)),
won as (select source, count(*) as seats from (select source, row_number() over (order by q desc, source nulls last) as r from quotients), seats where r <= n group by source),
dealt as (select d.*, g.source_size, g.target, coalesce(won.seats, 0) as seats, cast('0x' || substring(place, 25, 8) as bigint) % greatest(ceil(g.source_size / greatest(131072.0::double, sqrt(g.source_size::double))), 1)::bigint as shard from sizes d join goal g on d.source is not distinct from g.source left join won on d.source is not distinct from won.source),
shards as (select source, shard, sum(size)::bigint as length, any_value(seats) as seats from dealt group by all),
sq as (select h.source, shard, length::double / (2 * k + 1) as q, h.seats from shards h, range(0, 400000) t(k) where k <= seats and length > 0 and length::double / (2 * k + 1) >= (select sum(length) / 2.2 / greatest(any_value(x.seats), 1) from shards x where x.source is not distinct from h.source)),
sw as (select source, shard, count(*) as quota from (select source, shard, seats, row_number() over (partition by source order by q desc, shard) as r from sq) where r <= seats group by all),
quotas as (select h.source, h.shard, h.length, coalesce(sw.quota, 0)::bigint as quota from shards h left join sw on h.source is not distinct from sw.source and h.shard = sw.shard),
laid as (select d.*, q.length, least(q.quota * 8, q.length * 2) as take, coalesce(sum(size) over (partition by d.source, d.shard order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0) as begin
 from dealt d join quotas q on d.source is not distinct from q.source and d.shard = q.shard)
select doc_id, size::bigint as size, source_size, target,
 (case when length > 0 then (take // length) * size + least(greatest(take - (take // length) * length - begin, 0), size) else 0 end)::bigint as taken, source from laid
"""

#: Texts as hexadecimal digits, so that a window may begin within a character.
SUFFIX_DEDUP = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, i, md5_number(substring(h, 2 * i + 1, 400)) as m from (select r, h, unnest(range(0, len(h) // 2 - 199)) as i from d)),
twice as (select m from w group by m having count(*) > 1),
s as (select r, i, coalesce(i > lag(i) over (partition by r order by i) + 200, true) as new from w semi join twice using (m)),
island as (select r, min(i) as a, max(i) + 200 as b from (select r, i, sum(new::int) over (partition by r order by i) as k from s) group by r, k),
piece as (select r, coalesce(lag(b) over (partition by r order by a), 0) as x, a as y, b, lead(a) over (partition by r order by a) is null as last from island),
cut as (select r, sum(b - y) as removed, count(*) as spans, string_agg(substring(h, 2 * x + 1, 2 * (y - x)) || case when last then substring(h, 2 * b + 1) else '' end, '' order by y) as kept from piece join d using (r) group by r)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join cut using (r)
"""

SUBSTRING_DEDUP = rf"""
with w as (select doc_id, {WORDS} as words from documents),
windows as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as s from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w)),
least as (select s, min(doc_id) as m from windows group by s),
gone as (select distinct doc_id, i + j as p from windows join least using (s), range(13) t(j) where m < doc_id),
each as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as p from w),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as text from each anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)
"""

QUALITY = rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, {WORDS} as words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
grams as (select doc_id, i, array_to_string(words[i:i + 2], ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from d)),
repeated as (select doc_id, g from grams group by all having count(*) > 1),
rep as (select doc_id, count(distinct i + j) as n from grams join repeated using (doc_id, g), range(3) t(j) group by doc_id),
m as (select d.doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
 len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words from d left join rep using (doc_id)),
v as (select *, floor(word_chars * 100 / n_words) as word_length, floor(n_symbols * 1000 / n_words) as symbols, case when n_lines > 0 then floor(n_dup_lines * 1000 / n_lines) end as dup_lines, floor(n_repeat_words * 1000 / n_words) as repeats from m where n_words > 0),
long as (select lang, source, 'word_length' as measure, word_length as v from v union all select lang, source, 'symbols', symbols from v union all select lang, source, 'dup_lines', dup_lines from v union all select lang, source, 'repeats', repeats from v),
own as (select lang as l, source as s, measure, floor(ln(v + 1) / ln(1.02))::integer as bucket, count(*)::double as n from long where v is not null group by all),
every0 as (select measure, bucket, sum(n) as n from own group by all),
every as (select measure, bucket, n / sum(n) over (partition by measure) as p from every0),
lang0 as (select l, measure, bucket, sum(n) as n from own group by all),
lang1 as (select l, measure, bucket, sum(n) as n from (select * from lang0 union all select g.l, g.measure, e.bucket, e.p * 200 from (select distinct l, measure from lang0) g join every e using (measure)) group by all),
lang2 as (select l, measure, bucket, n / sum(n) over (partition by l, measure) as p from lang1),
merged as (select l, s, measure, bucket, sum(n) as n from (select * from own union all select g.l, g.s, g.measure, x.bucket, x.p * 200 from (select distinct l, s, measure from own) g join lang2 x on g.measure = x.measure and g.l is not distinct from x.l) group by all),
upto as (select *, round(sum(n) over (partition by l, s, measure order by bucket), 6) as upto, sum(n) over (partition by l, s, measure) as total from merged),
q as (select l, s, measure, min(bucket) filter (upto >= round(total * 0.1, 6)) as b1, min(bucket) filter (upto >= round(total * 0.5, 6)) as b5, min(bucket) filter (upto >= round(total * 0.9, 6)) as b9 from upto group by all),
f as (select l, s, measure, pow(1.02, b5 + 1) - 1 + (pow(1.02, b9 + 1) - pow(1.02, b5 + 1)) * 7 as most, pow(1.02, b5) - 1 - (pow(1.02, b5) - pow(1.02, b1)) * 7 as low from q),
fence as (select l, s, max(most) filter (measure = 'word_length') as wl, max(low) filter (measure = 'word_length') as wl_low, max(most) filter (measure = 'symbols') as sy, max(most) filter (measure = 'dup_lines') as du, max(most) filter (measure = 'repeats') as re from f group by all),
j as (select m.*, m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words as base_failed, v.word_length, v.symbols, v.dup_lines, v.repeats, wl, wl_low, sy, du, re from m left join v on m.doc_id = v.doc_id left join fence on m.lang is not distinct from fence.l and m.source is not distinct from fence.s),
o as (select *, concat_ws(',', case when word_length > wl then 'word_length' end, case when symbols > sy and n_symbols >= 10 then 'symbols' end, case when dup_lines > du and n_dup_lines >= 10 then 'dup_lines' end, case when repeats > re and n_repeat_words >= 10 then 'repeats' end, case when word_length < wl_low then 'word_length' end) as outside from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and outside = '' as kept, outside from o
"""

#: 1 to 4 words in a row, within pieces, and their occurrences in each language.
COLLOCATIONS = r"""
with piece as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
line as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as ws from piece),
f as materialized (select lang, array_to_string(ws[i:i + k - 1], ' ') as phrase, k, count(*) as a from (select lang, ws, unnest(range(1, len(ws) + 1)) as i from line), range(1, 5) t(k) where i + k - 1 <= len(ws) group by all),
total as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as materialized (select lang, phrase, k, a, string_split(phrase, ' ') as ws from f where k > 1 and a >= 30),
halves as materialized (select lang, phrase, a, j, array_to_string(ws[1:j], ' ') as lw, array_to_string(ws[j + 1:], ' ') as rw from c, range(1, 4) t(j) where j < k),
left_of as materialized (select h.*, f.a as l from halves h join f on f.lang = h.lang and f.phrase = lw),
cut as materialized (select h.lang, h.phrase, h.a, j, l, f.a as r, (2000000::hugeint * h.a) // (l + f.a) as score from left_of h join f on f.lang = h.lang and f.phrase = rw),
lowest as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longer as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(a) as most from c, range(2, 4) t(m), range(1, 4) u(i) where m < k and i + m - 1 <= k group by all),
ranked as (select lang, phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest left join longer using (lang, phrase) where most is null or 100::hugeint * most < 80::hugeint * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""

ORACLES = {"op2_source_mixing": MIXING, "op3_suffix_array_dedup": SUFFIX_DEDUP, "op5_substring_dedup": SUBSTRING_DEDUP, "op10_quality_rules": QUALITY, "op11_phrase_collocations": COLLOCATIONS}
