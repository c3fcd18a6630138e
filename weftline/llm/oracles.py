"""DuckDB SQL of the registered queries that SQL can express, over whole tables."""

from weftline.llm.quality import Rules

EXACT_DEDUP = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents
"""

_WORD = r"'[^\x20\x09-\x0D]+'"


def _window(n: int) -> str:
    """The n words from this one on, or null near the end."""
    return " || ' ' || ".join(["word", *[f"lead(word, {i}) over (partition by doc_id order by pos)" for i in range(1, n)]])


def _coverage(n: int) -> str:
    return f"""select doc_id, sum(case when inside then length(word) else 0 end) as chars from (
      select doc_id, word, max(again) over (partition by doc_id order by pos rows between {n - 1} preceding and current row) as inside
      from (select doc_id, pos, word, shingle is not null and row_number() over (partition by doc_id, shingle order by pos) > 1 as again
        from (select doc_id, pos, word, {_window(n)} as shingle from w))) group by doc_id"""


def quality_rules(rules: Rules) -> str:
    lengths = rules.ngram_coverage
    shares = [f"coalesce(c{n}.chars, 0) / greatest(word_chars, 1)::double" for n, _ in lengths]
    failed = " or ".join(f"{s} > {limit}::double" for s, (_, limit) in zip(shares, lengths, strict=True))
    joins = " ".join(f"left join ({_coverage(n)}) c{n} using (doc_id)" for n, _ in lengths)
    return f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from d),
three as (select doc_id, pos, {_window(3)} as shingle from w),
twice as (select doc_id, pos, shingle is not null and count(*) over (partition by doc_id, shingle) > 1 as twice from three),
repeated as (select doc_id, count(*) as n from (
    select doc_id, max(twice) over (partition by doc_id order by pos rows between 2 preceding and current row) as inside from twice)
  where inside group by doc_id),
lines as (select doc_id, line, row_number() over (partition by doc_id, line order by nth) as seen from (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as nth from d)
  where regexp_matches(line, {_WORD})),
dup as (select doc_id, count(*) as n, sum(length(array_to_string(regexp_extract_all(line, {_WORD}), ''))) as chars
  from lines where seen > 1 group by doc_id),
base as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(dup.n, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words, coalesce(dup.chars, 0)::bigint as dup_line_chars
  from d left join dup using (doc_id) left join repeated using (doc_id)),
m as (select base.*, greatest({', '.join(shares)}) as max_ngram_coverage, {failed} as covered,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from base {joins})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, max_ngram_coverage, base_failed,
  not base_failed and not covered and dup_line_chars <= {rules.line_coverage}::double * word_chars
    and n_symbols <= {rules.symbol_share}::double * word_chars as kept
from m
"""


CHAT_FORMATTING = r"""
with recursive
mail as (select c.conv_id, c.turn, c.role,
    coalesce(case c.role when 'assistant' then '> > ' || replace(t.text, chr(10), chr(10) || '> > ') || chr(10)
      when 'user' then '> ' || replace(t.text, chr(10), chr(10) || '> ') || chr(10) end, '')
    || coalesce(case c.role when 'assistant' then '> ' || replace(o.text, chr(10), chr(10) || '> ') || chr(10) end, '')
    || c.text as text
  from conversations c left join conversations o on o.conv_id = c.conv_id and o.turn + 1 = c.turn
  left join conversations t on t.conv_id = c.conv_id and t.turn + 2 = c.turn),
lines as (select conv_id, turn, line, pos, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) as level,
    trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)', '')), '\s+', ' ', 'g')) as words
  from (select conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from mail)),
marked as (select *, (level <> lag(level, 1, -1) over m or lag(words, 1, '') over m = '')::int as begins from lines
  window m as (partition by conv_id, turn order by pos)),
runs as (select *, sum(begins) over (partition by conv_id, turn order by pos) as run from marked),
passages as (select conv_id, turn, level, string_agg(words, ' ' order by pos) as passage from runs where words <> ''
  group by conv_id, turn, level, run),
originals as (select conv_id, passage, min(turn) as origin from passages where level = 0 group by conv_id, passage),
quoted as (select p.conv_id, p.turn, p.level, case when o.origin < p.turn then o.origin end as origin
  from passages p left join originals o on o.conv_id = p.conv_id and o.passage = p.passage where p.level > 0),
replies as (select conv_id, turn, count(*) as n_quoted, count(origin) as n_linked,
    arg_max(origin, -level * 1000000 + origin) filter (where origin is not null) as reply_to from quoted group by conv_id, turn),
roots as (select conv_id, turn, reply_to as root_turn from replies where reply_to is not null
  union select r.conv_id, r.turn, n.reply_to from roots r
  join replies n on n.conv_id = r.conv_id and n.turn = r.root_turn where n.reply_to is not null),
lowest as (select conv_id, turn, min(root_turn) as root_turn from roots group by conv_id, turn),
bodies as (select conv_id, turn, trim(string_agg(line, chr(10) order by pos), chr(10)) as body from (
    select conv_id, turn, line, pos, level, coalesce(lead(level) over (partition by conv_id, turn order by pos), 0) as following from lines)
  where level = 0 and not (regexp_matches(line, '(?i)\bwrote:\s*$') and following > 0) group by conv_id, turn)
select m.conv_id, m.turn, m.role, r.reply_to, coalesce(l.root_turn, m.turn) as root_turn,
  row_number() over (partition by m.conv_id order by coalesce(l.root_turn, m.turn), m.turn) - 1 as position,
  coalesce(r.n_quoted, 0) as n_quoted, coalesce(r.n_linked, 0) as n_linked,
  '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || coalesce(b.body, '') as chat
from mail m left join replies r using (conv_id, turn) left join lowest l using (conv_id, turn) left join bodies b using (conv_id, turn)
"""

NGRAM_JOIN = f"""
with recursive
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as ws
  from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) end as shingles from d),
e as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from s),
links as (select a.doc_id as x, b.doc_id as y from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges as (select x, y from links union select y, x from links),
reach as (select doc_id as x, doc_id as y from s union select r.x, e.y from reach r join edges e on e.x = r.y)
select s.doc_id, any_value(len(shingles)) as n_shingles, min(r.y) as component_id
from s join reach r on r.x = s.doc_id group by s.doc_id
"""

FILTER_AUDIT = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
flags as (select doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
    doc_id > min(doc_id) over (partition by text)] as fails from d),
marked as (select part, [coalesce(f, false) for f in fails] as fails, doc_id in (select doc_id from labels where quality = 1) as good,
  doc_id in (select doc_id from labels where toxic = 1) as toxic from flags),
cells as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from marked group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (select [a.f, b.f, c.f, d.f, e.f] as o from letters a, letters b, letters c, letters d, letters e
  where a.f <> b.f and a.f <> c.f and a.f <> d.f and a.f <> e.f and b.f <> c.f and b.f <> d.f and b.f <> e.f and c.f <> d.f and c.f <> e.f and d.f <> e.f),
steps as (select o, unnest([1, 2, 3, 4, 5]) as step from orders),
places as (select o, step, ascii(o[step]) - 64 as own, [ascii(x) - 64 for x in o[1:step - 1]] as before from steps),
each as (select part, o, step, own, n, good, toxic, fails[own] as failing,
    list_bool_or([fails[i] for i in before] || [false]) as earlier,
    len([x for x in fails if x]) = 1 as only_one from places, cells),
counted as (select part, array_to_string(o, '') as filter_order, step::int as step, own,
    coalesce(sum(n) filter (not earlier and not failing), 0)::bigint as kept, coalesce(sum(n) filter (not earlier and failing), 0)::bigint as removed,
    coalesce(sum(n) filter (earlier and failing), 0)::bigint as redundant, coalesce(sum(n) filter (failing and only_one), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (not earlier and failing), 0)::bigint as good_lost, coalesce(sum(toxic) filter (not earlier and failing), 0)::bigint as toxic_lost
  from each group by part, o, step, own)
select * exclude (own), sum(removed) over (partition by part, own)::bigint as shapley from counted
"""

NEAR_VECTORS = """
with recursive
v as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
good as (select r, vec_id, e from v where len(e) > 0 and list_bool_and([coalesce(isfinite(x), false) for x in e]) and list_sum([x * x for x in e]) > 0),
links as (select a.r as x, b.r as y from good a join good b on a.r <> b.r and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select r as x, r as y from v union select reach.x, links.y from reach join links on links.x = reach.y),
least as (select reach.x as r, min(v.vec_id) as component_id from reach join v on v.r = reach.y group by reach.x),
degree as (select x as r, count(*) as n from links group by x)
select v.vec_id, coalesce(degree.n, 0)::bigint as n_links, component_id, v.vec_id is not distinct from component_id as kept
from v left join degree using (r) left join least using (r)
"""

SOURCE_DIVERGENCE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
w as (select r, lang, source, unnest(ws) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= 10),
groups as (select distinct lang, source, false as whole from d union all select distinct lang, '' as source, true as whole from d),
found as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by lang, source, term),
cells as (select g.lang, g.source, g.whole, k.term, coalesce(f.n, 0) as n from groups g join kept k using (lang)
    left join found f on f.lang = g.lang and f.source = g.source and f.term = k.term where not g.whole
  union all select lang, '', true, term, sum(n) from found group by lang, term),
shares as (select *, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over g + 2 * count(*) over g) as p from cells window g as (partition by lang, source, whole)),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source and not a.whole and not b.whole group by all),
all_pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source and not a.whole and not b.whole
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select a.lang, a.source, 'term' as part, a.term as item, ((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and not a.whole and b.whole where a.n > 0 and a.p > b.p)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from all_pairs union all select * from terms)
qualify part = 'pair' or rank <= 10
"""
