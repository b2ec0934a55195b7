"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
with lines as (
  select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)
), keyed as (
  select *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') as key from lines
), common as (
  select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(c.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (c.key is null), '')) as kept_sha256
from keyed k left join common c on k.key = c.key group by doc_id
"""

NGRAM_JACCARD = rf"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
  from worded
), members as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (
  select a.doc_id as a, b.doc_id as b from members a join members b on a.shingle = b.shingle and a.doc_id <> b.doc_id
    and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach as (
  select doc_id, doc_id as other from sets union select r.doc_id, l.b from reach r join links l on r.other = l.a
), least_of as (select doc_id, min(other) as component_id from reach group by doc_id)
select s.doc_id, len(s.s) as n_shingles, component_id from sets s join least_of l on s.doc_id = l.doc_id
"""

SUBSTRING_DEDUP = r"""
with worded as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) as code from (select doc_id, w, unnest(range(1, len(w) - 33)) as s from worded)
), spans as (
  select doc_id, list(s) as starts from windows where code in (select code from windows group by code having count(*) > 1) group by doc_id
), places as (
  select doc_id, w[p] as word, p from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from worded)
), gone as (
  select distinct doc_id, unnest(range(s, s + 35)) as p from (select doc_id, unnest(starts) as s from spans)
)
select d.doc_id, max(len(d.w)) as n_words, count(g.p) as n_removed,
  sha256(coalesce(string_agg(word, ' ' order by p.p) filter (g.p is null), '')) as kept_sha256
from worded d left join places p on d.doc_id = p.doc_id left join gone g on g.doc_id = p.doc_id and g.p = p.p
group by d.doc_id
"""

CHAT_FORMAT = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, '<|im_start|>' || replace(role, '%', '%25') || chr(10) ||
    replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '%', '%25'),
      '<|im_start|>', '%3C|im_start|>'), '<|im_end|>', '%3C|im_end|>'), '<|endoftext|>', '%3C|endoftext|>'),
      '<s>', '%3Cs>'), '</s>', '%3C/s>'), '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]'),
      '<<SYS>>', '%3C<SYS>>'), '<</SYS>>', '%3C</SYS>>') || '<|im_end|>' || chr(10) as formatted
  from turns
), whole as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
    sum(length(formatted)) as formatted_chars
  from marked group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars
from whole
"""

SOURCE_MIX = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as place
  from documents
), by_source as (
  select source, cast(sum(size) as bigint) as source_size,
    1.0::double + (row_number() over (order by source nulls last) - 1) % 3 as weight
  from sizes group by source
), ranked as (
  select *, source_size * 3.0::double as cap,
    coalesce(sum(source_size * 3.0::double) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_before,
    sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as weights_from,
    sum(source_size) over () as words
  from by_source
), levels as (  -- the source with the smallest cap a weight that is not clamped sets the level
  select min((words - full_before) / weights_from) as share
  from (select *, row_number() over (order by source_size / weight, source nulls last) as k from ranked)
  where weights_from > 0 and (words - full_before) / weights_from * weight <= cap
    and k = (select min(k) from (select *, row_number() over (order by source_size / weight, source nulls last) as k from ranked)
             where (words - full_before) / weights_from * weight <= cap)
), targets as (
  select source, source_size, case when weight * share > cap then cap else weight * share end as target from by_source_cap, levels
), needs as (
  select *, cast(coalesce(floor(target / nullif(source_size, 0)), 0) as bigint) as epochs,
    cast(round(target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size) as bigint) as need
  from targets
), walked as (
  select s.*, n.source_size, n.target, n.epochs, n.need,
    coalesce(sum(size) over (partition by s.source order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from sizes s join needs n on s.source is not distinct from n.source
)
select doc_id, size, source_size, target,
  cast(epochs * size + greatest(0, least(size, need - before)) as bigint) as taken
from walked
""".replace("by_source_cap", "(select *, source_size * 3.0::double as cap from by_source)")

EXACT_DEDUP = f"""
with normal as (
  select doc_id, length(coalesce(text, '')) as chars, translate(coalesce(text, ''), {SPACES}, '') as body from documents
)
select doc_id, first_value(doc_id) over same as keep_id, count(*) over (partition by body) as group_size,
  doc_id is not distinct from first_value(doc_id) over same as kept, sha256(body) as text_sha256
from normal window same as (partition by body order by chars desc, doc_id nulls last)
"""


def crc32(text: str) -> str:
    """Unsigned checksum of an ASCII text, bit by bit."""
    octets = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::bigint)"
    byte = "list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end, xor(c, b))"
    return f"xor(list_reduce({octets}, lambda c, b: {byte}, 4294967295::bigint), 4294967295::bigint)"


def field(name: str) -> str:
    return f"coalesce(octet_length(encode(cast({name} as varchar))) || ':' || {name}, '-')"


LEAF = "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", "text"))) + ")"
RUN = "l.ds[3 * (p.idx // 3) + 1 : 3 * (p.idx // 3) + 3]"
BEFORE = f"coalesce(array_to_string(({RUN})[1 : p.idx % 3], ''), '')"
AFTER = f"coalesce(array_to_string(({RUN})[p.idx % 3 + 2 : 3], ''), '')"


def parents(ds: str) -> str:
    return f"list_transform(range(0, (len({ds}) + 2) // 3), lambda i: sha256(array_to_string({ds}[3 * i + 1 : 3 * i + 3], '')))"


MERKLE_MANIFEST = f"""
with recursive marked as (
  select *, {LEAF} as leaf, coalesce({crc32("cast(doc_id as varchar)")} % 2 = 0, false) as tampered from documents
), hashed as (
  select m.doc_id, coalesce('=' || m.source, '-') as branch, m.leaf,
    case when tampered then {LEAF.replace("text", "replace(text, chr(10), '')")} else leaf end as now
  from marked m
), leaves as (
  select *, row_number() over (partition by branch order by doc_id nulls last, leaf) - 1 as r from hashed
), levels as (
  select branch, 0 as lvl, list(leaf order by r) as ds from leaves group by branch
  union all select branch, lvl + 1, {parents("ds")} from levels where len(ds) > 1
), subroots as (
  select branch, ds[1] as subroot, row_number() over (order by branch) - 1 as r from levels where len(ds) = 1
), above as (
  select 0 as lvl, list(subroot order by r) as ds from subroots
  union all select lvl + 1, {parents("ds")} from above where len(ds) > 1
), climbed as (
  select doc_id, branch, leaf, 0 as lvl, r as idx, now as acc, '' as proof from leaves
  union all select p.doc_id, p.branch, p.leaf, p.lvl + 1, p.idx // 3, sha256({BEFORE} || p.acc || {AFTER}), p.proof || {BEFORE} || {AFTER}
  from climbed p join levels l on l.branch = p.branch and l.lvl = p.lvl where len(l.ds) > 1
), at_subroot as (
  select p.doc_id, p.leaf, s.subroot, s.r as idx, p.acc, p.proof
  from climbed p join levels l on l.branch = p.branch and l.lvl = p.lvl and len(l.ds) = 1 join subroots s on s.branch = p.branch
), reached as (
  select doc_id, leaf, subroot, 0 as lvl, idx, acc, proof from at_subroot
  union all select p.doc_id, p.leaf, p.subroot, p.lvl + 1, p.idx // 3, sha256({BEFORE} || p.acc || {AFTER}), p.proof || {BEFORE} || {AFTER}
  from reached p join above l on l.lvl = p.lvl where len(l.ds) > 1
)
select p.doc_id, p.leaf, p.subroot, l.ds[1] as root, sha256(p.proof) as proof_sha256, p.acc as folded_root, p.acc = l.ds[1] as verified
from reached p join above l on l.lvl = p.lvl and len(l.ds) = 1
"""


def edit(state: str, cost: str, letter: str) -> str:
    """A state is nine digits of cost and the audit, so text order is the order wanted; null: not reachable."""
    return f"(lpad(cast(cast(substr({state}, 1, 9) as bigint) + {cost} as varchar), 9, '0') || substr({state}, 10) || '{letter}')"


def stay(states: list[str], initial: str) -> str:
    moves = [f"case when d.initial = '{initial}' then {edit(p, 'd.extra', 'K')} else {edit(p, '1 + d.extra', 'R')} end" for p in states]
    return f"case when not d.gone then least({', '.join(moves)}, null) end"


TURN_REPAIR = rf"""
with recursive placed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as place
  from conversations
), harmed as (select *, {crc32("place")} % 20 as harm from placed),
damaged as (
  select conv_id, turn, case when harm = 4 then 'user' else role end as role,
    case harm when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when harm = 3 then 2 else 1 end)) as copy
  from harmed where harm <> 0
), numbered as (
  select *, substr(role, 1, 1) as initial, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as again, trim(text, {SPACES}) as said
  from damaged
), faults as (
  select *, said = '' as blank, said <> '' and again as duplicate,
    said <> '' and not again and right(said, 1) not in ('.', '!', '?') as cut,
    lag(initial) over (partition by conv_id order by i) as former
  from numbered
), dealt as (select *, blank or duplicate as gone, case when cut then 5 else 0 end as extra from faults),
walk as (
  select conv_id, 0 as i, '000000000' as p0, cast(null as varchar) as p1, '000000005I' as p2, '000000010II' as p3
  from (select distinct conv_id from dealt)
  union all
  select conv_id, i, p0, p1, p2, least(q3, {edit("p2", "5", "I")}) as p3 from (
    select *, q0 as p0, q1 as p1, least(q2, {edit("q0", "5", "I")}, {edit("q1", "5", "I")}, {edit("q3", "5", "I")}) as p2 from (
      select w.conv_id, d.i, {edit("p0", "2", "D")} as q0,
        least({edit("p1", "2", "D")}, case when not d.gone and d.initial = 's' then {edit("p0", "d.extra", "K")} end) as q1,
        least({edit("p2", "2", "D")}, {stay(["p0", "p1", "p3"], "u")}) as q2, least({edit("p3", "2", "D")}, {stay(["p2"], "a")}) as q3
      from walk w join dealt d on d.conv_id is not distinct from w.conv_id and d.i = w.i + 1))
), ended as (
  select w.conv_id, least(p0, p3) as best from walk w join (select conv_id, max(i) as n from dealt group by conv_id) m
    on m.conv_id is not distinct from w.conv_id and m.n = w.i
), letters as (
  select conv_id, k, substr(best, k + 9, 1) as letter from (select *, unnest(range(1, length(best) - 8)) as k from ended)
), counted as (
  select *, sum(case when letter <> 'I' then 1 else 0 end) over so_far as i, sum(case when letter <> 'D' then 1 else 0 end) over so_far as made
  from letters window so_far as (partition by conv_id order by k)
), matched as (
  select c.*, d.role, case when letter = 'I' then '' else d.text end as text,
    max(case when letter = 'K' and made = 1 and d.initial = 's' then 1 else 0 end) over (partition by c.conv_id) as headed
  from counted c left join dealt d on d.conv_id is not distinct from c.conv_id and d.i = c.i where letter <> 'D'
), repaired as (
  select conv_id, string_agg(case when letter = 'K' then role when (made - headed) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by k) as whole
  from matched group by conv_id
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (duplicate) as duplicate, count(*) filter (cut) as truncated,
    count(*) filter (former is not null and former || initial not in ('su', 'ua', 'au')) as illegal
  from dealt group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cast(substr(best, 1, 9) as bigint), 0) as cost, coalesce(substr(best, 10), '') as audit,
  sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
left join repaired r on r.conv_id is not distinct from o.conv_id
"""

EMBEDDING_LINKS = """
with recursive vectors as (
  select row_number() over () as n, vec_id, cast(embedding as double[]) as v from embeddings
), good as (
  select * from vectors where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.n as a, b.n as b from good a join good b on a.n <> b.n and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95
), reach as (select n, n as other from vectors union select r.n, l.b from reach r join links l on r.other = l.a),
named as (select r.n, min(o.vec_id) as component_id from reach r join vectors o on o.n = r.other group by r.n)
select vec_id, (select count(*) from links where a = v.n) as n_links, component_id, vec_id is not distinct from component_id as kept
from vectors v join named on named.n = v.n
"""

ORACLES = {
    "op1_line_dedup": LINE_DEDUP,
    "op2_ngram_jaccard": NGRAM_JACCARD,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op5_chat_format": CHAT_FORMAT,
    "op6_source_mix": SOURCE_MIX,
    "op10_exact_dedup": EXACT_DEDUP,
    "op11_merkle_manifest": MERKLE_MANIFEST,
    "op12_turn_repair": TURN_REPAIR,
    "op13_embedding_links": EMBEDDING_LINKS,
}
