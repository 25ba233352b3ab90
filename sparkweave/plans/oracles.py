"""The registered queries once more as SQL for DuckDB, built from shared common table expressions."""

from __future__ import annotations

import re

from sparkweave.functions.text import MANY, ONE_FROM, ONE_TO, WHITE
from sparkweave.operators.annotate import ADJECTIVE, EDGES, FUNCTION_WORDS, NER_LABELS, PRONOUNS, RE_LABELS, TYPES, UNTYPED
from sparkweave.operators.graph import STOP_KEYS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {_q('^' + WHITE + '+')}, ''), {_q(WHITE + '+$')}, '')"


def _scrub(x: str) -> str:
    squashed = _strip(f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {_strip('l')}), ' ')")
    folded = f"replace(translate({squashed}, '“”‘’`â–', '\"\"''''''''-'), '…', '...')"
    table = "map {" + ", ".join(f"{_q(c)}: {_q(a)}" for c, a in MANY.items()) + "}"
    many = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in MANY) + "]"
    spread = f"case when regexp_matches({folded}, {_q(many)}) then array_to_string(list_transform(string_split({folded}, ''), lambda c: coalesce({table}[c], c)), '') else {folded} end"
    return f"regexp_replace(translate({spread}, {_q(ONE_FROM)}, {_q(ONE_TO)}), '[^\\x00-\\x7F]', '', 'g')"


_SENT = r"string_split(regexp_replace({x}, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1))"
CTE: dict[str, str] = {}
CTE["sents"] = f"select doc_id, unnest(l) as s, generate_subscripts(l, 1) - 1 as i from (select doc_id, {_SENT.format(x='text')} as l from documents where text is not null)"
CTE["lines"] = f"select doc_id, i, {_scrub('s')} as s from sents"
CTE["fold"] = """
select doc_id, i, 0 as k, length(s) as total, s, false as broke, '' as before from lines where i = 0 and length(s) <= 1024
union all select doc_id, i, 1, length(s), s, true, '' from lines where i = 0 and length(s) > 1024
union all select f.doc_id, l.i, case when f.total + length(l.s) > 1024 then f.k + 1 else f.k end,
  case when f.total + length(l.s) > 1024 then length(f.s) + length(l.s) else f.total + length(l.s) end, l.s, f.total + length(l.s) > 1024, f.s
  from fold f join lines l on l.doc_id = f.doc_id and l.i = f.i + 1
"""
CTE["chunked"] = """
select doc_id, k as pos, string_agg(case when broke then before || chr(10) || s else s end, chr(10) order by i) as text from fold group by doc_id, k
union all select doc_id, 0, '' from fold where i = 0 and broke
"""
CTE["pages"] = "select url, min(doc_seq) as doc_seq from urls where url is not null group by url"
CTE["mentioned"] = "select chunk_uid, min(doc_seq) as doc_seq from entities group by chunk_uid"
CTE["chunks"] = """
select coalesce(p.doc_seq, m.doc_seq) as doc_seq, c.uid as chunk_uid, c.c.url as url, c.c.text as text
from (select uid, max(struct_pack(url := url, text := text)) as c from text_chunk where uid is not null and text is not null group by uid) c
left join pages p on p.url = c.c.url left join mentioned m on m.chunk_uid = c.uid where coalesce(p.doc_seq, m.doc_seq) is not null
"""
CTE["words"] = """
select doc_seq, chunk_uid, sent_id, generate_subscripts(w, 1) - 1 as place, unnest(w) as word from (
  select doc_seq, chunk_uid, sent_id, list_filter(string_split_regex(line, '[ \t\r\f]+'), lambda x: x <> '') as w from (
    select doc_seq, chunk_uid, generate_subscripts(l, 1) - 1 as sent_id, unnest(l) as line from (select *, string_split(text, chr(10)) as l from chunks)))
"""
CTE["cores"] = f"select doc_seq, chunk_uid, sent_id, place, regexp_replace(word, {_q(EDGES)}, '', 'g') as text, row_number() over (partition by chunk_uid order by sent_id, place) - 1 as tok_i from words"
_POS = (
    f"case when text = '' then 'PUNCT' when lower(text) in {_in(PRONOUNS)} then 'PRON' "
    + " ".join(f"when lower(text) in {_in(ws)} then '{pos}'" for pos, ws in FUNCTION_WORDS.items())
    + f" when regexp_matches(text, '^[0-9]') then 'NUM' when regexp_matches(text, '^\\p{{Lu}}') and place > 0 then 'PROPN' when regexp_matches(lower(text), {_q(ADJECTIVE)}) then 'ADJ' else 'NOUN' end"
)
CTE["tagged"] = f"select *, {_POS} as pos from cores"
CTE["tokens"] = """
select *, pos || '.' || lemma as key from (select *, case when pos <> 'NOUN' then lower(text)
  when regexp_matches(lower(text), '[^aeiou]ies$') then regexp_replace(lower(text), 'ies$', 'y')
  when regexp_matches(lower(text), '[^sui]s$') then regexp_replace(lower(text), 's$', '') else lower(text) end as lemma from tagged)
"""
CTE["kept"] = "select *, tok_i - row_number() over (partition by doc_seq, chunk_uid, sent_id order by tok_i) as island from tokens where pos in ('ADJ', 'NOUN', 'PROPN', 'NUM')"
CTE["ncs"] = """
select doc_seq, chunk_uid, sent_id, min(tok_i) as span_start, max(tok_i) + 1 as span_end, string_agg(key, ' ' order by tok_i) as key, string_agg(text, ' ' order by tok_i) as text, 'NP' as label
from (select *, max(case when pos in ('NOUN', 'PROPN') then tok_i end) over (partition by doc_seq, chunk_uid, sent_id, island) as last from kept) where tok_i <= last group by doc_seq, chunk_uid, sent_id, island
union all select doc_seq, chunk_uid, sent_id, tok_i, tok_i + 1, key, text, 'NP' from tokens where pos = 'PRON'
"""
CTE["names"] = f"""
select name, label from (select lower(text) as name, label, count(*) as n from entities where text is not null and label in {_in(NER_LABELS)} group by 1, 2)
qualify row_number() over (partition by name order by n desc, label) = 1
"""
CTE["proper"] = """
select doc_seq, chunk_uid, sent_id, min(tok_i) as span_start, max(tok_i) + 1 as span_end, string_agg(key, ' ' order by tok_i) as key, string_agg(text, ' ' order by tok_i) as text
from (select *, tok_i - row_number() over (partition by doc_seq, chunk_uid, sent_id order by tok_i) as island from tokens where pos = 'PROPN') group by doc_seq, chunk_uid, sent_id, island
"""
CTE["ner"] = "select p.*, n.label from proper p join names n on n.name = lower(p.text)"
CTE["ents"] = f"""
select doc_seq, chunk_uid, sent_id, span_start, span_end, key, text, coalesce(label, 'NP') as label, key not in {_in(STOP_KEYS)} as promoted from entities
where chunk_uid is not null and span_start is not null and span_end is not null and key is not null and doc_seq is not null
qualify row_number() over (partition by chunk_uid, span_start, span_end order by label is null, coalesce(loaded_at, timestamp '9999-12-31'), text, key, doc_seq) = 1
"""
CTE["rels"] = """
select *, row_number() over (partition by chunk_uid order by score desc nulls last, rel_seq, h_start, h_end, t_start, t_end, label) as rel_rank from (select distinct * from relations)
"""
CTE["ends"] = "select chunk_uid, h_start as s, h_end as e, rel_rank * 2 as made from rels union all select chunk_uid, t_start, t_end, rel_rank * 2 + 1 from rels"
CTE["missing"] = """
select chunk_uid, s, e, min(made)::integer as made from ends where chunk_uid is not null and s is not null and e is not null
and not exists (select 1 from ents x where x.chunk_uid = ends.chunk_uid and x.span_start = ends.s and x.span_end = ends.e) group by 1, 2, 3
"""
CTE["back"] = f"""
select *, '' as label, key not in {_in(STOP_KEYS)} as promoted from (
  select t.doc_seq, m.chunk_uid, arg_min(t.sent_id, t.tok_i) as sent_id, m.s as span_start, m.e as span_end, string_agg(t.key, ' ' order by t.tok_i) as key, string_agg(t.text, ' ' order by t.tok_i) as text, m.made
  from missing m join tokens t on t.chunk_uid = m.chunk_uid and t.tok_i >= m.s and t.tok_i < m.e group by t.doc_seq, m.chunk_uid, m.s, m.e, m.made)
"""
CTE["named"] = """
select doc_seq, chunk_uid, sent_id, span_start, span_end, key, text, label, promoted, null::integer as made from ents
union all select doc_seq, chunk_uid, sent_id, span_start, span_end, key, text, label, promoted, made from back
"""
CTE["events"] = """
select doc_seq, chunk_uid, 1 as phase, tok_i as a, 0 as b, key, text, pos, null::varchar as label from tokens where pos in ('NOUN', 'PROPN')
union all select doc_seq, chunk_uid, case when made is not null then 4 when label = 'NP' then 3 else 2 end, coalesce(made, span_start), case when made is not null then 0 else span_end end, key, text, 'NP', label
  from named where promoted
"""
CTE["dictionary"] = """
select key, row_number() over (order by doc_seq, chunk_uid, phase, a, b, key) - 1 as node_id, doc_seq as first_doc from (
  select * from events qualify row_number() over (partition by key order by doc_seq, chunk_uid, phase, a, b) = 1)
"""
CTE["firsts"] = "select * from events qualify row_number() over (partition by doc_seq, key order by doc_seq, chunk_uid, phase, a, b) = 1"
CTE["nodes"] = """
select g.doc_seq, d.node_id, g.key, case when g.entity then 'Entity' else 'Lemma' end as kind, case when g.entity then coalesce(r.label, 'NP') end as label, f.pos, f.text,
  coalesce(g.last_chunk, g.first_chunk) as chunk_uid, g.n + case when f.phase > 1 and d.first_doc < g.doc_seq then 1 else 0 end as count, f.phase as made, f.chunk_uid as cc, f.a as ca, f.b as cb
from (select doc_seq, key, count(*) as n, bool_or(phase > 1) as entity, max(case when phase > 1 then chunk_uid end) as last_chunk, min(chunk_uid) as first_chunk from events group by 1, 2) g
join firsts f on f.doc_seq = g.doc_seq and f.key = g.key join dictionary d on d.key = g.key
left join (select doc_seq, key, label from events where phase > 1 and label <> 'NP' qualify row_number() over (partition by doc_seq, key order by chunk_uid, phase, a, b) = 1) r on r.doc_seq = g.doc_seq and r.key = g.key
"""
CTE["ahead"] = """
select doc_seq, chunk_uid, key, unnest([lead(key, 1) over w, lead(key, 2) over w, lead(key, 3) over w]) as other from tokens where pos in ('NOUN', 'PROPN')
window w as (partition by doc_seq, chunk_uid, sent_id order by tok_i)
"""
CTE["follows"] = "select doc_seq, least(key, other) as ka, greatest(key, other) as kb, min(chunk_uid) as chunk_uid from ahead where other is not null group by 1, 2, 3"
CTE["compounds"] = """
select distinct n.doc_seq, least(n.key, p.key) as ka, greatest(n.key, p.key) as kb from (select *, unnest(list_distinct(string_split(key, ' '))) as part from nodes where made > 1) n
join nodes p on p.doc_seq = n.doc_seq and p.key = n.part and (p.cc, p.made, p.ca, p.cb) <= (n.cc, n.made, n.ca, n.cb)
"""
CTE["met"] = "select distinct doc_seq, chunk_uid, sent_id, key from named where promoted and sent_id is not null"
CTE["together"] = "select a.doc_seq, a.key as ka, b.key as kb, min(a.chunk_uid) as chunk_uid from met a join met b on a.doc_seq = b.doc_seq and a.chunk_uid = b.chunk_uid and a.sent_id = b.sent_id and a.key < b.key group by 1, 2, 3"
CTE["related"] = """
select h.doc_seq, least(h.key, t.key) as ka, greatest(h.key, t.key) as kb, r.chunk_uid, r.rel_rank, upper(replace(trim(r.label), ' ', '_')) as rel, round_even(r.score, 3) as prob
from rels r join named h on h.promoted and h.chunk_uid = r.chunk_uid and h.span_start = r.h_start and h.span_end = r.h_end
join named t on t.promoted and t.chunk_uid = r.chunk_uid and t.span_start = r.t_start and t.span_end = r.t_end
"""
CTE["edges"] = """
select e.doc_seq, least(a.node_id, b.node_id) as src, greatest(a.node_id, b.node_id) as dst, e.rel, e.prob from (
  select * from (select doc_seq, ka, kb, 1 as p, -chunk_uid as x, -rel_rank as y, rel, prob from related
    union all select doc_seq, ka, kb, 2, 0, 0, 'COMPOUND_ELEMENT_OF', null from compounds
    union all select doc_seq, ka, kb, 3, chunk_uid, 1, 'FOLLOWS_LEXICALLY', null from follows
    union all select doc_seq, ka, kb, 3, chunk_uid, 2, 'CO_OCCURS_WITH', 1.0 from together) qualify row_number() over (partition by doc_seq, ka, kb order by p, x, y) = 1) e
join dictionary a on a.key = e.ka join dictionary b on b.key = e.kb
"""
CTE["sizes"] = "select doc_seq, count(*) as n from nodes group by 1"
CTE["adjacent"] = "select doc_seq, src, dst from edges union all select doc_seq, dst, src from edges where src <> dst"
CTE["links"] = """
select a.doc_seq, a.src, a.dst, 1.0::double / d.n as w from adjacent a join (select doc_seq, src, count(*) as n from adjacent group by 1, 2) d on d.doc_seq = a.doc_seq and d.src = a.src
union all select n.doc_seq, n.node_id, m.node_id, 1.0::double / s.n from nodes n join nodes m on m.doc_seq = n.doc_seq join sizes s on s.doc_seq = n.doc_seq
  where not exists (select 1 from adjacent x where x.doc_seq = n.doc_seq and x.src = n.node_id)
"""
CTE["pr"] = """
select 0 as it, n.doc_seq, n.node_id, 1.0::double / s.n as r from nodes n join sizes s on s.doc_seq = n.doc_seq
union all select p.it + 1, l.doc_seq, l.dst, 0.15::double / s.n + 0.85 * sum(p.r * l.w) from pr p join links l on l.doc_seq = p.doc_seq and l.src = p.node_id join sizes s on s.doc_seq = p.doc_seq
  where p.it < 20 group by p.it, l.doc_seq, l.dst, s.n
"""
CTE["scaled"] = """
select n.*, round(p.r, 12) as pagerank, round(round(p.r, 12) / max(round(p.r, 12)) over (partition by n.doc_seq), 9) as x, n.count::double / max(n.count) over (partition by n.doc_seq) as y, s.n as size
from nodes n join (select * from pr where it = 20) p on p.doc_seq = n.doc_seq and p.node_id = n.node_id join sizes s on s.doc_seq = n.doc_seq
"""
CTE["quantiles"] = """
select doc_seq, list_transform(pts, lambda p: xs[cast(round_even(p * (n - 1), 0) as integer) + 1]) as qx, list_transform(pts, lambda p: ys[cast(round_even(p * (n - 1), 0) as integer) + 1]) as qy from (
  select doc_seq, n, xs, ys, case when g = 1 then [0.0::double] else list_transform(range(g), lambda i: i::double / (g - 1)) end as pts from (
    select doc_seq, count(*) as n, list_sort(list(x)) as xs, list_sort(list(y)) as ys, greatest(round_even(ln(count(*)) * 4, 0), 1)::integer as g from scaled group by 1))
"""
CTE["striped"] = """
select *, case when sum(rms) over (partition by doc_seq) > 0 then rms / sum(rms) over (partition by doc_seq) else 1.0::double / size end as rank from (
  select *, sqrt((stripe_weight * stripe_weight + stripe_count * stripe_count) / 2.0::double) as rms from (
    select s.*, len(list_filter(q.qx, lambda v: v <= s.x)) - 1 as stripe_weight, len(list_filter(q.qy, lambda v: v <= s.y)) - 1 as stripe_count from scaled s join quantiles q on q.doc_seq = s.doc_seq))
"""
CTE["onodes"] = """
select node_id::varchar as id, 'Entity' as kind, key, text, label, count, null::bigint as chunk_uid, null::varchar as url from (
  select node_id, arg_min(key, doc_seq) as key, arg_min(text, doc_seq) as text, arg_min(label, doc_seq) as label, sum(count)::bigint as count from nodes where kind = 'Entity' group by 1)
union all select 'chunk_' || chunk_uid, 'Chunk', null, null, null, null, chunk_uid, url from chunks
"""
CTE["oedges"] = """
select e.src, e.dst, arg_min(e.rel, e.doc_seq) as rel, max(coalesce(e.prob, 1.0)) as prob from edges e join nodes a on a.doc_seq = e.doc_seq and a.node_id = e.src and a.kind = 'Entity'
join nodes b on b.doc_seq = e.doc_seq and b.node_id = e.dst and b.kind = 'Entity' where e.rel not in ('FOLLOWS_LEXICALLY', 'COMPOUND_ELEMENT_OF') group by 1, 2
"""
CTE["within_"] = "select node_id::varchar as src, 'chunk_' || chunk_uid as dst, 'WITHIN' as rel, round(rank, 9) as weight from striped where kind = 'Entity'"
CTE["bags"] = "select chunk_uid, sent_id, list_prepend(sent_id::varchar, list_sort(list(key))) as bag from (select distinct chunk_uid, sent_id, key from met) group by 1, 2"
_TYPE = "case " + " ".join(f"when label = {_q(k)} then {_q(v)}" for k, v in TYPES.items()) + " end"
CTE["typed"] = f"select *, coalesce({_TYPE}, {_q(UNTYPED)}) as type from ents"
_EVERY = [*dict.fromkeys(TYPES.values()), UNTYPED]
CTE["allowed"] = "select * from (values " + ", ".join(f"({_q(lab)}, {_q(h)}, {_q(t)})" for lab, (hs, ts) in RE_LABELS.items() for h in hs or _EVERY for t in ts or _EVERY) + ") as v(label, h_type, t_type)"
# relations and each once more from the word before its head
CTE["moved"] = "select * from relations union all select chunk_uid, rel_seq, h_start - 1, h_end, t_start, t_end, label, score from relations where h_start >= 1"
for _name, _of in (("moved_rels", "rels"), ("moved_ends", "ends"), ("moved_missing", "missing"), ("moved_back", "back")):
    CTE[_name] = re.sub(r"\b(rels|ends|missing)\b", r"moved_\1", CTE[_of].replace("relations", "moved"))
# noun chunks with the type the gazetteer gives them, and the first relation two types allow
CTE["nctyped"] = f"""
select n.*, coalesce({_TYPE.replace('label', 'g.label')}, {_q(UNTYPED)}) as type from (select distinct on (chunk_uid, span_start, span_end) chunk_uid, sent_id, span_start, span_end, key, text from ncs) n left join names g on g.name = lower(n.text)
"""
CTE["firstrel"] = "select h_type, t_type, min(label) as label from allowed where label <> 'no_relation' group by 1, 2"
CTE["ncpairs"] = """
select h.chunk_uid, h.sent_id, h.span_start as h_start, h.span_end as h_end, t.span_start as t_start, t.span_end as t_end,
  case when list_has_all(string_split(t.key, ' '), string_split(h.key, ' ')) or list_has_all(string_split(h.key, ' '), string_split(t.key, ' ')) then 'has part' else coalesce(f.label, 'no_relation') end as label,
  round_even(1.0::double / (1 + greatest(t.span_start - h.span_end, 1) / 10.0::double), 3) as score
from nctyped h join nctyped t on t.chunk_uid = h.chunk_uid and t.sent_id = h.sent_id and (h.span_start, h.span_end) < (t.span_start, t.span_end) left join firstrel f on f.h_type = h.type and f.t_type = t.type
"""
# the same from pages: the chain once more over other chunks, with entities as found
CTE["page_docs"] = f"select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: {_strip('l')}), chr(10)) as text from documents where text is not null"
_PAGED = ("sents", "lines", "fold", "chunked", "chunks", "words", "cores", "tagged", "tokens", "kept", "ncs", "proper", "ner", "events", "dictionary", "firsts", "nodes", "onodes")


def _paged(body: str) -> str:
    return re.sub(rf"'(?:[^']|'')*'|\b(?:{'|'.join(_PAGED)})\b", lambda m: m.group() if m.group().startswith("'") else f"page_{m.group()}", body)


for _name in _PAGED:
    if _name == "events":
        CTE["page_ents"] = f"""
select doc_seq, chunk_uid, sent_id, span_start, span_end, key, text, coalesce(label, 'NP') as label, key not in {_in(STOP_KEYS)} as promoted, null::integer as made from (
  select doc_seq, chunk_uid, sent_id, span_start, span_end, key, text, label from page_ner union all select doc_seq, chunk_uid, sent_id, span_start, span_end, key, text, null from page_ncs)
qualify row_number() over (partition by chunk_uid, span_start, span_end order by label is null, text, key, doc_seq) = 1
"""
    CTE[f"page_{_name}"] = _paged(CTE[_name].replace("documents", "page_docs")).replace("from named where", "from page_ents where")
CTE["page_chunks"] = "select doc_id as doc_seq, row_number() over (order by doc_id, pos) - 1 as chunk_uid, 'doc:' || doc_id as url, text from page_chunked"
# JSON as Spark writes it: figures under a thousandth in powers of ten
_SMALL = "(round(weight * 1e9)::bigint::varchar)"
_WEIGHT = f"case when weight >= 1e-3 or weight = 0 then weight::varchar else {_SMALL}[1] || '.' || coalesce(nullif(rtrim({_SMALL}[2:], '0'), ''), '0') || 'E' || (length({_SMALL}) - 10) end"


def _object(columns: dict[str, str]) -> str:
    return "'{' || concat_ws(',', " + ", ".join(f"'\"{c}\":' || {v}" for c, v in sorted(columns.items())) + ") || '}'"


_text = lambda c: f"to_json({c})::varchar"
CTE["json"] = f"""
select 'node' as part, {_object({"chunk_uid": "chunk_uid::varchar", "count": "count::varchar"} | {c: _text(c) for c in ("id", "key", "kind", "label", "text", "url")})} as json from onodes
union all select 'link', {_object({"src": _text("src::varchar"), "dst": _text("dst::varchar"), "rel": _text("rel"), "prob": "prob::varchar"})} from oedges
union all select 'link', {_object({"src": _text("src"), "dst": _text("dst"), "rel": _text("rel"), "weight": _WEIGHT})} from within_
"""
# word hashing: CRC-32 of the distinct words' bytes, from a table made by its polynomial
CTE["crctable"] = "select list(list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as t from range(256) r(n)"
CTE["asked"] = "select uid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from (select chunk_uid as uid, text from chunks union all select -1, 'alzheimer')"
CTE["wordbytes"] = """
select word, list_transform(range(length(h) // 2), lambda i: (16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::bigint) as bytes
from (select word, hex(encode(word)) as h from (select distinct word from asked))
"""
CTE["hashed"] = "select word, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as h from wordbytes, crctable"
CTE["cells"] = "select uid, h // 2 % 64 as cell, sum(case when h % 2 = 0 then 1.0::double else -1.0 end) as v from asked join hashed using (word) group by 1, 2"
CTE["lengths"] = "select uid, sqrt(sum(v * v)) as length from cells group by 1"
CTE["embedded"] = """
select u.uid, list(case when coalesce(l.length, 0) > 0 then coalesce(c.v, 0) / l.length else 0 end::float order by g.i) as vector
from (select chunk_uid as uid from chunks union all select -1) u cross join range(64) g(i) left join cells c on c.uid = u.uid and c.cell = g.i left join lengths l on l.uid = u.uid group by 1
"""
# label propagation, five rounds
CTE["lpa_links"] = "select distinct * from (select src as a, dst as b from oedges where src <> dst union all select dst, src from oedges where src <> dst)"
CTE["lpa_0"] = "select distinct a as node, a as community from lpa_links"
for _i in range(5):
    CTE[f"lpa_{_i + 1}"] = f"""
select node, community from (select node, community, count(*) as n from (
  select l.a as node, p.community from lpa_links l join lpa_{_i} p on p.node = l.b union all select node, community from lpa_{_i}) group by 1, 2)
qualify row_number() over (partition by node order by n desc, community) = 1
"""


def _needs(body: str, seen: dict[str, None]) -> None:
    body = re.sub("'(?:[^']|'')*'", "''", body)
    for name in CTE:
        if re.search(rf"\b{name}\b", body) and name not in seen:
            seen[name] = None
            _needs(CTE[name], seen)


def sql(body: str) -> str:
    """``body`` with the expressions it uses before it."""
    used: dict[str, None] = {}
    _needs(body, used)
    listed = [name for name in CTE if name in used]
    heavy = {"nodes", "edges", "tokens", "ents", "named", "dictionary", "links", "striped", "scaled", "pr", "kept", "ncs", "names", "lines", "fold", "chunks", "onodes", "oedges", "asked", "hashed", "embedded", "nctyped", "rels", "missing", "lpa_links"}
    heavy |= {f"page_{n}" for n in heavy} | {f"lpa_{i}" for i in range(6)} | {"moved_rels", "moved_missing"}
    return f"with recursive {', '.join(f'{n} as {"materialized " if n in heavy else ""}({CTE[n]})' for n in listed)} {body}"


ORACLE = {
    "scrub_text": f"select doc_id, {_scrub('text')} as text from documents where text is not null",
    "html_paragraphs": f"select doc_id, list_transform(string_split(text, chr(10)), lambda l: {_strip('l')}) as paragraphs from documents where text is not null",
    "sentence_split": sql("select doc_id, i as sent_id, s as sentence from sents"),
    "chunk_documents": sql("select * from chunked"),
    "chunk_numbering": sql("select doc_id, pos, row_number() over (order by doc_id, pos) - 1 as uid, 'chunk_' || (row_number() over (order by doc_id, pos) - 1) as node from chunked"),
    "token_annotations": sql("select chunk_uid, sent_id, tok_i, text, pos, lemma, key from tokens"),
    "noun_chunk_spans": sql("select chunk_uid, sent_id, span_start, span_end, key, text, label from ncs"),
    "gazetteer_ner": sql("select chunk_uid, sent_id, span_start, span_end, key, text, label from ner"),
    "lemma_dictionary": sql("select key, node_id from dictionary"),
    "lemma_nodes": sql("select doc_seq, key, count(*) as count, arg_min(text, struct_pack(c := chunk_uid, t := a)) as text, arg_min(pos, struct_pack(c := chunk_uid, t := a)) as pos from events where phase = 1 group by 1, 2"),
    "lookback_edges": sql("select * from follows"),
    "entity_dedupe": sql("select chunk_uid, span_start, span_end, sent_id, key, text, label, promoted from ents"),
    "entity_nodes": sql("select doc_seq, node_id, key, kind, label, pos, text, chunk_uid, count from nodes"),
    "compound_edges": sql("select * from compounds"),
    "cooccurrence_edges": sql("select * from together"),
    "relation_edges": sql("select * from related"),
    "relation_candidates": sql(
        """select * from (select h.chunk_uid, h.sent_id, h.span_start as h_start, h.span_end as h_end, t.span_start as t_start, t.span_end as t_end, a.label,
        round_even(1.0::double / (1 + greatest(abs(t.span_start - h.span_start), 1) / 10.0::double), 3) as score from typed h join typed t on t.chunk_uid = h.chunk_uid and t.sent_id = h.sent_id
        and (h.span_start <> t.span_start or h.span_end <> t.span_end) join allowed a on a.h_type = h.type and a.t_type = t.type) where score >= 0.5"""
    ),
    "relation_backfill": sql("select chunk_uid, sent_id, span_start, span_end, key, text, label, promoted, made from moved_back"),
    "pairwise_relations": sql("select * from ncpairs where score >= 0.5 and label <> 'has part'"),
    "page_chunks": sql("select * from page_chunks"),
    "page_entities": sql("select chunk_uid, span_start, span_end, sent_id, key, text, label, promoted from page_ents"),
    "kg_from_pages": sql("select * from page_onodes"),
    "chunk_vectors": sql("select c.chunk_uid as uid, c.url, c.text, e.vector from chunks c join embedded e on e.uid = c.chunk_uid"),
    "chunk_search": sql(
        """select e.uid, round(list_sum(list_transform(list_zip(e.vector::double[], q.vector::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) as _distance
        from embedded e, (select vector from embedded where uid = -1) q where e.uid >= 0 order by 2, 1 limit 10"""
    ),
    "kg_json": sql("select * from json"),
    "communities_lpa": sql("select * from lpa_5"),
    "resolved_edges": sql("select * from edges"),
    "pagerank_fixed20": sql("select doc_seq, node_id, round(r, 9) as pagerank from pr where it = 20"),
    "rank_stripes": sql("select doc_seq, node_id, stripe_weight, stripe_count, round(rank, 9) as rank from striped"),
    "textrank": sql("select doc_seq, node_id, key, text, label, count, round(rank, 9) as rank from striped where kind = 'Entity'"),
    "top_entities": sql("select doc_seq, node_id, key, round(rank, 9) as rank from striped where kind = 'Entity' qualify row_number() over (partition by doc_seq order by round(rank, 12) desc, node_id) <= 20"),
    "overlay_nodes": sql("select * from onodes"),
    "overlay_edges": sql("select * from oedges"),
    "within_edges": sql("select * from within_"),
    "pronoun_qc": sql("select key, node_id from dictionary where contains(key, 'PRON')"),
    "promotion_report": sql(
        """select n.doc_seq, n.n_nodes, n.n_kept_nodes, coalesce(e.n_edges, 0) as n_edges, coalesce(e.n_kept_edges, 0) as n_kept_edges from
        (select doc_seq, count(*) as n_nodes, count(*) filter (kind = 'Entity') as n_kept_nodes from nodes group by 1) n left join
        (select e.doc_seq, count(*) as n_edges, count(*) filter (a.kind = 'Entity' and b.kind = 'Entity' and e.rel not in ('FOLLOWS_LEXICALLY', 'COMPOUND_ELEMENT_OF')) as n_kept_edges from edges e
        join nodes a on a.doc_seq = e.doc_seq and a.node_id = e.src join nodes b on b.doc_seq = e.doc_seq and b.node_id = e.dst group by 1) e on e.doc_seq = n.doc_seq"""
    ),
    "sentence_bags": sql("select * from bags"),
    "viz_overlay": sql(
        """select id, case when kind = 'Entity' then round_even(20 * ln(1 + sqrt(count) / (select count(distinct doc_seq) from chunks)), 0)::integer else 5 end as size,
        case when kind = 'Entity' then text else id end as label, case when kind = 'Entity' then key else url end as title, case when kind = 'Entity' then 'entity' else 'chunk' end as colour from onodes"""
    ),
    "viz_lexical": sql("select doc_seq, node_id, round_even((case when kind = 'Entity' then 200 else 30 end) * round(rank, 9), 0)::integer as size, text as label, key as title from striped"),
    "vector_topk": """with q as (select embedding::double[] as q from embeddings where vec_id = 0)
        select vec_id, round(list_sum(list_transform(list_zip(embedding::double[], q.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) as _distance from embeddings, q order by 2, 1 limit 10""",
    "vector_neighbours_positive": """with q as (select embedding::double[] as q from embeddings where vec_id = 0)
        select * from (select vec_id, round(list_cosine_similarity(embedding::double[], q.q), 6) as similarity from embeddings, q order by 2 desc, 1 limit 10) where similarity > 0""",
    "mean_similarity": """with q as (select embedding::double[] as q from embeddings where vec_id = 0)
        select round(avg(similarity), 5) as mean_similarity from (select vec_id, round(list_cosine_similarity(embedding::double[], q.q), 6) as similarity from embeddings, q order by 2 desc, 1 limit 10) where similarity > 0""",
}
