"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from paperloom.sources.tables import ENTRIES_SQL as E

TOKENS = r"list_transform(regexp_extract_all({}, '([a-zA-Z0-9]+|[^ \t\r\na-zA-Z0-9])', 1), lambda x: lower(x))"
LINKS = r"list_filter(list_transform(regexp_extract_all({}, '\[\[([^\[\]\n]*)\]\]', 1), lambda x: trim(x, ' ')), lambda x: length(x) > 0)"
QUERY = "the thhentha estion worthless"
TERMS = "('estion'), ('the'), ('thhentha'), ('worthless')"
CENTER = "area0/21.md"
AS_OF = "timestamp '2025-01-01'"

# --- graph ---------------------------------------------------------------------

_NAMED = f"""{E},
er as (select a.src, n.path as dst, 'related' as kind from (select path as src, unnest(related) as ref from entries) a join entries n on lower(ref) = lower(n.path)),
ec as (select a.src, n.path as dst, 'contradiction' as kind from (select path as src, unnest(contradictions) as ref from entries) a join entries n on lower(ref) = lower(n.path)),
ew as (select a.src, n.path as dst, 'wikilink' as kind
       from (select path as src, regexp_replace(unnest({LINKS.format("body")}), '^wiki/', '') as ref from entries) a join entries n on lower(ref) = lower(n.path)),
refs as (select * from er union all select * from ec union all select * from ew)"""
_GRAPH = f"""{_NAMED},
tg as (select path, unnest(tags) as tag from entries),
tc as (select a.path as a, b.path as b, count(*) as same from tg a join tg b on a.tag = b.tag and a.path < b.path group by 1, 2),
tj as (select a, b, same / (len(x.tags) + len(y.tags) - same) as jaccard from tc join entries x on x.path = a join entries y on y.path = b),
et as (select a as src, b as dst, 'tag_cooccurrence' as kind from tj where jaccard >= 0.3 union all select b, a, 'tag_cooccurrence' from tj where jaccard >= 0.3),
edges as (select * from refs union all select * from et)"""
_CHANGED_GRAPH = """entries as (select * replace (
  case when domain = 'area1' then ['src3', 'new'] else tags end as tags, case when domain = 'area1' then ['AREA0/21.md'] else related end as related,
  case when domain = 'area1' then '[[area2/2.md]]' else body end as body) from entries0 where doc_id % 50 <> 3),
er as ("""
_DEGREE = "deg as (select dst as path, count(*) as in_degree from refs group by dst)"
_HUBS = """hub as (select cast(case when (select count(*) from entries) < 50 then 5
  else greatest(3, least(20, ceil(2.0 * (select count(*) from edges) / (select count(*) from entries)))) end as bigint) as threshold)"""


def _near(start: str, hops: int, table: str) -> str:
    parts = [f"h0 as (select '{start}' as path, 0 as hop, '' as kind)"]
    for h in range(1, hops + 1):
        seen = " union all ".join(f"select path from h{i}" for i in range(h))
        parts.append(f"h{h} as (select dst as path, {h} as hop, min(kind) as kind from {table} where src in (select path from h{h - 1}) and dst not in ({seen}) group by dst)")
    return ", ".join(parts)


_RANK = "case when confidence = 'high' then 2 when confidence = 'low' then 0 else 1 end"
_NAME = "case when {} = 2 then 'high' when {} = 0 then 'low' else 'medium' end"
_PROPAGATION = f"""{_NAMED},
lk as (select distinct src, dst from (select src, dst from er union all select src, dst from ew
       union all select regexp_replace(unnest(aggregated_from), '^(wiki/)+/*', '') as src, path as dst from entries)),
r0 as (select path, {_RANK} as declared, {_RANK} as rank from entries),
r1 as (select r0.path, declared, least(rank, coalesce(low, rank)) as rank from r0 left join (select dst, min(rank) as low from lk join r0 on src = path group by dst) on dst = path),
r2 as (select r1.path, declared, least(rank, coalesce(low, rank)) as rank from r1 left join (select dst, min(rank) as low from lk join r1 on src = path group by dst) on dst = path),
rep as (select path, {_NAME.format("declared", "declared")} as declared, {_NAME.format("rank", "rank")} as effective, rank < declared as downgraded,
               path in (select dst from ec) as needs_review from (select path, declared, rank from r2))"""

# --- governance ------------------------------------------------------------------

_ISSUES = f"""{E},
iss as (select path, 'ERROR' as severity, 'missing title' as message from entries where coalesce(length(title), 0) = 0
        union all select path, 'ERROR', 'missing domain' from entries where coalesce(length(domain), 0) = 0
        union all select path, 'WARN', 'no tags' from entries where len(tags) = 0
        union all select path, 'INFO', 'quality not scored' from entries where quality_score = 0),
rf as (select path, unnest(related || contradictions) as ref from entries),
br as (select path, ref from rf where ref not in (select path from entries)),
qo as (select path from entries where upper(level) <> 'L0' and len(related) = 0 and len(contradictions) = 0
       and replace(lower(domain), ' ', '_') || '/[' || domain || '] ' || regexp_replace(title, '[/\\\\:*?"<>|]', '_', 'g') || '.md' not in (select unnest(related) from entries)),
more as (select path, 'WARN' as severity, 'orphan' as message from qo union all select path, 'ERROR', 'broken link: ' || ref from br),
al as (select *, substr(sha256(path || '|' || message), 1, 16) as id from (select * from iss union all select * from more)),
cp as (select distinct least(path, ref) as a, greatest(path, ref) as b from (select path, unnest(contradictions) as ref from entries) where ref in (select path from entries)),
cu as (select distinct least(path, ref) as a, greatest(path, ref) as b from (select path, unnest(contradictions) as ref from entries))"""
_GATE = f"""{E},
gate as (select path, publish_status as before, version,
  case when length(title) = 0 or length(domain) = 0 or (quality_score > 0 and quality_score < 0.7) or (quality_score = 0 and status <> 'compiled') then 'blocked'
       when status = 'compiled' and quality_score >= 0.7 then 'published' else 'draft' end as after from entries)"""
_STALE = f"""st as (select path, date_diff('day', coalesce(last_validated, updated), {AS_OF}) as days, quality_score from entries
  where date_diff('day', coalesce(last_validated, updated), {AS_OF}) >= 90)"""

# --- retrieval ---------------------------------------------------------------------

_FIELDS = f"""{E},
ft as (select path, 'title' as field, {TOKENS.format("title")} as t from entries
       union all select path, 'body', {TOKENS.format("body")} from entries
       union all select path, 'tags', {TOKENS.format("array_to_string(tags, ' ')")} from entries),
fs as (select field, avg(len(t)) as mean, count(*) as total from ft group by field),
qt as (select * from (values {TERMS}) q(term)),
tf as (select path, field, len(t) as size, term, len(list_filter(t, lambda x: x = term)) as tf from ft, qt),
hit as (select * from tf where tf > 0),
dfq as (select field, term, count(*) as df from hit group by field, term),
bm as (select path, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 4) as score
       from hit join dfq using (field, term) join fs using (field) group by path)"""
_BUCKET = """(list_reduce(list_concat([37], list_transform(range(1, octet_length(encode(term)) + 1),
   lambda i: cast(concat('0x', substr(hex(encode(term)), cast(2 * i - 1 as int), 2)) as int)), [255]), lambda h, b: (xor(h, b) * 179) & 255) & 255)"""


_UPSERTED = f"""{E.replace("entries as (", "entries0 as (", 1)},
entries as (select * replace (case when domain = 'area1' then 'worthless estion' else body end as body) from entries0){_FIELDS.split(E, 1)[1].replace("('estion'), ('the'), ('thhentha'), ('worthless')", "('worthless')")}"""


def _vectors(source: str) -> str:
    return f"""{source},
tk as (select path, list_filter({TOKENS.format("title || ' ' || body")}, lambda x: octet_length(encode(x)) > 1) as t from entries),
vt as (select path, term, n_tokens, count(*) as tf from (select path, len(t) as n_tokens, unnest(t) as term from tk) group by path, term, n_tokens),
dfr as (select term, count(*) as df from vt group by term),
idf as (select term, ln(((select count(*) from entries) + 1) / (df + 1)) + 1 as idf, cast({_BUCKET} as int) as bucket from dfr),
vw as (select path, bucket, sum(tf / greatest(n_tokens, 1) * idf) as w from vt join idf using (term) group by path, bucket),
vec as (select path, bucket, w / sqrt(sum(w * w) over (partition by path)) as weight from vw)"""


_QUERY_VECTOR = f"""
qk as (select list_filter({TOKENS.format(f"'{QUERY}'")}, lambda x: octet_length(encode(x)) > 1) as t),
qf as (select term, count(*) / max(n) as tf from (select len(t) as n, unnest(t) as term from qk) group by term),
qw as (select cast({_BUCKET} as int) as bucket, sum(tf * coalesce(idf, 1.0)) as w from (select qf.term, tf, idf.idf from qf left join idf on idf.term = qf.term) group by 1),
qv as (select bucket, w / sqrt(sum(w * w) over ()) as q from qw),
sem as (select e.path, round(coalesce(s, 0.0), 6) as score from entries e left join (select path, sum(weight * q) as s from vec join qv using (bucket) group by path) d on d.path = e.path)"""
_BOTH = _vectors(_FIELDS) + "," + _QUERY_VECTOR


def _fused(n: int) -> str:
    return f"""{_BOTH},
k as (select path, row_number() over (order by score desc, path) as r from (select * from bm order by score desc, path limit {n})),
s as (select path, row_number() over (order by score desc, path) as r from (select * from sem order by score desc, path limit {n})),
rrf as (select path, round(sum(1.0::double / (60 + r)), 8) as score from (select * from k union all select * from s) group by path)"""


def _phrase_count(words: str) -> str:
    """How often words follow one another in ``t``."""
    ws = words.split()
    return f"len(list_filter(range(1, len(t) + 1), lambda i: {' and '.join(f't[i + {n}] = {chr(39)}{w}{chr(39)}' for n, w in enumerate(ws))}))"


def _clause_scores(*clauses: tuple[str, str, str]) -> str:
    """``ch``: clause name, path and score, for clauses of a name, words and a field (empty: any)."""
    words = sorted({w for _, ws, _ in clauses for w in ws.split()})
    counts = " union all ".join(
        f"select '{name}' as clause, path, field, len(t) as size, {_phrase_count(ws)} as tf, [{', '.join(repr(w) for w in ws.split())}] as ws from ft" + (f" where field = '{field}'" if field else "")
        for name, ws, field in clauses
    )
    return f"""{_FIELDS.split("qt as (")[0].rstrip().rstrip(",")},
cw as (select field, term, count(*) as df from (select field, unnest(list_distinct(t)) as term from ft) where term in ({", ".join(repr(w) for w in words)}) group by field, term),
ct as (select * from ({counts}) where tf > 0),
ch as (select clause, path, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) as score
       from (select clause, path, field, size, tf, unnest(ws) as term from ct) join cw using (field, term) join fs using (field) group by clause, path)"""


_INDEX_LINES = """ab as (select path, title, domain, body, string_split(body, chr(10)) as ls from entries),
am as (select *, list_position(list_transform(ls, lambda x: contains(x, '[!ABSTRACT]')), true) as mark from ab),
il as (select path, title, domain, body, '| [[' || path || ']] | ' || coalesce(trim(case when mark > 0 then ls[mark + 1] end, ' '), '') || ' |' as line from am)"""


def _wiki_first(query: str) -> str:
    """``hits`` and ``few``: what wiki-first search finds, and the entries without references that stand in for it."""
    return f"""{_NAMED}, {_INDEX_LINES},
hits as (select path, title, cast(case when contains(lower(line), '{query}') then 1.0 when contains(lower(title), '{query}') then 0.95 else 0.75 end as double) as score from il
         where contains(lower(line), '{query}') or contains(lower(title || ' ' || body), '{query}') order by score desc, path limit 10),
us as (select src as p from er union all select dst from er union all select src from ec union all select dst from ec),
few as (select path, title, 0.1::double as score from entries where path not in (select p from us) order by path limit 3)"""


def _presented(hits: str) -> str:
    """Common table expressions from ``gh`` (path, score) to ``shown`` (hits as they are shown, without near-equal ones)."""
    bucket = f"({_BUCKET} & 127)"
    return f"""gh as ({hits}),
sn as (select path, title, domain, score, body, instr(lower(body), '{QUERY}') as pos, row_number() over (order by score desc, path) as r from gh join entries using (path)),
sp as (select *, case when pos > 0 then substr(body, greatest(1, pos - 100), pos - greatest(1, pos - 100) + {len(QUERY)} + 200) else '' end as snippet from sn),
dt as (select r, list_filter({TOKENS.format("title || ' ' || snippet || ' ' || substr(body, 1, 500)")}, lambda x: octet_length(encode(x)) > 1) as t from sp),
dk as (select r, term, count(*) as tf from (select r, unnest(t) as term from dt) group by r, term),
di as (select term, ln(((select count(*) from gh) + 1) / (count(*) + 1)) + 1 as idf from dk group by term),
dw as (select r, cast({bucket} as int) as bucket, sum(tf * idf) as w from dk join di using (term) group by 1, 2),
dn as (select r, bucket, w / sqrt(sum(w * w) over (partition by r)) as w from dw),
ds as (select y.r as r, x.r as earlier from dn x join dn y using (bucket) where x.r < y.r group by 1, 2 having sum(x.w * y.w) >= 0.92),
dl as (select sp.r, list(earlier) filter (earlier is not null) as near from sp left join ds using (r) group by sp.r),
kp as (select 0::bigint as r, []::bigint[] as kept union all
       select dl.r, case when len(list_intersect(kept, coalesce(near, []::bigint[]))) = 0 then list_append(kept, dl.r) else kept end from kp join dl on dl.r = kp.r + 1),
shown as (select path, title, domain, score, snippet from sp where r in (select unnest(kept) from kp where r = (select max(r) from kp)))"""


_SEARCHABLE = "publish_status = 'published' and quality_score >= 0.7"

# --- changes -----------------------------------------------------------------------

_SOURCES = """with src as (select 'raw/' || doc_id as path, sha256(coalesce(text, '')) as hash from documents),
sta as (select 'raw/' || doc_id as path, case when doc_id % 5 = 0 then 'old' else sha256(coalesce(text, '')) end as source_hash, doc_id % 7 = 0 as empty,
        case when doc_id % 4 = 0 then 'v1' when doc_id % 4 = 1 then 'v2' end as instruction_hash from documents where doc_id % 3 <> 0),
todo as (select path, case when source_hash is null then 'new' when hash <> source_hash then 'changed' when empty then 'no outputs' end as reason
         from src left join sta using (path))"""
_MANIFESTS = """with loc as (select 'wiki/' || doc_id as path, sha256(coalesce(text, '')) as hash from documents where doc_id % 4 <> 0),
rem as (select 'wiki/' || doc_id as path, sha256(coalesce(text, '') || case when doc_id % 6 = 0 then 'x' else '' end) as hash from documents where doc_id % 5 <> 0)"""
_ROOT = "sha256(string_agg(hash, '|' order by hash))"
_JOBS = "with jobs as (select user_id as job, event_id as seq, ts, event_type as status from events)"
_JOB_LOG = """with lg as (select user_id || '/' || strftime(ts, '%d') as job, event_id as seq, ts,
  case event_type when 'click' then 'start' when 'view' then 'succeed' when 'error' then 'fail' when 'signup' then 'complete' else 'await' end as action,
  case when event_type in ('click', 'view', 'error') then ['extract', 'prompt_gen', 'agent_wiki', 'index_rebuild', 'quality_gate'][event_id % 2 + hour(ts) % 2 * 2 + 1] end as stage,
  case event_type when 'error' then 'error ' || event_id when 'signup' then case when event_id % 2 = 0 then 'completed' else 'partial' end end as detail from events),
sg as (select *, max(case when action = 'start' then ts end) over (partition by job, stage order by seq rows between unbounded preceding and 1 preceding) as since from lg where stage is not null),
se as (select job, stage, arg_max(action, seq) as last_, arg_max(ts, seq) filter (action = 'start') as started, arg_max(ts, seq) filter (action <> 'start') as finished,
         arg_max({'ms': case when since is not null then greatest(0, date_sub('millisecond', since, ts)) end}, seq) filter (action <> 'start') as ms, arg_max(detail, seq) filter (action = 'fail') as failure,
         max(seq) filter (action = 'fail') as failed, max(seq) filter (action = 'start') as restart from sg group by job, stage),
sts as (select job, stage, case last_ when 'start' then 'running' when 'fail' then 'failed' else 'succeeded' end as status, started, finished, ms.ms as duration_ms,
          case when coalesce(restart, -1) < failed then failure end as error from se)"""
_POSITIONS = """with pg as (select doc_id as doc, generate_subscripts(a, 1) as page, unnest(a) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents)),
ps as (select doc, page, coalesce(sum(length(line)) over (partition by doc order by page rows between unbounded preceding and 1 preceding), 0) as start from pg),
tx as (select doc_id as doc, replace(coalesce(text, ''), chr(10), '') as text from documents),
kw as (select * from (values ('estion'), ('worthless'), ('The')) k(keyword)),
kp as (select doc, keyword, text, string_split(lower(text), lower(keyword)) as parts from tx, kw where contains(lower(text), lower(keyword))),
kg as (select doc, keyword, text, generate_subscripts(parts, 1) as i, unnest(parts) as part from kp),
kc as (select doc, keyword, text, i, row_number() over (partition by doc, keyword order by i desc) as last_,
         cast(sum(length(part)) over (partition by doc, keyword order by i) as bigint) + (i - 1) * length(keyword) as position from kg),
kh as (select kc.doc, keyword, page, position, substr(text, greatest(position - 20, 0) + 1, position + length(keyword) + 20 - greatest(position - 20, 0)) as context
       from kc asof join (select doc, start, max(page) as page from ps group by doc, start) s on kc.doc = s.doc and kc.position >= s.start where last_ > 1)"""
_HTML = r"""with p as (select page_id, coalesce(html, '') as html, strlen(html) as size from pages),
f as (select page_id, size, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as links,
      length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ')) as text_chars from p)"""
_DAY = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_FENCED = """ln as (select path, pos, line, starts_with(ltrim(line, ' '), '```') as fence
  from (select path, generate_subscripts(a, 1) as pos, unnest(a) as line from (select path, string_split(body, chr(10)) as a from entries))),
op as (select *, sum(case when fence then 1 else 0 end) over (partition by path order by pos) as k from ln)"""


def _drift() -> str:
    """Findings and, as ``dr``, pairs of entries that drift apart."""
    return f"""{_vectors(_ISSUES)}, tt as (select path, created, unnest(list_distinct(tags)) as tag from entries),
      pr as (select x.path as a, y.path as b, min(tag) as tag from tt x join tt y using (tag) where x.path < y.path and abs(date_diff('day', x.created, y.created)) >= 90 group by 1, 2),
      dt as (select a, b, sum(u.weight * v.weight) as s from pr join vec u on u.path = a join vec v on v.path = b and v.bucket = u.bucket group by a, b),
      dd as (select a, b, tag, round(coalesce(s, 0.0), 4) as similarity from pr left join dt using (a, b)),
      dr as (select a, b, x.title as a_title, y.title as b_title, tag, similarity from dd join entries x on x.path = a join entries y on y.path = b where similarity < 0.6)"""


SQL: dict[str, str] = {
    "scan_fulltext_docs": f"{E} select path, title, domain, array_to_string(tags, ' ') as tags, cast(length(body) as bigint) as chars from entries where {_SEARCHABLE}",
    "scan_graph_nodes": f"{E} select path, title, domain, array_to_string(tags, ',') as tags, level from entries",
    "scan_embedding_docs": f"{E} select path, sha256(title || ' ' || body) as text_hash from entries where {_SEARCHABLE}",
    "wiki_entry_listing": f"{E} select path, title, domain, array_to_string(tags, ',') as tags, level from entries",
    "entries_by_domain": f"{E} select split_part(path, '/', 1) as domain, count(*) as n, round(avg(quality_score), 6) as quality from entries group by 1",
    "scan_quality_entries": f"{E} select path, quality_score, status, publish_status, cast(len(tags) as bigint) as n_tags from entries",
    "wiki_index_rows": f"{E}, {_INDEX_LINES} select domain, cast(row_number() over (partition by domain order by title, path) as int) as place, line from il",
    "discover_domains": f"{E} select distinct domain from entries",
    "log_tail": f"{_JOBS} select job, seq, status from jobs order by ts desc, seq desc limit 20",
    "entry_point_lookup": f"{E} select path, title, version from entries where domain = 'area0' and path = '{CENTER}'",
    "domain_listing": f"{E} select domain, count(*) as n, min(path) as first from entries group by domain",
    "reflow_text": f"""{E}, l as (select path, list_filter(string_split(body, chr(10)), lambda x: length(trim(x, ' ')) > 0) as ls from entries)
      select path, sha256(array_to_string(list_transform(range(0, cast(ceil(len(ls) / 5.0) as bigint)), lambda k: array_to_string(ls[5 * k + 1 : 5 * k + 5], chr(10))), chr(10) || chr(10))) as reflowed from l""",
    "front_matter_split": f"""{E}, y as (select path, body, 'title: "' || title || '"' || chr(10) || 'domain: "' || domain || '"' || chr(10) || 'source: "' || source || '"' || chr(10) || 'page: "' || page || '"' || chr(10) ||
        'tags: [' || array_to_string(list_transform(tags, lambda x: '"' || x || '"'), ', ') || ']' || chr(10) ||
        'contradictions: [' || array_to_string(list_transform(contradictions, lambda x: '"' || x || '"'), ', ') || ']' || chr(10) ||
        'related: [' || array_to_string(list_transform(related, lambda x: '"' || x || '"'), ', ') || ']' || chr(10) ||
        'aggregated_from: [' || array_to_string(list_transform(aggregated_from, lambda x: '"' || x || '"'), ', ') || ']' || chr(10) ||
        'level: ' || level || chr(10) || 'confidence: ' || confidence || chr(10) || 'quality_score: ' || quality_score || chr(10) || 'status: ' || status || chr(10) ||
        'publish_status: ' || publish_status || chr(10) || 'version: ' || version || chr(10) || 'created: ' || {_DAY.format("created")} || chr(10) || 'updated: ' || {_DAY.format("updated")} ||
        case when last_validated is null then '' else chr(10) || 'last_validated: ' || {_DAY.format("last_validated")} end as yaml from entries)
      select path, cast(length(trim(yaml, ' ' || chr(10))) + 2 as bigint) as yaml_chars, sha256(body) as body_hash from y""",
    "parse_light_meta": f"{E} select path, title, domain, level from entries",
    "parse_entries": f"{E} select path, title, domain, level, quality_score, version, array_to_string(tags, ',') as tags, created, body from entries",
    "searchable_entries": f"{E} select path, quality_score from entries where {_SEARCHABLE}",
    "minimal_quality": f"{E} select path from entries where length(title) > 0 and length(domain) > 0 and len(tags) > 0",
    "page_range_select": f"""{E}, parts as (select path, unnest(string_split(page, ',')) as part from entries),
      r as (select path, cast(split_part(part, '-', 1) as int) as low, cast(case when contains(part, '-') then split_part(part, '-', 2) else part end as int) as high from parts)
      select distinct path, cast(unnest(range(low, least(high, 10) + 1)) as int) as page from r where low <= least(high, 10)""",
    "path_safety": f"{E} select path, doc_id % 10 > 1 as ok from entries",
    "canonical_paths": f"{E} select path, replace(lower(domain), ' ', '_') || '/[' || domain || '] ' || title || '.md' as canonical from entries",
    "markdown_structure": f"""{E}, {_FENCED},
      a as (select path, count(*) filter (not fence and k % 2 = 0 and regexp_matches(line, '^#+[ \\t]')) as headings,
                   coalesce(sum(case when not fence and k % 2 = 0 then len({LINKS.format("line")}) end), 0) as links, count(*) filter (fence) as f from op group by path)
      select path, headings, cast(links as bigint) as links, cast(ceil(f / 2.0) as bigint) as fenced_blocks from a""",
    "page_facts": f"{_HTML} select page_id, title, cast(links as bigint) as links, cast(text_chars as bigint) as text_chars from f",
    "probe_quality": f"{_HTML} select page_id, case when text_chars / greatest(size, 1) >= 0.3 then 'digital' when text_chars / greatest(size, 1) >= 0.05 then 'hybrid' else 'scanned' end as method from f",
    "line_diff": f"""{E}, l as (select path, generate_subscripts(a, 1) as pos, unnest(a) as x, unnest(b) as y
        from (select path, string_split(body, chr(10)) as a, string_split(replace(body, 'the', 'THE'), chr(10)) as b from entries))
      select path, sha256('--- original' || chr(10) || '+++ patched' || chr(10) || coalesce(string_agg(case when x <> '' then '-' || x || chr(10) else '' end || case when y <> '' then '+' || y || chr(10) else '' end, '' order by pos)
        filter (x is distinct from y), '')) as diff from l group by path""",
    "titles_of_paths": f"""{E} select path, title from entries""",
    "normal_tags": f"""{E} select path, array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(' ' || upper(t)))), lambda t: octet_length(encode(t)) >= 3))), ',') as tags from entries""",
    "truncated_bodies": f"{E} select path, case when length(body) > 120 then substr(body, 1, 120) || '...' else body end as body from entries",
    "patch_section": f"""{E}, l as (select path, version, title, body, string_split(body, chr(10)) as a from entries),
      h as (select path, version, body, a, list_filter(generate_series(2, len(a)), lambda i: regexp_matches(a[i], '^#[ \\t]')) as later from l)
      select path, cast(version + cast(new <> body as int) as int) as version, new as body from (select path, version, body, a[1] || chr(10) || 'put here' ||
        case when len(later) > 0 then chr(10) || array_to_string(a[later[1]:], chr(10)) else '' end as new from h)""",
    "patch_front_matter": f"{E} select path, title, 'L1' as level, cast(version + cast(level <> 'L1' as int) as int) as version from entries",
    "layout_regions": r"""with d as (select doc_id as id, cast(doc_id as varchar) as i, substr(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g'), 1, 200) as head from documents)
      select id, cast(1 as int) as place, i || ',2,3,' || i as box, right(head || ' ', 50) || '[' || i || ', 2,3 ,' || i || ']' || ' table ' as context from d
      union all select id, 2, i || ',0,0,1', ' table ' || '[' || i || ',0,0,1]' || left(' ' || head, 50) from d""",
    "raw_sources_by_kind": """select kind, count(*) as n from (select case when doc_id % 7 in (0, 1) then 'pdf' when doc_id % 7 = 2 then 'markdown' when doc_id % 7 = 4 then 'image' end as kind from documents)
      where kind is not null group by kind""",
    "file_info": "select page_id, strlen(html) as bytes, round(strlen(html) / 1048576, 2) as megabytes from pages",
    "escalations": f"{_HTML} select page_id, case when text_chars <= 400 then 'ocr' when page_id % 10 < 3 then 'vlm' else 'none' end as escalate from f",
    "result_previews": f"""{E}, b as (select path, regexp_replace(body, '[^a-zA-Z ]', ' ', 'g') as t from entries)
      select path, sha256(case when length(t) > 300 then '{{"truncated":true,"chars":' || length(t) || ',"preview":"' || substr(t, 1, 300) || '"}}' else t end) as preview_hash from b""",
    "longest_extraction": "select doc_id, greatest(length(coalesce(text, '')), length(source)) as chars from documents",
    "corpus_texts": f"{E} select path, sha256(title || ' ' || body) as text_hash from entries",
    "propagation_write_back": f"""{_PROPAGATION} select e.path, case when downgraded or needs_review then effective else confidence end as confidence,
      case when needs_review then 'needs_recompile' else status end as status from entries e join rep using (path)""",
    "domain_partitions": f"""{_GRAPH}, en as (select x.domain as a, y.domain as b from edges join entries x on x.path = src join entries y on y.path = dst)
      select domain, count(*) as nodes, (select count(*) from en where a = domain and b = domain) as inside, (select count(*) from en where a = domain and b <> domain) as leaving from entries group by domain""",
    "domain_subgraph": f"""{_GRAPH} select src, dst, kind, count(*) as n from edges where src in (select path from entries where domain = 'area2') and dst in (select path from entries where domain = 'area2') group by src, dst, kind""",
    "meta_lint": f"""{_GRAPH}, {_DEGREE}, {_HUBS}, {_ISSUES.split(E, 1)[1].lstrip(", ")}, {_STALE}, {_PROPAGATION.split(_NAMED, 1)[1].lstrip(", ")},
      ag as (select count(*) as n from deg, hub where in_degree >= threshold)
      select count(*) filter (severity = 'ERROR') as errors, count(*) filter (severity = 'WARN') as warnings, count(*) filter (severity = 'INFO') as infos,
        (select count(*) from br) as broken, (select count(*) from qo) as orphans, (select count(*) from cp) as contradictions, (select count(*) from st) as stale,
        (select count(*) from deg where in_degree >= 2) as load_bearing, (select count(*) from rep where downgraded) as downgraded, (select count(*) from rep where needs_review) as needs_review,
        (select n from ag) as hubs, (select round(1 - n / (select count(*) from entries), 6) from ag) as diversity_index from iss""",
    "sync_pull_newest": f"""{_MANIFESTS} select path, case when loc.hash is null then 'add' when cast(split_part(path, '/', 2) as bigint) % 3 = 0 then 'replace' else 'keep' end as action
      from rem left join loc using (path) where loc.hash is distinct from rem.hash""",
    "sync_store_after_push": """with c as (select distinct coalesce(text, '') as t from documents where doc_id % 5 <> 0 or doc_id % 4 <> 0)
      select substr(sha256(t), 1, 2) || '/' || substr(sha256(t), 3) as object_key, strlen(t) as bytes from c""",
    "any_change": f"""{_MANIFESTS} select (select list_sort(list(path || hash)) from loc) is distinct from (select list_sort(list(path || hash)) from rem) as changed""",
    "flag_states": """select event_id, case event_id % 4 when 0 then event_id % 8 >= 4 when 1 then event_id % 8 >= 4 when 2 then coalesce(user_id in (1, 2, 3), false) else false end as is_on from events""",
    "tool_tiers": "select distinct event_type, case when event_type in ('click', 'view') then 'core' when event_type = 'purchase' then 'code_only' else 'deferred' end as tier from events",
    "camel_names": "select distinct event_type, 'onNew' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) as camel from events",
    "retry_delays": "select n_nationkey, round(least(0.5 * pow(2, n_nationkey), 30) * 1.1, 6) as seconds from nation",
    "proposals_pending": "select event_id as id, user_id as job from events where event_type = 'view'",
    "patch_search_replace": f"{E} select path, version + cast(contains(body, 'the ') as int) as version, sha256(replace(body, 'the ', 'THE ')) as body_hash from entries",
    "wiki_tree": f"{E} select split_part(path, '/', 1) as name, count(*) as entries, false as is_entry from entries group by 1 union all select title, 1, true from entries",
    "highlight_hits": f"""{E} select path, sha256(regexp_replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '(estion)', '<mark>\\1</mark>', 'gi')) as marked,
      cast(len(regexp_extract_all(lower(body), 'estion')) as bigint) as n from entries where contains(lower(body), 'estion')""",
    "search_snippets": f"""{E}, a as (select path, body, instr(lower(body), 'estion') as pos from entries where contains(lower(body), 'estion'))
      select path, sha256(substr(body, greatest(1, pos - 100), pos - greatest(1, pos - 100) + 200)) as snippet from a""",
    "edges_related": f"{_NAMED} select * from er",
    "edges_contradiction": f"{_NAMED} select * from ec",
    "edges_wikilink": f"{_NAMED} select * from ew",
    "edges_tag_cooccurrence": f"{_GRAPH} select * from et",
    "graph_edges": f"{_GRAPH} select src, dst, kind, count(*) as n from edges group by all",
    "graph_stats": f"{_GRAPH} select (select count(*) from entries) as nodes, (select count(*) from edges) as edges",
    "suggest_links": f"""{_GRAPH}, own as (select tags from entries where path = '{CENTER}'),
      s as (select e.path, title, round(len(list_intersect(e.tags, own.tags)) / len(list_distinct(e.tags || own.tags)), 6) as score from entries e, own where e.path <> '{CENTER}')
      select * from s where score >= 0.1 and path not in (select dst from edges where src = '{CENTER}') order by score desc, path limit 5""",
    "suggest_links_by_tags": f"""{E}, s as (select path, title, round(len(list_intersect(tags, ['src3', 'g4', 'h2'])) / len(list_distinct(tags || ['src3', 'g4', 'h2'])), 6) as score from entries)
      select * from s where score >= 0.1 order by score desc, path limit 10""",
    "find_orphans": f"""{_NAMED}, u as (select src as p from er union all select dst from er union all select src from ec union all select dst from ec)
      select path, title, domain from entries where path not in (select p from u)""",
    "backlinks": f"{E} select distinct path, title from (select path, title, unnest(related || contradictions) as ref from entries) where ref = '{CENTER}'",
    "reference_in_degree": f"{_NAMED}, {_DEGREE} select * from deg",
    "load_bearing_entries": f"{_NAMED}, {_DEGREE} select path, in_degree, case when in_degree >= 6 then 'critical' when in_degree >= 4 then 'protected' else 'normal' end as protection from deg where in_degree >= 2",
    "neighbors_nhop": f"{_NAMED}, {_near(CENTER, 3, 'refs')} select * from h1 union all select * from h2 union all select * from h3",
    "concept_map_edges": f"""{_NAMED}, both_ as (select * from refs union all select dst, src, kind from refs), {_near(CENTER, 2, 'both_')},
      near as (select path from h0 union all select path from h1 union all select path from h2)
      select distinct src, dst, kind, case when kind = 'contradiction' then '--x' when kind = 'tag_cooccurrence' then '-.->' else '-->' end as arrow from refs
      where src in (select path from near) and dst in (select path from near)""",
    "concept_map_text": f"""{_NAMED}, both_ as (select * from refs union all select dst, src, kind from refs), {_near(CENTER, 2, 'both_')},
      near as (select path from h0 union all select path from h1 union all select path from h2),
      ce as (select distinct src, dst, kind, case when kind = 'contradiction' then '--x' else '-->' end as arrow,
             case kind when 'related' then 'relates' when 'contradiction' then 'contradicts' else 'wikilink' end as name from refs where src in (select path from near) and dst in (select path from near)),
      cn as (select path, title, row_number() over (order by path) - 1 as n from entries where path in (select src from ce union select dst from ce union select '{CENTER}')),
      cl as (select 0 as part, 0 as n, 'graph LR' as line union all select 3, 0, '    classDef center stroke-width:2px'
             union all select 1, n, '    n' || n || '["' || replace(title, '"', chr(39)) || '"]' || case when path = '{CENTER}' then ':::center' else '' end from cn
             union all select 2, 0, '    n' || x.n || ' ' || arrow || '|' || name || '| n' || y.n from ce join cn x on src = x.path join cn y on dst = y.path)
      select sha256(string_agg(line, chr(10) order by part, n, line)) as text_hash, cast(length(string_agg(line, chr(10) order by part, n, line)) as bigint) as chars from cl""",
    "graph_after_upsert": f"""{_GRAPH.replace("entries as (", "entries0 as (", 1).replace("er as (", _CHANGED_GRAPH, 1)} select src, dst, kind, count(*) as n from edges group by src, dst, kind""",
    "stored_graph_stats": f"{_GRAPH} select (select count(*) from entries) as nodes, (select count(*) from edges) as edges",
    "confidence_propagation": f"{_PROPAGATION} select * from rep",
    "propagation_summary": f"""{_PROPAGATION} select count(*) as entries, count(*) filter (downgraded) as downgraded, count(*) filter (needs_review) as needs_review,
      count(*) filter (effective = 'low') as effective_low from rep""",
    "cognitive_diversity": f"""{_GRAPH}, {_DEGREE}, {_HUBS}, h as (select count(*) as hubs from deg, hub where in_degree >= threshold), n as (select count(*) as entries from entries)
      select entries, hubs, round(case when entries > 0 then 1 - hubs / entries else 1.0 end, 6) as diversity_index from n, h""",
    "diversity_warnings": f"{_GRAPH}, {_DEGREE}, {_HUBS} select path, in_degree from deg, hub where in_degree >= threshold and path not in (select path from entries where len(contradictions) > 0)",
    "quality_issues": f"{_ISSUES} select * from iss",
    "quality_issues_filtered": f"{_ISSUES} select * from iss where severity = 'WARN' union all select * from more",
    "list_quality_issues": f"{_ISSUES} select * from al",
    "quality_snapshot": f"{_ISSUES} select path, severity, message from al order by severity, path, message limit 20",
    "fix_suggestions": f"""{_ISSUES} select id, path, case when starts_with(message, 'broken link') then 'patch_wiki_entry' when message = 'orphan' then 'suggest_links' when message = 'no tags' then 'patch_wiki_entry'
      when message = 'quality not scored' then 'check_quality' else 'save_wiki_entry' end as action from al""",
    "broken_links": f"{_ISSUES} select * from br",
    "referenced_paths": f"{E} select distinct unnest(related || contradictions) as path from entries",
    "quality_orphans": f"{_ISSUES} select * from qo",
    "avg_quality_score": f"{E} select round(coalesce(avg(quality_score) filter (quality_score > 0), 0.0), 6) as avg_quality, count(*) filter (quality_score > 0) as scored from entries",
    "distinct_domains": f"{E} select count(distinct domain) as domains from entries",
    "entries_per_domain": f"{E} select split_part(path, '/', 1) as folder, count(*) as n from entries group by 1",
    "contradiction_pairs": f"{_ISSUES} select * from cp",
    "contradiction_pairs_enriched": f"{_ISSUES} select a, b, title as b_title from cu left join entries on path = b",
    "contradictions_explicit": f"{_ISSUES} select * from cu",
    "contradiction_pair_count": f"{_ISSUES} select count(*) as pairs from cu",
    "contradiction_issues": f"{_ISSUES} select a as path, 'ERROR' as severity, 'contradicts ' || b as message from cp",
    "publish_gate": f"{_GATE} select path, before, after, before <> after as changed, version + cast(before <> after as int) as version from gate",
    "gate_summary": f"""{_GATE} select count(*) filter (after = 'published') as published, count(*) filter (after = 'blocked') as blocked, count(*) filter (after = 'draft') as draft,
      count(*) filter (before <> after) as changed from gate""",
    "stale_entries": f"{E}, {_STALE} select path, days, round(least(1.0, greatest(0.0, quality_score * power(0.5, days / 180))), 6) as decayed from st",
    "drift_pairs": f"""{_vectors(E)}, tt as (select path, created, unnest(list_distinct(tags)) as tag from entries),
      pr as (select x.path as a, y.path as b, min(tag) as tag from tt x join tt y using (tag) where x.path < y.path and abs(date_diff('day', x.created, y.created)) >= 90 group by 1, 2),
      dt as (select a, b, sum(u.weight * v.weight) as s from pr join vec u on u.path = a join vec v on v.path = b and v.bucket = u.bucket group by a, b),
      dd as (select a, b, tag, round(coalesce(s, 0.0), 4) as similarity from pr left join dt using (a, b))
      select a, b, x.title as a_title, y.title as b_title, tag, similarity from dd join entries x on x.path = a join entries y on y.path = b where similarity < 0.6""",
    "planned_actions": f"""{_drift()}
      select cast(1 as int) as place, 'suggest_links' as tool, path as target, cast(json_object('entry_path', path, 'top_k', 5) as varchar) as arguments, 'nothing refers to this entry' as reason
      from (select path from qo order by path limit 5)
      union all select 2, 'patch_wiki_entry', path, cast(json_object('entry_path', path, 'drop', list_sort(list(distinct ref))) as varchar), 'references lead nowhere'
      from br where path = (select min(path) from br) group by path
      union all select 3, 'hypothesis_test', null, '{{}}', 'contradictions may be open'
      union all select 4, 'recompile_entry', a, cast(json_object('entry_path', a) as varchar), 'differs most from an entry of the same tag'
      from (select a from dr where (select count(*) from dr) > 2 order by similarity, a, b limit 1)
      union all select 5, 'rebuild_index', null, '{{}}', 'searches should see what was mended'""",
    "quality_report_full": f"""{_drift()}, hd as (select count(*) as entries, count(distinct domain) as domains,
        round(coalesce(avg(case when quality_score > 0 then quality_score end), 0), 6) as avg_quality from entries)
      select cast(0 as int) as section, '- **Total entries**: ' || entries as line from hd union all select 0, '- **Domains**: ' || domains from hd
      union all select 0, '- **Average quality score**: ' || cast(round(avg_quality * 100, 1) as varchar) || '%' from hd
      union all select 0, '- **Orphan entries**: ' || (select count(*) from qo) union all select 0, '- **Broken links**: ' || (select count(*) from br)
      union all select 0, '- **Findings**: ' || (select count(*) from iss)
      union all select 1, '| ' || severity || ' | ' || path || ' | ' || message || ' |' from iss union all select 2, '- `' || path || '`' from qo
      union all select 3, '- `' || path || '` → `' || ref || '`' from br
      union all select 4, '- `' || a || '` | `' || b || '` | ' || tag || ' | ' || cast(cast(similarity as decimal(6,4)) as varchar) from dr""",
    "next_actions": f"""{_ISSUES} select cast(1 as int) as place, 'suggest_links' as tool, path as target from (select path from qo order by path limit 5)
      union all select 2, 'patch_wiki_entry', min(path) from br having count(*) > 0 union all select 3, 'hypothesis_test', null union all select 4, 'rebuild_index', null""",
    "quality_snapshot_counts": f"""{_ISSUES}, {_GATE.split(E, 1)[1].lstrip(", ")}
      select (select count(*) from iss) as issues, (select count(*) from qo) as orphans, (select count(*) from cp) as contradictions, (select count(*) from br) as broken,
        count(*) filter (after = 'published') as published, count(*) filter (after = 'blocked') as blocked, count(*) filter (after = 'draft') as draft from gate""",
    "quality_report_lines": f"""{_ISSUES}, hd as (select count(*) as entries, count(distinct domain) as domains,
        round(coalesce(avg(case when quality_score > 0 then quality_score end), 0), 6) as avg_quality from entries)
      select cast(0 as int) as section, '- **Total entries**: ' || entries as line from hd union all select 0, '- **Domains**: ' || domains from hd
      union all select 0, '- **Average quality score**: ' || cast(round(avg_quality * 100, 1) as varchar) || '%' from hd
      union all select 0, '- **Orphan entries**: ' || (select count(*) from qo) union all select 0, '- **Broken links**: ' || (select count(*) from br)
      union all select 1, '| ' || severity || ' | ' || path || ' | ' || message || ' |' from iss union all select 2, '- `' || path || '`' from qo
      union all select 3, '- `' || path || '` → `' || ref || '`' from br""",
    "near_duplicate_pairs": f"""{_vectors(E)}, dd as (select u.path as a, v.path as b, round(sum(u.weight * v.weight), 4) as similarity from vec u join vec v on u.bucket = v.bucket and u.path < v.path group by 1, 2)
      select * from dd where similarity >= 0.92""",
    "missing_concept_hints": f"""{E}, t as (select lower(trim(unnest(tags))) as tag from entries)
      select tag, count(*) as n from t where octet_length(encode(tag)) >= 3 and tag not in (select lower(title) from entries) group by tag having count(*) >= 3 order by n desc, tag limit 15""",
    "lint_summary": f"""{_ISSUES}, {_STALE} select count(*) filter (severity = 'ERROR') as errors, count(*) filter (severity = 'WARN') as warnings, count(*) filter (severity = 'INFO') as infos,
      (select count(*) from br) as broken, (select count(*) from qo) as orphans, (select count(*) from cp) as contradictions, (select count(*) from st) as stale from iss""",
    "health_report": f"""{_ISSUES} select count(*) as entries, count(distinct domain) as domains, cast(sum(strlen(body)) as bigint) as body_bytes,
      round(coalesce(avg(quality_score) filter (quality_score > 0), 0.0), 6) as avg_quality, (select count(*) from qo) as orphans, (select count(*) from br) as broken, (select count(*) from cp) as contradictions from entries""",
    "bm25_keyword_search": f"{_FIELDS} select * from bm order by score desc, path limit 10",
    "scan_keyword_search": f"{_FIELDS} select * from bm order by score desc, path limit 10",
    "scan_semantic_search": f"{_BOTH} select * from sem order by score desc, path limit 10",
    "index_postings": f"{_FIELDS} select term, count(*) as n, sum(tf)::bigint as tf from (select path, field, term, count(*) as tf from (select path, field, unnest(t) as term from ft) group by 1, 2, 3) group by term",
    "index_sizes": f"{_FIELDS} select field, round(mean, 6) as mean, total from fs",
    "index_upsert": f"{_UPSERTED} select field, count(*) as n, sum(len(t))::bigint as size from ft group by field",
    "index_upsert_search": f"{_UPSERTED} select * from bm order by score desc, path limit 5",
    "sharded_search": f"""{_FIELDS}, sd as (select f.*, domain from ft f join entries using (path)),
      ss as (select domain, field, avg(len(t)) as mean, count(*) as total from sd group by domain, field),
      hs as (select domain, path, field, size, term, tf from hit join entries using (path)),
      dd as (select domain, field, term, count(*) as df from hs group by domain, field, term)
      select path, domain, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 4) as score
      from hs join dd using (domain, field, term) join ss using (domain, field) group by domain, path order by score desc, path limit 10""",
    "light_hits": f"""{_FIELDS}, tp as (select * from bm order by score desc, path limit 10)
      select path, title, score, case when pos > 0 then substr(body, greatest(1, pos - 100), pos - greatest(1, pos - 100) + 200) else substr(body, 1, 200) end as snippet
      from (select path, title, score, body, instr(lower(body), 'estion') as pos from tp join entries using (path))""",
    "keyword_search_domain": f"{_FIELDS} select bm.* from bm join entries using (path) where domain = 'area3' order by score desc, path limit 10",
    "search_gate_semi_join": f"{_FIELDS}, top as (select * from bm order by score desc, path limit 100) select * from top where path in (select path from entries where {_SEARCHABLE}) order by score desc, path limit 5",
    "search_domain_facets": f"{_FIELDS}, top as (select * from bm order by score desc, path limit 50) select domain, count(*) as n from top join entries using (path) group by domain",
    "tfidf_document_frequency": f"{_vectors(E)} select * from dfr",
    "tfidf_term_frequency": f"{_vectors(E)} select path, term, tf from vt",
    "tfidf_idf": f"{_vectors(E)} select term, round(idf, 6) as idf, bucket from idf",
    "tfidf_vectors": f"{_vectors(E)} select path, bucket, round(weight, 6) as weight from vec",
    "vector_upsert": f"{_vectors(E)} select path, count(*) as buckets, round(sum(case when ends_with(path, '7.md') then 0.0 else weight end), 3) as weight from vec group by path",
    "semantic_search": f"{_BOTH} select * from sem order by score desc, path limit 10",
    "embedding_topk": """with q as (select embedding::double[] as v from embeddings where embedding is not null order by vec_id limit 1)
      select vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as score from embeddings, q order by score desc, vec_id limit 10""",
    "rrf_fusion": f"{_fused(20)} select * from rrf",
    "hybrid_search": f"""{_fused(20).replace("with ", "with recursive ", 1)}, top as (select * from rrf order by score desc, path limit 10),
      {_presented(f"select * from top where path in (select path from entries where {_SEARCHABLE})")} select * from shown""",
    "search_dedup": f"""{_FIELDS.replace("with ", "with recursive ", 1)}, {_presented("select * from bm order by score desc, path limit 20")} select * from shown""",
    "index_build": f"""{_vectors(_FIELDS)} select 'postings' as name, count(*) as n from (select distinct path, field, unnest(t) as term from ft)
      union all select 'fields', count(*) from ft union all select 'weights', count(*) from idf union all select 'vectors', count(*) from vec union all select 'shown', count(*) from entries""",
    "phrase_search": f"""{_clause_scores(("a", "of the", ""), ("b", "is the and", ""))} select path, round(sum(score), 4) as score from ch group by path order by score desc, path limit 20""",
    "boolean_search": f"""{_clause_scores(("a", "worthless", ""), ("b", "the", ""), ("no", "src3", "tags"), ("c", "estion", ""))}
      select path, round(sum(score), 4) as score from ch where path in (select path from ch where clause = 'a') and path in (select path from ch where clause = 'b')
        and path not in (select path from ch where clause = 'no') group by path order by score desc, path limit 20""",
    "field_search": f"""{_clause_scores(("a", "21", "title"), ("b", "src3", "tags"), ("c", "and the", "body"))} select path, round(sum(score), 4) as score from ch group by path order by score desc, path limit 20""",
    "search_meta": f"""{_FIELDS}, top as (select * from bm order by score desc, path limit 10) select 'keyword' as mode,
      (select count(*) from top where path in (select path from entries where {_SEARCHABLE})) as hits, (select count(*) from entries where {_SEARCHABLE}) = 0 as index_empty""",
    "recompile_candidates": f"{E} select path, case when status = 'needs_recompile' then 'asked for' else 'source changed' end as reason, version + 1 as version from entries",
    "wiki_first_search": f"{_wiki_first('number 7')} select * from hits",
    "wiki_first_fallback": f"{_wiki_first('no such words')} select * from hits union all select * from few where (select count(*) from hits) = 0",
    "fallback_scan_search": f"""{E}, qt as (select * from (values {TERMS}) q(term)), c as (select path, body, count(*) as n from entries, qt where contains(lower(body), term) group by path, body)
      select path, round(n / sqrt(strlen(body)) * 100, 4) as score from c order by score desc, path limit 10""",
    "keyword_hits_with_page": """with l as (select doc_id as doc, generate_subscripts(a, 1) as page, unnest(a) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents))
      select doc, page, cast(len(regexp_extract_all(lower(line), 'estion')) as bigint) as hits from l where contains(lower(line), 'estion')""",
    "api_catalog_search": """with t as (select distinct name, brand as description, kind as category from items),
      s as (select name, cast(case when lower(name) = 'bolt' then 100 when contains(lower(name), 'bolt') then 50 else 0 end + case when contains(lower(description), 'bolt') then 10 else 0 end
        + case when contains(lower(category), 'bolt') then 5 else 0 end as int) as score from t) select * from s where score > 0 order by score desc, name limit 10""",
    "keyword_positions": f"{_POSITIONS} select doc, keyword, page, position, context from kh",
    "pages_with_matches": f"{_POSITIONS} select doc, count(*) as matches, count(distinct page) as pages from kh group by doc",
    "job_stages": f"{_JOB_LOG} select * from sts",
    "job_states": f"""{_JOB_LOG},
      jt as (select job, coalesce(arg_max(st, seq) filter (st is not null), 'running') as status, arg_max(detail, seq) filter (action in ('fail', 'complete')) as message, min(ts) as begun, max(ts) as updated
             from (select *, case action when 'start' then 'running' when 'fail' then 'failed' when 'await' then 'awaiting_agent' when 'complete' then detail end as st from lg) group by job)
      select jt.*, coalesce(r, 0) as stages_running, coalesce(s, 0) as stages_succeeded, coalesce(f, 0) as stages_failed from jt left join
        (select job, count(*) filter (status = 'running') as r, count(*) filter (status = 'succeeded') as s, count(*) filter (status = 'failed') as f from sts group by job) using (job)""",
    "illegal_steps": f"""{_JOB_LOG},
      li as (select *, lag(action) over (partition by job, stage order by seq) as before,
             coalesce(max(case when action = 'complete' and detail in ('completed', 'partial', 'failed') then 1 else 0 end) over (partition by job order by seq rows between unbounded preceding and 1 preceding), 0) as over_ from lg),
      lr as (select *, case when over_ = 1 then 'the job has ended' when action in ('start', 'succeed', 'fail') and stage is null then 'no such stage'
             when action = 'start' and before = 'start' then 'the stage is running' when action in ('succeed', 'fail') and coalesce(before, '') <> 'start' then 'the stage was not started' end as reason from li)
      select job, seq, action, stage, reason from lr where reason is not null""",
    "sources_needing_compile": f"{_SOURCES} select * from todo where reason is not null",
    "stale_by_instruction": f"{_SOURCES} select path, instruction_hash from sta where instruction_hash is distinct from 'v2'",
    "source_state_upsert": f"""{_SOURCES} select path, case when reason is null then source_hash else hash end as source_hash from todo join src using (path) left join sta using (path)""",
    "sync_manifest": f"{_MANIFESTS} select * from loc",
    "sync_root_hash": f"{_MANIFESTS} select {_ROOT} as root_hash, count(*) as objects from loc",
    "merkle_root": f"""{_MANIFESTS}, lf as (select path, sha256(path || '|' || hash) as node, substr(sha256(path), 1, 3) as bin from loc),
      b as (select bin, sha256(string_agg(node, '' order by path)) as node from lf group by bin) select sha256(string_agg(node, '' order by bin)) as merkle_root from b""",
    "sync_conflicts": f"{_MANIFESTS} select path, loc.hash as local_hash, rem.hash as remote_hash from loc join rem using (path) where loc.hash <> rem.hash",
    "sync_push_plan": f"{_MANIFESTS} select distinct hash, substr(hash, 1, 2) || '/' || substr(hash, 3) as object_key from loc where hash not in (select hash from rem)",
    "sync_pull_plan": f"{_MANIFESTS} select path, case when loc.hash is null then 'add' else 'replace' end as action from rem left join loc using (path) where loc.hash is distinct from rem.hash",
    "sync_status": f"{_MANIFESTS} select (select {_ROOT} from loc) = (select {_ROOT} from rem) as in_sync, (select count(*) from loc) as local_objects, (select count(*) from rem) as remote_objects",
    "job_current_state": f"{_JOBS} select job, status, ts as at from jobs qualify row_number() over (partition by job order by ts desc, seq desc) = 1",
    "job_stage_durations": f"""{_JOBS}, l as (select job, seq, ts, lag(ts) over (partition by job order by ts, seq) as before from jobs)
      select job, seq, cast(floor((epoch_us(ts) - epoch_us(before)) / 1000000) as bigint) as seconds from l where before is not null""",
    "job_history_last10": f"{_JOBS} select job, seq, cast(row_number() over (partition by job order by ts desc, seq desc) as int) as place from jobs qualify place <= 10",
    "status_changes": f"""{_JOBS}, l as (select *, lag(status) over (partition by job order by ts, seq) as before from jobs) select job, seq, status from l where before is null or before <> status""",
    "latest_versions": f"{E} select path, version, sha256(path || '@' || version) as hash from entries",
    "active_locks": """select cast(user_id as varchar) as path, event_type as holder, ts as taken from events where ts + interval 300 second > timestamp '2024-01-15'
      qualify row_number() over (partition by user_id order by ts desc, event_type desc) = 1""",
    "tool_latency_stats": "select event_type as tool, count(*) as calls, count(*) filter (event_id % 10 = 0) as errors, round(avg(value), 4) as avg_latency from events group by 1",
    "latency_histogram": """select event_type as tool, count(*) filter (value <= 10) as le_0, count(*) filter (value <= 50) as le_1, count(*) filter (value <= 100) as le_2,
      count(*) as le_inf from events group by 1""",
    "compile_plan_tasks": f"""{_SOURCES}, en as ({E} select * from entries)
      select 'create_l1' as task, path as target from todo where reason is not null union all select distinct 'domain_map_l3', domain from en
      union all select 'recompile_entry', path from en where status = 'needs_recompile'""",
    "rebuild_stats": f"{_GRAPH} select (select count(*) from entries) as documents, (select count(*) from entries) as nodes, (select count(*) from edges) as edges",
    "events_tumbling": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "events_sliding": """with w as (select time_bucket(interval '1 hour', ts) as s from events), b as (select s as start from w union all select s - interval '1 hour' from w)
      select start, count(*) as n from b group by start""",
    "events_sessions": """with l as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 0 else 1 end as new from events),
      g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from l) select user_id, min(ts) as start, count(*) as n from g group by user_id, s""",
    "pricing_summary": """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_price, round(avg(l_discount), 6) as avg_discount,
      count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
    "revenue_by_nation": """select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
    "customers_without_orders": "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)",
    "segment_rollup": "select c_mktsegment, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from customer join orders on c_custkey = o_custkey group by rollup (c_mktsegment, o_orderstatus)",
    "part_cube": "select p_brand, p_size, count(*) as n from part group by cube (p_brand, p_size)",
    "top_orders_per_customer": "select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) as place from orders qualify place <= 3",
    "running_order_total": """select o_orderkey, round(sum(o_totalprice) over w, 2) as running, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders
      window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)""",
    "brand_sets": """with s as (select p_brand, p_type from part where p_size < 10), l as (select p_brand, p_type from part where p_size > 40)
      select distinct p_brand, p_type, 'except' as side from (select * from s except all select * from l) union all (select *, 'intersect' from (select * from s intersect select * from l))""",
    "status_pivot": """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as F, count(*) filter (o_orderstatus = 'O') as O, count(*) filter (o_orderstatus = 'P') as P from orders group by 1""",
    "last_order_before_event": """with p as (select event_id, user_id, ts from events where event_type = 'purchase'),
      o as (select o_custkey, o_orderkey, timestamp '2024-01-01' + to_days(cast(o_orderkey % 30 as int)) as ots from orders)
      select event_id, (select o_orderkey from o where o_custkey = user_id and ots <= ts order by ots desc, o_orderkey desc limit 1) as last_order from p""",
    "distinct_parts": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1",
}
