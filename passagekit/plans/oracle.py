"""Independent SQL (DuckDB dialect) for every registered query.

Written from the stated semantics in the plainest form an engine on one machine
can run -- global windows, all-pairs distances, whole pools -- which is fine for
small data and is exactly what the Spark plans avoid.
"""

from __future__ import annotations

PASSAGES_RAW = """
passages_raw as (
  select src, num, 'doc' || src || '_' || num as corpus_id, title,
         case when title = '' then line else title || ' ' || line end as text
  from (select doc_id as src, (generate_subscripts(lines, 1) - 1)::INTEGER as num, unnest(lines) as line,
               lines[1] as title
        from (select doc_id, string_split(text, chr(10)) as lines from documents)))"""


def _curate(name: str, raw: str, prefix: str) -> str:
    """Ids by title, the title and one blank taken off the text."""
    return f"""
{name} as (
  select '{prefix}' || dense_rank() over (order by title nulls first) as doc_id, corpus_id, src, num,
         coalesce(title, 'NaN') as title,
         case when title <> '' and starts_with(text, title) then substr(text, length(title) + 2) else text end as text
  from {raw})"""


PASSAGES = PASSAGES_RAW + "," + _curate("passages", "passages_raw", "d_")

DEDUP_PASSAGES = PASSAGES + """,
passages_dedup as (
  select distinct on (doc_id, title, text) doc_id, corpus_id, src, num, title, text
  from passages order by doc_id, title, text, src, num)"""

# all pairs, leave-one-out, squared L2 in double
PAIRS = """
pairs as (
  select q.vec_id as query_id, x.vec_id, x.label as doc,
         list_sum(list_transform(range(1, len(q.e) + 1),
                  lambda i: (q.e[i]::double - x.e[i]::double) * (q.e[i]::double - x.e[i]::double))) as d2
  from vecs q join vecs x on q.vec_id <> x.vec_id),
ranked as (
  select query_id, vec_id, doc, d2,
         row_number() over (partition by query_id order by d2, vec_id) as rank from pairs)"""

RAW_VECS = "vecs as (select vec_id, label::varchar as label, embedding as e from embeddings)"
UNIT_VECS = """vecs as (
  select vec_id, label::varchar as label,
         list_transform(embedding, lambda v: (v::double / sqrt(list_sum(list_transform(embedding,
                        lambda w: w::double * w::double))))::float) as e
  from embeddings)"""

BEST = """
best as (
  select g.vec_id as query_id, min(r.rank) as best
  from vecs g left join ranked r on r.query_id = g.vec_id and r.doc = g.label and r.rank <= 100
  group by g.vec_id)"""

KS = "(select unnest([10, 20, 50, 100]) as k) ks"


def _collapse(src: str, n: int) -> str:
    """Every n-th passage of a document with the passages that directly follow it.

    The next n-1 rows in id order are looked at; those whose id goes on by one
    belong to the group (after a gap no later row can).
    """
    return f"""
select doc_id, array_to_string(list_transform(run, lambda x: x.k), ',') as corpus_ids, title,
       array_to_string(list_transform(run, lambda x: translate(x.t, chr(13) || chr(10), '  ')), ' ') as doc_text,
       src, num as first_num
from (
  select doc_id, title, src, num, place, list_filter(ahead, lambda x, i: x.s = src and x.n = num + i - 1) as run
  from (select doc_id, title, src, num,
               row_number() over (partition by doc_id order by src, num) as place,
               list({{'s': src, 'n': num, 'k': corpus_id, 't': text}}) over (
                 partition by doc_id order by src, num rows between current row and {n - 1} following) as ahead
        from {src}))
where place % {n} = 1 % {n}"""


def _first_copies(src: str) -> str:
    return f"""
select distinct on (doc_id, title, doc_text) * from ({src}) order by doc_id, title, doc_text, src, first_num"""


ORACLE: dict[str, str] = {}

ORACLE["knn_top10"] = f"""
with {RAW_VECS}, {PAIRS}
select query_id, rank::INTEGER as rank, vec_id, round(d2, 6) as d2 from ranked where rank <= 10"""

ORACLE["knn_blocked"] = ORACLE["knn_pruned"] = ORACLE["extended_search"] = ORACLE["knn_top10"]

ORACLE["accuracy_at_k"] = f"""
with {RAW_VECS}, {PAIRS}, {BEST}
select k, round(sum(case when best <= k then 1 else 0 end)::DOUBLE * 100.0 / count(*), 6) as accuracy,
       count(*) as n
from best, {KS} group by k"""

ORACLE["failed_queries"] = f"""
with {RAW_VECS}, {PAIRS}, {BEST}
select b.query_id,
       coalesce((select string_agg(r.doc, ',' order by r.rank) from ranked r
                 where r.query_id = b.query_id and r.rank <= 10), '') as returned
from best b where b.best is null or b.best > 10"""

ORACLE["evaluate_grid"] = f"""
with raw as (
  with {RAW_VECS}, {PAIRS}, {BEST}
  select 'l2' as config, best from best),
unit as (
  with {UNIT_VECS}, {PAIRS}, {BEST}
  select 'l2_unit' as config, best from best),
allb as (select * from raw union all select * from unit)
select config, k, round(sum(case when best <= k then 1 else 0 end)::DOUBLE * 100.0 / count(*), 6) as accuracy,
       count(*) as n
from allb, {KS} group by config, k"""

ORACLE["doc_ids"] = f"""
with {PASSAGES_RAW}
select corpus_id, 'd_' || dense_rank() over (order by title nulls first) as doc_id from passages_raw"""

ORACLE["curated_titles"] = f"""
with {PASSAGES}
select corpus_id, title, text from passages"""

ORACLE["collapse_2"] = f"with {PASSAGES}" + _collapse("passages", 2)

ORACLE["collapse_3"] = f"with {DEDUP_PASSAGES}" + _collapse("passages_dedup", 3)

ORACLE["dedup_passages"] = f"""
with {PASSAGES}
select doc_id, title, doc_text, corpus_ids from ({_first_copies(_collapse("passages", 2))})"""


# ------------------------------------------------------------------ coverage
def _corpus(name: str, cond: str, prefix: str) -> str:
    raw = f"(select p.* from passages_raw p join documents d on d.doc_id = p.src where {cond})"
    return _curate(name, raw, prefix)


CORPORA = PASSAGES_RAW + "," + _corpus("nq", "d.lang = 'en'", "d_") + "," + \
    _corpus("wiki", "not (d.lang = 'en')", "wikidoc_")

# every line in which the text starts: of the document from that line on, the first occurrence lies in the line
ANSWERS = """
answers as (
  select 'q' || item_id as query_id, item_id, src, 'doc' || src || '_' || line as corpus_id
  from (select item_id, item, src, lines, unnest(range(len(lines))) as line
        from (select b.item_id, b.text as item, d.doc_id as src, string_split(d.text, chr(10)) as lines
              from benchmark b join documents d on contains(d.text, b.text) where b.text <> ''))
  where strpos(array_to_string(lines[line + 1:], chr(10)), item) between 1 and length(lines[line + 1]) + 1)"""


def _loose(x: str) -> str:
    return f"replace(lower({x}), ' ', '')"


ORACLE["missing_titles_norm"] = f"""
with {CORPORA}
select distinct title from nq
where not exists (select 1 from wiki where {_loose('wiki.title')} = {_loose('nq.title')})"""

ORACLE["missing_titles_exact"] = f"""
with {CORPORA}, {ANSWERS}
select distinct title from nq
where corpus_id in (select corpus_id from answers)
  and not exists (select 1 from wiki where wiki.title = nq.title)"""

ORACLE["title_coverage"] = f"""
with {CORPORA},
t as (select title, exists (select 1 from wiki where {_loose('wiki.title')} = {_loose('n.title')}) as found
      from (select distinct title from nq) n)
select count(*) as n_titles, count(*) filter (not found) as n_missing,
       round(count(*) filter (not found)::DOUBLE * 100.0 / count(*), 6) as missing_pct from t"""

ORACLE["query_trace"] = f"""
with {PASSAGES}, {ANSWERS}
select query_id, text as query_text, corpus_id, doc_id, title
from benchmark join (select query_id, item_id, p.corpus_id, p.doc_id, p.title
                     from passages p, answers where p.corpus_id = answers.corpus_id) using (item_id)"""

ORACLE["keyword_titles"] = f"""
with {CORPORA}
select distinct title from wiki where title like '%La%' or title like '%De%'"""

ORACLE["match_questions"] = f"""
with {CORPORA}
select a.text, a.n_a, b.n_b
from (select text, count(*) as n_a from nq group by text) a
join (select text, count(*) as n_b from wiki group by text) b on a.text = b.text"""


# ------------------------------------------------------------------ sampling
def U(key: str, seed: int = 42) -> str:
    return (f"(('0x' || substr(md5('{seed}' || '|' || {key}), 1, 8))::BIGINT::DOUBLE"
            f" / 4294967296.0::DOUBLE)")


ORACLE["sample_rate"] = f"""
with {PASSAGES}
select corpus_id, doc_id from passages where {U('corpus_id')} < 0.2"""

ORACLE["sample_about"] = f"""
with {PASSAGES}
select corpus_id from passages where {U('corpus_id')} < 1000::DOUBLE / (select count(*) from passages)"""

ORACLE["sample_per_group"] = f"""
with {PASSAGES}
select doc_id, corpus_id from (
  select doc_id, corpus_id,
         row_number() over (partition by doc_id order by {U('corpus_id')}, corpus_id) as pos
  from passages) where pos <= 5"""

ORACLE["batch_assign"] = f"""
with {PASSAGES},
s as (select corpus_id, {U('corpus_id')} as u from passages
      where {U('corpus_id')} < (50 * 20)::DOUBLE / (select count(*) from passages))
select corpus_id, (ntile(20) over (order by u, corpus_id))::INTEGER as batch_id, '' as questions from s"""


def _corpus_sql(level: int, rate: float) -> str:
    cols = "title, doc_text as text, corpus_ids, NULL::VARCHAR as questions"
    return f"""
with {CORPORA}, {ANSWERS},
grp as ({_collapse('nq', level)}),
gold as (select distinct a.query_id, g.* from grp g join answers a
           on list_contains(string_split(g.corpus_ids, ','), a.corpus_id)),
others as (
  select *, row_number() over (partition by doc_id order by {U('corpus_ids')}, corpus_ids) as place
  from ({_first_copies('select * from grp where doc_id in (select doc_id from gold)')}) g
  where not exists (select 1 from gold where gold.corpus_ids = g.corpus_ids)),
noise as ({_first_copies(f"select * from ({_collapse('wiki', level)}) w "
                         "where not exists (select 1 from nq where nq.title = w.title)")})
select 1 as stage, query_id, doc_id, {cols} from gold
union all select 2 as stage, NULL::VARCHAR as query_id, doc_id, {cols} from others where place <= 5
union all select 3 as stage, NULL::VARCHAR as query_id, doc_id, {cols} from noise where {U('corpus_ids')} < {rate}"""


for _lvl, _rate in ((1, 0.0075), (2, 0.0143), (3, 0.02)):
    ORACLE[f"corpus_level_{_lvl}"] = _corpus_sql(_lvl, _rate)

ORACLE["gold_pairs"] = f"""
with c as ({_corpus_sql(3, 0.02)})
select distinct c.query_id, c.doc_id, q.text as query_text
from c join (select 'q' || item_id as query_id, text from benchmark) q on q.query_id = c.query_id
where c.stage = 1"""


# ------------------------------------------------------------------ text preparation
def _sentence_chain(col: str) -> str:
    from passagekit.functions.text import SENTENCE_STEPS, spelled_out
    t = f"(' ' || {col} || '  ')"
    for kind, a, b in SENTENCE_STEPS:
        if kind == "lit":
            sa = "chr(10)" if a == "\n" else "'" + a + "'"
            t = f"replace({t}, {sa}, '{b}')"
        else:
            rb = b.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
            t = f"regexp_replace({t}, '{spelled_out(a)}', '{rb}', 'g')"
    return t


def _sentences(src: str, key: str, col: str) -> str:
    """(key, parts) -> unnest rows (key, pos, sentence); pos 1-based."""
    from passagekit.functions.text import STRIP
    return f"""
select {key}, generate_subscripts(s, 1) as pos, unnest(s) as sentence from (
  select {key}, list_transform(parts[1:len(parts) - 1],
                               lambda x: regexp_replace(x, '{STRIP}', '', 'g')) as s
  from (select {key}, string_split({_sentence_chain(col)}, '<stop>') as parts from {src}))"""


def _clean_sentences(src: str, key: str, col: str) -> str:
    return f"""
select {key}, (row_number() over (partition by {key} order by first_pos) - 1)::INTEGER as sent_id, sentence
from (select {key}, sentence, min(pos) as first_pos from ({_sentences(src, key, col)}) group by {key}, sentence)"""


SEGMENTS_T = """
paras as (
  select doc_id, row_number() over (partition by doc_id order by pos) as idx, p,
         len(string_split(p, ' ')) as c
  from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos,
               unnest(string_split(text, chr(10))) as p from {src})
  where length(p) > 0),
walk as (
  select doc_id, idx, 0 as seg_id, c as n from paras where idx = 1
  union all
  select w.doc_id, p.idx, case when w.n >= 490 then w.seg_id + 1 else w.seg_id end,
         case when w.n >= 490 then p.c else w.n + p.c end
  from walk w join paras p on p.doc_id = w.doc_id and p.idx = w.idx + 1),
segments as (
  select w.doc_id, w.seg_id::INTEGER as seg_id, string_agg(p.p, ' ' order by w.idx) as segment,
         sum(p.c)::INTEGER as n_tokens
  from walk w join paras p on p.doc_id = w.doc_id and p.idx = w.idx group by w.doc_id, w.seg_id)"""
SEGMENTS = SEGMENTS_T.replace("{src}", "documents")

ENT = "([A-Z][a-z]+(?: [A-Z][a-z]+)*|[0-9]+)"

def entities_sql(src: str) -> str:
    return f"""
csent as ({_clean_sentences(src, 'doc_id', 'text')}),
ents as (
  select doc_id, sent_id, sentence, (generate_subscripts(e, 1) - 1)::INTEGER as ent_id, unnest(e) as ent_text
  from (select doc_id, sent_id, sentence, regexp_extract_all(sentence, '{ENT}', 1) as e from csent)),
ents_l as (
  select *, case when regexp_full_match(ent_text, '[0-9]{{4}}') then 'DATE'
                 when regexp_full_match(ent_text, '[0-9]+') then 'CARDINAL' else 'PROPER' end as label
  from ents)"""


ENTITIES = entities_sql("documents")


def _u3(a: str, b: str, c: str) -> str:
    return U(f"({a}::VARCHAR || '|' || {b} || '|' || {c})")


CHOICES = ENTITIES + f""",
pool as (select distinct doc_id, ent_text, label, {_u3('doc_id', 'ent_text', 'label')} as h from ents_l),
psize as (select doc_id, least(4, count(*)) - 1 as m from pool group by doc_id),
pairs as (
  select e.doc_id, e.ent_text, p.ent_text as wrong,
         row_number() over (partition by e.doc_id, e.ent_text, e.label
                            order by p.label <> e.label, p.h, p.ent_text, p.label) as place
  from pool e join pool p on p.doc_id = e.doc_id and (p.ent_text <> e.ent_text or p.label <> e.label)),
options as (
  select doc_id, ent_text, wrong as answer, false as correct from pairs join psize using (doc_id) where place <= m
  union all select doc_id, ent_text, ent_text, true from pool),
texts as (
  select doc_id, ent_text, string_agg(answer || '|' || correct::VARCHAR, ';'
         order by {_u3('doc_id', 'ent_text', 'answer')}, answer, correct) as choices
  from options group by doc_id, ent_text),
choices as (
  select e.doc_id, e.sent_id, e.ent_id, e.ent_text, e.label, t.choices
  from ents_l e join texts t on t.doc_id = e.doc_id and t.ent_text = e.ent_text)"""

ORACLE["sentence_split"] = f"""
select doc_id, (pos - 1)::INTEGER as sent_id, sentence from ({_sentences('documents', 'doc_id', 'text')})"""

ORACLE["clean_sentences"] = _clean_sentences("documents", "doc_id", "text")

ORACLE["pack_segments"] = f"with recursive {SEGMENTS} select doc_id, seg_id, segment, n_tokens from segments"

ORACLE["entities"] = f"with {ENTITIES} select doc_id, sent_id, ent_id, ent_text, label from ents_l"

ORACLE["choices"] = f"with {CHOICES} select doc_id, sent_id, ent_id, ent_text, choices from choices"

PROMPT_CANDS = f"""
segsent as (
  select doc_id, seg_id, segment, sent_id, sentence from (
    select doc_id, seg_id, segment, sentence,
           (row_number() over (partition by doc_id, seg_id order by first_pos) - 1) as sent_id
    from (select doc_id, seg_id, segment, sentence, min(pos) as first_pos
          from ({_sentences('segments', 'doc_id, seg_id, segment', 'segment')})
          group by doc_id, seg_id, segment, sentence))),
cands as (
  select doc_id, 0 as kind, seg_id::BIGINT as part, sent_id::BIGINT as item, 'sentences' as style,
         sentence as answer, segment as context, '0:' || seg_id || ':' || sent_id as cand_id from segsent
  union all
  select e.doc_id, 1, e.sent_id, e.ent_id, 'multiple_choice', e.ent_text, e.sentence,
         '1:' || e.sent_id || ':' || e.ent_id from ents_l e)"""

ORACLE["prompts"] = f"""
with recursive {SEGMENTS}, {ENTITIES}, {PROMPT_CANDS}
select doc_id, cand_id, style, answer, md5('<answer> ' || answer || ' <context> ' || context) as prompt_md5
from cands"""

ORACLE["token_columns"] = """
with t as (
  select 'q' || item_id as query_id,
         list_transform(list_filter(string_split(lower(text), ' '), lambda x: x <> ''),
                        lambda x: ((('0x' || substr(md5(x), 1, 8))::BIGINT % 30000) + 1)::INTEGER) as ids
  from benchmark),
w as (select query_id, ids, unnest(range(greatest(1, (len(ids) + 19) // 20)))::INTEGER as win from t),
cut as (select query_id, win, ids[win * 20 + 1:win * 20 + 20] as own from w)
select query_id, win as "window", array_to_string(list_resize(own, 20, 0), ',') as ids,
       array_to_string(list_resize(list_transform(own, lambda x: 1), 20, 0), ',') as mask
from cut"""

ORACLE["passage_template"] = f"""
with c as ({_corpus_sql(3, 0.02)})
select stage, corpus_ids, concat_ws(' [SEP] ', coalesce(title, ''), coalesce(text, ''), coalesce(questions, ''))
       as passage from c"""


# ------------------------------------------------------------------ models and augmentation
def _words(x: str) -> str:
    return f"list_filter(string_split(lower({x}), ' '), lambda w: w <> '')"


def _bucket(t: str, dim: int = 64) -> str:
    return f"((('0x' || substr(md5({t}), 1, 8))::BIGINT % {dim}))::INTEGER"


HASH_ENCODE = f"""
with {PASSAGES},
toks as (select corpus_id, unnest({_words('text')}) as t from passages),
tf as (select corpus_id, {_bucket('t')} as bucket, count(*)::DOUBLE as tf from toks group by all)
select corpus_id, bucket, round(tf / sqrt(sum(tf * tf) over (partition by corpus_id)), 6) as weight from tf"""

ORACLE["hash_encode"] = HASH_ENCODE
ORACLE["encode_arrow"] = ORACLE["encode_budgeted"] = HASH_ENCODE


def scored_sql(src: str) -> str:
    """CTEs segments .. scored over a source ``src(doc_id, text)``."""
    return f"""{SEGMENTS_T.replace('{src}', src)}, {entities_sql(src)}, {PROMPT_CANDS},
qs as (
  select *, case when style = 'multiple_choice' then replace(context, answer, '____') || '?'
                 when longest = '' then answer || '?'
                 else replace(answer, longest, '____') || '?' end as question
  from (select *, list_reduce(list_prepend('', string_split(answer, ' ')),
                              lambda acc, w: case when length(w) > length(acc) then w else acc end) as longest
        from cands)),
scored as (
  select *, case when len(list_distinct(list_concat({_words('question')}, {_words('answer')}))) = 0 then 0.0
                 else len(list_intersect({_words('question')}, {_words('answer')}))::DOUBLE
                      / len(list_distinct(list_concat({_words('question')}, {_words('answer')}))) end as score
  from qs),
ranked_c as (
  select *, row_number() over (partition by doc_id order by score desc, kind, part, item) as rank from scored)"""


def augment_sql(src: str, n: int) -> str:
    return f"""{scored_sql(src)},
aug as (
  select s.doc_id, coalesce(a.questions, '') as questions, coalesce(a.n_questions, 0)::INTEGER as n_questions
  from (select distinct doc_id from {src}) s left join (
    select doc_id, string_agg(split_part(question, '?', 1) || ' [SEP] ', '' order by rank) as questions,
           count(*) as n_questions
    from ranked_c where rank <= {n} group by doc_id) a on a.doc_id = s.doc_id)"""


DOCS_SRC = "src_docs as (select doc_id, text from documents)"

ORACLE["score_pairs"] = f"""
with recursive {DOCS_SRC}, {scored_sql('src_docs')}
select doc_id, cand_id, question, round(score, 6) as score from scored"""

ORACLE["rank_candidates"] = f"""
with recursive {DOCS_SRC}, {scored_sql('src_docs')}
select doc_id, rank::INTEGER as rank, cand_id, round(score, 6) as score from ranked_c where rank <= 10"""

ORACLE["augment"] = f"""
with recursive {DOCS_SRC}, {augment_sql('src_docs', 25)}
select doc_id, questions, n_questions from aug"""

UPDATED = f"""
corpus3 as ({_corpus_sql(3, 0.02)}),
todo as (select distinct doc_id as d, title, text from corpus3 where stage = 1),
src_docs as (select md5(concat_ws(chr(31), d, title, text)) as doc_id, text from todo),
{augment_sql('src_docs', 25)},
updated as (
  select c.stage, c.query_id, c.doc_id, c.title, c.text, c.corpus_ids,
         case when u.d is not null then u.questions else c.questions end as questions
  from corpus3 c left join (
    select t.d, t.title, t.text, a.questions from todo t
    join aug a on a.doc_id = md5(concat_ws(chr(31), t.d, t.title, t.text))) u
  on u.d = c.doc_id and u.title = c.title and u.text = c.text)"""

ORACLE["update_questions"] = f"""
with recursive {UPDATED.lstrip()}
select stage, query_id, corpus_ids, questions from updated"""

ORACLE["queue_pending"] = f"""
with q as (select * from ({_corpus_sql(2, 0.0143)}) where query_id is null),
d as (select * from q where {U('corpus_ids')} < 0.5)
select doc_id, corpus_ids from q
where not exists (select 1 from d where d.doc_id = q.doc_id and d.text = q.text)"""

ORACLE["append_noise"] = f"""
with recursive {UPDATED.lstrip()},
rows as (
  select 'qg' as index_name, 'gold' as origin, stage, query_id, corpus_ids,
         concat_ws(' [SEP] ', coalesce(title, ''), coalesce(text, ''), coalesce(questions, '')) as passage
  from updated where stage < 3
  union all
  select 'no_qg', 'gold', stage, query_id, corpus_ids, concat_ws(' [SEP] ', coalesce(title, ''), coalesce(text, ''))
  from updated where stage < 3
  union all
  select i, 'noise', stage, query_id, corpus_ids, concat_ws(' [SEP] ', coalesce(title, ''), coalesce(text, ''))
  from updated, (select unnest(['qg', 'no_qg']) as i) where stage = 3),
ntok as (select index_name, origin, query_id, corpus_ids, unnest({_words('passage')}) as t from rows),
ntf as (select index_name, origin, query_id, corpus_ids, {_bucket('t')} as b, count(*)::DOUBLE as tf
        from ntok group by all),
nw as (select index_name, origin, (b + 1) * tf / sqrt(sum(tf * tf) over (
         partition by index_name, origin, query_id, corpus_ids)) as w from ntf),
sums as (select index_name, origin, sum(w) as s from nw group by all),
sizes as (select index_name, origin, count(*) as n from rows group by all),
one as (
  select z.index_name, z.origin, z.n, s.s, case when z.origin = 'gold' then z.n - 1
         else sum(z.n) over (partition by z.index_name) - 1 end as last_id
  from sizes z join sums s on s.index_name = z.index_name and s.origin = z.origin)
select index_name, origin, n, round(s, 2) as vector_sum, last_id::BIGINT as last_id from one
union all
select index_name, '__all__', sum(n)::BIGINT, round(sum(s), 2), max(last_id)::BIGINT from one group by index_name"""

TEXT_RANKED = f"""
ptok as (select src, num, unnest({_words('text')}) as t from passages),
ptf as (select src, num, {_bucket('t')} as b, count(*)::DOUBLE as tf from ptok group by all),
pw as (select src, num, b, tf / sqrt(sum(tf * tf) over (partition by src, num)) as w from ptf),
pdense as (
  select p.src, p.num, list(coalesce(w.w, 0.0) order by g.b) as e
  from passages p cross join (select unnest(range(64)) as b) g
  left join pw w on w.src = p.src and w.num = p.num and w.b = g.b group by p.src, p.num),
qtok as (select item_id, unnest({_words('text')}) as t from benchmark),
qtf as (select item_id, {_bucket('t')} as b, count(*)::DOUBLE as tf from qtok group by all),
qw as (select item_id, b, tf / sqrt(sum(tf * tf) over (partition by item_id)) as w from qtf),
qdense as (
  select q.item_id, list(coalesce(w.w, 0.0) order by g.b) as e
  from benchmark q cross join (select unnest(range(64)) as b) g
  left join qw w on w.item_id = q.item_id and w.b = g.b group by q.item_id),
pairs as (
  select q.item_id, p.src, p.num,
         list_sum(list_transform(range(1, 65), lambda i: (q.e[i] - p.e[i]) * (q.e[i] - p.e[i]))) as d2
  from qdense q cross join pdense p),
ranked as (
  select item_id, src, num, row_number() over (partition by item_id order by d2, src, num) as rank from pairs)"""

ORACLE["text_hits"] = f"""
with {PASSAGES}, {TEXT_RANKED}
select item_id as query_id, rank::INTEGER as rank, 'doc' || src || '_' || num as corpus_id from ranked where rank <= 20"""

ORACLE["text_retrieval"] = f"""
with {PASSAGES}, {ANSWERS}, {TEXT_RANKED},
best as (
  select q.item_id, (select min(r.rank) from ranked r join answers g on g.item_id = r.item_id and g.src = r.src
                     where r.item_id = q.item_id and r.rank <= 100) as best
  from (select distinct item_id from answers) q)
select k, round(sum(case when best <= k then 1 else 0 end)::DOUBLE * 100.0 / count(*), 6) as accuracy,
       count(*) as n
from best, {KS} group by k"""

ORACLE["index_roundtrip"] = """
with ids as (
  select vec_id as key, 'label' || label as doc_id, embedding as e,
         row_number() over (order by vec_id % 2, vec_id) - 1 as vec_id from embeddings),
pairs as (
  select q.key as query_id, x.vec_id, x.doc_id,
         list_sum(list_transform(range(1, len(q.e) + 1),
                  lambda i: (q.e[i]::double - x.e[i]::double) * (q.e[i]::double - x.e[i]::double))) as d2
  from ids q join ids x on q.key % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by d2, vec_id) as rank from pairs)
select query_id, rank::INTEGER as rank, vec_id, doc_id from ranked where rank <= 5"""

ORACLE["corpus_table_build"] = f"""
select stage, query_id, title, corpus_ids from ({_corpus_sql(2, 0.0143)})"""

ORACLE["passage_queries"] = f"""
with c as ({_corpus_sql(2, 0.0143)})
select distinct b.text as query_text, c.doc_id, c.title, c.text,
       list_sum(list_transform(string_split(c.corpus_ids, ','), lambda x: string_split(x, '_')[2]::INTEGER))::INTEGER
         as num_sum
from c left join benchmark b on 'q' || b.item_id = c.query_id"""

ORACLE["stream_augment"] = f"""
with recursive {PASSAGES}, src_docs as (select corpus_id as doc_id, text from passages),
{augment_sql('src_docs', 25)}
select doc_id as corpus_id, questions, n_questions from aug"""


# ------------------------------------------------------------------ retrieval grid
def _dense(src: str, key: str, text: str, name: str) -> str:
    return f"""
{name}_tok as (select {key} as k, unnest({_words(text)}) as t from {src}),
{name}_tf as (select k, {_bucket('t')} as b, count(*)::DOUBLE as tf from {name}_tok group by all),
{name}_w as (select k, b, tf / sqrt(sum(tf * tf) over (partition by k)) as w from {name}_tf),
{name}_dense as (
  select s.k, list(coalesce(w.w, 0.0) order by g.b) as e
  from (select distinct {key} as k from {src}) s cross join (select unnest(range(64)) as b) g
  left join {name}_w w on w.k = s.k and w.b = g.b group by s.k)"""


def _grid_sql() -> str:
    levels = ((1, 0.0075), (2, 0.0143), (3, 0.02))
    corpus_all = " union all ".join(f"select {lv} as level, * from ({_corpus_sql(lv, r)})" for lv, r in levels)
    variants, golds = [], []
    for corpus_name, max_stage in (("gold", 2), ("wiki", 3)):
        for qg in (False, True):
            for title in (True, False):
                parts = (["coalesce(title, '')"] if title else []) + ["coalesce(text, '')"] + \
                    (["coalesce(questions, '')"] if qg else [])
                suffix = ("qg" if qg else "no_qg") + ("" if title else "_no_title")
                cfg = f"'{corpus_name}_' || level || '_{suffix}'"
                variants.append(f"select {cfg} as config, doc_id, corpus_ids, query_id, "
                                f"concat_ws(' [SEP] ', {', '.join(parts)}) as passage "
                                f"from updated where stage <= {max_stage}")
                golds.append(f"select {cfg} as config, substr(query_id, 2)::BIGINT as query_id, doc_id "
                             f"from gold_l")
    return f"""
with recursive
corpus_all as ({corpus_all}),
todo as (select distinct level, doc_id as d, title, text from corpus_all where stage = 1),
src_docs as (select md5(concat_ws(chr(31), level, d, title, text)) as doc_id, text from todo),
{augment_sql('src_docs', 25)},
updated as (
  select c.level, c.stage, c.query_id, c.doc_id, c.title, c.text, c.corpus_ids,
         case when u.d is not null then u.questions else c.questions end as questions
  from corpus_all c left join (
    select t.level, t.d, t.title, t.text, a.questions from todo t
    join aug a on a.doc_id = md5(concat_ws(chr(31), t.level, t.d, t.title, t.text))) u
  on u.level = c.level and u.d = c.doc_id and u.title = c.title and u.text = c.text),
variants as ({' union all '.join(variants)}),
vsrc as (select *, row_number() over (order by config, corpus_ids, query_id nulls first) as vec_id from variants),
{_dense('vsrc', 'vec_id', 'passage', 'p')},
{_dense('benchmark', 'item_id', 'text', 'q')},
gold_l as (select distinct level, query_id, doc_id from updated where stage = 1),
gold_cfg as ({' union all '.join(golds)}),
pairs as (
  select g.config, g.query_id, v.vec_id, v.doc_id,
         list_sum(list_transform(range(1, 65), lambda i: (qd.e[i] - pd.e[i]) * (qd.e[i] - pd.e[i]))) as d2
  from (select distinct config, query_id from gold_cfg) g join q_dense qd on qd.k = g.query_id
  join vsrc v on v.config = g.config join p_dense pd on pd.k = v.vec_id),
ranked as (select *, row_number() over (partition by config, query_id order by d2, vec_id) as rank from pairs),
best as (
  select g.config, g.query_id, min(r.rank) as best from gold_cfg g
  left join ranked r on r.config = g.config and r.query_id = g.query_id and r.rank <= 100 and r.doc_id = g.doc_id
  group by g.config, g.query_id)
select config, k, round(sum(case when best <= k then 1 else 0 end)::DOUBLE * 100.0 / count(*), 6) as accuracy,
       count(*) as n
from best, {KS} group by config, k"""


ORACLE["retrieval_grid"] = _grid_sql()

ORACLE["ingest_corpus"] = """
select doc_id, lang, len(string_split(text, chr(10)))::INTEGER as n_passages from documents"""

def _easy_noise(n: int) -> str:
    return f"""
with {CORPORA}
select distinct doc_id, title, doc_text as text from ({_collapse('wiki', 3)})
order by doc_id, title, text limit {n}"""


ORACLE["easy_noise"] = _easy_noise(250000)
ORACLE["easy_noise_500"] = _easy_noise(500)

ORACLE["plugged_augment"] = ORACLE["augment"].replace("rank <= 25", "rank <= 10")
ORACLE["plugged_entities"] = ORACLE["entities"]

ORACLE["process_batches"] = f"""
with recursive {PASSAGES},
s as (select corpus_id, text, {U('corpus_id')} as u from passages
      where {U('corpus_id')} < (50 * 20)::DOUBLE / (select count(*) from passages)),
b as (select corpus_id, text, (ntile(20) over (order by u, corpus_id))::INTEGER as batch_id from s),
src_docs as (select corpus_id as doc_id, text from b),
{augment_sql('src_docs', 25)}
select b.corpus_id, b.batch_id, a.questions from b join aug a on a.doc_id = b.corpus_id"""

ORACLE["update_labels"] = """
select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on l.doc_id = d.doc_id"""

ORACLE["qa_pair_scores"] = f"""
with qa as (
  select u.conv_id, u.turn, u.text as question, a.text as answer
  from conversations u join conversations a
    on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  where u.role = 'user')
select conv_id, turn,
       round(case when len(list_distinct(list_concat({_words('question')}, {_words('answer')}))) = 0 then 0.0
                  else len(list_intersect({_words('question')}, {_words('answer')}))::DOUBLE
                       / len(list_distinct(list_concat({_words('question')}, {_words('answer')}))) end, 6) as score
from qa"""


# ------------------------------------------------------------------ stored state
ORACLE["stored_changes"] = """
select doc_id, case when quality is null then source else 'quality ' || quality end as source, lang, n_chars
from documents left join labels using (doc_id) where coalesce(toxic, 0) <> 1"""

ORACLE["claimed_segments"] = ORACLE["pack_segments"]

ORACLE["title_dictionary"] = """
with t as (select string_split(text, chr(10))[1] as title, bool_or(lang = 'en') as early from documents group by 1)
select title, row_number() over (order by not early, title) as title_id, case when early then 1 else 2 end as load from t"""

ORACLE["keyword_table"] = """
with words as (select unnest(string_split(text, ' ')) as word from benchmark),
k as (select word as keyword from words union select word[1:2] from words union select '' union select null),
t as (select distinct string_split(text, chr(10))[1] as title from documents)
select keyword, count(*) as n_titles, min(title) as first_title from k join t on contains(title, keyword) group by keyword"""

ORACLE["ingest_rejects"] = """
with x as (select doc_id, lang, source, n_chars, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source
                  || '","n_chars":' || n_chars || '}' as line from documents)
select case when doc_id % 7 <> 0 then doc_id end as doc_id, case when doc_id % 7 <> 0 then lang end as lang,
       case when doc_id % 7 <> 0 then source end as source, case when doc_id % 7 <> 0 then n_chars end as n_chars,
       case when doc_id % 7 = 0 then line[1:length(line) - 2] end as record from x"""
