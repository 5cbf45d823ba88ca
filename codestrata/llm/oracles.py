"""DuckDB counterparts of the numbered operators that SQL can express."""

from __future__ import annotations

from codestrata.llm.mixing import EXPONENT_DECIMALS, ROUNDS, SECTIONS, WEIGHT_DECIMALS


def mixing_sql(entropy: float, blocks: int = 64, seed: int = 17) -> str:
    """Temperature mixing of ``documents`` to a share of the largest entropy."""
    rounds = []
    for k in range(ROUNDS):
        # the exponents of a round whose weights reach the goal are its first ones
        rounds.append(f"""
r{k + 1} as (
  select low + good * step as low, low + (good + 1) * step as high from (
    select any_value(low) as low, any_value(step) as step, count(*) filter (h >= (select goal from target)) as good from (
      select a, any_value(low) as low, any_value(step) as step,
             ln(sum(pow(p, a))) - a * sum(pow(p, a) * ln(p)) / sum(pow(p, a)) as h
      from (select low, (high - low) / {SECTIONS} as step, low + (high - low) / {SECTIONS} * k as a
            from r{k}, range(1, {SECTIONS}) t(k)), shares
      group by a)))""")
    return rf"""
with counted as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents),
sources as (select source, sum(n_tokens)::bigint as tokens from counted group by source having sum(n_tokens) > 0),
shares as (select source, tokens, tokens / (select sum(tokens) from sources)::double as p from sources),
target as (select {entropy} * ln(count(*)) as goal from sources),
r0 as (select 0.0::double as low, 1.0::double as high),{','.join(rounds)},
chosen as (
  select case when (select count(*) from sources) < 2 or (select -sum(p * ln(p)) from shares) >= (select goal from target) then 1.0
              else round(low, {EXPONENT_DECIMALS}) end as a from r{ROUNDS}),
weighted as (
  select source, tokens, round(pow(p, a) / (select sum(pow(p, a)) from shares, chosen), {WEIGHT_DECIMALS}) as weight from shares, chosen),
plan as (
  select source, tokens, ceil(weight * (select max(tokens / weight) from weighted) - 1e-3)::bigint as budget from weighted),
copies as (
  select c.doc_id, c.source, c.n_tokens, plan.budget, e::int as epoch,
         md5('{seed}/' || e || '/' || coalesce(c.doc_id::varchar, '')) as key
  from counted c left join plan on c.source is not distinct from plan.source,
       range(0, coalesce(greatest(ceil(plan.budget / plan.tokens)::bigint, 1), 1)) t(e)),
placed as (
  select *, coalesce(sum(n_tokens) over (partition by source order by epoch, key, doc_id
                                         rows between unbounded preceding and 1 preceding), 0)::bigint as before from copies)
select doc_id, source, n_tokens, epoch, before as start,
       least(floor(before * {blocks}::double / greatest(coalesce(budget, 1), 1)), {blocks - 1})::int as block,
       md5('{seed}/block/' || epoch || '/' || coalesce(doc_id::varchar, '')) as place
from placed where case when n_tokens = 0 then epoch = 0 else before < coalesce(budget, 1) end
"""


def host_rules_sql(limit: float = 0.5, sureness: float = 2.0, strength: float = 2.0) -> str:
    """Host rules over ``documents``, in their own words."""
    words = r"[^\x20\x09-\x0D]+"
    rules = {
        "few": "n_words < 20", "again": "100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > n_words",
        "lines": "100 * n_dup_lines > 30 * n_lines", "length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    }
    following = " || ' ' || ".join(f"lead(word, {k}) over (partition by row order by i)" for k in range(8))
    sums = ", ".join(f"count(*) filter ({cond}) as {r}" for r, cond in rules.items())
    fits = " union all ".join(f"""
  select '{r}' as rule, count(*) as k, sum(n) as total, sum(n * n) as n2, sum({r}) / sum(n)::double as mean,
         sum({r} * {r} / n::double) as s from hosts where source is not null""" for r in rules)
    verdicts = " union all ".join(f"""
  select source, n, (mean * size + {r}) / (size + n) as rate, size from hosts, priors where rule = '{r}' and source is not null""" for r in rules)
    return rf"""
with base as (
  select row_number() over () as row, doc_id, source, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{words}') as w from documents),
places as (select row, unnest(w) as word, unnest(range(len(w))) as i from base),
windows as (
  select row, i, {following} as win from places qualify lead(i, 7) over (partition by row order by i) is not null),
often as (select row, win from windows group by row, win having count(*) > 1),
covered as (
  select row, count(distinct i + o) as n from windows join often using (row, win), range(0, 8) t(o) group by row),
facts as (
  select doc_id, source, len(w)::bigint as n_words, len(list_aggregate(w, 'string_agg', ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{words}')) as lines, coalesce(n, 0)::bigint as n_repeat_words
  from base left join covered using (row)),
judged as (
  select doc_id, source, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words from facts),
hosts as (select source, count(*) as n, {sums} from judged group by source),
fits as ({fits}),
spread as (
  select rule, k, mean, mean * (1 - mean) as chance, s / total - mean * mean - mean * (1 - mean) * (k - 1) / total as seen,
         case when k > 1 then 1 - n2 / (total * total)::double - (k - 1) / total::double else 0 end as room from fits),
priors as (
  select rule, mean, case when chance > 0 and room > 0 then 1 / least(greatest(seen / (chance * room), 1e-6), 0.999) - 1
                          else {strength} end as size from spread),
bad as (
  select distinct source from ({verdicts})
  where rate - {sureness} * sqrt(rate * (1 - rate) / (size + n + 1)) > {limit})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {rules['few']} or {rules['again']} as base_failed,
       not ({rules['few']} or {rules['again']}) and not coalesce(source in (select source from bad), false) as kept,
       coalesce(source in (select source from bad), false) as host_failed
from judged
"""


def ball_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codes of ``embeddings`` with every part compared with every entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} as (
  select id, part, any_value(v) as v, arg_min(entry, (d, entry)) as entry, min(d) as d from (
    select c.id, c.part, c.v, b.entry,
           list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from cut c join b{k} b on c.part = b.part) group by id, part)""")
        if k < rounds:
            steps.append(f"""
s{k} as (
  select part, entry, pos, sum(x)::bigint as s, count(*)::bigint as n from (
    select part, entry, unnest(v) as x, unnest(range(1, len(v) + 1)) as pos from a{k}) group by part, entry, pos),
m{k} as (
  select part, entry, list((s - ((s % n) + n) % n) // n order by pos) as v from s{k} group by part, entry),
b{k + 1} as (select b.part, b.entry, coalesce(m.v, b.v) as v from b{k} b left join m{k} m on b.part = m.part and b.entry = m.entry)""")
    return f"""
with good as (
  select row_number() over (order by vec_id nulls last, embedding) as id, vec_id, label,
         list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as materialized (
  select id, part, list_slice(v, (len(v) // {parts}) * part + 1, (len(v) // {parts}) * (part + 1)) as v
  from good, range(0, {parts}) t(part)),
b0 as (select part, id - 1 as entry, v from cut where id <= {entries}),{','.join(steps).replace(' as (', ' as materialized (')},
coded as (
  select vec_id, label, code, error from good join (
    select id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' order by part) as code, sum(d)::bigint as error
    from a{rounds} group by id) using (id)),
books as (
  select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, books
"""


def audit_sql(least: int = 3, top: int = 200) -> str:
    """Divergence of sources over every kept term of ``documents``, counted document by document."""
    return rf"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (
  select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
per_doc as (select row, lang, source, term, count(*) as c from words group by all),
vocabulary as (select lang, term, sum(c)::bigint as total from per_doc group by lang, term having count(*) >= {least}),
counted as (select lang, source, term, sum(c)::bigint as c from per_doc semi join vocabulary using (lang, term) group by lang, source, term),
members as (select distinct lang, source from docs),
sizes as (select lang, count(*) as v, sum(total) as n_lang from vocabulary group by lang),
totals as (
  select m.lang, m.source, coalesce(n, 0) as n from members m
  left join (select lang, source, sum(c) as n from counted group by lang, source) s on m.lang = s.lang and m.source = s.source),
dense as materialized (
  select t.lang, t.source, w.term, coalesce(c.c, 0) as c,
         1 + 1000000000::hugeint * (coalesce(c.c, 0) + 1) // (t.n + s.v) as p,
         1 + 1000000000::hugeint * (w.total + 1) // (s.n_lang + s.v) as q
  from totals t join sizes s using (lang) join vocabulary w using (lang)
  left join counted c on c.lang = t.lang and c.source = t.source and c.term = w.term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
terms as (
  select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from dense where c > 0 and p > q),
listed as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value
  from members a join members b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all select lang, source, 'term', item, value from terms),
ranked as (
  select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from listed)
select * from ranked where part = 'pair' or rank <= {top}
"""
