"""DuckDB SQL of the queries that SQL can state, from the definitions."""

from __future__ import annotations

from lotwise.llm import secret_scan as S

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _places(kind: str, pattern: str, source: str = "docs") -> str:
    """Matches with their places: what lies between them, and themselves, add up."""
    p = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' kind, hit, (upto - length(hit))::bigint start, upto::bigint stop from (
      select doc_id, hit, sum(length(gap) + length(hit)) over (partition by doc_id order by i) upto from (
        select doc_id, unnest(range(1, len(hits) + 1)) i, hits[i] hit, gaps[i] gap from (
          select doc_id, regexp_extract_all(t, '{p}') hits, string_split_regex(t, '{p}') gaps from {source})))"""


def _dense(kind: str, characters: str, window: int, bits: float) -> str:
    weights = "[" + ", ".join(str(S.weight(c)) for c in range(1, window + 1)) + "]"
    allow = " or ".join([*(f"regexp_matches(hit, '{p}')" for p in S.ALLOW_PATTERNS), *(f"contains(hit, '{v}')" for v in S.ALLOW_VALUES)])
    return f"""select doc_id, '{kind}' kind, start + min(lo) as start, start + max(lo) + {window} as stop from (
      select *, sum(new) over (partition by doc_id, start order by lo) run from (
        select *, case when lo <= lag(lo) over (partition by doc_id, start order by lo) + {window} then 0 else 1 end new from (
          select doc_id, start, lo, string_split(substr(hit, lo::int + 1, {window}), '') c from (
            select doc_id, start, hit, unnest(range(0, length(hit) - {window - 1})) lo from ({_places(kind, S.run_of(characters, window))}) where not ({allow})))
        where list_sum(list_transform(list_distinct(c), lambda x: ({weights})[len(list_filter(c, lambda y: y = x))])) <= {S.most(window, bits)}))
      group by doc_id, start, run"""


def secret_scan() -> str:
    base = f"""select doc_id, kind, start, stop from ({_places('assign', S.ASSIGN)}) where length(regexp_extract(hit, '{S.ASSIGN.replace("'", "''")}', 2)) >= {S.LEAST_VALUE}
      union all select doc_id, kind, start, stop from ({_places('access', S.ACCESS)}) union all select doc_id, kind, start, stop from ({_places('hex', S.HEX)})"""
    added = " union all ".join(f"({_dense(*c)})" for c in S.CLASSES)
    rank = "list_position([" + ", ".join(f"'{k}'" for k in S.kinds()) + "], kind)"
    text = f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, {rank}, stop) {{}}, '')"
    count = lambda k: f"count(*) filter (kind = '{k}') n_{k}"
    return f"""with docs as (select doc_id, coalesce(text, '') t from documents), spans as ({base} union all {added})
      select d.doc_id, {count('assign')}, {count('access')}, {count('hex')}, sha256({text.format("filter (kind in ('assign', 'access', 'hex'))")}) base_sha256,
        {text.format("filter (kind is not null)")} spans from docs d left join spans s on s.doc_id = d.doc_id group by d.doc_id"""


def near_duplicates(percent: int = 80) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with recursive words as (select doc_id, {_WORDS.format(lower)} w from documents),
      sets as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) when len(w) = 1 then w else [] end s from words),
      each as (select doc_id, unnest(s) g from sets),
      common as (select a.doc_id a, b.doc_id b, count(*) n from each a join each b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
      links as (select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= {percent} * (len(x.s) + len(y.s) - n)),
      reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
      select s.doc_id, len(s.s)::bigint n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) component_id, s.doc_id <= coalesce(m, s.doc_id) kept
      from sets s left join (select a, min(b) m from reach group by a) r on r.a = s.doc_id"""


def without_repeats(k: int = 20) -> str:
    return f"""with docs as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
      windows as (select doc_id, p, array_to_string(list_slice(w, p, p + {k - 1}), ' ') g from (select doc_id, w, unnest(range(1, len(w) - {k - 2})) p from docs)),
      later as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) rn from windows) where rn > 1),
      gone as (select distinct doc_id, p + i p from later, (select unnest(range(0, {k})) i)),
      words as (select doc_id, p, w[p] word from (select doc_id, w, unnest(range(1, len(w) + 1)) p from docs)),
      kept as (select x.doc_id, string_agg(word, ' ' order by x.p) t, count(*) n from words x anti join gone g on g.doc_id = x.doc_id and g.p = x.p group by x.doc_id)
      select d.doc_id, len(w)::bigint n_words, len(w)::bigint - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from docs d left join kept k on k.doc_id = d.doc_id"""


def fill_middle() -> str:
    draw = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::bigint"
    part = lambda lo, hi: f"array_to_string(list_slice(u, {lo}, {hi}), '')"
    return f"""with units as (select doc_id, coalesce(text, '') t, sha256('7:' || doc_id) h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') u from documents),
      drawn as (select *, len(u)::bigint n, {draw(0)} % (len(u) + 1) x, {draw(1)} % (len(u) + 1) y from units),
      parts as (select *, {part('1', 'least(x, y)')} p, {part('least(x, y) + 1', 'greatest(x, y)')} m, {part('greatest(x, y) + 1', 'n')} s,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when {draw(3)} % 100 < 50 then 'spm' else 'psm' end form from drawn)
      select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
        sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) output_sha256,
        sha256(t) restored_sha256 from parts"""


def without_repeated_lines(least: int = 40, docs: int = 5) -> str:
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) x from documents),
      lines as (select doc_id, unnest(x) line, unnest(range(1, len(x) + 1)) i from split),
      keyed as (select *, translate(trim(line, {white}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
      often as (select k, max(doc_id) keeper from keyed where length(k) >= {least} group by k having count(distinct doc_id) >= {docs}),
      marked as (select y.doc_id, line, i, o.k is not null and y.doc_id <> keeper gone from keyed y left join often o on o.k = y.k)
      select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
      from marked group by doc_id"""
