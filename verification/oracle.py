"""DuckDB SQL for the registered queries, written apart from the Spark code.

Statements share the CTEs below; a statement names the last ones it needs and
gets those they build on. Text and link rules are stated another way than in
Spark (segment by segment, string folds), so that agreement means something.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from midyear import constants as K


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chars(text: str) -> str:
    """A string of awkward characters as an expression."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in text) + ")"


# --- scalar rules ----------------------------------------------------------

NAMES = {"apos": 39, **name2codepoint}
NAME_MAP = (
    "map([" + ", ".join(quoted(n) for n in NAMES) + "], [" + ", ".join(f"chr({c})" for c in NAMES.values()) + "])"
)


def char_of(code: str) -> str:
    return f"case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr({code}::int) end"


def decoded(text: str) -> str:
    """Character references replaced, one ``&`` segment after the other."""
    hexa = "regexp_extract(s, '^#[xX]([0-9a-fA-F]{1,6});?', 1)"
    number = "regexp_extract(s, '^#([0-9]{1,7});?', 1)"
    name = "regexp_extract(s, '^([A-Za-z][A-Za-z0-9]*);', 1)"
    segment = (
        f"case when i = 1 then s"
        f" when {hexa} <> '' then coalesce({char_of(f'try_cast(concat(chr(48), chr(120), {hexa}) as bigint)')}"
        f" || regexp_replace(s, '^#[xX][0-9a-fA-F]{{1,6}};?', ''), '&' || s)"
        f" when {number} <> '' then coalesce({char_of(f'try_cast({number} as bigint)')}"
        f" || regexp_replace(s, '^#[0-9]{{1,7}};?', ''), '&' || s)"
        f" when {name} <> '' then coalesce((select c from names where n = {name})"
        f" || regexp_replace(s, '^[A-Za-z][A-Za-z0-9]*;', ''), '&' || s)"
        f" else '&' || s end"
    )
    segment = segment.replace(f"(select c from names where n = {name})", f"{NAME_MAP}[{name}]")
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda s, i: {segment}), '')"


HIDDEN = (
    "<!--.*?(-->|\\z)|<script(\\s[^>]*)?>.*?(</script[^>]*>|\\z)|<style(\\s[^>]*)?>.*?(</style[^>]*>|\\z)"
)
TAG = "<[A-Za-z/!?][^>]*(>|\\z)"


def shown(html: str) -> str:
    return f"regexp_replace({html}, '{HIDDEN}', '', 'gis')"


def untagged(html: str) -> str:
    return f"regexp_replace({html}, '{TAG}', '', 'g')"


def title(html: str) -> str:
    return decoded(untagged(f"regexp_extract({shown(html)}, '<title(?:\\s[^>]*)?>(.*?)(?:</title|\\z)', 1, 'is')"))


def blocks(html: str) -> str:
    """List of block texts: split where blocks start, then cut each segment."""
    marked = (
        f"regexp_replace({shown(html)},"
        " '<(h)[0-9]{1,2}([\\s/][^>]*)?>|<(p)([\\s/][^>]*)?>', chr(1) || '\\1\\3', 'gi')"
    )
    end = "</(h[0-9]{1,2}|p)\\s*>"
    opener = "<(" + "|".join(K.PARAGRAPH_CLOSERS) + ")([\\s/][^>]*)?>"
    closer = "</(" + "|".join(K.CONTAINERS) + ")\\s*>"
    body = "substr(s, 2)"
    cut = (
        f"case when lower(s[1]) = 'p' then regexp_replace({body}, '({end}|{opener}|{closer}).*$', '', 'is')"
        f" when regexp_matches({body}, '{end}', 'i') then regexp_replace({body}, '{end}.*$', '', 'is')"
        f" else regexp_replace({body}, '{closer}.*$', '', 'is') end"
    )
    segments = f"(string_split({marked}, chr(1)))[2:]"
    texts = f"list_transform({segments}, lambda s: {untagged(cut)})"
    return f"list_transform({texts}, lambda t: {decoded('t')})"


def page_text(block_list: str) -> str:
    line = f"trim(x, {chars(K.BLANKS)})"
    ends = chars("[" + K.LINE_ENDS + "]")
    lines = f"list_filter(list_transform(regexp_split_to_array(b, {ends}), lambda x: {line}), lambda y: y <> '')"
    block = f"array_to_string(list_transform({lines}, lambda z: ' ' || z), '')"
    filled = f"list_filter(list_transform({block_list}, lambda b: {block}), lambda v: v <> '')"
    return f"array_to_string(list_transform({filled}, lambda w: chr(10) || chr(10) || chr(10) || w), '')"


def hrefs(html: str) -> str:
    raw = (
        f"regexp_extract_all({shown(html)},"
        " '<a\\s(?:[^>]*?\\s)?href\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>\"'']+)', 1, 'i')"
    )
    bare = "case when v[1] in ('\"', '''') then substr(v, 2, length(v) - 2) else v end"
    return f"list_sort(list_distinct(list_transform(list_transform({raw}, lambda v: {bare}), lambda t: {decoded('t')})))"


def resolved(href: str, site: str) -> str:
    """Absolute URL; the path is folded segment by segment into a string."""
    x = (
        f"case when contains({href}, 'http') then"
        f" case when {href}[1] in ('?', '#') then {site} || {href} else {href} end"
        f" when contains({href}, {site}) then {href} else {site} || '/' || {href} end"
    )
    path = "regexp_extract(u, '^[^?#]*')"
    rest = f"substr(u, length({path}) + 1)"
    rest = f"regexp_replace(regexp_replace({rest}, '^([^#]*)#$', '\\1'), '^\\?(#.*)?$', '\\1')"
    segments = f"string_split(regexp_replace({path}, '^/', ''), '/')"
    kept = (
        f"case when {path}[1] = '/' then {segments}"
        f" else list_filter({segments}, lambda g, i: g <> '' or i = length({segments})) end"
    )
    folded = (
        f"list_reduce({kept}, lambda acc, g: case when g = '..' then regexp_replace(acc, '/[^/]*$', '')"
        f" when g = '.' then acc else acc || '/' || g end, '')"
    )
    slash = f"case when {segments}[-1] in ('.', '..') then '/' else '' end"
    joined = (
        f"case when starts_with({path}, '//') then 'http:' || {path}"
        f" when {folded} || {slash} = '' then '{K.ARCHIVE_ROOT}/'"
        f" else '{K.ARCHIVE_ROOT}' || {folded} || {slash} end || {rest}"
    )
    joined = f"list_transform([translate(regexp_replace(x, '^http:', '', 'i'), chr(9) || chr(10) || chr(13), '')], lambda u: {joined})[1]"
    whole = (
        "case when regexp_matches(x, 'http://web.archive.org/') then x"
        " when regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') and not regexp_matches(x, '^http:', 'i') then x"
        f" else {joined} end"
    )
    return f"list_transform([{x}], lambda x: {whole})[1]"


def url_key(url: str, site: str) -> str:
    tail = f"rtrim(substr({url}, strpos({url}, {site})), '/$')"
    return (
        f"case when strpos({url}, {site}) > 0 and length({tail}) > length({site}) then {tail} else {url} end"
    )


def when(digits: str) -> str:
    return f"try_strptime({digits}, '%Y%m%d%H%M%S')"


def time_text(url: str) -> str:
    digits = f"regexp_extract({url}, '[0-9]{{14}}')"
    return f"case when {when(digits)} is not null then {digits} else '' end"


def time_of(url: str) -> str:
    digits = f"regexp_extract({url}, '[0-9]{{14}}')"
    return f"coalesce({when(digits)}, timestamp '0001-01-01')"


def printed(time: str) -> str:
    return f"strftime({time}, '%Y-%m-%d %H:%M:%S')"


def query_url(site: str, year: str) -> str:
    return f"'{K.AVAILABILITY_QUERY}' || {site} || '&timestamp=' || {year}::varchar || '0701'"


def file_ok(url: str) -> str:
    return f"not regexp_matches({url}, '[.](" + "|".join(K.BLOCKED_EXTENSIONS) + ")$', 'i')"


def path_ok(url: str) -> str:
    return f"strpos(lower({url}), '/products/') = 0"


def on_site(url: str, site: str) -> str:
    return f"strpos(lower({url}), lower({site})) > 0"


def in_window(url: str, year: str, span: int = 1) -> str:
    found = f"regexp_extract({url}, '/web/([0-9]{{4}})[0-9]{{4}}[0-9]+/http', 1)"
    return f"case when {found} = '' then true else abs(try_cast({found} as int) - {year}) <= {span} end"


def eligible(url: str, site: str, year: str) -> str:
    return f"{file_ok(url)} and {path_ok(url)} and {on_site(url, site)} and {in_window(url, year)}"


FAILURE = f"case when status is null then coalesce(transport_error, '{K.NOT_STORED}') end"
THROTTLED = f"(status = 200 and final_url = '{K.THROTTLE_PAGE}')"
HOMEPAGE_ERROR = (
    f"case when status is null then {FAILURE} when {THROTTLED} then '{K.HOMEPAGE_THROTTLED}' || final_url"
    f" when status <> 200 then '{K.HOMEPAGE_STATUS}' || status::varchar end"
)
PAGE_ERROR = (
    f"case when status is null then '{K.PAGE_TRANSPORT}' || {FAILURE}"
    f" when {THROTTLED} then '{K.HOMEPAGE_THROTTLED}' || final_url"
    f" when status <> 200 then '{K.PAGE_STATUS}' || status::varchar end"
)
IS_TEXT = "(content_type is null or regexp_matches(content_type, 'text|hmtl|xml'))"
CONTENT_ERROR = (
    f"case when not {IS_TEXT} then '{K.CONTENT_REJECTED}' || final_url"
    f" || {quoted(K.CONTENT_REJECTED_STATUS)} || status::varchar end"
)
LINK_CONTENT = f"case when not {IS_TEXT} then '{K.LINK_CONTENT_REJECTED}' || status::varchar end"
LINK_ERROR = f"case when status is null then {FAILURE} else {LINK_CONTENT} end"
LINK_ERROR_STRICT = (
    f"case when status is null then {FAILURE} when status <> 200 or {THROTTLED}"
    f" then '{K.LINK_STATUS}' || status::varchar else {LINK_CONTENT} end"
)

# --- shared CTEs -----------------------------------------------------------

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


def with_ctes(sql: str, *needs: str, instead: dict[str, str] | None = None) -> str:
    """``instead`` names CTEs to be put in the place of others."""
    order: list[str] = []
    body = {**CTES, **{name: CTES[other] for name, other in (instead or {}).items()}}

    def visit(name: str) -> None:
        if name not in order:
            for need in body[name][1]:
                visit(need)
            order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({body[n][0]})" for n in order) + "\n" + sql


ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str, *needs: str, instead: dict[str, str] | None = None) -> None:
    ORACLE[name] = with_ctes(sql, *needs, instead=instead)


def captures_sql(healed: int) -> str:
    failed = f"(page_id % 23 = 0 and (page_id // 23) % 3 >= {healed})"
    return f"""
select page_id, site, ts14, page_url, home as url,
  case when page_id % 37 = 0 then '{K.THROTTLE_PAGE}' when page_id % 11 = 0 then home || '/index' else home end
    as final_url,
  case when {failed} then null when page_id % 13 = 0 then 404 when page_id % 29 = 0 then 503 else 200 end as status,
  case when {failed} then 'Error_detected: timeout' end as transport_error,
  case when page_id % 17 = 0 then 'application/pdf' when page_id % 19 = 0 then null
    else 'text/html; charset=utf-8' end as content_type,
  case when page_id % 37 = 0 or page_id % 11 = 0 then 1 else 0 end as n_redirects,
  case when {failed} or page_id % 13 = 0 or page_id % 29 = 0 then 3 else (page_id % 3)::int end as n_retries,
  case when page_id % 31 = 0 then replace(replace(html, '<p>', '<i>'), '<h1>', '<i>') else html end as html
from (
  select *, '{K.ARCHIVE_ROOT}/web/' || ts14 || '/' || page_url as home from (
    select page_id, html, url as page_url,
      regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www[.]', '') as site,
      case when page_id % 50 = 49 then '20149931000000' else
        (2014 + page_id % 7)::varchar || lpad((1 + (page_id * 5) % 12)::varchar, 2, '0')
        || lpad((1 + (page_id * 3) % 28)::varchar, 2, '0') || lpad((page_id % 24)::varchar, 2, '0')
        || lpad(((page_id * 7) % 60)::varchar, 2, '0') || lpad(((page_id * 13) % 60)::varchar, 2, '0') end as ts14
    from pages) a) b"""


cte("captures", captures_sql(0))
cte("seed_rows", """
select distinct site as website, (2014 + page_id % 7)::int as year_query from captures
union all
select distinct 'gone-' || site, (2014 + page_id % 7)::int from captures where page_id % 9 = 0""", "captures")
cte("seed_lines", """
select case when page_id % 10 = 3 then site when page_id % 10 = 5 then site || ',' || (2014 + page_id % 7)::varchar
  when page_id % 10 = 7 then site || ', x' when page_id % 10 = 9 then ''
  else ' ' || site || ', ' || (2014 + page_id % 7)::varchar || chr(9) end as value, page_id, site from captures""",
    "captures")
cte("ranked", """
select site, page_id, ts14, page_url, row_number() over (partition by site order by page_id) as rn from captures""",
    "captures")
cte("archived", """
select a.site, a.page_id, case (a.rn + b.rn) % 7
  when 0 then '/web/' || b.ts14 || '/' || b.page_url || '.PDF'
  when 1 then '/web/' || b.ts14 || '/http://' || b.site || '/products/' || b.page_id::varchar
  when 2 then '/web/' || b.ts14 || '/' || b.page_url || '/'
  when 3 then '/web/' || b.ts14 || 'id_/' || b.page_url
  when 4 then '/web/' || b.ts14 || '/http://other.example/' || b.page_id::varchar
  else '/web/' || b.ts14 || '/' || b.page_url end as href
from ranked a join ranked b on a.site = b.site and b.rn between a.rn + 1 and a.rn + 25""", "ranked")
cte("odd", """
select site, page_id, unnest([
  '#', '#s' || page_id, '../up/' || page_id, './here/' || page_id, 'a//b/../c' || page_id || '/.',
  'mailto:x@' || site, '//' || site || '/c' || page_id, 'redirect?u=http://' || page_id, '?q=http://' || page_id,
  'HTTP://' || site || '/A' || page_id || '?#', 'javascript:void(0)', site || '/x' || page_id || '#']) as href
from captures""", "captures")
cte("page_hrefs", f"select site, page_id, unnest({hrefs('html')}) as href from captures", "captures")
cte("links", """
select * from page_hrefs union all select * from archived union all select * from odd""",
    "page_hrefs", "archived", "odd")
cte("linked", f"""
select site, page_id, href, {resolved('href', 'site')} as link, (2014 + page_id % 7)::int as year_query from links""",
    "links")
cte("page_blocks", f"select page_id, {blocks('html')} as b from captures", "captures")
cte("texts", f"""
select c.page_id, c.url, {title('c.html')} as title, {page_text('p.b')} as text
from captures c join page_blocks p using (page_id)""", "captures", "page_blocks")

# Homepages: all captures of a site compared with mid-year.
cte("nearest", f"""
select website, year_query, url as capture_url, captured from (
  select s.website, s.year_query, c.url, {when('c.ts14')} as captured,
    row_number() over (partition by s.website, s.year_query order by
      abs(epoch({when('c.ts14')}) - epoch(make_timestamp(s.year_query, 7, 1, 0, 0, 0))), {when('c.ts14')}, c.url) as n
  from seed_rows s join captures c on s.website = c.site where {when('c.ts14')} is not null) x
where n = 1""", "seed_rows", "captures")
NO_ANSWER = '{"archived_snapshots": {}}'


def answer_unusable(site: str, year: str, body: str) -> str:
    return (
        f"{quoted(K.ANSWER_UNUSABLE)} || {site} || '{K.ANSWER_QUERY}' || {query_url(site, year)}"
        f" || '{K.ANSWER_BODY}' || {body}"
    )


cte("homepages", f"""
select s.website, s.year_query, n.capture_url, {query_url('s.website', 's.year_query')} as query_url,
  r.page_id, r.status, r.transport_error, r.final_url, r.content_type, r.n_redirects, r.n_retries,
  case when n.capture_url is null then {answer_unusable('s.website', 's.year_query', quoted(NO_ANSWER))}
    else {HOMEPAGE_ERROR} end as error
from seed_rows s left join nearest n using (website, year_query) left join captures r on n.capture_url = r.url""",
    "seed_rows", "nearest", "captures")
cte("level0", f"""
select website, year_query, 0 as depth, 0 as n_page, capture_url as url, final_url as original_url, status,
  transport_error, final_url, n_redirects, 0 as nretries_link, n_retries as n_retries_api, {CONTENT_ERROR} as error
from homepages where error is null""", "homepages")
cte("walk_links", """
select c.url, l.href from (select * from page_hrefs union all select * from archived) l
join captures c using (page_id)""", "page_hrefs", "archived", "captures")
cte("seen0", "select website, year_query, final_url as url_key from level0", "level0")


def level_ctes(depth: int, limit: int = 20) -> None:
    parent, seen = f"level{depth - 1}", f"seen{depth - 1}"
    cte(f"candidates{depth}", f"""
select *, {url_key('link', 'website')} as url_key from (
  select p.website, p.year_query, p.n_page as position, p.taken, p.n_retries_api,
    {resolved('l.href', 'p.website')} as link
  from (select *, max(n_page) over (partition by website, year_query) as taken from {parent}) p
  join walk_links l using (url) where p.error is null) x
where {eligible('link', 'website', 'year_query')}""", parent, "walk_links")
    cte(f"frontier{depth}", f"""
select * from (
  select *, taken + row_number() over (partition by website, year_query order by position, link) as n_page from (
    select *, row_number() over (partition by website, year_query, url_key order by position, link) as k
    from candidates{depth} c
    where not exists (select 1 from {seen} v where v.website = c.website and v.year_query = c.year_query
      and v.url_key = c.url_key)) x
  where k = 1) y where n_page <= {limit + 1}""", f"candidates{depth}", seen)
    cte(f"level{depth}", f"""
select f.website, f.year_query, {depth} as depth, f.n_page::int as n_page, f.link as url, f.link as original_url,
  status, transport_error, final_url, n_redirects, coalesce(n_retries, 0) as nretries_link, f.n_retries_api,
  {LINK_ERROR} as error
from frontier{depth} f left join captures r on f.link = r.url""", f"frontier{depth}", "captures")
    cte(f"seen{depth}", f"""
select * from {seen} union all select website, year_query, url_key from frontier{depth}""", seen, f"frontier{depth}")
    union = " union all ".join(f"select * from level{d}" for d in range(depth + 1))
    cte(f"outcomes{depth}", outcome_sql(f"({union})"), *(f"level{d}" for d in range(depth + 1)), "texts")


def outcome_sql(visits: str) -> str:
    return f"""
select v.* exclude (error), t.title, t.text,
  coalesce(v.error, case when coalesce(t.text, '') = '' then '{K.NO_TEXT_MESSAGE}' end) as error
from {visits} v left join texts t on v.url = t.url"""


cte("outcomes0", outcome_sql("level0"), "level0", "texts")
level_ctes(1)
level_ctes(2)

PAGE_COLUMNS = f"""website, {url_key('final_url', 'website')} as downloaded_link, year_query,
  original_url as "original_query_URL_wayback_machine", final_url as "URL_wayback_machine_processed",
  n_page as n_page_downloaded, coalesce(title, '') as "Title_page", text as "TextContent",
  {time_text('final_url')} as snapshot_date_string, {printed(time_of('final_url'))} as snapshot_date,
  year({time_of('final_url')})::int as year_obtained, n_redirects > 0 as "Redirected", depth as "Depth",
  n_retries_api, nretries_link"""


def pages_sql(outcomes: str) -> str:
    return f"""
select * exclude (k) from (
  select *, row_number() over (partition by website, downloaded_link, year_query,
    "original_query_URL_wayback_machine", "URL_wayback_machine_processed" order by n_page_downloaded desc) as k
  from (select {PAGE_COLUMNS} from {outcomes} where error is null) p) q where k = 1"""


HOMEPAGE_ERRORS = """
select website, year_query, coalesce(capture_url, query_url) as "original_query_URL_wayback_machine",
  null::varchar as "URL_wayback_machine_processed", 0 as "Depth", error as error_message, true as website_not_scrapped,
  null::boolean as "Redirected", null::int as n_retries_api, null::int as nretries_link
from homepages where error is not null"""


def page_errors_sql(outcomes: str) -> str:
    return f"""
select * exclude (k) from (
  select *, row_number() over (partition by website, year_query, "original_query_URL_wayback_machine",
    "URL_wayback_machine_processed" order by "Depth" desc) as k
  from (select website, year_query, original_url as "original_query_URL_wayback_machine",
      case when status is not null then final_url else original_url end as "URL_wayback_machine_processed",
      depth as "Depth", error as error_message, null::boolean as website_not_scrapped,
      status is not null and coalesce(n_redirects, 0) > 0 as "Redirected", n_retries_api, nretries_link
    from {outcomes} where error is not null) p) q where k = 1"""


# --- lists -----------------------------------------------------------------

oracle("seeds", """
select site as website, (2014 + page_id % 7)::int as year_query from seed_lines where page_id % 10 not in (3, 5, 7, 9)""",
       "seed_lines")
oracle("seeds_in_order", """
select site as website, (2014 + page_id % 7)::int as year_query, min(line_no) as line_no
from (select *, row_number() over (order by page_id) - 1 as line_no from seed_lines) x
where page_id % 10 not in (3, 5, 7, 9) group by all""", "seed_lines")
oracle("bad_seed_lines", "select value from seed_lines where page_id % 10 in (3, 5, 7, 9)", "seed_lines")
oracle("availability_urls", f"""
select website, year_query, {query_url('website', 'year_query')} as query_url from seed_rows""", "seed_rows")

# --- URLs ------------------------------------------------------------------

oracle("hosts", """
select page_id, url, case when place = '' then '' else case when scheme = '' then 'http' else scheme end
  || '://' || place end as host
from (
  select page_id, url, scheme, case when regexp_matches(rest, '^//[^/?#]') then regexp_extract(rest, '^//([^/?#]*)', 1)
    else regexp_extract(regexp_replace(rest, '^//[^/?#]*', ''), '^[^?#]*') end as place
  from (
    select page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme,
      regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*:', '') as rest
    from (select page_id, final_url as url from captures union all select page_id, href from odd) u) v) w""",
       "captures", "odd")
oracle("links_resolved", "select site, page_id, href, link from linked", "linked")
oracle("url_keys", f"""
select site, url, {url_key('url', 'site')} as url_key
from (select site, final_url as url from captures union all select site, link from linked) u""", "captures", "linked")
oracle("snapshot_times", f"""
select page_id, {time_text('final_url')} as snapshot_date_string, {printed(time_of('final_url'))} as snapshot_date,
  year({time_of('final_url')})::int as year_obtained, ts14[1:4]::int as year_query from captures""", "captures")
oracle("link_filters", f"""
select site, link, {file_ok('link')} as file_ok, {path_ok('link')} as path_ok, {on_site('link', 'site')} as on_site
from linked""", "linked")
oracle("year_window", f"select year_query, link, {in_window('link', 'year_query')} as in_window from linked", "linked")

# --- HTML ------------------------------------------------------------------

oracle("hrefs_distinct", f"""
select page_id, (i - 1)::int as pos, h[i] as href
from (select page_id, h, unnest(range(1, length(h) + 1)) as i
  from (select page_id, {hrefs('html')} as h from captures) a) b""", "captures")
oracle("titles", f"select page_id, {title('html')} as title from captures", "captures")
oracle("title_fallback", f"""
select page_id, case when t = '' then '{K.NO_TITLE}' else t end as title from (
  select page_id, {title("case when page_id % 5 = 0 then regexp_replace(html, '<title>.*?</title>', '', 'gs') else html end")}
    as t from captures) x""", "captures")
oracle("text_blocks", """
select page_id, (i - 1)::int as pos, b[i] as block
from (select page_id, b, unnest(range(1, length(b) + 1)) as i from page_blocks) x""", "page_blocks")
oracle("page_text", "select page_id, text from texts", "texts")
oracle("no_text_errors", f"select page_id, '{K.NO_TEXT_MESSAGE}' as error_message from texts where text = ''", "texts")
# Text nodes with the tags before them as steps: +name opens, -name closes, nothing stays. The open elements before a
# node are a fold over the steps up to it, from the document on.
cte("shown_pages", f"""
select page_id, regexp_replace({shown('html')}, '<title(\\s[^>]*)?>.*?(</title[^>]*>|\\z)', '<!>', 'gis') as html
from (select page_id, case when page_id % 3 = 0
  then replace(html, '<head>', '<head>loose<meta name=a>more') || 'after' else html end as html from captures) a""", "captures")
STEP = (
    "case when starts_with(t, '</') then '-' || lower(regexp_extract(t, '^</([A-Za-z][^\\s/>]*)', 1))"
    " when ends_with(t, '/>') or regexp_extract(t, '^<([A-Za-z][^\\s/>]*)', 1) = ''"
    f" or lower(regexp_extract(t, '^<([A-Za-z][^\\s/>]*)', 1)) in ({', '.join(map(quoted, (*K.VOID_ELEMENTS, 'title', 'script', 'style')))})"
    " then '' else '+' || lower(regexp_extract(t, '^<([A-Za-z][^\\s/>]*)', 1)) end"
)
cte("page_nodes", f"""
select page_id, regexp_split_to_array(html, '{TAG}') as nodes,
  list_transform(regexp_extract_all(html, '{TAG}'), lambda t: {STEP}) as steps
from shown_pages""", "shown_pages")
OPEN = (
    "list_reduce(list_prepend('/', steps[1:i - 1]), lambda s, t: case when t = '' then s"
    " when t[1] = '+' then s || t[2:] || '/' when not contains(s, '/' || t[2:] || '/') then s"
    " else left(s, length(s) - instr(reverse(s), reverse('/' || t[2:] || '/')) - length(t[2:])) end)"
)
NOT_OWN = " and ".join(f"not ends_with(path, '/{name}/')" for name in K.TEXT_NOT_SHOWN)
oracle("visible_text", f"""
select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, text
from (select page_id, i, {decoded('nodes[i]')} as text, {OPEN} as path
  from (select *, unnest(range(1, length(nodes) + 1)) as i from page_nodes) a) b
where path <> '/' and {NOT_OWN} and trim(text, {chars(K.BLANKS)}) <> ''""", "page_nodes")
oracle("content_gate", f"select page_id, {IS_TEXT} as is_text from captures", "captures")

# --- answers and responses -------------------------------------------------

cte("answers", """
select website, year_query, case length(website) % 5 when 0 then null when 1 then '{"archived_snapshots": {}}'
  when 2 then 'gateway {error' else '{"url": "' || website || '", "archived_snapshots": {"closest": {"available": true, '
  || '"status": "200", "timestamp": "' || year_query || '0630120000", "url": "http://web.archive.org/web/'
  || year_query || '0630120000/http://' || website || '/"}}}' end as body from seed_rows""", "seed_rows")
oracle("api_outcomes", f"""
select website, year_query, found as capture_url, {query_url('website', 'year_query')} as query_url,
  case when body is null then '{K.URL_NOT_FOUND}' || website || {quoted(K.URL_NOT_FOUND_QUERY)}
      || {query_url('website', 'year_query')}
    when found is null then {answer_unusable('website', 'year_query', 'body')} end as answer_error
from (select *, case when json_valid(body) then json_extract_string(
    case when json_valid(body) then body else '{{}}' end, '$.archived_snapshots.closest.url') end as found
  from answers) x""", "answers")
ATTEMPTS = f"""
select url, round, attempt,
  case when page_id % 23 = 0 then null when page_id % 13 = 0 then 404 when attempt <= (page_id + round) % 4 then 503
    else 200 end as status,
  case when page_id % 23 = 0 then 'Error_detected: timeout ' || attempt end as transport_error,
  case when page_id % 37 = 0 and page_id % 74 = 0 and round = 2 then url else final_url end as final_url
from captures, (select unnest([1, 2])::int as round) r, (select unnest([1, 2, 3, 4])::int as attempt) a"""
BY_ROUND = """
select *, row_number() over (partition by url, round order by case when status = 200 then attempt end nulls last,
    attempt desc) as n,
  coalesce(min(case when status = 200 then attempt end) over (partition by url, round) - 1, 3) as n_retries
from attempts where attempt <= 3"""
CHOSEN = f"""
select b.url, b.status, b.transport_error, b.final_url, b.n_retries::int as n_retries, b.round
from by_round a join by_round b on a.url = b.url and a.round = 1 and a.n = 1 and b.n = 1
where b.round = case when a.status = 200 and a.final_url = '{K.THROTTLE_PAGE}' then 2 else 1 end"""
cte("attempts", ATTEMPTS, "captures")
cte("by_round", BY_ROUND, "attempts")
oracle("attempts_resolved", """
select url, round, status, transport_error, final_url, n_retries::int as n_retries from by_round where n = 1""",
       "by_round")
oracle("throttled_second_round", CHOSEN, "by_round")
oracle("compacted_attempts", """
select url, round, attempt, status from by_round
where attempt = 3 or (status = 200 and n = 1)""", "by_round")
# Captures whose responses are the attempts chosen.
cte("plain_captures", captures_sql(0))
cte("plain_attempts", ATTEMPTS.replace("from captures", "from plain_captures"), "plain_captures")
cte("plain_by_round", BY_ROUND.replace("from attempts", "from plain_attempts"), "plain_attempts")
cte("resolved_captures", f"""
select c.* replace (r.final_url as final_url, r.status as status, r.transport_error as transport_error,
  r.n_retries as n_retries, case when r.status = 503 then '<h1>Busy</h1>' when r.status is not null then c.html end as html)
from plain_captures c join ({CHOSEN.replace('by_round', 'plain_by_round')}) r using (url)""",
    "plain_captures", "plain_by_round")
for _name, _rule in {
    "homepage_outcomes": HOMEPAGE_ERROR,
    "page_outcomes": PAGE_ERROR,
    "link_outcomes": LINK_ERROR,
    "link_outcomes_strict": LINK_ERROR_STRICT,
}.items():
    oracle(_name, f"select page_id, {_rule} as error from captures", "captures")

# --- nearest capture, frontier, fetch --------------------------------------

oracle("nearest_captures", f"select website, year_query, capture_url, {printed('captured')} as captured_at from nearest",
       "nearest")
oracle("nearest_from_index", f"select website, year_query, capture_url, {printed('captured')} as captured_at from nearest",
       "nearest")
cte("whole_candidates", f"""
select site as website, year_query, page_id as position, link, {url_key('link', 'site')} as url_key
from linked where {eligible('link', 'site', 'year_query')}""", "linked")
cte("whole_first", """
select website, year_query, url_key, position, link from (
  select *, row_number() over (partition by website, year_query, url_key order by position, link) as k
  from whole_candidates) x where k = 1""", "whole_candidates")
cte("whole_fresh", f"""
select * from whole_first f where not exists (
  select 1 from captures c where c.status = 200 and c.site = f.website and 2014 + c.page_id % 7 = f.year_query
    and {url_key('c.final_url', 'c.site')} = f.url_key)""", "whole_first", "captures")
oracle("first_per_key", "select * from whole_first", "whole_first")
oracle("not_visited", "select * from whole_fresh", "whole_fresh")
oracle("quota", """
select website, year_query, link, n::int as n_page from (
  select *, row_number() over (partition by website, year_query order by position, link) as n from whole_fresh) x
where n <= 6""", "whole_fresh")
oracle("frontier_depth1", """
select website, year_query, link, n_page::int as n_page, n_retries_api from frontier1""", "frontier1")
oracle("fetched_links", """
select website, year_query, n_page, url, status, final_url, nretries_link, error from level1""", "level1")

# --- whole plans -----------------------------------------------------------

oracle("homepage_pages", pages_sql("outcomes0"), "outcomes0")
oracle("homepage_failures", HOMEPAGE_ERRORS, "homepages")
oracle("crawl_pages", pages_sql("outcomes1"), "outcomes1")
oracle("crawl_stored_archive", pages_sql("outcomes1"), "outcomes1")
oracle("crawl_from_attempts", pages_sql("outcomes1"), "outcomes1", instead={"captures": "resolved_captures"})
cte("answered", """
select site as website, (2014 + page_id % 7)::int as year_query, min(url) as capture_url, null::timestamp as captured
from captures group by all""", "captures")
oracle("crawl_from_answers", pages_sql("outcomes1"), "outcomes1", instead={"nearest": "answered"})
oracle("crawl_errors", f"{HOMEPAGE_ERRORS} union all {page_errors_sql('outcomes1')}", "homepages", "outcomes1")
oracle("crawl_depth2", pages_sql("outcomes2"), "outcomes2")
cte("retry_list", """
select page_id, site as website, (2014 + page_id % 7)::int as year_query,
  case when page_id % 4 = 0 then url || '?from' else url end as original_url,
  case when page_id % 10 = 9 then url || '/gone' else url end as processed_url, 1 as depth
from captures""", "captures")
cte("single", f"""
select l.website, l.year_query, l.original_url, l.processed_url, l.depth, coalesce(r.n_retries, 0) as n_retries,
  t.title, t.text, coalesce({PAGE_ERROR}, {CONTENT_ERROR},
    case when coalesce(t.text, '') = '' then '{K.NO_TEXT_MESSAGE}' end) as error
from retry_list l left join captures r on l.processed_url = r.url left join texts t on l.processed_url = t.url""",
    "retry_list", "captures", "texts")
oracle("single_page_pass", f"""
select website, {url_key('processed_url', 'website')} as downloaded_link, year_query,
  original_url as "original_query_URL_wayback_machine", processed_url as "URL_wayback_machine_processed",
  null::int as n_page_downloaded, coalesce(title, '') as "Title_page", text as "TextContent",
  {time_text('processed_url')} as snapshot_date_string, {printed(time_of('processed_url'))} as snapshot_date,
  year({time_of('processed_url')})::int as year_obtained, original_url <> processed_url as "Redirected",
  depth as "Depth", null::int as n_retries_api, n_retries as nretries_link
from single where error is null""", "single")
oracle("single_page_errors", """
select website, year_query, original_url as "original_query_URL_wayback_machine",
  processed_url as "URL_wayback_machine_processed", depth as "Depth", error as error_message,
  null::boolean as website_not_scrapped, null::boolean as "Redirected", null::int as n_retries_api,
  n_retries as nretries_link
from single where error is not null""", "single")

# --- tables ----------------------------------------------------------------

cte("error_log", f"""
select (page_id % 3)::int as batch_no, page_id as seq,
  case when page_id % 6 = 0 then 'homepage' when (page_id // 6) % 2 = 1 then 'single' else 'walk' end as write_shape,
  site as website, (2014 + page_id % 7)::int as year_query,
  case when page_id % 6 = 0 then url else slot end as original,
  case when page_id % 6 <> 0 then slot || case when page_id % 8 > 3 then '/index' else ' ' || chr(10) end end
    as processed,
  case when page_id % 6 in (0, 5) then 0 else 1 end as depth,
  case when page_id % 60 = 9 then null when page_id % 6 = 0 then 'Domain not scraped at all, status_code: 404'
    when page_id % 6 in (1, 5) then '{K.NO_TEXT_MESSAGE}' when page_id % 6 = 2 then 'Error_from_request : status_code : 404'
    when page_id % 6 = 3 then 'Error_from_request : status_code : 503' else 'Error_detected: timeout' end as message,
  case when page_id % 6 = 0 then true end as flag,
  case when page_id % 6 <> 0 and (page_id // 6) % 2 = 0 then page_id % 2 = 1 end as redirected,
  case when page_id % 6 <> 0 and (page_id // 6) % 2 = 0 then (page_id % 5)::int end as n_api,
  case when page_id % 6 <> 0 then (page_id % 4)::int end as n_link,
  make_timestamp(page_id * 1000000) as modified
from (select *, '{K.ARCHIVE_ROOT}/web/2016/' || site || '/' || (page_id % 4)::varchar as slot from captures) c""",
    "captures")
cte("error_table", """
select * exclude (k) from (
  select *, row_number() over (partition by website, year_query, flag, case when flag then null else original end,
    case when flag then null else processed end order by batch_no desc, seq desc) as k from error_log) x
where k = 1""", "error_log")
ERROR_FIELDS = """website, year_query, original as "original_query_URL_wayback_machine",
  processed as "URL_wayback_machine_processed", depth as "Depth", message as error_message,
  flag as website_not_scrapped, redirected as "Redirected", n_api as n_retries_api, n_link as nretries_link"""
ERROR_COLUMNS = f"""{ERROR_FIELDS}, {printed('modified')} as "lastModified\""""
oracle("latest_writes", """
select website, year_query, original as "original_query_URL_wayback_machine", batch_no, seq, write_shape,
  message as error_message from (
  select *, row_number() over (partition by website, year_query, original order by batch_no desc, seq desc) as k
  from error_log) x where k = 1""", "error_log")
# The later log: reversed order, odd rows once more a year on.
cte("later_log", """
select * replace (-seq as seq) from (
  select * from error_log union all
  select * replace (year_query + 1 as year_query) from error_log where seq % 2 = 1) x""", "error_log")


def last_set(column: str, condition: str, keys: str) -> str:
    """Value of ``column`` in the last row of the key that sets it."""
    return (
        f"first_value({column}) over (partition by {keys}"
        f" order by ({condition}) desc, batch_no desc, seq desc) as {column}"
    )


def merged_errors(keys: str, own: str, original: str, walk: str) -> str:
    """Old rows count as a write of every field before the first batch."""
    columns = ["processed", "depth", "message", "flag", "redirected", "n_api", "n_link", "modified"]
    sets = {"redirected": walk, "n_api": walk, "processed": "old", "n_link": "old" if own == "flag" else "true",
            "flag": "true" if own == "flag" else "old"}
    if own == "flag":
        sets |= {"redirected": "old", "n_api": "old"}
    else:
        columns.remove("processed")
    values = ",\n    ".join(last_set(c, sets.get(c, "true"), keys) for c in columns)
    original_value = last_set("original", "true", keys) if original == "merged" else "original"
    processed = "" if "processed" in columns else "processed,"
    return f"""
select {ERROR_COLUMNS} from (
  select website, year_query, {original_value}, {processed} {values},
    row_number() over (partition by {keys} order by batch_no desc, seq desc) as k
  from (select *, false as old from later_log where {own if own == 'flag' else 'flag is null'}
    union all select * replace (-1 as batch_no), true as old from error_table
      where {own if own == 'flag' else 'flag is null'}) w) m
where k = 1
union all
select {ERROR_COLUMNS} from error_table where {'flag is null' if own == 'flag' else 'flag'}"""


oracle("merge_page_errors", merged_errors(
    "website, year_query, original, processed", "page", "key", "old or write_shape = 'walk'"),
    "later_log", "error_table")
oracle("merge_homepage_errors", merged_errors("website, year_query", "flag", "merged", "old"),
       "later_log", "error_table")


def page_log(slots: int) -> str:
    return f"""
select ((c.page_id // 5) % 3)::int as batch_no, c.page_id as seq,
  case when c.page_id % 3 = 2 then 'single' else 'walk' end as write_shape, site as website,
  site || '/' || (c.page_id % {slots})::varchar as downloaded_link, (2014 + c.page_id % 7)::int as year_query,
  '{K.ARCHIVE_ROOT}/web/20160701000000/http://' || site || '/' || (c.page_id % {slots})::varchar as link,
  case when c.page_id % 3 <> 2 then (c.page_id % 21)::int end as n_page,
  case when c.page_id % 4 <> 0 then title end as title, text, make_timestamp(c.page_id * 60000000) as snapshot,
  c.page_id % 2 = 0 as redirected,
  case when c.page_id % 3 <> 2 and c.page_id % 5 <> 0 then (c.page_id % 3)::int end as n_api,
  (c.page_id % 4)::int as n_link, make_timestamp(c.page_id * 1000000) as modified
from captures c join texts t using (page_id)"""


cte("page_writes", page_log(4), "captures", "texts")
cte("page_table", f"""
select * exclude (k) from (
  select *, row_number() over (partition by website, downloaded_link, year_query order by batch_no desc, seq desc) as k
  from ({page_log(6)}) l) x where k = 1""", "captures", "texts")
PAGE_MERGE_KEY = "website, downloaded_link, year_query"
_walk_only = "old or write_shape = 'walk'"
_page_values = ",\n    ".join(
    last_set(c, _walk_only if c in ("n_page", "n_api") else "true", PAGE_MERGE_KEY)
    for c in ("n_page", "title", "text", "snapshot", "redirected", "n_api", "n_link", "modified")
)
oracle("merge_pages", f"""
select website, downloaded_link, year_query, link as "original_query_URL_wayback_machine",
  link as "URL_wayback_machine_processed", n_page as n_page_downloaded, title as "Title_page", text as "TextContent",
  '20160701000000' as snapshot_date_string, {printed('snapshot')} as snapshot_date, 2016 as year_obtained,
  redirected as "Redirected", 1 as "Depth", n_api as n_retries_api, n_link as nretries_link,
  {printed('modified')} as "lastModified"
from (
  select website, downloaded_link, year_query, link, {_page_values},
    row_number() over (partition by {PAGE_MERGE_KEY} order by batch_no desc, seq desc) as k
  from (select *, false as old from page_writes
    union all select * replace (-1 as batch_no), true as old from page_table) w) m
where k = 1""", "page_writes", "page_table")

# Errors of the table and of a pass over the list; sites scraped, and pages that a later pass opened.
cte("errors_with_pass", """
select website, year_query, original, processed, depth, message, flag, redirected, n_api, n_link from error_table
union all
select website, year_query, original_url, processed_url, depth, error, null, null, null, n_retries
from single where error is not null""", "error_table", "single")
cte("captures_later", captures_sql(1))
cte("opened_later", f"""
select l.website, l.year_query, l.original_url as original, l.processed_url as processed
from retry_list l left join captures_later r on l.processed_url = r.url where {PAGE_ERROR} is null""",
    "retry_list", "captures_later")
CLEARED_SITE = "flag and (website, year_query) in (select website, year_query from level0)"
CLEARED_PAGE = """flag is null and (website, year_query, original, processed) in (
  select website, year_query, original, processed from opened_later)"""
_cleared = ("errors_with_pass", "level0", "opened_later")
oracle("clear_errors", f"""
select {ERROR_FIELDS} from errors_with_pass
where not coalesce({CLEARED_SITE}, false) and not coalesce({CLEARED_PAGE}, false)""", *_cleared)
oracle("cleared_counts", f"""
select 'homepage' as kind, count(*) as n from errors_with_pass where {CLEARED_SITE}
union all select 'page', count(*) from errors_with_pass where {CLEARED_PAGE}""", *_cleared)
cte("to_retry", f"""
select website, year_query, original, processed, depth, n_link from error_table
where (message is null or message <> '{K.NO_TEXT_MESSAGE}')
  and (message is null or not regexp_matches(message, '{K.PERMANENT_STATUS}')) and flag is null and depth = 1""",
    "error_table")


def compact(url: str) -> str:
    return f"replace(replace({url}, ' ', ''), chr(10), '')"


oracle("retry_homepages", "select website || ', ' || year_query as value from error_table where flag", "error_table")
oracle("retry_pages", f"""
select website || ', ' || year_query || ', ' || {compact('original')} || ', ' || {compact('processed')} || ', ' || depth
  as value from to_retry""", "to_retry")
oracle("retry_page_rows", f"""
select website, year_query, {compact('original')} as original_url, {compact('processed')} as processed_url, depth
from to_retry""", "to_retry")
oracle("retry_rows_without_url", """
select website, year_query, original as original_url, depth from to_retry where n_link = 3""", "to_retry")
oracle("error_counts", """
select 'homepage' as kind, count(*) as n from error_table where flag union all select 'page', count(*) from to_retry""",
       "error_table", "to_retry")
oracle("not_downloaded", f"""
select {ERROR_COLUMNS} from error_table e where not exists (
  select 1 from page_table p where p.website = e.website and p.year_query = e.year_query
    and '{K.ARCHIVE_ROOT}/web/2016/' || p.downloaded_link || '/index' = e.processed)""", "error_table", "page_table")
oracle("coverage", """
select website, year_query, n_pages, n_errors, case when n_pages > 0 then 'downloaded' when n_flagged > 0
  then 'not_scraped' when n_errors > 0 then 'empty' else 'missing' end as status
from (select s.website, s.year_query,
    (select count(*) from page_table p where p.website = s.website and p.year_query = s.year_query) as n_pages,
    (select count(*) from error_table e where e.website = s.website and e.year_query = s.year_query) as n_errors,
    (select count(*) from error_table e where e.flag and e.website = s.website and e.year_query = s.year_query)
      as n_flagged
  from seed_rows s) x""", "seed_rows", "page_table", "error_table")
oracle("site_years", "select distinct website, year_query from error_log", "error_log")

# --- whole runs ------------------------------------------------------------
# Round by round, each with the stop rule: a loop ends when nothing failed, or as much as before.
# The archives are those of 0, 1, 2, 3, 3, ... rounds of healing, so five rounds of either kind are all there can be.

ROUNDS = 5
ERROR_KEY = "website, year_query, original, processed"
WALKED = ["nearest", "homepages", "level0", "seen0", "candidates1", "frontier1", "level1", "seen1", "outcomes1"]


def again(suffix: str, instead: dict[str, str]) -> None:
    """The CTEs of a crawl once more, over other inputs."""
    renamed = {**{name: name + suffix for name in WALKED}, **instead}

    def put(text: str) -> str:
        return re.sub("\\b(" + "|".join(renamed) + ")\\b", lambda m: renamed[m[1]], text)

    for name in WALKED:
        sql, needs = CTES[name]
        cte(name + suffix, put(sql), *(renamed.get(n, n) for n in needs))


def goes_on(count: str, before: str | None) -> str:
    """Whether a loop goes on after it found ``count`` failures."""
    if before is None:
        return f"select n, n <> 0 as active from ({count}) c"
    return f"select c.n, b.active and c.n <> 0 and c.n <> b.n as active from ({count}) c, {before} b"


def walk_writes(batch: int, outcomes: str) -> str:
    return f"select {batch} as batch_no, n_page as seq, 'walk' as write_shape, {PAGE_COLUMNS} from {outcomes} where error is null"


def single_writes(batch: int, rows: str) -> str:
    return f"""
select {batch} as batch_no, 0 as seq, 'single' as write_shape, website, {url_key('processed_url', 'website')} as downloaded_link,
  year_query, original_url, processed_url, null::int as n_page_downloaded, coalesce(title, ''), text,
  {time_text('processed_url')}, {printed(time_of('processed_url'))}, year({time_of('processed_url')})::int,
  original_url <> processed_url, depth, null::int as n_retries_api, n_retries
from {rows} where error is null"""


def walk_errors(outcomes: str) -> str:
    """Of one pass, by key."""
    return f"""
select * exclude (k) from (
  select *, row_number() over (partition by {ERROR_KEY} order by depth desc) as k from (
    select website, year_query, original_url as original,
      case when status is not null then final_url else original_url end as processed, depth, error as message,
      status is not null and coalesce(n_redirects, 0) > 0 as redirected, n_retries_api as n_api, nretries_link as n_link
    from {outcomes} where error is not null) e) f where k = 1"""


FLAGGED = "select website, year_query, coalesce(capture_url, query_url) as original, error as message from {} where error is not null"
for _healed in (1, 2, 3):
    cte(f"captures_h{_healed}", captures_sql(_healed))
cte("flagged0", FLAGGED.format("homepages"), "homepages")
cte("failed0", walk_errors("outcomes1"), "outcomes1")
_writes_of = [(walk_writes(0, "outcomes1"), "outcomes1")]
for _i in range(ROUNDS):
    _captures = f"captures_h{min(_i + 1, 3)}"
    _before = f"home_round{_i - 1}" if _i else None
    cte(f"home_round{_i}", goes_on(f"select count(*) as n from flagged{_i}", _before), f"flagged{_i}", *([_before] if _i else []))
    cte(f"todo{_i}", f"select website, year_query from flagged{_i}, home_round{_i} where active", f"flagged{_i}", f"home_round{_i}")
    again(f"_r{_i}", {"captures": _captures, "seed_rows": f"todo{_i}"})
    cte(f"flagged{_i + 1}", f"""
select f.* from flagged{_i} f anti join todo{_i} t on f.website = t.website and f.year_query = t.year_query
union all {FLAGGED.format(f'homepages_r{_i}')}""", f"flagged{_i}", f"todo{_i}", f"homepages_r{_i}")
    cte(f"failed_now{_i}", walk_errors(f"outcomes1_r{_i}"), f"outcomes1_r{_i}")
    cte(f"failed{_i + 1}", f"""
select f.* from failed{_i} f anti join failed_now{_i} n using ({ERROR_KEY}) union all select * from failed_now{_i}""",
        f"failed{_i}", f"failed_now{_i}")
    _writes_of.append((walk_writes(_i + 1, f"outcomes1_r{_i}"), f"outcomes1_r{_i}"))
cte("left0", f"select * from failed{ROUNDS}", f"failed{ROUNDS}")
for _i in range(ROUNDS):
    _captures = f"captures_h{min(_i + 1, 3)}"
    _before = f"page_round{_i - 1}" if _i else None
    cte(f"listed{_i}", f"""
select website, year_query, original as original_url, processed as processed_url, depth from left{_i}
where (message is null or message <> '{K.NO_TEXT_MESSAGE}') and depth = 1
  and (message is null or not regexp_matches(message, '{K.PERMANENT_STATUS}'))""", f"left{_i}")
    cte(f"page_round{_i}", goes_on(f"select count(*) as n from listed{_i}", _before), f"listed{_i}", *([_before] if _i else []))
    cte(f"tried{_i}", f"""
select l.* exclude (n, active), coalesce(r.n_retries, 0) as n_retries, t.title, t.text, {PAGE_ERROR} as failure,
  coalesce({PAGE_ERROR}, {CONTENT_ERROR}, case when coalesce(t.text, '') = '' then '{K.NO_TEXT_MESSAGE}' end) as error
from (select * from listed{_i}, page_round{_i} where active) l
left join {_captures} r on l.processed_url = r.url left join texts t on l.processed_url = t.url""",
        f"listed{_i}", f"page_round{_i}", _captures, "texts")
    # What was opened leaves the table; what holds no text comes back as a new row.
    cte(f"left{_i + 1}", f"""
select f.* from left{_i} f anti join tried{_i} t
  on (f.website, f.year_query, f.original, f.processed) = (t.website, t.year_query, t.original_url, t.processed_url)
union all
select t.website, t.year_query, t.original_url, t.processed_url, t.depth, t.error,
  case when failure is not null then f.redirected end, case when failure is not null then f.n_api end, t.n_retries
from tried{_i} t join left{_i} f
  on (f.website, f.year_query, f.original, f.processed) = (t.website, t.year_query, t.original_url, t.processed_url)
where t.error is not null""", f"left{_i}", f"tried{_i}")
    _writes_of.append((single_writes(ROUNDS + 1 + _i, f"tried{_i}"), f"tried{_i}"))
cte("run_writes", " union all ".join(sql for sql, _ in _writes_of), *(need for _, need in _writes_of))
RUN_KEY = 'website, downloaded_link, year_query, "original_query_URL_wayback_machine", "URL_wayback_machine_processed"'
_later_fields = ", ".join(
    last_set(c, "write_shape = 'walk'" if c in ("n_page_downloaded", "n_retries_api") else "true", RUN_KEY)
    for c in ('n_page_downloaded', '"Title_page"', '"TextContent"', "snapshot_date_string", "snapshot_date", "year_obtained",
              '"Redirected"', '"Depth"', "n_retries_api", "nretries_link")
)
oracle("rerun_to_fixpoint", f"""
select * exclude (k) from (
  select {RUN_KEY}, {_later_fields}, row_number() over (partition by {RUN_KEY} order by batch_no desc, seq desc) as k
  from run_writes) w where k = 1""", "run_writes")
oracle("rerun_errors", f"""
select website, year_query, original as "original_query_URL_wayback_machine",
  null::varchar as "URL_wayback_machine_processed", 0 as "Depth", message as error_message, true as website_not_scrapped,
  null::boolean as "Redirected", null::int as n_retries_api, null::int as nretries_link from flagged{ROUNDS}
union all
select website, year_query, original, processed, depth, message, null, redirected, n_api, n_link from left{ROUNDS}""",
       f"flagged{ROUNDS}", f"left{ROUNDS}")
oracle("rerun_counts", " union all ".join(
    f"select '{kind}' as kind, {i} as round, c.n from {rounds}{i} c" + (f", {rounds}{i - 1} b where b.active" if i else "")
    for kind, rounds in (("homepage", "home_round"), ("page", "page_round")) for i in range(ROUNDS)
), *(f"{rounds}{i}" for rounds in ("home_round", "page_round") for i in range(ROUNDS)))
