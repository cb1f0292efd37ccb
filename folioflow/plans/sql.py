"""SQL building blocks: the given tables as elements, sections, boxes and pipe tables, as the adapters in sources make them."""

_WS = "[ \\t\\n\\r\\f]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


RAW = """
lines_ as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
raw as (select cast(doc_id as varchar) as document_id, cast(pos as int) as pos, cast(pos // 5 + 1 as int) as page,
  case when nw <= 4 then 'Title' else case (doc_id + pos) % 13 when 0 then 'Table' when 1 then 'Image' when 2 then 'Figure' when 3 then 'Formula' when 4 then 'Footer' when 5 then 'Address'
    when 6 then 'Header' when 7 then 'SectionHeader' when 8 then 'ListItem' else 'NarrativeText' end end as category,
  case when nw <= 4 then nw - 1 end as category_depth, text
  from (select *, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) as nw from lines_)),
marked as (select *, case when opens then greatest(1, case when category_depth >= 0 then category_depth + 1 when category = 'Title' then 1 else 2 end) end as level,
  cast(sum(opens::int) over (partition by document_id order by pos) as int) as sec_seq,
  case when not heading then 'el-' || cast(sum((not heading)::int) over (partition by document_id order by pos) as varchar) end as element_id
  from (select *, category in ('Title', 'Header', 'SectionHeader') as heading, category in ('Title', 'Header', 'SectionHeader') and trim(text) <> '' as opens from raw)),
els as (select document_id, pos, element_id, case when category = 'Table' then 'table' when category in ('Image', 'Figure') then 'image' when category = 'Formula' then 'formula' else 'text' end as type, page, text, sec_seq
  from marked where not heading and category not in ('PageBreak', 'Footer', 'Address') and trim(text) <> '')"""

SECTIONS = (
    RAW
    + """,
heads as (select document_id, sec_seq, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as title, cast(level as int) as level, page from marked where level is not null),
linked as (select h.*, coalesce((select max(p.sec_seq) from heads p where p.document_id = h.document_id and p.sec_seq < h.sec_seq and p.level < h.level), 0) as parent_seq,
  coalesce((select min(p.sec_seq) from heads p where p.document_id = h.document_id and p.sec_seq > h.sec_seq and p.level <= h.level), 1000000000) as end_seq from heads h),
walk as (select document_id, sec_seq, title as path from linked where parent_seq = 0
  union all select l.document_id, l.sec_seq, w.path || ' > ' || l.title from linked l join walk w on l.document_id = w.document_id and l.parent_seq = w.sec_seq),
own as (select document_id, sec_seq, page from heads union all select document_id, sec_seq, page from els where sec_seq > 0),
secs as (select l.document_id, l.sec_seq, 's' || l.sec_seq as sec_id, l.title, l.level, w.path, l.parent_seq, min(o.page) as page_lo, max(o.page) as page_hi
  from linked l join walk w using (document_id, sec_seq) join own o on o.document_id = l.document_id and o.sec_seq >= l.sec_seq and o.sec_seq < l.end_seq group by all)"""
)

BOXES = """
boxes as (select cast(l_suppkey as varchar) as document_id, cast(l_linenumber as int) as page, row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey, l_partkey) as pos,
  l_orderkey || '-' || l_partkey || '-' || l_linenumber as id, case l_returnflag when 'R' then 'table' when 'A' then 'image' else 'text' end as kind,
  cast(l_quantity as double) as x, cast(l_discount as double) * 400 as y, cast(l_tax as double) * 100 + 8 as h, case when l_partkey % 3 = 0 then 600 else 612 end as page_width from lineitem)"""

PIPES = """
numbered as (select *, row_number() over (partition by p_brand order by p_partkey) as n from part),
pipes as (select p_brand as document_id, cast((n - 1) // 10 as int) as tbl_seq, cast((n - 1) // 10 + 1 as int) as page,
  '| key | part name | size |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' | ' || p_size || ' |', chr(10) order by n) as markdown,
  case when (n - 1) // 10 % 3 = 0 then 'stream' else 'lattice' end as flavor from numbered group by 1, 2, 3, 5)"""

#: Short ids and dates in four spellings, by arithmetic on doc_id.
MONTH_LIST = "['January','February','March','April','May','June','July','August','September','October','November','December']"
DATED = f"""
dated as (select doc_id, case doc_id % 4 when 0 then m || ' ' || (2000 + doc_id % 30) when 1 then left(m, 3) || '-' || (10 + doc_id % 20) when 2 then (2000 + doc_id % 30) || '-' || (doc_id % 12 + 1) || '-' || (doc_id % 28 + 1)
  else (doc_id % 12 + 1) || '/' || (2000 + doc_id % 30) end as s, text from (select doc_id, text, {MONTH_LIST}[cast(doc_id % 12 + 1 as int)] as m from documents))"""


def suspicious(source: str, keys: str) -> str:
    """CTEs that end in `suspect`, the keys of the source's texts with suspicious repeats."""
    return f"""
letters as (select {keys}, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from {source} where text <> ''),
inked as (select * from letters where not regexp_matches(c, '\\s')),
runs as (select {keys} from (select *, i - row_number() over (partition by {keys}, c order by i) as g from inked) group by {keys}, c, g having count(*) >= 10),
dense as (select {keys} from inked group by {keys} having count(*) >= 8 and count(distinct c) <= 2),
often as (select {keys} from (select {keys}, w, count(*) as n from (select {keys}, unnest(regexp_extract_all(text, '[\\pL\\pM\\p{{Nd}}\\p{{Pc}}]{{3,}}')) as w from {source}) group by all) group by {keys} having sum(n) >= 12 and max(n) >= 0.5 * sum(n)),
suspect as (select * from runs union select * from dense union select * from often)"""
