"""What DuckDB answers to the same questions: the views as common tables, then a query for each operator."""

from __future__ import annotations

NOW = "timestamp '2024-01-31 00:00:00'"
#: The tables' accented letters. DuckDB's levenshtein counts bytes, so its texts have control characters, which no text holds, in their place.
ACCENTS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
CONTROLS = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)])


def _bytes(text: str) -> str:
    return rf"regexp_replace(translate({text}, '{ACCENTS}', {CONTROLS}), '[^\x00-\x7F]', '?', 'g')"


FONT = ("font_name", "family", "style", "size", "encoding", "embedded", "usage")


def _keyed(rows: str) -> str:
    """Keyed values of both sides of every pair, where they differ, as {rows}_diff."""
    side = lambda s: f"(select pair_id, key, value from pairs join {rows} on doc_id = {s}_id)"
    change = "case when b.value is null then 'added' when c.value is null then 'deleted' else 'modified' end"
    return f"{rows}_diff as (select pair_id, key, b.value as base_value, c.value as compare_value, {change} as change from {side('base')} b full join {side('compare')} c using (pair_id, key) where b.value is distinct from c.value)"


VIEWS = r"""
with doc_lines as (select doc_id, i as para_no, a[i] as para from (select doc_id, a, unnest(generate_series(1, len(a))) as i from (
    select doc_id, regexp_split_to_array(text, '\r\n|\n|\r') as a from documents)) where a[i] <> ''),
wrapped as (select doc_id, row_number() over (partition by doc_id order by para_no, k) - 1 as n, substring(para, k * 80 + 1, 80) as text
    from (select doc_id, para_no, para, unnest(generate_series(0, (length(para) - 1) // 80)) as k from doc_lines)),
page_lines as (select doc_id, n // 20 + 1 as page_no, n % 20 + 1 as line_no, text from wrapped),
doc_pages as (select doc_id, max(page_no) as page_count from page_lines group by doc_id),
line_keys as (select distinct doc_id, para from doc_lines where length(para) > 20),
held as (select doc_id, para, count(*) over (partition by para) as n from line_keys),
texts as (select distinct doc_id, md5(text) as k from documents where doc_id in (select doc_id from doc_lines)),
linked as (select a.doc_id as base_id, b.doc_id as compare_id, false as copy from held a join held b on a.para = b.para and a.doc_id < b.doc_id where a.n <= 20
    union all select doc_id, lead(doc_id) over (partition by para order by doc_id), false from held where n > 20
    union all select doc_id, lead(doc_id) over (partition by k order by doc_id), true from texts),
scored as (select base_id, compare_id, count(*) as shared, max(copy) as copy from linked where compare_id is not null group by all),
pairs as (select base_id as pair_id, base_id, compare_id from (select *, row_number() over (partition by base_id order by copy desc, shared desc, compare_id) as rn from scored) where rn = 1),
words as (select doc_id, page_no, line_no, i as w, a[i] as word from (select doc_id, page_no, line_no, a, unnest(generate_series(1, len(a))) as i from (select *, string_split(text, ' ') as a from page_lines)) where a[i] <> ''),
elements as (select doc_id, page_no, line_no as true_line, row_number() over (partition by doc_id, page_no order by line_no, w) as elem_no, word as text, cast(72 + 6 * (w - 1) * 8 as double) as x, cast(792 - 14 * line_no as double) as y,
    cast(6 * length(word) as double) as width, cast(12 as double) as height, case when w % 7 = 0 then 'Courier' when line_no = 1 then 'Helvetica-Bold' else 'Times' end as font_name, cast(case when line_no = 1 then 14 else 10 end as double) as font_size from words),
grid_px as (select vec_id // 4 as img_id, pos % 8 + 8 * (vec_id % 2) as x, pos // 8 + 8 * ((vec_id // 2) % 2) as y, cast(round((v + 1) * 127.5) as bigint) as lum
    from (select vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as v from embeddings)),
image_pages as (select distinct img_id, img_id // 10 as pair_id, img_id % 10 + 1 as page_no from grid_px),
base_px as (select i.pair_id, i.page_no, g.x, g.y, case when i.page_no % 4 = 2 then least(255, g.lum + (g.x + g.y) % 17) else g.lum end as lum
    from image_pages i join grid_px g on g.img_id = case when i.page_no % 4 = 2 then i.img_id - 1 else i.img_id end),
compare_px as (select pair_id, case when pair_id % 2 = 1 then page_no % 10 + 1 else page_no end as page_no, x, y,
    case when page_no % 5 = 0 then 255 - lum when page_no % 3 = 0 then least(255, lum + (x * 7 + y * 13) % 29) else lum end as lum from base_px where not (pair_id % 4 = 3 and page_no = 10)),
jobs as (select event_id as job_id, user_id as base_id, (user_id + 7) % 150 as compare_id, ts as created_at, ts + to_microseconds(cast(round(value * 1000000) as bigint)) as updated_at,
    case event_type when 'view' then 'PENDING' when 'click' then 'PROCESSING' when 'purchase' then 'COMPLETED' when 'error' then 'FAILED' else 'CANCELLED' end as status, event_id % 3 = 0 as has_result from events),
metrics as (select event_id, concat('engine.', event_type, '.', cast(user_id % 4 as varchar)) as operation_type, case when value < 10 then 'tiny' when value < 30 then 'small' when value < 80 then 'medium' when value < 200 then 'large' else 'very_large' end as size_category,
    value as total_time_ms, ts from events),
doc_meta as (select page_id as doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html lang="([a-z]*)"', 1) as lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) as charset, regexp_extract(html, '<style>([^<]*)</style>', 1) as style, length(html) as n_chars from pages),
side_b as (select pair_id, page_no, list(distinct text) as lines from pairs join page_lines on doc_id = base_id group by all),
side_c as (select pair_id, page_no, list(distinct text) as lines from pairs join page_lines on doc_id = compare_id group by all),
page_pairs as (select coalesce(b.pair_id, c.pair_id) as pair_id, b.page_no as base_page, c.page_no as compare_page, b.page_no is not null and c.page_no is not null as matched,
    case when b.page_no is not null and c.page_no is not null then round(len(list_intersect(b.lines, c.lines)) / len(list_distinct(list_concat(b.lines, c.lines))), 6) else 0.0 end as score
    from side_b b full join side_c c on b.pair_id = c.pair_id and b.page_no = c.page_no),
lb as (select p.pair_id, base_page, compare_page, line_no, text from page_pairs p join pairs using (pair_id) join page_lines l on l.doc_id = base_id and l.page_no = base_page where matched),
lc as (select p.pair_id, base_page, compare_page, line_no, text from page_pairs p join pairs using (pair_id) join page_lines l on l.doc_id = compare_id and l.page_no = compare_page where matched),
line_pairs as (select coalesce(b.pair_id, c.pair_id) as pair_id, coalesce(b.base_page, c.base_page) as base_page, coalesce(b.compare_page, c.compare_page) as compare_page, coalesce(b.line_no, c.line_no) as line_no, b.text as base_text, c.text as compare_text
    from lb b full join lc c on b.pair_id = c.pair_id and b.base_page = c.base_page and b.line_no = c.line_no),
measured as (select *, levenshtein(""" + _bytes("base_text") + ", " + _bytes("compare_text") + r""") as distance, greatest(length(base_text), length(compare_text)) as longer from line_pairs),
judged as (select *, case when base_text is null then 'added' when compare_text is null then 'deleted' when (longer - distance) / longer < 0.8 then 'modified' end as change,
    case when base_text is null or compare_text is null then case when length(coalesce(base_text, compare_text)) > 50 then 'major' else 'minor' end
         when distance > 0.5 * length(base_text) then 'major' when distance > 0.2 * length(base_text) then 'minor' else 'cosmetic' end as severity from measured),
diffs as (select *, sha256(concat_ws('|', pair_id, base_page, compare_page, 'text', line_no)) as diff_id, 'text' as type,
    case when base_text is not null then 72.0::double end as base_x, case when base_text is not null then (792 - 14 * line_no)::double end as base_y, (6 * length(base_text))::double as base_width, case when base_text is not null then 12.0::double end as base_height,
    case when compare_text is not null then 72.0::double end as compare_x, case when compare_text is not null then (792 - 14 * line_no)::double end as compare_y, (6 * length(compare_text))::double as compare_width, case when compare_text is not null then 12.0::double end as compare_height
    from judged where change is not null),
totals as (select p.pair_id, count(d.diff_id) as total from pairs p left join diffs d using (pair_id) group by all),
similarity as (select pair_id, round(coalesce(count(*) filter (matched) / greatest(count(base_page), count(compare_page)) * coalesce(avg(score) filter (matched), 0), 0), 6) as similarity from page_pairs group by all),
page_counts as (select pair_id, count(*) as pages, count(*) filter (matched) as matched, count(*) filter (not matched) as unmatched, coalesce(max(different), 0) as different
    from page_pairs left join (select pair_id, count(distinct base_page) as different from diffs group by all) using (pair_id) group by all),
bp as (select distinct pair_id, page_no from base_px), cp as (select distinct pair_id, page_no from compare_px),
every as (select pair_id, b.page_no as base_page, c.page_no as compare_page from bp b join cp c using (pair_id)),
pix as (select e.*, b.x, b.y, b.lum as l1, c.lum as l2 from every e join base_px b on b.pair_id = e.pair_id and b.page_no = e.base_page join compare_px c on c.pair_id = e.pair_id and c.page_no = e.compare_page and c.x = b.x and c.y = b.y),
quick as (select pair_id, base_page, compare_page, round(avg(case when 3 * abs(l1 - l2) < 50 then 1.0::double else 0 end), 6) as quick from pix group by all),
wins as (select pair_id, base_page, compare_page, wx, wy, avg(l1) as m1, avg(l2) as m2, var_pop(l1) as v1, var_pop(l2) as v2, covar_pop(l1, l2) as cv, max(abs(l1 - l2)) as far
    from pix join quick q using (pair_id, base_page, compare_page), unnest(generate_series(0, 8)) as a(wx), unnest(generate_series(0, 8)) as b(wy)
    where q.quick between 0.1 and 0.95 and x between wx and wx + 7 and y between wy and wy + 7 group by all),
sims as (select pair_id, base_page, compare_page, round(avg(case when far < 1e-6 then 1.0 else greatest(0, least(1, ((2 * m1 * m2 + 6.5025) * (2 * cv + 58.5225)) / ((m1 * m1 + m2 * m2 + 6.5025) * (v1 + v2 + 58.5225)))) end), 6) as ssim from wins group by all),
scores as (select q.pair_id, q.base_page, q.compare_page, coalesce(ssim, quick) as score, case when ssim is null then 'quick' else 'ssim' end as score_kind from quick q left join sims using (pair_id, base_page, compare_page)),
same as (select * from scores where base_page = compare_page),
ub as (select * from bp where (pair_id, page_no) not in (select (pair_id, base_page) from same where score >= 0.7)),
uc as (select * from cp where (pair_id, page_no) not in (select (pair_id, compare_page) from same where score >= 0.7)),
near as (select pair_id, b.page_no as base_page, c.page_no as compare_page from ub b join uc c using (pair_id) where abs(b.page_no - c.page_no) between 1 and 10),
edges0 as (select pair_id, base_page, compare_page, score from scores where score >= 0.7),
smart0 as (select * from edges0 where base_page = compare_page union select e.* from edges0 e join near using (pair_id, base_page, compare_page)),
fonts as (select doc_id, page_no, font_name, count(*) as usage, max(font_size) as size, regexp_extract(font_name, '^([^-]*)', 1) as family, case when contains(font_name, '-') then regexp_extract(font_name, '-(.*)$', 1) else 'Regular' end as style from elements group by all),
named as (select doc_id, page_no, font_name as font, case when font_name = 'Times' and doc_id % 5 = 0 then 'Georgia' when font_name = 'Helvetica-Bold' and doc_id % 3 = 0 then 'Helvetica-Oblique' else font_name end as font_name, usage, size from fonts),
faces as (select doc_id, page_no, font, font_name, regexp_extract(font_name, '^([^-]*)', 1) as family, case when contains(font_name, '-') then regexp_extract(font_name, '-(.*)$', 1) else 'Regular' end as style, size, case when doc_id % 7 = 0 then 'MacRoman' else 'WinAnsi' end as encoding, doc_id % 6 > 0 as embedded, usage from named),
fb as (select p.pair_id, base_page, compare_page, f.* exclude (doc_id, page_no) from page_pairs p join pairs using (pair_id) join faces f on f.doc_id = base_id and f.page_no = base_page where matched),
fc as (select p.pair_id, base_page, compare_page, f.* exclude (doc_id, page_no) from page_pairs p join pairs using (pair_id) join faces f on f.doc_id = compare_id and f.page_no = compare_page where matched),
font_diff as (select pair_id, base_page, compare_page, font, """ + ", ".join(f"{s}.{c} as {n}_{c}" for s, n in (("b", "base"), ("c", "compare")) for c in FONT) + r""", case when b.font_name is null then 'added' when c.font_name is null then 'deleted' else 'modified' end as change
    from fb b full join fc c using (pair_id, base_page, compare_page, font) where (""" + ", ".join(f"b.{c}" for c in FONT) + ") is distinct from (" + ", ".join(f"c.{c}" for c in FONT) + r""")),
font_graded as (select *, case when change <> 'modified' then 'major' when base_family <> compare_family then 'major' when base_style <> compare_style then 'minor' else 'cosmetic' end as severity,
    case change when 'added' then 'Font added: ' || compare_font_name when 'deleted' then 'Font deleted: ' || base_font_name else 'Font modified: ' || base_font_name || ' to ' || compare_font_name end as description from font_diff),
titles as (select doc_id, arg_min(para, para_no)[1:40] as title from doc_lines group by all),
info as (select d.doc_id, title, source as author, lang as subject, case when d.doc_id % 4 = 0 then lang || ', ' || source end as keywords, case when d.doc_id % 3 > 0 then 'editor ' || d.doc_id % 3 end as creator, case when d.doc_id % 2 = 0 then 'docdelta' end as producer,
    '2024-01-' || lpad(cast(d.doc_id % 28 + 1 as varchar), 2, '0') as created, case when d.doc_id % 5 > 0 then '2024-02-' || lpad(cast(d.doc_id % 28 + 1 as varchar), 2, '0') end as changed, coalesce(page_count, 0) as page_count, coalesce(strlen(text), 0) as size, d.doc_id % 11 = 0 as encrypted
    from documents d left join titles using (doc_id) left join doc_pages using (doc_id)),
meta as (select doc_id, k as key, v as value from (select doc_id, unnest(['Title', 'Author', 'Subject', 'Keywords', 'Creator', 'Producer', 'Creation Date', 'Modification Date', 'Page Count', 'File Size', 'Encrypted']) as k,
    unnest([title, author, subject, keywords, creator, producer, created, changed, cast(page_count as varchar), case when size < 1024 then size || ' B' when size < 1048576 then printf('%.2f', round(size / 1024.0, 2)) || ' KB' else printf('%.2f', round(size / 1048576.0, 2)) || ' MB' end, cast(encrypted as varchar)]) as v from info) where v is not null),
sheets as (select doc_id, 'color' as key, 'c' || doc_id % 3 as value from documents union all select doc_id, case when doc_id % 4 = 0 then 'size' else 'font' end, cast(doc_id % 5 as varchar) from documents),
""" + _keyed("meta") + ",\n" + _keyed("sheets") + r""",
img as (select img_id as i, o, x, y, case when o = 1 and (x + y) % 23 = 0 then least(255, lum + 40) else lum end as lum from grid_px, (values (0), (1)) as t(o) where img_id < 5),
ipx as (select a.i as ai, a.o as ao, b.i as bi, b.o as bo, x, y, a.lum as l1, b.lum as l2 from img a join img b using (x, y)),
iquick as (select ai, ao, bi, bo, round(avg(case when 3 * abs(l1 - l2) < 50 then 1.0::double else 0 end), 6) as quick, bool_and(l1 = l2 or x % 3 > 0 or y % 3 > 0) as exact from ipx group by all),
iwin as (select ai, ao, bi, bo, wx, wy, avg(l1) as m1, avg(l2) as m2, var_pop(l1) as v1, var_pop(l2) as v2, covar_pop(l1, l2) as cv, max(abs(l1 - l2)) as far from ipx, unnest(generate_series(0, 8)) as a(wx), unnest(generate_series(0, 8)) as b(wy) where x between wx and wx + 7 and y between wy and wy + 7 group by all),
issim as (select ai, ao, bi, bo, round(avg(case when far < 1e-6 then 1.0 else greatest(0, least(1, ((2 * m1 * m2 + 6.5025) * (2 * cv + 58.5225)) / ((m1 * m1 + m2 * m2 + 6.5025) * (v1 + v2 + 58.5225)))) end), 6) as ssim from iwin group by all),
seen as (select p.pair_id, base_page, compare_page, p.score as content, exact, case when quick between 0.1 and 0.95 then ssim else quick end as visual from page_pairs p join pairs using (pair_id)
    join iquick q on q.ai = (base_id // 2 + base_page) % 5 and q.ao = base_id % 2 and q.bi = (compare_id // 2 + compare_page) % 5 and q.bo = compare_id % 2 join issim s on s.ai = q.ai and s.ao = q.ao and s.bi = q.bi and s.bo = q.bo where matched),
image_found as (select pair_id, base_page, compare_page, 'modified' as change, case when visual < 0.7 then 'major' when visual < 0.9 then 'minor' else 'cosmetic' end as severity from seen where not exact and visual > 0.95 and visual < 1
    union all select pair_id, base_page, compare_page, unnest(['deleted', 'added']), 'major' from seen where not exact and visual <= 0.95),
five as (select pair_id, diff_id, type, change, severity, base_page, compare_page, line_no, null::varchar as name, base_text, compare_text, null::varchar as description, base_x, base_y, base_width, base_height, compare_x, compare_y, compare_width, compare_height,
    coalesce((base_x + compare_x) / 2, base_x, compare_x) as x, coalesce((base_y + compare_y) / 2, base_y, compare_y) as y, greatest(base_width, compare_width) as width, greatest(base_height, compare_height) as height from diffs
    union all by name select pair_id, sha256(concat_ws('|', pair_id, base_page, compare_page, 'image', change || ' 1')) as diff_id, 'image' as type, change, severity, base_page, compare_page, 'image 1' as name, 72.0::double as x, 600.0::double as y, 96.0::double as width, 96.0::double as height from image_found
    union all by name select pair_id, sha256(concat_ws('|', pair_id, base_page, compare_page, 'font', font)) as diff_id, 'font' as type, change, severity, base_page, compare_page, coalesce(compare_font_name, base_font_name) as name, description from font_graded
    union all by name select pair_id, sha256(concat_ws('|', pair_id, 'metadata', key)) as diff_id, 'metadata' as type, change, 'minor' as severity, key as name from meta_diff
    union all by name select pair_id, sha256(concat_ws('|', pair_id, 'style', key)) as diff_id, 'style' as type, change, 'cosmetic' as severity, key as name from sheets_diff),
boxed as (select * from five where type = 'text')
"""



def _rounds(edges: str, n: int = 4) -> str:
    """Common tables k (kept edges) of n unrolled rounds of locally dominant matching."""
    out = f", r0 as materialized (select pair_id, base_page, compare_page, score from {edges})"
    for i in range(n):
        order = "score desc, abs(base_page - compare_page), base_page, compare_page"
        out += f"""
, k{i} as materialized (select pair_id, base_page, compare_page, score from (select *, row_number() over (partition by pair_id, base_page order by {order}) as rb, row_number() over (partition by pair_id, compare_page order by {order}) as rc from r{i}) where rb = 1 and rc = 1)
, r{i + 1} as materialized (select * from r{i} where (pair_id, base_page) not in (select (pair_id, base_page) from k{i}) and (pair_id, compare_page) not in (select (pair_id, compare_page) from k{i}))"""
    return out + "\n, k as (" + " union all ".join(f"select * from k{i}" for i in range(n)) + ")"


LEFT = """select pair_id, page_no as base_page, null::bigint as compare_page from bp where (pair_id, page_no) not in (select (pair_id, base_page) from k)
union all select pair_id, null, page_no from cp where (pair_id, page_no) not in (select (pair_id, compare_page) from k)"""
SIGN = """, sign_b as (select pair_id, page_no, '16x16_' || string_agg(cast(lum as varchar), ',' order by y, x) as signature from base_px where x % 3 = 0 and y % 3 = 0 group by all)
, sign_c as (select pair_id, page_no, '16x16_' || string_agg(cast(lum as varchar), ',' order by y, x) as signature from compare_px where x % 3 = 0 and y % 3 = 0 group by all)
, exact as (select b.pair_id, b.page_no as base_page, c.page_no as compare_page, 1.0::double as score from (select *, row_number() over (partition by pair_id, signature order by page_no) as n from sign_b) b
    join (select *, row_number() over (partition by pair_id, signature order by page_no) as n from sign_c) c using (pair_id, signature, n))
, image_edges as (select * exclude (score_kind) from scores where score > 0.95 and (pair_id, base_page) not in (select (pair_id, base_page) from exact) and (pair_id, compare_page) not in (select (pair_id, compare_page) from exact))"""
IMAGES = (
    SIGN
    + _rounds("image_edges")
    + """
, image_diff as (select pair_id, base_page, compare_page, score, 'modified' as change, case when score < 0.7 then 'major' when score < 0.9 then 'minor' else 'cosmetic' end as severity from k where score < 1
  union all select pair_id, page_no, null, null, 'deleted', 'major' from bp where (pair_id, page_no) not in (select (pair_id, base_page) from k) and (pair_id, page_no) not in (select (pair_id, base_page) from exact)
  union all select pair_id, null, page_no, null, 'added', 'major' from cp where (pair_id, page_no) not in (select (pair_id, compare_page) from k) and (pair_id, page_no) not in (select (pair_id, compare_page) from exact))"""
)
SEVEN = "pair_id, base_page, line_no, change, severity"
BOX = "diff_id, x, y, width, height"
ASKED = ", asked as (select pair_id, unnest([1, 2, 9])::bigint as page_no from pairs)"
SUMMARY = """select p.pair_id, pages, matched, round(coalesce(matched / longest, 0) * coalesce(mean, 0), 6) as similarity, round(matched / pages * coalesce(mean, 0), 6) as confidence, coalesce(total, 0) as total, coalesce(different, 0) as different,
    coalesce(n_major, 0) as n_major, coalesce(n_minor, 0) as n_minor, coalesce(n_cosmetic, 0) as n_cosmetic
    from pairs p left join (select pair_id, count(*) as pages, count(*) filter (matched) as matched, greatest(count(base_page), count(compare_page)) as longest, avg(score) filter (matched) as mean from page_pairs group by all) using (pair_id)
    left join (select pair_id, count(*) as total, count(distinct base_page) as different, count(*) filter (severity = 'major') as n_major, count(*) filter (severity = 'minor') as n_minor, count(*) filter (severity = 'cosmetic') as n_cosmetic from diffs group by all) using (pair_id)"""
LABEL = "case when {0} >= 0.95 then 'Excellent Match' when {0} >= 0.85 then 'Good Match' when {0} >= 0.7 then 'Fair Match' when {0} >= 0.5 then 'Possible Match' when {0} > 0 then 'Poor Match' else 'No Match' end"
NAMES = ", names as (select page_id, url || case when page_id % 3 = 0 then '.PDF' else '.html' end as name, length(html) as size from pages)"
SMART = _rounds("smart0")


def _bar(c: str) -> str:
    return f"round(case when {c} = 0 then 0.0 else least(100.0, greatest(5.0, {c} * 100.0 / greatest(total, 1)))::double end, 6)"


def _ssim(source: str, wx: int, wy: int) -> str:
    """Structural similarity of equal page numbers; windows of 8 by 8, or the whole of a smaller image."""
    return f""", p as ({source}), w as (select pair_id, page_no, wx, wy, avg(l1) as m1, avg(l2) as m2, var_pop(l1) as v1, var_pop(l2) as v2, covar_pop(l1, l2) as cv, max(abs(l1 - l2)) as far
    from p, unnest(generate_series(0, {wx})) as a(wx), unnest(generate_series(0, {wy})) as b(wy) where x between wx and wx + 7 and y between wy and wy + 7 group by all)
    select pair_id, page_no, round(avg(case when far < 1e-6 then 1.0 else greatest(0, least(1, ((2 * m1 * m2 + 6.5025) * (2 * cv + 58.5225)) / ((m1 * m1 + m2 * m2 + 6.5025) * (v1 + v2 + 58.5225)))) end), 6) as ssim from w group by all"""


SAME_PIX = "select b.pair_id, b.page_no, b.x, b.y, b.lum as l1, c.lum as l2 from base_px b join compare_px c using (pair_id, page_no, x, y)"
ESTIMATED = "case when change = 'added' then length(compare_text) when change = 'deleted' then length(base_text) else longer end"
METHOD = {"exact": "coalesce(base_text, '') <> coalesce(compare_text, '')", "smart": r"regexp_replace(coalesce(base_text, ''), '\s+', '', 'g') <> regexp_replace(coalesce(compare_text, ''), '\s+', '', 'g')"}
FUZZY = {"strict": METHOD["exact"], "normal": "change is not null", "relaxed": "change is not null"}
MAJOR = "severity = 'major'"
METHODS = " union all ".join(
    f"select '{m}' as method, '{t}' as threshold, pair_id, count(*) as n from judged where ({FUZZY[t] if m == 'fuzzy' else METHOD[m]}) and {MAJOR if t == 'relaxed' else 'true'} group by pair_id" for m in ("exact", "smart", "fuzzy") for t in ("strict", "normal", "relaxed")
)



def _image_box(rule: str, none: tuple[str, str, str, str], least: tuple[str, str, str, str], changed: tuple[str, str, str, str]) -> str:
    """One of the two rules for the box of an image: what stands for nothing, for a part of a side, and for a modified one."""
    out = []
    for n, free, part, both in zip(("x", "y", "width", "height"), none, least, changed, strict=True):
        b, c = f"coalesce(base_{n}, 0)", f"coalesce(compare_{n}, 0)"
        own = "({} > 0)"
        mixed = f"({b} + {c}) / 2" if n in "xy" else f"greatest({b}, {c})"
        wide = {t: own.format(f"coalesce({t}_width, 0)") for t in ("base", "compare")}
        side = lambda t, v: f"when change = '{'added' if t == 'compare' else 'deleted'}' and ({wide[t]} or '{rule}' = 'model') then case when {v} > 0 then {v} else {part} end"  # noqa: E731, B023
        out.append(f"case {side('compare', c)} {side('base', b)} when change <> 'modified' then {free} when {wide['base']} and {wide['compare']} then {mixed} when {wide['base']} then {b} when {wide['compare']} then {c} else {both} end::double as {n}")
    return f"select diff_id, '{rule}' as rule, {', '.join(out)} from sized"




def _side(s: str) -> str:
    """Font, size, colour and place of a side's line, as text: they follow from document and line."""
    values = {"font": f"case when line_no = 1 then 'Helvetica-Bold' when {s}_id % 5 = 0 then 'Georgia' else 'Times' end", "font_size": f"(case when line_no = 1 then 14 when {s}_id % 3 = 0 then 11 else 10 end)::double",
        "color": f"case when {s}_id % 4 = 0 then 'navy' else 'black' end", "x": f"(72 + 15 * ({s}_id % 3))::double", "y": "(792 - 14 * line_no)::double", "width": f"(6 * length({s}_text))::double", "height": "12.0::double"}
    return ", ".join(f"case when {s}_text is not null then {v} end as {s}_{n}" for n, v in values.items())


def _attributed(rows: str) -> str:
    own = ", diff_id" if rows == "diffs" else ""
    return f", attributed as (select pair_id, base_page, compare_page, line_no, base_text, compare_text, change{own}, {_side('base')}, {_side('compare')} from {rows} join pairs using (pair_id))"


_short = lambda c, n: f"case when length({c}) > {n} then {c}[1:{n}] || '...' else {c} end"
_MADE = f"""case type when 'text' then case when base_text is not null and compare_text is not null then 'Text changed from "' || {_short('base_text', 15)} || '" to "' || {_short('compare_text', 15)} || '"' when compare_text is not null then 'Text added: "' || {_short('compare_text', 30)} || '"' else 'Text deleted: "' || {_short('base_text', 30)} || '"' end
    when 'image' then case change when 'modified' then 'Image changed' when 'added' then 'Image added' when 'deleted' then 'Image deleted' else 'Image: ' || name end when 'font' then 'Font changed to "' || name || '"' when 'style' then 'Style element ' || coalesce(change, 'changed') || ': "' || name || '"' else 'Difference detected' end"""
DESCRIBE = f"select diff_id, 'own' as form, coalesce(description, {_MADE}) as description from five union all select diff_id, 'bare' as form, {_MADE} from (select * replace (case when pair_id % 3 > 0 then change end as change) from five)"
_counted = lambda name, rows, synthetic="0": f"select '{name}' as options, pair_id, type, count(*) as n, {synthetic}::bigint as synthetic from {rows} group by pair_id, type"
COMPARE_OPTIONS = (
    ", forced_pages as (select pair_id from page_pairs where matched and score < 0.98), forced as (select pair_id, 'text' as type from forced_pages union all select distinct pair_id, 'text' from page_pairs where matched and pair_id not in (select pair_id from forced_pages)) "
    + " union all ".join([
        _counted("all", "five"), _counted("strict text", "(select pair_id, 'text' as type from line_pairs where base_text is distinct from compare_text)"),
        _counted("relaxed text, fonts", "(select pair_id, type from five where type = 'font' or type = 'text' and severity = 'major')"), _counted("no text", "(select * from five where type <> 'text')"), _counted("forced", "forced", "count(*)"),
    ])
)
ESCAPED = "replace(replace(replace(replace(coalesce(cast({} as varchar), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_LAST = 2**31 - 1
_HEAD = ", head as (select p.pair_id, base_id, compare_id, count(diff_id) as total from pairs p left join five using (pair_id) group by all)"
_json = lambda *cs: "to_json({" + ", ".join(f"'{c}': {c}" for c in cs) + "})"
REPORT_JSON = _HEAD + f""", items as (select pair_id, coalesce(base_page, compare_page, 0) as page, concat_ws('|', lpad(cast(line_no as varchar), 10, '0'), diff_id) as place, {_json('diff_id', 'type', 'change', 'severity', 'base_page', 'compare_page', 'line_no', 'name')} as item from five)
    select pair_id, -10 as page, 0 as section, '' as place, '{{"pair_id":' || pair_id || ',"base_id":' || base_id || ',"compare_id":' || compare_id || ',"total":' || total || ',"differences":[' as line from head
    union all select pair_id, page, 3, place, case when row_number() over (partition by pair_id order by page, place) = 1 then '' else ',' end || item from items
    union all select pair_id, {_LAST}, 9, '', ']}}' from head"""
REPORT_HTML = _HEAD + f""", fm as (select * from five where type <> 'metadata' and type <> 'style')
    select pair_id, -10 as page, 0 as section, '' as place, '<!DOCTYPE html><html><body><h1>Comparison Summary</h1><p>pair_id: ' || pair_id || '</p><p>base_id: ' || base_id || '</p><p>compare_id: ' || compare_id || '</p><p>total: ' || total || '</p><h2>Detailed Differences</h2>' as line from head
    union all select pair_id, -9, 1, key, '<p>Key: ' || {ESCAPED.format('key')} || ' Base Value: ' || {ESCAPED.format('base_value')} || ' Comparison Value: ' || {ESCAPED.format('compare_value')} || '</p>' from meta_diff
    union all select pair_id, coalesce(base_page, compare_page), 2, '', '<h3>Page ' || coalesce(base_page, compare_page) || '</h3>' || case when compare_page is null then 'Page exists only in base document' when base_page is null then 'Page exists only in comparison document' else '' end from page_pairs
    union all select pair_id, base_page, 3, concat_ws('|', type, lpad(cast(line_no as varchar), 10, '0'), diff_id), '<tr><td>' || type || '</td><td>' || change || '</td><td>' || severity || '</td><td>' || {ESCAPED.format('name')} || '</td><td>' || {ESCAPED.format('base_text')} || '</td><td>' || {ESCAPED.format('compare_text')} || '</td></tr>' from fm
    union all select pair_id, {_LAST}, 9, '', '</body></html>' from head"""
_cut_width = lambda t, k: f"case when line_no % 4 not in ({k}, 2) then {t}_width end as {t}_width"
IMAGE_BOXES = f", sized as (select * replace ({_cut_width('base', 0)}, {_cut_width('compare', 1)}) from diffs) " + _image_box("service", ("50", "50", "400", "300"), ("0", "0", "400", "300"), ("0", "0", "400", "300")) + " union all " + _image_box("model", ("100",) * 4, ("100",) * 4, ("100",) * 4)

_QUERIES = {
    "page_lines": "select * from page_lines",
    "result_exists": "select job_id as pair_id, has_result as exists from jobs",
    "retention": f"select job_id, status from jobs where status in ('COMPLETED', 'FAILED') and updated_at < {NOW} - interval 24 hour",
    "content_hash": "select doc_id, md5(text) as content_hash from documents",
    "dedupe_documents": "select doc_id, min(doc_id) over (partition by md5(text)) as canonical_id, doc_id <> min(doc_id) over (partition by md5(text)) as reused from documents",
    "lookup_by_hash": "select doc_id, md5(text) as content_hash from documents ",
    "metadata_rows": "select * from meta",
    "file_labels": NAMES + " select page_id, lower(regexp_extract(name, '\\.([^.]*)$', 1)) as extension, case when size < 1024 then size || ' B' else printf('%.2f', round(size / 1024.0, 2)) || ' KB' end as label from names",
    "format_dates": "select job_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created from jobs",
    "reused_flag": f"select job_id, created_at < {NOW} - interval 1 minute as reused from jobs",
    "validate_documents": NAMES + " select page_id, case when size = 0 then 'empty file' when page_id % 3 <> 0 then 'not a PDF' when page_id % 7 < 1 or page_id % 7 > 5 then 'no such page' end as reject_reason from names",
    "catalog_counts": "select (select count(*) from documents) as documents, (select count(*) from jobs) as comparisons",
    "group_lines": "select doc_id, page_no, dense_rank() over (partition by doc_id, page_no order by true_line) as line_no, elem_no from elements",
    "line_boxes": "select doc_id, page_no, line_no, string_agg(text, ' ' order by x) as text, min(x) as x, min(y) as y, max(x + width) - min(x) as width, max(y + height) - min(y) as height from (select *, dense_rank() over (partition by doc_id, page_no order by true_line) as line_no from elements) group by all",
    "page_text": "select p.doc_id, p.page_no, coalesce(t, '[Page ' || p.page_no || ' text]') as text from (select doc_id, unnest(generate_series(1, page_count + 1)) as page_no from doc_pages) p left join (select doc_id, page_no, string_agg(text, chr(10) order by line_no) as t from page_lines group by all) using (doc_id, page_no)",
    "pair_lines": "select * from line_pairs",
    "line_added_deleted": f"select {SEVEN} from diffs where change <> 'modified'",
    "line_modified": f"select {SEVEN} from diffs where change = 'modified'",
    "text_similarity": "select pair_id, base_page, line_no, round((longer - distance) / longer, 6) as similarity from measured where distance is not null",
    "edit_distance": "select pair_id, base_page, line_no, distance from measured where distance is not null",
    "text_severity": "select pair_id, base_page, line_no, severity from judged where distance is not null",
    "text_diff": f"select diff_id, {SEVEN}, base_text, compare_text from diffs",
    "text_boxes": f"select {BOX} from boxed",
    "text_box_defaults": ", d as (select * replace (case when line_no % 3 <> 0 then base_x end as base_x) from diffs), v as (select *, case when change = 'added' and compare_x > 0 then 'c' when change = 'deleted' and base_x > 0 then 'b' when change = 'modified' and base_x > 0 and compare_x > 0 then 'm' when change = 'modified' and base_x > 0 then 'b' when change = 'modified' and compare_x > 0 then 'c' end as s from d) select diff_id, coalesce(case s when 'c' then compare_x when 'b' then base_x when 'm' then (base_x + compare_x) / 2 end, 100) as x, coalesce(case s when 'c' then compare_y when 'b' then base_y when 'm' then (base_y + compare_y) / 2 end, 100) as y, case when coalesce(case s when 'c' then compare_width when 'b' then base_width when 'm' then greatest(base_width, compare_width) end, 0) > 0 then case s when 'c' then compare_width when 'b' then base_width else greatest(base_width, compare_width) end else 100 end as width, coalesce(case s when 'c' then compare_height when 'b' then base_height when 'm' then greatest(base_height, compare_height) end, 14) as height from v",
    "text_box_estimated": f"select diff_id, (100 + ({ESTIMATED} * 31) % 300)::double as x, (100 + (({ESTIMATED} * 31) // 10) % 500 + (base_page - 1) * 50)::double as y, least(500, greatest(50, 20 + 7 * {ESTIMATED}))::double as width, 14.0::double as height from (select * replace (greatest(length(base_text), length(compare_text)) as longer) from diffs)",
    "text_methods": METHODS,
    "text_measures": _attributed("diffs") + ", m as (select *, coalesce(length(base_text), 0) as nb, coalesce(length(compare_text), 0) as nc, " + ", ".join(f"coalesce(compare_{n}, 0) - coalesce(base_{n}, 0) as d_{n}" for n in ("font_size", "x", "y", "width", "height")) + " from attributed) select diff_id, nb as base_length, nc as compare_length, greatest(nb, nc) as max_length, least(nb, nc) as min_length, abs(nb - nc) as length_gap, round(coalesce(abs(nb - nc) / nullif(greatest(nb, nc), 0), 0), 6) as gap_ratio, coalesce(base_font <> compare_font, false) as font_changed, d_font_size <> 0 as font_size_changed, coalesce(base_color <> compare_color, false) as color_changed, d_x <> 0 or d_y <> 0 as position_changed, d_width <> 0 or d_height <> 0 as extent_changed, d_font_size as font_size_change, round(coalesce(d_font_size * 100 / nullif(coalesce(base_font_size, 0), 0), 0), 6) as font_size_percent, d_x as x_change, d_y as y_change, d_width as width_change, d_height as height_change from m",
    "text_forced": ", t as (select doc_id, page_no, string_agg(text, chr(10) order by line_no) as text from page_lines group by all) select p.pair_id, base_page, compare_page, b.text as base_text, c.text as compare_text, 'modified' as change, 'major' as severity, true as synthetic from page_pairs p join pairs using (pair_id) join t b on b.doc_id = base_id and b.page_no = base_page join t c on c.doc_id = compare_id and c.page_no = compare_page where matched and score < 0.98 and (p.pair_id, base_page) not in (select (pair_id, base_page) from diffs)",
    "pair_forced": "select pair_id, min(base_page) as base_page, min(compare_page) as compare_page, true as synthetic from page_pairs where matched and pair_id not in (select pair_id from diffs) group by pair_id",
    "suppress_cosmetic": _attributed("judged") + ", c as (select *, change is not null as text_changed, (base_font, base_font_size) is distinct from (compare_font, compare_font_size) as font_changed, base_color is distinct from compare_color as color_changed, (base_x, base_y) is distinct from (compare_x, compare_y) as moved, coalesce(greatest(abs(base_x - compare_x), abs(base_y - compare_y)) <= 20, false) as near from attributed) select ignored, pair_id, base_page, compare_page, line_no, text_changed, font_changed, color_changed, moved from c, (values ('none', false, false), ('colors', true, false), ('positions', false, true), ('both', true, true)) as o(ignored, colors, positions) where text_changed or font_changed or color_changed and not colors or moved and not (near and positions)",
    "match_same_page": "select pair_id, base_page, compare_page, score from same",
    "match_unmatched": "select *, 'base' as side from ub union all select *, 'compare' from uc",
    "match_nearby": "select * from near",
    "match_distant": ", o as (select pair_id from (select pair_id, count(*) as n from bp group by all) join (select pair_id, count(*) as m from cp group by all) using (pair_id) left join (select pair_id, count(*) as u from ub group by all) using (pair_id) left join (select pair_id, count(*) as v from uc group by all) using (pair_id) where coalesce(u, 0) > 0.3 * n or coalesce(v, 0) > 0.3 * m), x as (select *, row_number() over (partition by pair_id order by (page_no * 7919) % 104729, page_no) as r from ub), y as (select *, row_number() over (partition by pair_id order by (page_no * 7919) % 104729, page_no) as r from uc) select pair_id, x.page_no as base_page, y.page_no as compare_page from x join y using (pair_id) join o using (pair_id) where x.r <= 10 and y.r <= 10 and abs(x.page_no - y.page_no) > 3",
    "match_full": "select * from every",
    "match_reuse": "select pair_id, base_page, compare_page, score from same",
    "match_assign": _rounds("edges0") + " select * from k",
    "match_unmatched_pages": _rounds("edges0") + " " + LEFT,
    "match_confidence": "select pair_id, round(count(*) filter (matched) / count(*) * avg(score) filter (matched), 6) as confidence from page_pairs group by pair_id",
    "match_weighted": "select pair_id, base_page, compare_page, round(0.7 * visual + 0.3 * content + 1e-9, 6) as score from seen",
    "sample_key_pages": "select distinct doc_id, unnest(case when page_count > 10 then [1, 2, 3, page_count // 4, page_count * 2 // 4, page_count * 3 // 4, page_count] else generate_series(1, least(3, page_count)) end) as page_no from doc_pages",
    "match_mode": ", k as (select pair_id, base_page, compare_page, score from same where score >= 0.7) select *, true as matched from k union all select pair_id, base_page, compare_page, 0.0, false from (" + LEFT + ")",
    "match_pipeline": SMART + " select *, true as matched from k union all select pair_id, base_page, compare_page, 0.0, false from (" + LEFT + ")",
    "match_coarse": SMART + " select *, true as matched from k union all select pair_id, base_page, compare_page, 0.0, false from (" + LEFT + ")",
    "pluggable_match": ", e as (select unnest(['content', 'visual', 'weighted', 'front']) as strategy, pair_id, base_page, compare_page, unnest([content, visual, round(0.7 * visual + 0.3 * content + 1e-9, 6), round(1.0::double / base_page, 6)]) as score from seen), kept as (select * from e where score >= 0.7), sides as (select strategy, pair_id, base_page, compare_page from page_pairs, (select unnest(['content', 'visual', 'weighted', 'front']) as strategy)), found as (select strategy, pair_id, base_page, compare_page, score, true as matched from kept union all select strategy, pair_id, base_page, null, 0, false from sides where base_page is not null and (strategy, pair_id, base_page) not in (select (strategy, pair_id, base_page) from kept) union all select strategy, pair_id, null, compare_page, 0, false from sides where compare_page is not null and (strategy, pair_id, compare_page) not in (select (strategy, pair_id, compare_page) from kept)) select found.*, round(coalesce(count(*) filter (matched) over w / count(*) over w * avg(score) filter (matched) over w, 0), 6) as confidence from found window w as (partition by strategy, pair_id)",
    "quick_similarity": ", p as (" + SAME_PIX + ") select pair_id, page_no, round(avg(case when abs(l1 - l2) + abs(l1 * 3 % 256 - l2 * 3 % 256) + abs(l2 - l1) < 50 then 1.0::double else 0 end), 6) as quick from p where x % 2 = 0 and y % 2 = 0 group by all",
    "luminance": "select img_id, x, y, (76 * lum + 150 * (lum * 3 % 256) + 29 * (255 - lum)) >> 8 as luminance from grid_px",
    "ssim": _ssim(SAME_PIX, 8, 8),
    "ssim_small": _ssim(SAME_PIX + " where x < 6 and y < 5", 0, 0),
    "page_score": "select pair_id, base_page as page_no, score, score_kind from same",
    "grid_align": "select img_id, nx as x, ny as y, lum from grid_px join (select unnest(generate_series(0, 11)) as nx) on x = nx * 16 // 12 join (select unnest(generate_series(0, 9)) as ny) on y = ny * 16 // 10",
    "grid_downscale": "select img_id, x // 2 as x, y // 2 as y, round(avg(lum), 6) as lum from grid_px group by all",
    "image_signature": SIGN + " select * from sign_b",
    "image_exact": SIGN + " select * from exact",
    "image_modified": IMAGES + " select * from image_diff where change <> 'added'",
    "image_added": IMAGES + " select pair_id, compare_page from image_diff where change = 'added'",
    "image_diff": IMAGES + " select * from image_diff",
    "image_severity": "select pair_id, base_page as page_no, case when score < 0.7 then 'major' when score < 0.9 then 'minor' else 'cosmetic' end as severity from same",
    "image_boxes": IMAGE_BOXES,
    "image_shape": ", s as (select doc_id, n_chars % 640 as w, doc_id * 37 % 480 as h from doc_meta) select doc_id, w * h as area, coalesce(round(w / nullif(h, 0), 6), 0) as aspect, case when w > h then 'landscape' when w < h then 'portrait' else 'square' end as shape from s",
    "image_measures": ", i as (select doc_id, n_chars % 640 as w, doc_id * 37 % 480 as h, doc_id % 50 as x, doc_id % 70 as y from documents), s as (select pair_id, b.w as bw, b.h as bh, b.x as bx, b.y as y1, c.w as cw, c.h as ch, c.x as cx, c.y as y2, round(b.w / greatest(b.h, 1), 6) as ba, round(c.w / greatest(c.h, 1), 6) as ca from pairs join i b on b.doc_id = base_id join i c on c.doc_id = compare_id) select pair_id, bw * bh as base_area, cw * ch as compare_area, cw * ch - bw * bh as area_change, coalesce(round((cw * ch - bw * bh) * 100 / nullif(bw * bh, 0), 6), 0) as area_percent, ba as base_aspect, ca as compare_aspect, round(ca - ba, 6) as aspect_change, cx - bx as x_change, y2 - y1 as y_change, cw - bw as width_change, ch - bh as height_change, coalesce(round((cw - bw) * 100 / nullif(bw, 0), 6), 0) as width_percent, coalesce(round((ch - bh) * 100 / nullif(bh, 0), 6), 0) as height_percent from s",
    "font_usage": "select * from fonts",
    "font_diff": "select * from font_diff",
    "font_severity": "select pair_id, base_page, compare_page, font, severity, description from font_graded",
    "font_measures": ", m as (select *, coalesce(compare_size, 0) - coalesce(base_size, 0) as ds, coalesce(compare_usage, 0) - coalesce(base_usage, 0) as du from font_diff) select pair_id, base_page, compare_page, font, coalesce(base_family <> compare_family, false) as family_changed, coalesce(base_style <> compare_style, false) as style_changed, coalesce(base_encoding <> compare_encoding, false) as encoding_changed, ds <> 0 as size_changed, coalesce(base_embedded, false) <> coalesce(compare_embedded, false) as embedding_changed, ds as size_change, coalesce(round(ds * 100 / nullif(coalesce(base_size, 0), 0), 6), 0) as size_percent, du as usage_change, coalesce(round(du * 100 / nullif(coalesce(base_usage, 0), 0), 6), 0) as usage_percent from m",
    "metadata_diff": "select * from meta_diff",
    "style_diff": "select * from sheets_diff",
    "infer_type": "select diff_id, case when line_no % 5 = 0 then 'image' when line_no % 7 = 0 then 'font' else 'text' end as type from diffs",
    "infer_change": "select diff_id, change from diffs",
    "min_bounds": "select diff_id, case when base_width is null or base_width - 6 < 2 then 10 else base_width - 6 end as width, coalesce(compare_height, 10) as height from diffs",
    "page_difference": "select pair_id, diff_id, base_page as page_no, type, x, y, width, height from five where width > 0 and height > 0",
    "dedupe_differences": "select diff_id, severity, (case when base_text is null then 1 else 0 end)::bigint as side from diffs",
    "sort_differences": "select pair_id, diff_id, row_number() over (partition by pair_id order by base_page, y, diff_id) as rank from boxed",
    "filter_differences": "select diff_id from five where type in ('text', 'font') and severity <> 'cosmetic' and (contains(lower(coalesce(base_text, '')), 'the') or contains(lower(coalesce(compare_text, '')), 'the') or contains(lower(coalesce(description, '')), 'the'))",
    "group_by_type": ", b as (select pair_id, unnest(['text', 'image', 'font', 'style', 'structure']) as bucket from pairs) select b.pair_id, b.bucket, count(five.diff_id) as n from b left join five on five.pair_id = b.pair_id and case when type in ('text', 'image', 'font', 'style') then type else 'structure' end = b.bucket group by all",
    "describe": DESCRIBE,
    "hit_test": ", pts as (select pair_id as point_id, pair_id, 1 as page_no, 100.0 as px, 700.0 + base_id % 80 as py from pairs join doc_pages on doc_id = base_id) select point_id, min(diff_id) as diff_id from pts p join boxed b on b.pair_id = p.pair_id and b.base_page = p.page_no where px between x and x + width and py between y and y + height group by point_id",
    "to_pixels": ", v as (select diff_id, coalesce(base_x, compare_x, 0) as x, coalesce(base_y, compare_y, 0) as y, coalesce(base_width, compare_width, 50) as w, coalesce(base_height, compare_height, 20) as h from diffs), f as (select 150.0::double / 72 as f) select diff_id, round(x * f, 6) as px_x, round(1650 - y * f - h * f, 6) as px_y, round(greatest(w * f, 5), 6) as px_width, round(greatest(h * f, 5), 6) as px_height from v, f",
    "difference_flags": "select diff_id, " + ", ".join(f"{k} = '{v}' as is_{v}" for k, vs in (("change", ("added", "deleted", "modified")), ("severity", ("major", "minor", "cosmetic")), ("type", ("text", "image", "font", "style", "metadata"))) for v in vs) + ", coalesce(width, 0) > 0 and coalesce(height, 0) > 0 as box_valid from five",
    "total_differences": "select * from totals",
    "count_by_dimension": " union all ".join(f"select pair_id, '{k}' as dimension, cast({k} as varchar) as value, count(*) as n from five group by all" for k in ("type", "severity", "change", "base_page")),
    "page_counts": "select * from page_counts",
    "pages_by_dimension": " union all ".join(f"select pair_id, '{k}' as dimension, {k} as value, count(distinct base_page) as pages from five group by all" for k in ("type", "severity")),
    "count_maps": "select p.pair_id, " + ", ".join(f"count(*) filter (type = '{t}') as n_{t}" for t in ("text", "image", "font", "style", "metadata")) + ", " + ", ".join(f"count(*) filter (severity = '{s}') as n_{s}" for s in ("major", "minor", "cosmetic")) + " from pairs p left join five using (pair_id) group by all",
    "overall_similarity": "select * from similarity",
    "identical_similar": "select pair_id, total = 0 as identical, similarity >= 0.5 as similar from totals join similarity using (pair_id)",
    "ui_summary": ", c as (select p.pair_id, count(*) filter (type = 'text') as content, count(*) filter (type = 'image') as images, count(*) filter (type = 'font') as fonts, count(*) filter (type = 'style') as style, count(type) as total, count(distinct base_page) as different from pairs p left join five using (pair_id) group by all), s as (select c.*, case when content + images + fonts + style = 0 then total else total - content - images - fonts - style end as structure from c) select pair_id, different as different_pages, content, images, fonts, style, structure, " + ", ".join(f"{_bar(c)} as bar_{c}" for c in ("content", "images", "fonts", "style", "structure")) + " from s",
    "match_label": f"select pair_id, base_page, compare_page, {LABEL.format('score')} as label from page_pairs",
    "document_pairs": f"select pair_id, base_id, compare_id, b.page_count is not null as has_base, c.page_count is not null as has_compare, coalesce(b.page_count, 0) as base_pages, coalesce(c.page_count, 0) as compare_pages, '1-' || b.page_count as base_range, '1-' || c.page_count as compare_range, total, similarity, {LABEL.format('similarity')} as label from pairs left join doc_pages b on b.doc_id = base_id left join doc_pages c on c.doc_id = compare_id join totals using (pair_id) join similarity using (pair_id)",
    "page_details": ASKED + ", t as (select doc_id, page_no, string_agg(text, chr(10) order by line_no) as text from page_lines group by all), l as (select pair_id, base_page, compare_page, " + ", ".join(f"count(*) filter (type = '{t}') as n_{t}" for t in ("text", "image", "font", "style")) + ", string_agg(diff_id, ',' order by diff_id) as ids from five group by all) select a.pair_id, a.page_no, b.text is not null as in_base, c.text is not null as in_compare, b.text as base_text, c.text as compare_text, " + ", ".join(f"coalesce(n_{t}, 0) as n_{t}" for t in ("text", "image", "font", "style")) + ", ids as base_differences, ids as compare_differences from asked a join pairs using (pair_id) left join t b on b.doc_id = base_id and b.page_no = a.page_no left join t c on c.doc_id = compare_id and c.page_no = a.page_no left join l on l.pair_id = a.pair_id and l.base_page = a.page_no and l.compare_page = a.page_no",
    "pairs_with_differences": "select * from page_pairs where matched and (pair_id, base_page) in (select (pair_id, base_page) from diffs where severity = 'major')",
    "page_lookup": ASKED + ", n as (select *, row_number() over (partition by pair_id order by coalesce(base_page, compare_page), compare_page) as n from page_pairs) select a.pair_id, a.page_no, coalesce(o.n, m.n, 1) as pair_no from asked a left join n o on o.pair_id = a.pair_id and o.base_page = a.page_no left join n m on m.pair_id = a.pair_id and m.n = a.page_no",
    "matched_pairs": "select count(*) filter (similarity > 0) as n from similarity",
    "summary": SUMMARY,
    "compare_options": COMPARE_OPTIONS,
    "report_json": REPORT_JSON,
    "report_html": REPORT_HTML,
    "result_purge": "select pair_id, diff_id, change from diffs where pair_id not in (select job_id from jobs where status in ('COMPLETED', 'FAILED') and updated_at < " + NOW + " - interval 24 hour)",
    "report_latest": "select base_id as pair_id, max('report-' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '-' || job_id) as path from jobs group by base_id",
    "result_write": ", d as materialized (select pair_id, diff_id, change, severity from diffs), again as (select distinct pair_id from d where pair_id % 2 = 0 and change <> 'modified') select d.* from d left join again on again.pair_id = d.pair_id where d.pair_id % 2 <> 0 or d.change <> 'modified' or again.pair_id is null",
    "result_read": "select pair_id, diff_id, change from diffs",
    "create_comparisons": ", q as (select job_id, base_id, compare_id * 8 as compare_id, case when base_id not in (select doc_id from documents) then 'base document not found' when compare_id * 8 not in (select doc_id from documents) then 'compare document not found' end as reject_reason from jobs) select *, case when reject_reason is null then 'PROCESSING' end as status from q",
    "resolve_status": "select w.job_id, case when j.has_result then 'COMPLETED' else coalesce(j.status, 'NOT_FOUND') end as status from (select job_id * 2 as job_id from jobs) w left join jobs j using (job_id)",
    "progress": ", q as (select job_id, status, case when status in ('PROCESSING', 'FAILED', 'CANCELLED') then ['Loading documents', 'Base document loaded', 'Documents loaded', 'Comparing documents', 'Comparison done', 'Saving results', 'Results saved'][job_id % 7 + 1] end as phase, (case status when 'PENDING' then 0 when 'COMPLETED' then 100 else [5, 10, 15, 20, 85, 90, 95][job_id % 7 + 1] end)::bigint as percent from jobs) select *, percent * (job_id % 50) // 100 as completed_operations from q",
    "in_progress": "select job_id from jobs where not has_result and status in ('PROCESSING', 'PENDING')",
    "elapsed": f", q as (select job_id, cast(floor(epoch_us({NOW}) / 1e6) - floor(epoch_us(created_at) / 1e6) as bigint) as seconds from jobs) select *, floor(seconds / 60) > 5 as maybe_stuck from q",
    "repair_stuck": f", q as (select *, status in ('PROCESSING', 'PENDING') as running, epoch_us({NOW}) - epoch_us(updated_at) > 900000000 as stale from jobs) select job_id, case when running and has_result then 'COMPLETED' when running and stale then 'FAILED' else status end as status, case when running and not has_result and stale then 'No progress for more than 15 minutes' end as message from q",
    "recent_comparisons": f", q as (select *, (epoch_us({NOW}) - epoch_us(created_at)) / 1e6 as age from jobs) select job_id, status, has_result, cast(floor(age / 60) as bigint) as age_minutes from q where age between 0 and 259200",
    "incremental_pairs": "select distinct base_id, compare_id + base_id % 2 as compare_id from jobs where (base_id, compare_id + base_id % 2) not in (select (base_id, compare_id) from jobs where has_result)",
    "metrics_by_operation": "select string_split(operation_type, '.')[-1] as operation, cast(round(sum(total_time_ms)) as bigint) as total_ms, count(*) as n from metrics group by 1",
    "metrics_by_size": "select size_category, cast(round(sum(total_time_ms)) as bigint) as total_ms, (case size_category when 'tiny' then 1 when 'small' then 2 when 'medium' then 3 when 'large' then 4 else 5 end)::bigint as place from metrics group by all",
    "metrics_summary": "select string_split(operation_type, '.')[1] as engine, count(*) as n, round(sum(total_time_ms), 2) as total_ms, arg_max(event_id, (total_time_ms, event_id)) as slowest_event from metrics group by 1",
}
# Streams whose rows hold no times; the others are held against their batch twins by tests.
_QUERIES |= {
    "stream_dedupe": "select distinct md5(text) as content_hash from documents",
    "stream_stuck": "select job_id, 'FAILED' as status from jobs where status in ('PROCESSING', 'PENDING') and not has_result and updated_at + interval 15 minute < (select max(updated_at) from jobs)",
    "stream_retention": f"select job_id, status from jobs where not (status in ('COMPLETED', 'FAILED') and updated_at < {NOW} - interval 24 hour)",
    "stream_compare": "select pair_id, diff_id, change, severity from diffs",
    "stream_progress": "select job_id, arg_max(status, (ts, status)) as status, max(ts) as ts from (select job_id % 500 as job_id, status, created_at as ts from jobs) group by job_id",
}

#: Pairs as arriving documents find them: the last holder of each key before them.
_A, _B = VIEWS.index("pairs as (select base_id"), VIEWS.index("words as (")
ARRIVALS = """sharing as (select doc_id, 'p' || md5(para) as k from line_keys union all select doc_id, 't' || k from texts),
before as (select doc_id as compare_id, lag(doc_id) over (partition by k order by doc_id) as base_id, k from sharing),
pairs as (select compare_id as pair_id, arg_max(base_id, (copy, shared, base_id)) as base_id, compare_id from (select base_id, compare_id, count(*) as shared, max(k[1:1] = 't') as copy from before where base_id is not null group by all) group by compare_id),
"""
SQL = {name: f"{VIEWS}\n{sql}" for name, sql in _QUERIES.items()}
SQL["stream_compare"] = f"{VIEWS[:_A]}{ARRIVALS}{VIEWS[_B:]}\n{_QUERIES['stream_compare']}"
