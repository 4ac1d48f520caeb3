"""DuckDB SQL for the catalog's queries over tables, written from the definitions; nothing here comes from the Spark code."""

from html.entities import html5

from tessera.plans import fixtures as X

CHUNK_CHARS = 1200
#: The stop words.
STOP_WORDS = """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по
только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть
был него до вас нибудь опять уж вам сказал ведь там потом себя ничего ей может они тут где есть надо
ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того
потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех
никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая
много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более
всегда конечно всю между какие такое такие какую каком который которая которые которого""".split()
#: Media types by extension.
MEDIA_TYPES = {
    "html": "text/html; charset=utf-8", "js": "application/javascript; charset=utf-8", "css": "text/css; charset=utf-8",
    "json": "application/json; charset=utf-8", "webmanifest": "application/manifest+json", "txt": "text/plain; charset=utf-8",
    "md": "text/plain; charset=utf-8", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml",
    "ico": "image/x-icon", "webp": "image/webp", "pdf": "application/pdf", "woff2": "font/woff2",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
#: Fixed value: paths that are never served.
DENIED = r"(?i)(^|/)(\.|_srv(/|$)|auth(/|$))|\.(php|phtml|phar|sql|ini|log|sh|py)$"

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

PARTS = r"""
cut AS (SELECT doc_id, source, lang, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS s FROM documents),
docs AS (SELECT doc_id, source, lang, CASE WHEN s[len(s)] = '' THEN s[1:len(s) - 1] ELSE s END AS l FROM cut),
parts AS (
  SELECT doc_id, p AS part, array_to_string(l[(p - 1) * 60 + 1 : p * 60], chr(10)) AS text
  FROM docs, unnest(range(1, (len(l) + 59) // 60 + 1)) u(p))"""

CHUNKS = (
    PARTS
    + rf""",
lines AS (
  SELECT doc_id, part, generate_subscripts(x, 1) AS k, unnest(x) AS p
  FROM (SELECT doc_id, part, string_split_regex(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n+') AS x FROM parts)),
para AS (
  SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id, part ORDER BY k) AS i, trim(p) AS p FROM lines WHERE trim(p) <> ''),
walk AS (
  SELECT doc_id, part, i, length(p) AS size, 0 AS piece FROM para WHERE i = 1
  UNION ALL
  SELECT w.doc_id, w.part, q.i, CASE WHEN w.size + length(q.p) + 1 > {CHUNK_CHARS} THEN length(q.p) ELSE w.size + 1 + length(q.p) END,
         CASE WHEN w.size + length(q.p) + 1 > {CHUNK_CHARS} THEN w.piece + 1 ELSE w.piece END
  FROM walk w JOIN para q ON q.doc_id = w.doc_id AND q.part = w.part AND q.i = w.i + 1),
pieces AS (
  SELECT doc_id, part, piece::BIGINT AS piece, string_agg(p, ' ' ORDER BY i) AS text FROM walk JOIN para USING (doc_id, part, i) GROUP BY ALL),
chunk AS (SELECT row_number() OVER (ORDER BY doc_id, part, piece) - 1 AS chunk_id, * FROM pieces)"""
)

TF = (
    CHUNKS
    + f""",
word AS (SELECT chunk_id, doc_id, unnest(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[a-zа-я0-9]+')) AS term FROM chunk),
token AS (SELECT * FROM word WHERE term NOT IN ({STOP}) AND (length(term) > 1 OR regexp_full_match(term, '[0-9]+'))),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM token GROUP BY ALL)"""
)

BM25 = (
    TF
    + """,
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
len AS (SELECT chunk_id, sum(tf)::BIGINT AS len FROM tf GROUP BY chunk_id),
st AS (SELECT (SELECT count(*) FROM chunk) AS n, (SELECT sum(tf) FROM tf)::DOUBLE / (SELECT count(*) FROM chunk) AS avg),
weights AS (
  SELECT chunk_id, term, tf, greatest(1, round_even(100 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg)), 0))::BIGINT AS weight
  FROM tf JOIN df USING (term) JOIN len USING (chunk_id), st),
size AS (SELECT term, 2 * length(term) + 6 + 8 * count(*) AS bytes, count(*) AS df FROM weights GROUP BY term),
plan AS (SELECT sum(bytes)::BIGINT AS bytes, greatest(1, round_even(sum(bytes) / 60000, 0))::BIGINT AS shards FROM size)"""
)

OFFSETS = """,
np AS (SELECT doc_id, (len(l) + 59) // 60 AS parts FROM docs),
nc AS (SELECT doc_id, count(*) AS chunks FROM chunk GROUP BY doc_id),
off AS (
  SELECT doc_id, parts, coalesce(chunks, 0) AS chunks,
         (sum(coalesce(chunks, 0)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - coalesce(chunks, 0))::BIGINT AS start
  FROM np LEFT JOIN nc USING (doc_id))"""

R = "WITH RECURSIVE "
UPPER = "(x = upper(x) AND x <> lower(x))"
HEAD = r"^(?:[IVXLC]+\.?\s|Глава\s|ГЛАВА\s|Раздел\s|РАЗДЕЛ\s|Приложение\s|ПРИЛОЖЕНИЕ\s|\d+(?:\.\d+)*\.?\s+[А-ЯЁ][А-ЯЁ\s,.-]{6,}$)"
ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
# HTML's character references: a map of all names, and numbers by code. UNESC needs nm, that map, among its columns.
QUOTED = lambda v: "'" + v.replace("'", "''") + "'"
NAMES = f"names AS (SELECT map_from_entries([{', '.join(f'({QUOTED(k)}, {QUOTED(v)})' for k, v in html5.items() if chr(0) not in v)}]) AS nm)"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0C <&#;]{1,32};?)"
WINDOWS = [bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)]
NUMBER = f"""list_transform([{{}}], lambda n: CASE WHEN n IS NULL OR n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN [{', '.join(map(QUOTED, WINDOWS))}][n - 127]
  WHEN n < 9 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END)[1]"""
REFERRED = f"""CASE WHEN m = '' THEN '' WHEN regexp_matches(m, '^&#[0-9]') THEN {NUMBER.format("TRY_CAST(regexp_extract(m, '[0-9]+') AS BIGINT)")}
  WHEN regexp_matches(m, '^&#[xX][0-9a-fA-F]') THEN {NUMBER.format("TRY_CAST('0x' || regexp_extract(m, '^&#[xX]([0-9a-fA-F]+)', 1) AS BIGINT)")}
  ELSE coalesce(nm[substr(m, 2)], {', '.join(f'nm[substr(m, 2, {k})] || substr(m, {k + 2})' for k in range(6, 1, -1))}, m) END"""
UNESC = f"""array_to_string(list_transform(list_zip(string_split_regex(g, '{REFERENCE}'), list_append(regexp_extract_all(g, '{REFERENCE}'), '')),
  lambda p: p[1] || list_transform([p[2]], lambda m: {REFERRED})[1]), '')"""
EXT = r"lower(regexp_extract(regexp_replace({}, '[?#].*$', ''), '\.([^./]*)$', 1))"
SESSIONS = """s AS (SELECT o_orderkey AS id, o_custkey AS user_id, epoch_us(o_orderdate) // 1000000 + 7776000 AS expires FROM orders),
u AS (SELECT c_custkey, lower(c_name) AS u_email, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE 'active' END AS u_status, c_acctbal > 1000 AS ok FROM customer)"""
WORDS = lambda t: f"(SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\\p{{L}}+'))) AS w FROM {t})"
# Every string one edit away from a word, made letter by letter.
EDITS = """
SELECT w, left(w, i - 1) || substr(w, i + 1) AS e FROM {0}, range(1, 40) t(i) WHERE i <= length(w)
UNION SELECT w, left(w, i - 1) || substr(w, i + 1, 1) || substr(w, i, 1) || substr(w, i + 2) FROM {0}, range(1, 40) t(i) WHERE i < length(w)
UNION SELECT w, left(w, i - 1) || c || substr(w, i + 1) FROM {0}, range(1, 40) t(i), unnest((SELECT list(DISTINCT c) FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM benchmark UNION SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''))))) a(c) WHERE i <= length(w)
UNION SELECT w, left(w, i - 1) || c || substr(w, i) FROM {0}, range(1, 40) t(i), unnest((SELECT list(DISTINCT c) FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM benchmark UNION SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''))))) a(c) WHERE i <= length(w) + 1"""

MEMBERS = """m AS (SELECT c_custkey AS id, lower(c_name) AS email, c_mktsegment AS name, sha256(c_custkey::VARCHAR) AS pass, CASE c_nationkey WHEN 0 THEN 'admin' ELSE 'user' END AS role,
  CASE WHEN c_acctbal < 0 THEN 'blocked' WHEN c_acctbal < 1000 THEN 'pending' ELSE 'active' END AS status, CASE WHEN c_acctbal > 500 THEN 1 ELSE 0 END AS verified,
  800000000 + c_custkey * 1000 AS created, CASE WHEN c_acctbal > 5000 THEN 900000000 + c_custkey ELSE 0 END AS last_login FROM customer)"""
ACTS = "a AS (SELECT c_custkey AS id, ['rehash', 'verify', 'reset', 'approve', 'block', 'role', 'login', 'delete'][c_custkey % 8 + 1] AS act FROM customer WHERE c_custkey % 3 <> 0)"

# Words of Russian look, put together from parts by their number.
ROOTS = "поезд тормоз след скор неисправн провер локомотив длин движ останавлив важн вагон путев сигнал стр нов открыт стрел приказ станц".split()
MIDDLES = ["", "а", "я", "и", "ова", "ейш", "ость", "нн"]
TAILS = "а я ов ев ами ях ий ый ая ую ого ему ыми ить ать яли ете ся ивши ившись вшись ующий ющая нный ем ость ости ейший ейше ь и ы у".split()
CYRILLIC = f"""r AS (SELECT {ROOTS} AS a, {MIDDLES} AS b, {TAILS} AS c),
k AS (SELECT i, a[i % len(a) + 1] || b[i // len(a) % len(b) + 1] || c[i // (len(a) * len(b)) % len(c) + 1] AS w FROM r, (SELECT l_orderkey * 8 + l_linenumber AS i FROM lineitem)),
w AS (SELECT DISTINCT w FROM k)"""
# Endings of the stemmer; those after the bar stand only after а or я.
ENDINGS = {
    "gerund": "ив ивши ившись ыв ывши ывшись | в вши вшись",
    "adjective": "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею |",
    "participle": "ивш ывш ующ | ем нн вш ющ щ",
    "verb": "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю | ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно",
    "noun": "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я |",
}


def _cut(x: str, kind: str) -> str:
    """SQL for x without its longest ending of a kind, null if it has none."""
    free, bound = (e.split() for e in ENDINGS[kind].split("|"))
    longest = f"greatest(0, list_max([CASE WHEN {x} LIKE '%' || e THEN length(e) ELSE 0 END FOR e IN {free}])"
    longest += f", list_max([CASE WHEN {x} LIKE '%а' || e OR {x} LIKE '%я' || e THEN length(e) ELSE 0 END FOR e IN {bound}]))" if bound else ")"
    return f"CASE WHEN {longest} > 0 THEN left({x}, length({x}) - {longest}) END"


STEM = f"""{CYRILLIC},
s1 AS (SELECT w, regexp_extract(w, '^[^аеиоуыэюя]*[аеиоуыэюя]') AS head FROM w),
s2 AS (SELECT w, head, substr(w, length(head) + 1) AS rv FROM s1),
s3 AS (SELECT *, {_cut("rv", "gerund")} AS g, regexp_replace(rv, '(ся|сь)$', '') AS p FROM s2),
s4 AS (SELECT *, {_cut("p", "adjective")} AS adj, {_cut("p", "verb")} AS verb, {_cut("p", "noun")} AS noun FROM s3),
s5 AS (SELECT w, head, coalesce(g, coalesce({_cut("adj", "participle")}, adj), verb, noun, p) AS t FROM s4),
s6 AS (SELECT w, head, CASE WHEN t LIKE '%и' THEN left(t, length(t) - 1) ELSE t END AS t FROM s5),
s7 AS (SELECT w, head, CASE WHEN regexp_matches(t, '[^аеиоуыэюя][аеиоуыэюя].*ость?$') THEN regexp_replace(t, 'ость?$', '') ELSE t END AS t FROM s6),
s8 AS (SELECT w, head, CASE WHEN t LIKE '%ь' THEN left(t, length(t) - 1) ELSE regexp_replace(t, 'ейше?$', '') END AS u, t LIKE '%ь' AS soft FROM s7),
stems AS (SELECT w AS word, CASE WHEN head = '' THEN w WHEN NOT soft AND u LIKE '%нн' THEN head || left(u, length(u) - 1) ELSE head || u END AS stem FROM s8)"""

PAGES = f"""{PARTS},
ln AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS x FROM docs),
tx AS (SELECT doc_id, k, trim(regexp_replace(x, '[^\\pL]+', ' ', 'g')) AS t FROM ln),
ls AS (SELECT doc_id, list(t ORDER BY k) AS t FROM tx WHERE t <> '' GROUP BY doc_id),
nu AS (SELECT doc_id, t, unnest(range((len(t) + 39) // 40 * 40)) AS i FROM ls),
pl AS (SELECT doc_id, i, t[i % len(t) + 1] AS t FROM nu),
kd AS (SELECT * REPLACE (CASE WHEN i % 20 = 0 AND length(t) >= 220 THEN '<b>' || t || '</b>' ELSE t END AS t), i // 40 + 1 AS page, CASE WHEN i % 20 = 0 AND length(t) < 220 THEN 'h' WHEN i % 10 = 0 THEN 'c' WHEN i % 20 IN (15, 16) THEN 'r' ELSE 'p' END AS kind FROM pl),
nw AS (SELECT *, CASE WHEN kind = 'p' AND i % 4 <> 1 AND lag(kind) OVER o = 'p' OR kind = 'r' AND i % 20 = 16 THEN 0 ELSE 1 END AS fresh FROM kd WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM nw),
bl AS (SELECT doc_id, g, any_value(kind) AS kind, max(page) AS page, CASE kind WHEN 'r' THEN string_agg(t, '<br>' ORDER BY i) ELSE string_agg(t, ' ' ORDER BY i) END AS t FROM gr GROUP BY doc_id, g, kind),
pg AS (SELECT DISTINCT doc_id, page FROM kd),
im AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM pg WHERE page % 4 = 0),
hb AS (
  SELECT doc_id, kind, page, CASE kind WHEN 'h' THEN CASE WHEN t = upper(t) OR regexp_matches(t, '^[IVXLC]+ ') THEN '<h2>' || t || '</h2>' ELSE '<h3>' || t || '</h3>' END
    WHEN 'p' THEN '<p>' || t || '</p>' ELSE '<p class="' || kind || '">' || t || '</p>' END AS html FROM bl
  UNION ALL SELECT doc_id, 'page', page, '<a id="page=' || page || '"></a>' FROM pg
  UNION ALL SELECT doc_id, 'table', page, '<div class="tbl"><table><tr><td>a</td><td>b &amp;</td></tr><tr><td>c- d</td><td>' || page || '</td></tr></table></div>' FROM pg WHERE page % 3 = 0
  UNION ALL SELECT doc_id, 'image', page, '<figure><img src="img/' || n || '.png" alt="" loading="lazy"></figure>' FROM im)"""

# What the rules make of each sample, by hand.
RULED = [
    "да, нет", "вагон, локомотив", "поезд, а вагон", "далее\u00a0— ПТЭ", "№\u00a01215/р", "длина 5\u00a0км", "он {} ушел", "a &amp; b c", "старый локомотив", "слово, слово", "По прибытии поезда", "не позднее чем завтра",
]
PAGE_BODY = f"""WITH a AS (SELECT k, page_id, [{", ".join(f"'{x}'" for x in RULED)}][(k * 7 + page_id * 287) % 12 + 1] || ' лист' || translate(page_id::VARCHAR, '0123456789', 'абвгдежзик') AS t FROM pages, range(40) r(k)),
q AS (SELECT *, replace(t, '{{}}', CASE WHEN k IN (21, 22) THEN '„сам“' ELSE '«сам»' END) || CASE k WHEN 20 THEN ' «и' WHEN 22 THEN ' тут»' ELSE '' END AS x FROM a),
l AS (SELECT *, CASE WHEN k IN (6, 7, 8, 33, 35) THEN 'r' WHEN k IN (0, 1, 2, 4, 30, 31) THEN 'h' WHEN k = 3 THEN 'H' WHEN k = 5 THEN 'b' ELSE 'p' END AS kind FROM q),
j AS (SELECT *, k IN (1, 2, 4, 7, 8) AS joins FROM l),
b AS (SELECT page_id, sum((NOT joins)::INT) OVER (PARTITION BY page_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS g, k, kind, CASE kind WHEN 'H' THEN 'I. ' || x ELSE x END AS x FROM j),
m AS (SELECT page_id, g, first(kind ORDER BY k) AS kind, string_agg(x, '<br>' ORDER BY k) AS x FROM b GROUP BY page_id, g)
SELECT page_id, string_agg(CASE kind WHEN 'r' THEN '<p class="r">' || x || '</p>' WHEN 'p' THEN '<p>' || x || '</p>' WHEN 'b' THEN '<h3><b>' || x || '</b></h3>' ELSE '<h2>' || x || '</h2>' END, chr(10) ORDER BY g) AS html
FROM m GROUP BY page_id"""

SQL = {
    "page_blocks": f"WITH {PAGES} SELECT doc_id, kind, page, md5(html) AS digest FROM hb",
    "page_documents": f"""WITH {PAGES} SELECT doc_id, count(*) AS blocks, sum(length(html))::BIGINT + count(*) - 1 + 2 * length('&lt;' || doc_id || '&gt;') + CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 0 END
  + length('<!doctype html><html lang="ru"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title></title><style>p{{}}</style></head><body><div class="bar"><span></span><a href="files/a&amp;b.pdf">Оригинал</a></div><main>')
  + 2 + length('</main></body></html>') AS chars FROM hb GROUP BY doc_id""",
    "sidecar_html": rf"""WITH {PARTS},
l AS (SELECT doc_id, part, generate_subscripts(s, 1) AS k, unnest(s) AS y FROM (SELECT doc_id, part, string_split(text, chr(10)) AS s FROM parts)),
x AS (SELECT doc_id, part, k, trim(regexp_replace(y, '\s+', ' ', 'g')) AS x FROM l WHERE trim(regexp_replace(y, '\s+', ' ', 'g')) <> ''),
h AS (SELECT doc_id, part, k, CASE WHEN length(x) < 120 AND {UPPER} THEN '<h2>' || {ESC("x")} || '</h2>' ELSE '<p>' || {ESC("x")} || '</p>' END AS h FROM x
  UNION ALL SELECT doc_id, part, 0, '<a id="page=' || part || '"></a>' FROM parts)
SELECT doc_id, md5(string_agg(h, chr(10) ORDER BY part, k)) AS digest FROM h GROUP BY doc_id""",
    "docx_tables": """SELECT l_orderkey, '<div class="tbl"><table>' || string_agg('<tr><td>' || l_returnflag || '</td><td>&lt;' || l_linestatus || '<br>&amp;</td></tr>', '' ORDER BY l_linenumber, l_returnflag, l_linestatus) || '</table></div>' AS html
FROM lineitem GROUP BY l_orderkey""",
    "docx_files": """SELECT p_partkey, '<h3>' || p_name || '</h3>' || chr(10) || '<div class="tbl"><table><tr><td>' || p_brand || '</td><td>' || p_type || '</td></tr><tr><td>' || p_brand || '</td><td>' || p_size || '</td></tr></table></div>' AS html FROM part""",
    "boxes": """WITH w AS (SELECT p_partkey, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS w FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)),
g AS (SELECT p_partkey, i // 3 AS g, string_agg(w, ' ' ORDER BY i) || CASE WHEN count(*) = 3 THEN '.' ELSE '' END AS t FROM w GROUP BY ALL)
SELECT p_partkey, '<div class="box">' || string_agg('<p>' || t || '</p>', '' ORDER BY g) || '</div>' AS html FROM g GROUP BY p_partkey""",
    "page_body": PAGE_BODY,
    "page_log": """WITH f AS (SELECT * FROM (VALUES (0, ',,', ','), (1, 'вагон,локомотив', 'вагон, локомотив'), (2, 'поезд а вагон', 'поезд, а вагон'), (8, 'тепловоз', 'локомотив'), (10, 'По прибытию', 'По прибытии'),
  (11, 'не позднее, чем', 'не позднее чем')) t(s, was, became)) SELECT was, became, count(DISTINCT page_id) AS pages FROM pages, range(40) r(k) JOIN f ON s = (k * 7 + page_id * 287) % 12 GROUP BY ALL""",
    "stem_words": f"WITH {STEM} SELECT word, stem FROM stems",
    "cyrillic_terms": f"""WITH {STEM}
SELECT i // 50 AS chunk_id, stem AS term, sum(1 + i % 3)::BIGINT AS tf FROM k JOIN stems ON w = word WHERE word NOT IN ({STOP}) GROUP BY 1, 2""",
    "text_parts": f"WITH {PARTS} SELECT doc_id, part, 'часть ' || part AS label, length(text) AS chars, md5(text) AS digest FROM parts",
    "text_lines_html": rf"""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS y FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS s FROM documents)),
x AS (SELECT doc_id, k, trim(regexp_replace(y, '\s+', ' ', 'g')) AS x FROM l WHERE trim(regexp_replace(y, '\s+', ' ', 'g')) <> ''),
h AS (SELECT doc_id, k, CASE WHEN length(x) < 120 AND {UPPER} THEN '<h2>' || {ESC("x")} || '</h2>' ELSE '<p>' || {ESC("x")} || '</p>' END AS h FROM x),
a AS (SELECT doc_id, string_agg(h, chr(10) ORDER BY k) AS h FROM h GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(h, '')) AS digest FROM documents d LEFT JOIN a USING (doc_id)""",
    "chunks": f"{R}{CHUNKS} SELECT doc_id, part, piece, length(text) AS chars, md5(text) AS digest FROM chunk",
    "chunk_ids": f"{R}{CHUNKS} SELECT chunk_id, doc_id, part, piece FROM chunk",
    "chunk_pages": f"{R}{CHUNKS} SELECT chunk_id // 40 AS page, count(*) AS n, min(chunk_id) AS first, max(chunk_id) AS last FROM chunk GROUP BY 1",
    "doc_offsets": f"{R}{CHUNKS}{OFFSETS} SELECT doc_id, parts, chunks, start FROM off",
    "doc_records": f"{R}{CHUNKS}{OFFSETS} SELECT doc_id, 'doc ' || lang || ' ' || doc_id AS name, coalesce(source, '') AS sec, parts, chunks, start FROM off JOIN docs USING (doc_id)",
    "tokens": f"{R}{TF} SELECT doc_id, count(*) AS n, count(DISTINCT term) AS terms FROM token GROUP BY doc_id",
    "term_freq": f"{R}{TF} SELECT chunk_id, term, tf FROM tf",
    "chunk_len": f"{R}{TF} SELECT chunk_id, coalesce(sum(tf), 0)::BIGINT AS len FROM chunk LEFT JOIN tf USING (chunk_id) GROUP BY chunk_id",
    "doc_freq": f"{R}{TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "corpus_stats": f"{R}{BM25} SELECT n, round(avg, 6) AS avg_len FROM st",
    "idf": f"{R}{BM25} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st",
    "bm25_weights": f"{R}{BM25} SELECT chunk_id, term, tf, weight FROM weights",
    "postings": f"{R}{BM25} SELECT term, string_agg(chunk_id || ',' || weight, ',' ORDER BY chunk_id) AS flat FROM weights GROUP BY term",
    "shard_plan": f"{R}{BM25} SELECT bytes, shards FROM plan",
    "index_shards": f"""{R}{BM25} SELECT list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: unicode(c)::BIGINT)),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295) % shards AS shard, term, df FROM size, plan""",
    "vocab": f"{R}{BM25} SELECT term, df FROM df WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+')",
    "index_meta": f"""{R}{BM25} SELECT lower(to_hex(1700000000)) AS v, '14.11.2023' AS built, (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM chunk) AS chunks, shards, 40 AS per,
  (bytes + (SELECT sum(strlen(text)) FROM chunk))::BIGINT AS bytes, (SELECT string_agg(DISTINCT source, '|' ORDER BY source) FROM documents WHERE source <> '') AS secs,
  (SELECT md5(string_agg(DISTINCT w, ' ' ORDER BY w)) FROM (SELECT unnest([{STOP}]) AS w)) AS stop FROM plan""",
    "search_topk": f"""{R}{BM25}, hit AS (SELECT chunk_id, sum(weight)::BIGINT AS score FROM weights WHERE term IN ('the', 'reading', 'of', 'an', 'erer', 'tion', 'enter') GROUP BY 1),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM hit) SELECT chunk_id, score, rank FROM top WHERE rank <= 10""",
    "stored_search": f"""{R}{BM25}, hit AS (SELECT chunk_id, sum(weight)::BIGINT AS score FROM weights WHERE term IN ('the', 'reading', 'of', 'an', 'erer', 'tion', 'enter') GROUP BY 1),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM hit) SELECT chunk_id, score, rank FROM top WHERE rank <= 10""",
    "stored_search_many": f"""{R}{BM25},
qw AS (SELECT item_id, unnest(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[a-zа-я0-9]+')) AS term FROM benchmark),
qt AS (SELECT DISTINCT item_id, term FROM qw WHERE term NOT IN ({STOP}) AND (length(term) > 1 OR regexp_full_match(term, '[0-9]+'))),
hit AS (SELECT item_id, chunk_id, sum(weight)::BIGINT AS score FROM weights JOIN qt USING (term) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM hit) SELECT item_id AS query_id, chunk_id, score, rank FROM top WHERE rank <= 5""",
    "incremental_weights": f"{R}{BM25} SELECT chunk_id, term, tf, weight FROM weights",
    "incremental_stats": f"""{R}{TF}, old AS (SELECT CASE WHEN lang = 'es' THEN upper(text) ELSE text END AS t FROM documents WHERE lang <> 'de')
SELECT (SELECT count(*) FROM chunk) AS chunks, (SELECT sum(tf) FROM tf)::BIGINT AS total, (SELECT count(DISTINCT coalesce(text, '')) FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(t, '') FROM old)) AS read""",
    "search_typo": f"""{R}{BM25}, v AS (SELECT term, df FROM df WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+')),
q AS (SELECT * FROM (VALUES ('thn'), ('ther'), ('errre'), ('tionr'), ('anhte')) t(w) WHERE w NOT IN (SELECT term FROM v)),
e AS ({EDITS.format("q")}), r AS (SELECT w, term, v.df, row_number() OVER (PARTITION BY w ORDER BY v.df DESC, term) AS k FROM e JOIN v ON e = term)
SELECT w AS word, term, df FROM r WHERE k = 1""",
    "header_footer": f"""WITH {PARTS},
ln AS (SELECT doc_id, part, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS t FROM (SELECT doc_id, part, string_split(text, chr(10)) AS x FROM parts)),
k AS (SELECT doc_id, regexp_replace(trim(t), '[0-9]+', '#', 'g') AS key FROM ln WHERE i * 10 + 8 < 48 OR i * 10 > 540),
np AS (SELECT doc_id, count(*) AS pages FROM parts GROUP BY doc_id)
SELECT doc_id, key, count(*) AS n FROM k JOIN np USING (doc_id) WHERE key <> '' GROUP BY doc_id, key, pages HAVING count(*) >= greatest(3.0, pages * 0.3)""",
    "kept_lines": f"""WITH {PARTS},
ln AS (SELECT * FROM (SELECT doc_id, part, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS t FROM (SELECT doc_id, part, string_split(text, chr(10)) AS x FROM parts)) WHERE i % 9 <> 4),
k AS (SELECT *, i < 4 OR i > 54 AS edge, regexp_replace(trim(t), '[0-9]+', '#', 'g') AS key FROM ln),
np AS (SELECT doc_id, count(*) AS pages FROM parts GROUP BY doc_id),
rep AS (SELECT doc_id, key FROM k JOIN np USING (doc_id) WHERE edge AND key <> '' GROUP BY doc_id, key, pages HAVING count(*) >= greatest(3.0, pages * 0.3))
SELECT doc_id, count(*) AS lines, sum(i * 10.0)::DOUBLE AS tops, sum(length(t))::BIGINT AS chars FROM k
WHERE NOT (edge AND (regexp_full_match(t, '[\\s0-9\\-–—./стрСтр]*') OR (doc_id, key) IN (SELECT (doc_id, key) FROM rep))) AND NOT (part % 2 = 0 AND i BETWEEN 10 AND 20) GROUP BY doc_id""",
    "zipped_tables": """WITH a AS (SELECT doc_id, length(text) AS chars, row_number() OVER (ORDER BY doc_id) AS n FROM documents), b AS (SELECT page_id, length(html) AS html_chars, row_number() OVER (ORDER BY page_id) AS n FROM pages)
SELECT doc_id, chars, page_id, html_chars FROM a JOIN b USING (n)""",
    "noise_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_full_match(x, '[\s0-9\-–—./стрСтр]*')) AS n_noise FROM l GROUP BY doc_id""",
    "heading_level": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT doc_id, count(*) FILTER ({UPPER} OR regexp_matches(x, '{HEAD}')) AS h2, count(*) FILTER (NOT ({UPPER} OR regexp_matches(x, '{HEAD}'))) AS h3 FROM l WHERE x <> '' GROUP BY doc_id""",
    "merge_adjacent": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations),
b AS (SELECT conv_id, role, min(turn) AS t, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM a GROUP BY conv_id, role, g)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t) AS island, role, n, digest FROM b""",
    "margin_pct": """SELECT l_orderkey, list_sort(list(l_extendedprice))[count(*) // 10 + 1] AS "left", list_reverse_sort(list(l_extendedprice + l_quantity))[greatest(1, count(*) // 10)] AS "right" FROM lineitem GROUP BY l_orderkey""",
    "distinct_first": """WITH w AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS word FROM (SELECT doc_id, regexp_extract_all(text, '\\p{L}+') AS x FROM documents)),
f AS (SELECT doc_id, word, min(i) AS pos FROM w GROUP BY ALL) SELECT doc_id, word, pos AS "at", row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM f""",
    "oov_words": f"SELECT w AS word, w AS part FROM {WORDS('documents')} d WHERE length(w) >= 3 AND w NOT IN (SELECT w FROM {WORDS('benchmark')})",
    "edit1_suggest": f"""WITH b AS (SELECT w FROM {WORDS('benchmark')} x WHERE length(w) > 2), e AS ({EDITS.format("b")}),
d AS (SELECT w AS word FROM {WORDS('documents')} x WHERE length(w) >= 3 AND w NOT IN (SELECT w FROM {WORDS('benchmark')})),
r AS (SELECT DISTINCT word, w FROM d JOIN e ON word = e), k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY w) AS k FROM r)
SELECT word, string_agg(w, ', ' ORDER BY w) AS suggestions FROM k WHERE k <= 3 GROUP BY word""",
    "strip_tags": "SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages)",
    "html_escape": f"SELECT page_id, md5({ESC('html')}) AS plain, md5(replace(replace({ESC('html')}, '\"', '&quot;'), '''', '&#039;')) AS quoted FROM pages",
    "page_entities": f"""WITH {NAMES}, l AS (SELECT list_sort(map_keys(nm)) AS ks FROM names),
t AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') || list_aggregate(list_transform(range(20), lambda k: '&' || ks[(page_id * 20 + k) % len(ks) + 1] || ['', ' ', 'x', ';'][(page_id + k) % 4 + 1]
  || '&#' || (page_id * 131 + k * 8191) % 1200000 || [';', ' '][k % 2 + 1] || '&#x' || lower(to_hex((page_id * 37 + k) % 4096)) || ';'), 'string_agg', '') AS g FROM pages, l)
SELECT page_id, length({UNESC}) AS chars, md5({UNESC}) AS digest FROM t, names""",
    "tag_aware_fix": rf"""WITH {NAMES}, a AS (SELECT page_id, string_split_regex(html, '<[^>]+>') AS gs, regexp_extract_all(html, '<[^>]+>') AS ts FROM pages),
b AS (SELECT page_id, ts, generate_subscripts(gs, 1) AS i, unnest(gs) AS g FROM a),
c AS (SELECT page_id, i, regexp_replace(regexp_replace({UNESC}, '[ \t]{{2,}}', ' ', 'g'), ' +([,.;:!?)])', '\1', 'g') AS g, coalesce(ts[i], '') AS t FROM b, names)
SELECT page_id, md5(string_agg({ESC("g")} || t, '' ORDER BY i)) AS digest FROM c GROUP BY page_id""",
    "session_join": f"WITH {SESSIONS} SELECT id, user_id, expires, u_email, u_status FROM s JOIN u ON user_id = c_custkey",
    "valid_sessions": f"WITH {SESSIONS} SELECT id, user_id, expires, u_email FROM s JOIN u ON user_id = c_custkey WHERE expires >= 852076800 AND u_status = 'active' AND ok",
    "valid_tokens": """WITH t AS (SELECT event_id AS id, user_id, event_type AS kind, (epoch_us(ts) // 1000000) + 604800 AS expires FROM events WHERE event_type = 'signup'),
l AS (SELECT user_id, max((expires, id)) AS m FROM (SELECT user_id, expires, id FROM t) GROUP BY user_id)
SELECT t.* FROM t JOIN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY expires DESC, id DESC) AS k FROM t) WHERE k = 1) USING (id) WHERE expires > 1704067200 + 25 * 86400""",
    "rate_limit": """WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000000) AS sec FROM events WHERE event_type = 'error')
SELECT event_id, user_id, sec AS "at", n, n >= 10 AS limited FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) AS n FROM e)""",
    "comma_hints": f"""{X.WORDS} SELECT key, 1 AS "at", CASE key % 5 WHEN 0 THEN v || 'ов следующих в депо' WHEN 2 THEN w || 'ов в котором путь' ELSE 'вот ' || v || 'ать которых' END AS was,
  CASE key % 5 WHEN 0 THEN v || 'ов, следующих в депо' WHEN 2 THEN w || 'ов, в котором путь' ELSE 'вот, ' || v || 'ать которых' END AS becomes FROM words WHERE key % 5 IN (0, 2, 4)""",
    "word_parses": f"""{X.WORDS}, e AS (SELECT * FROM (VALUES ('ов', 'NOUN', 'gent', 'plur', 'masc'), ('ам', 'NOUN', 'datv', 'plur', 'masc'), ('ать', 'INFN', NULL, NULL, NULL)) t(e, pos, "case", number, gender))
SELECT DISTINCT v || e AS form, 1 AS rank, pos, "case", number, gender, false AS known FROM words, e""",
    "session_renewals": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, bool_or(event_type = 'signup') AS opens FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e),
w AS (SELECT user_id, i, t, opens AS moves, CASE WHEN opens THEN t + 259200 END AS expires FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.i, n.t, n.opens OR coalesce(w.expires >= n.t AND n.t + 259200 - w.expires > 86400, false),
    CASE WHEN n.opens OR (w.expires >= n.t AND n.t + 259200 - w.expires > 86400) THEN n.t + 259200 ELSE w.expires END FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
SELECT user_id AS token, t AS "at", expires FROM w WHERE moves""",
    "shard_files": f"""{R}{BM25}, s AS (SELECT term, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: unicode(c)::BIGINT)),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295) % shards AS shard FROM size, plan),
h AS (SELECT shard, count(DISTINCT term) AS terms, sum(chunk_id + weight)::BIGINT AS numbers FROM weights JOIN s USING (term) GROUP BY shard)
SELECT k AS shard, coalesce(terms, 0) AS terms, coalesce(numbers, 0) AS numbers FROM (SELECT unnest(range(shards)) AS k FROM plan) LEFT JOIN h ON k = shard""",
    "page_files": f"""{R}{CHUNKS} SELECT chunk_id // 40 AS page, count(*) AS chunks, md5(string_agg(doc_id || '|часть ' || part || '|' || text, chr(10) ORDER BY chunk_id)) AS digest FROM chunk GROUP BY 1""",
    "case_order": "SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS rank FROM orders",
    "pending_count": "SELECT count(*) FILTER (c_acctbal > 500 AND c_acctbal < 1000) AS pending, count(*) AS users FROM customer",
    "user_updates": f"WITH {MEMBERS}, {ACTS} "+'''SELECT id, CASE WHEN act IN ('rehash', 'reset') THEN 'new' || id ELSE pass END AS pass, CASE act WHEN 'role' THEN 'admin' ELSE role END AS role,
  CASE act WHEN 'approve' THEN 'active' WHEN 'block' THEN 'blocked' ELSE status END AS status, CASE WHEN act IN ('verify', 'reset', 'approve') THEN 1 ELSE verified END AS verified,
  CASE act WHEN 'login' THEN 950000000 ELSE last_login END AS last_login FROM m LEFT JOIN a USING (id)''',
    "user_inserts": f"WITH {MEMBERS} "+'''SELECT id, email, CASE id % 3 WHEN 2 THEN left(repeat(name, 15), 100) ELSE repeat(name, 15) END AS name, CASE id % 3 WHEN 0 THEN 'admin' ELSE 'user' END AS role,
  CASE id % 3 WHEN 1 THEN 'pending' ELSE 'active' END AS status, CASE id % 3 WHEN 1 THEN 0 ELSE 1 END AS verified, 870000000::BIGINT AS created FROM m''',
    "user_deletes": f"WITH {MEMBERS}, {ACTS} "+'''SELECT 'users' AS name, count(*) AS n, sum(id)::BIGINT AS ids FROM m WHERE id NOT IN (SELECT id FROM a WHERE act = 'delete')
UNION ALL SELECT 'sessions', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_custkey NOT IN (SELECT id FROM a WHERE act IN ('reset', 'block', 'delete'))
UNION ALL SELECT 'tokens', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey NOT IN (SELECT id FROM a WHERE act = 'delete')''',
    "token_users": '''SELECT sha256('t' || o_orderkey) AS token, o_custkey AS user_id FROM orders
WHERE o_orderkey % 4 <> 0 AND o_orderstatus = 'O' AND epoch_us(o_orderdate) // 1000000 + 86400 > 852076800''',
    "session_users": '''SELECT o_orderkey AS id, o_custkey AS user_id, lower(c_name) AS u_email FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 2 = 0 AND c_acctbal >= 1000 AND epoch_us(o_orderdate) // 1000000 + 7776000 >= 852076800''',
    "opened_sessions": '''WITH s AS (SELECT o_custkey AS user_id, epoch_us(o_orderdate) // 1000000 + 7776000 AS expires FROM orders WHERE epoch_us(o_orderdate) // 1000000 + 7776000 >= 852076800
UNION ALL SELECT c_custkey, 852076800 + 7776000 FROM customer WHERE c_acctbal >= 1000) SELECT user_id, count(*) AS n, max(expires) AS last FROM s GROUP BY user_id''',
    "attempt_purge": '''WITH e AS (SELECT event_id AS id, left('10.0.' || user_id || repeat('.1', 30), 45) AS cut, '10.0.' || user_id || repeat('.1', 30) AS ip, 'u' || user_id AS email, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type = 'error')
SELECT id, ip, email, s AS "at" FROM e WHERE s < 1705795200 AND s >= 1705795200 - 86400 UNION ALL SELECT id, cut, email, s FROM e WHERE s = 1705795260 UNION ALL SELECT id, cut, email, s FROM e WHERE id % 97 = 0 AND s >= 1705795200''',
    "who_json": f"WITH {MEMBERS} "+'''SELECT id, '{"email":"' || email || '","name":"' || name || '","admin":' || (role = 'admin') || ',"pending":' ||
  CASE role WHEN 'admin' THEN (SELECT count(*) FROM m WHERE status = 'pending' AND verified = 1) ELSE 0 END || '}' AS json FROM m''',
    "user_listing": f"WITH {MEMBERS} "+'''SELECT id, CASE WHEN id % 11 = 0 THEN 'odd' WHEN status = 'pending' THEN 'заявка' WHEN status = 'active' THEN 'доступ открыт' ELSE 'заблокирован' END AS label,
  'с ' || strftime(make_timestamp(created * 1000000), '%d.%m.%Y') || CASE WHEN last_login <> 0 THEN ', последний вход ' || strftime(make_timestamp(last_login * 1000000), '%d.%m.%Y %H:%M') ELSE '' END AS seen FROM m''',
    "admin_mail": f"WITH {MEMBERS} "+'''SELECT email, '=?UTF-8?B?' || base64(encode(email)) || '?=' AS header,
  regexp_replace(base64(encode('Заявка от ' || email || repeat(' текст', 9))), '(.{1,76})', '\\1' || chr(13) || chr(10), 'g') AS body FROM m WHERE role = 'admin' AND status = 'active' ''',
    "url_codec": "SELECT page_id, url_encode(url || ' ~*(+)é') AS quoted, 'a+b ' || url || ' ~*(+)é' AS back FROM pages",
    "file_titles": '''WITH p AS (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') AS x FROM pages)
SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'files/a%20b/%D0%9F_' || x || CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '.pdf' END END AS file,
  CASE WHEN page_id % 5 <> 0 THEN regexp_replace('П_' || x, '_+', ' ', 'g') END AS title FROM p''',
    "etags": '''SELECT page_id, '"' || lower(to_hex(page_id * 1000003 + 1600000000)) || '-' || lower(to_hex(length(html))) || '"' AS etag FROM pages''',
    "worker_route": r'''WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') || CASE page_id % 4 WHEN 1 THEN '/index.html' WHEN 2 THEN '/auth/x' WHEN 3 THEN '/' ELSE '' END AS p FROM pages)
SELECT page_id, CASE WHEN p LIKE '%/auth/%' THEN 'network only' WHEN p LIKE '%/' OR regexp_matches(p, '/(index\.html|pdf\.html|meta\.json|tickets\.json|sw\.js)$') THEN 'network first' ELSE 'cache first' END AS route FROM p''',
    "stale_urls": "SELECT page_id FROM pages WHERE page_id % 4 = 1",
    "path_acl": rf"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/?', '') AS p FROM pages)
SELECT page_id, regexp_matches(p, '{DENIED}') AS denied, 'private, ' || CASE WHEN lower(regexp_extract(p, '\.([^./]*)$', 1)) IN ('html', 'json', 'js', 'webmanifest') THEN 'no-cache' ELSE 'max-age=600' END AS policy FROM p""",
    "safe_next": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS p FROM pages)
SELECT page_id, CASE WHEN p LIKE '/%' AND p NOT LIKE '//%' AND NOT regexp_matches(p, '[\\\s]') AND p NOT LIKE '/auth/%' THEN p ELSE '/' END AS target FROM p""",
    "mime_lookup": f"SELECT page_id, CASE {EXT.format('url')} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END AS mime FROM pages",
    "norm_text": "SELECT c_custkey, lower(trim(c_mktsegment)) AS email FROM customer",
    "content_cache": "SELECT sha1(text) AS key, min(doc_id) AS first, count(*) - 1 AS hits FROM documents GROUP BY 1",
}
