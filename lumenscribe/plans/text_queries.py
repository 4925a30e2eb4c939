"""Queries of sources, strings, Thai text, glyph names and the front end, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.functions import arabic, glyphs, naming, strings, thai
from lumenscribe.functions.draws import sql_u32
from lumenscribe.operators import frontend, generators, layout
from lumenscribe.session import small_batches, table

SEED = 11
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_rows(values: list[str]) -> str:
    """VALUES (number, text) with line breaks spelt out."""
    each = (quoted(v).replace("\n", "' || chr(10) || '") for v in values)
    return "values " + ", ".join(f"({k}, {v})" for k, v in enumerate(each))


def fixture(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "sid bigint, text string")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(strings.lines(F.col("text"))).alias("line", "text"))


DOC_LINES = f"""
lines as (
  select doc_id, i - 1 as line, parts[i] as text
  from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i
        from (select doc_id, string_split_regex(text, '{strings.LINE_BREAK}') as parts from documents)))"""


@query(f"with {DOC_LINES} select count(*)::bigint as n_lines, sum((length(text) > 0)::int)::bigint as n_entries from lines")
def line_count(spark, sf_dir):
    """Lines, and the ones that are entries."""
    lines = document_lines(spark, sf_dir)
    return lines.agg(F.count("*").alias("n_lines"), F.sum((F.char_length("text") > 0).cast("bigint")).alias("n_entries"))


_FIRST = f"with {DOC_LINES}, firsts as (select text, min(doc_id * 1000000 + line) as spot from lines where length(text) > 0 group by text)"


def _first_lines(spark, sf_dir):
    lines = document_lines(spark, sf_dir).where(F.char_length("text") > 0)
    return frontend.distinct_first(lines, "text", "doc_id", "line")


@query(f"{_FIRST} select row_number() over (order by spot) - 1 as idx, (spot // 1000000)::bigint as doc_id, (spot % 1000000)::int as line, text from firsts")
def line_scan_dedup(spark, sf_dir):
    """A dictionary of all texts' lines: no empty ones, each at its first place, numbered from 0."""
    return frontend.numbered(_first_lines(spark, sf_dir), "doc_id", "line").select("idx", "doc_id", "line", "text")


@query(f"{_FIRST} select (spot // 1000000)::bigint as doc_id, (spot % 1000000)::int as line, text from firsts order by spot limit 1000")
def line_scan_dedup_limit(spark, sf_dir):
    """The first 1000 entries, as a request for a count asks."""
    return frontend.first_rows(_first_lines(spark, sf_dir), 1000, "doc_id", "line").select("doc_id", "line", "text")




def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{strings.SPACE}]+|[{strings.SPACE}]+$', '', 'g')"



@query(f"with {DOC_LINES} select doc_id, line::int as line, {_strip('text')} as text from lines")
def stripped_lines(spark, sf_dir):
    """Lines of a strings file: empty ones stay, white space at the ends goes."""
    return document_lines(spark, sf_dir).select("doc_id", "line", strings.strip(F.col("text")).alias("text"))


@query("""
with items as (select row_number() over (order by p_partkey) - 1 as pos, substr(p_name, 1, 200) as text from part),
fonts as (select row_number() over (order by n_nationkey) - 1 as pos, n_name as font from nation)
select o_orderkey as idx, items.text, fonts.font from orders
join items on items.pos = (o_orderkey - 1 + 10 * (select count(*) from items)) % (select count(*) from items)
join fonts on fonts.pos = (o_orderkey - 1 + 10 * (select count(*) from fonts)) % (select count(*) from fonts)
""")
def cycle_strings(spark, sf_dir):
    """Texts and fonts taken in turn by every request."""
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    items = generators.items(table(spark, sf_dir, "part"), "p_name", "p_partkey")
    fonts = generators.items(table(spark, sf_dir, "nation"), "n_name", "n_nationkey", "font")
    return generators.from_strings(requests, items, fonts).select("idx", "text", "font")


@query(f"""
with words as (select row_number() over (order by p_partkey) - 1 as pos, p_name as word from part),
drawn as (
  select idx, j, {sql_u32(SEED, "'word' || j", "idx")} % (select count(*) from words) as pos
  from (select c_custkey as idx, unnest(range(1, {sql_u32(SEED, "'length'", "c_custkey")} % 5 + 2)) as j from customer))
select idx, string_agg(word, ' ' order by j) as text from drawn join words using (pos) group by idx
""")
def dict_sampler(spark, sf_dir):
    """1 to 5 dictionary words for each request, with replacement."""
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"))
    words = generators.items(table(spark, sf_dir, "part"), "p_name", "p_partkey", "word")
    return generators.from_dict(requests, words, SEED, 5, True)


def _random_sql(alphabet: str, low: int, high: int) -> str:
    at, n = "idx || '.' || w", len(alphabet)
    size = f"({sql_u32(SEED, repr('size'), at)} % {high - low + 1} + {low})"
    char = f"substr({quoted(alphabet)}, ({sql_u32(SEED, 'c', at)} % {n} + 1)::int, 1)"
    words = f"({sql_u32(SEED, repr('words'), 'idx')} % 4 + 1)"
    return f"""
select idx, string_agg(word, ' ' order by w) as text
from (select idx, w, string_agg({char}, '' order by c) as word
      from (select idx, w, unnest(range(1, {size} + 1)) as c
            from (select o_orderkey as idx, unnest(range(1, {words.replace('idx', 'o_orderkey')} + 1)) as w from orders))
      group by idx, w) group by idx"""


@query(_random_sql(strings.pool(), 2, 10))
def random_sequences(spark, sf_dir):
    """1 to 4 random words of letters, digits and symbols."""
    return generators.from_random(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx")), SEED, 4, True)


@query(_random_sql(strings.pool(True, False, False, "ja"), 1, 2))
def random_sequences_ja(spark, sf_dir):
    return generators.from_random(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx")), SEED, 4, True, True, False, False, "ja")


@query(f"""
with kept as (
  select doc_id, list_filter(string_split_regex(replace(text, chr(10), ' '), '{strings.SENTENCE_END}'), lambda s: len(regexp_extract_all(s, '[^{strings.SPACE}]+')) > 4) as parts from documents)
select doc_id, (i - 1)::int as pos, {_strip('parts[i]')} as text from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from kept)
""")
def sentence_source(spark, sf_dir):
    """Sentences of more than four words of every document."""
    return generators.from_articles(table(spark, sf_dir, "documents").select("doc_id", "text"), 4)


@query(f"""
with placed as (select doc_id, row_number() over (order by doc_id) - 1 as idx from documents),
fonts as (select row_number() over (order by n_nationkey) - 1 as pos, n_name as font from nation)
select doc_id, idx, font, format('{{:04d}}', idx // 100) as bucket, 'base/' || format('{{:04d}}', idx // 100) as out_dir
from placed join fonts on pos = {sql_u32(SEED, "'font'", "idx")} % (select count(*) from fonts)
""")
def font_bucket_route(spark, sf_dir):
    """Number, folder and a drawn font of every document."""
    docs = frontend.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    fonts = generators.items(table(spark, sf_dir, "nation"), "n_name", "n_nationkey", "font")
    return frontend.routed(docs, fonts, SEED, size=100).select("doc_id", "idx", "font", "bucket", "out_dir")


@query("""
with wanted as (select o_orderkey as idx, format('{:04d}', o_orderkey // 5000) as bucket, o_orderkey || '.jpg' as file_name from orders),
done as (select distinct format('{:04d}', event_id // 5000) as bucket, event_id || '.jpg' as file_name from events where event_type = 'click')
select * from wanted anti join done using (bucket, file_name)
""")
def resume_anti_join(spark, sf_dir):
    """Requests whose files are not there yet."""
    files = lambda df, key: df.select(F.col(key).alias("idx"), naming.bucket(F.col(key)).alias("bucket"), F.concat(F.col(key).cast("string"), F.lit(".jpg")).alias("file_name"))
    done = files(table(spark, sf_dir, "events").where("event_type = 'click'"), "event_id")
    return frontend.not_done(files(table(spark, sf_dir, "orders"), "o_orderkey"), done).select("idx", "bucket", "file_name")


@query("""
select doc_id, upper(replace(text, 'ß', 'SS')) as upper_text, lower(text) as lower_text,
       array_to_string(list_reverse(string_split(text, ' ')), ' ') as reversed_text from documents
""")
def case_rtl_words(spark, sf_dir):
    """Texts in upper and lower case, and with their words in reverse order."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", strings.change_case(text, "upper").alias("upper_text"), strings.change_case(text, "lower").alias("lower_text"), strings.reverse_words(text).alias("reversed_text"))


THAI = ["น้ำใจ", "กำลังใจดี", "เก้าอี้ไม้", "ที่ปู่รู้จัก", "ไม้แก้ว abc", "ก็", "์", "ผู้ใหญ่บ้านน้ำทิพย์", "a😀b", "", "บน\nล่าง", "ป่ำ", "ค่ํา", "แม่น้ำ", "ซื้อ ๓ ชิ้น", "ุก", "กาเ", "เกี๊ยวฺ์ํ"]


@query(f"""
with texts as (select 'doc' as kind, doc_id as sid, text from documents union all select 'thai', v.* from ({sql_rows(THAI)}) v(sid, text)),
split as (select kind, sid, regexp_extract_all(text, '{thai.CLUSTER}') as g from texts)
select kind, sid, len(g)::int as n_clusters, md5(array_to_string(g, '|')) as clusters from split
""")
def grapheme_clusters(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("sid"), "text").union(fixture(spark, THAI).select(F.lit("thai"), "sid", "text"))
    g = thai.clusters(F.col("text"))
    return texts.select("kind", "sid", F.size(g).alias("n_clusters"), F.md5(F.array_join(g, "|").cast("binary")).alias("clusters"))


_PART = "regexp_replace(g, '[^{}]', '', 'g')"


@query(f"""
with split as (select sid, regexp_extract_all(text, '{thai.CLUSTER}') as c from ({sql_rows(THAI)}) v(sid, text)),
each as (select sid, k - 1 as k, c[k] as g from (select sid, c, unnest(range(1, len(c) + 1)) as k from split))
select sid::bigint as sid, k::int as k, g as cluster, regexp_replace(g, '[{thai.UPPER}{thai.LOWER}{thai.LEADING}\\x{{0E33}}]', '', 'g') as base,
  {", ".join(("case when contains(g, '{}') then '{}' else '' end || ".format(thai.SARA_AM, thai.NIKHAHIT) if n == "upper_diacritic" else "") + _PART.format(c) + " as " + n for n, c in thai.PARTS.items())},
  case when contains(g, '{thai.SARA_AM}') then '{thai.SARA_AA}' else '' end as trailing, contains(g, '{thai.SARA_AM}') as is_sara_am
from each
""")
def thai_decompose(spark, sf_dir):
    each = fixture(spark, THAI).select("sid", F.posexplode(thai.clusters(F.col("text"))).alias("k", "cluster"))
    return each.select("sid", "k", "cluster", thai.decompose(F.col("cluster")).alias("d")).select("sid", "k", "cluster", "d.*")


@query(f"""
with texts as (select 'doc' as kind, doc_id as sid, text from documents union all select 'thai', v.* from ({sql_rows(THAI)}) v(sid, text))
select kind, sid, {thai.sql_reorder('text')} as reordered, {thai.sql_reorder(f"replace(text, '{thai.SARA_AM}', '{thai.NIKHAHIT + thai.SARA_AA}')")} as normalized,
  regexp_matches(text, '[{thai.UPPER}]') as has_upper, regexp_matches(text, '[{thai.LOWER}]') as has_lower, regexp_matches(text, '[{thai.ANY}]') as has_thai
from texts
""")
def thai_reorder(spark, sf_dir):
    """Reordered and normalised texts, and what they hold."""
    texts = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("sid"), "text").union(fixture(spark, THAI).select(F.lit("thai"), "sid", "text"))
    t = F.col("text")
    return texts.select("kind", "sid", thai.reorder(t).alias("reordered"), thai.normalize(t).alias("normalized"), thai.has_upper(t).alias("has_upper"), thai.has_lower(t).alias("has_lower"), thai.contains_thai(t).alias("has_thai"))


@query(f"""
with {DOC_LINES}, runs as (select doc_id, line, regexp_extract_all(text, '(?s)[A-Za-z.,!?; ]+|[^A-Za-z.,!?; ]+') as r from lines)
select doc_id, line::int as line, (k - 1)::int as k, r[k] as segment, regexp_matches(r[k], '^[A-Za-z.,!?; ]') as supported
from (select doc_id, line, r, unnest(range(1, len(r) + 1)) as k from runs)
""")
def font_support_segments(spark, sf_dir):
    """Runs of every line that a Latin font without accents has, or has not."""
    runs = layout.support_segments(F.col("text"), "A-Za-z.,!?;")
    return document_lines(spark, sf_dir).select("doc_id", "line", F.posexplode(runs).alias("k", "r")).select("doc_id", "line", "k", "r.segment", "r.supported")


NAMES = ["uni0E4D", "nikhahit.alt", "uni0E32", "sara_aa.narrow", "uni0E33", "uni0E48.small", "uni0E4D0E49", "uni0E4D0E48.liga", "maiEk", "A", "a.sc", "uni0041", "afii59757", "uni0E40", "uni0E38", "uni0E47", "uni0E4C", "uni0E30", "uni0E01", "uniZZZZ", "tonemark", "uni0E3F", "space", "zzz"]
CMAP = {"A": "A", "a": "a", "uni0E48": "่", "space": " "}


@query(f"""
with cmap as (select * from (values {", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in CMAP.items())}) v(n, c)),
names as (select sid, text as name, string_split(text, '.')[1] as stem from ({sql_rows(NAMES)}) v(sid, text))
select sid::bigint as sid, name, {glyphs.sql_role_of_name('name')} as role,
  coalesce((select c from cmap where n = name),
    case when regexp_full_match(stem, 'uni([0-9A-Fa-f]{{4}}){{2,}}') then array_to_string(list_transform(regexp_extract_all(substr(stem, 4), '[0-9A-Fa-f]{{4}}'), lambda x: chr(('0x' || x)::int)), '') end,
    (select c from cmap where n = stem), case when regexp_full_match(stem, 'uni[0-9A-Fa-f]{{4}}') then chr(('0x' || substr(stem, 4))::int) end, '') as chars
from names
""")
def classify_glyphs(spark, sf_dir):
    """Role and characters of glyph names."""
    cmap = F.create_map(*(F.lit(x) for kv in CMAP.items() for x in kv))
    known = F.array(F.try_element_at(cmap, F.col("text")), F.try_element_at(cmap, F.split("text", r"\.")[0]))
    return fixture(spark, NAMES).select("sid", F.col("text").alias("name"), glyphs.role_of_name(F.col("text")).alias("role"), glyphs.chars_of_name(F.col("text"), known).alias("chars"))


@query(f"""
with named as (select doc_id, row_number() over (order by doc_id) - 1 as idx, text from documents),
each as (
  select doc_id, idx, f, substr(regexp_replace(case f when 1 then idx || '_' || text when 2 then idx::varchar when 4 then replace(text, ' ', '') || '_' || idx else text || '_' || idx end, '{naming.FORBIDDEN}', '', 'g'), 1, 200) as name
  from named, (values (0), (1), (2), (3), (4)) v(f))
select doc_id, idx, f as name_format, name || '.jpg' as image_name, {", ".join(f"name || '{e}' as {n}" for n, e in naming.DERIVED.items())} from each
""")
def file_names(spark, sf_dir):
    """Names of every document's files in each format (4: the first without spaces)."""
    docs = frontend.numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    names = [naming.safe_name(naming.sample_name(F.col("text"), F.col("idx"), f if f < 4 else 0, 0 if f == 4 else 1)) for f in range(5)]
    each = docs.select("doc_id", "idx", F.posexplode(F.array(*names)).alias("name_format", "name"))
    return each.select("doc_id", "idx", "name_format", F.concat("name", F.lit(".jpg")).alias("image_name"), *(F.concat("name", F.lit(e)).alias(n) for n, e in naming.DERIVED.items()))


@query(f"""
select c_custkey as idx, {", ".join(f"({sql_u32(SEED, repr(f'color-{c}'), 'c_custkey')} % {hi - lo + 1} + {lo})::int as {c}" for c, lo, hi in zip("rgb", (16, 32, 0), (250, 64, 255)))} from customer
""")
def color_pick(spark, sf_dir):
    """A text colour between two for each request."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), naming.pick_color(SEED, F.col("c_custkey"), "#1020ff,#fa4000").alias("c")).select("idx", "c.*")


# Names of parts spelt in Arabic letters, with marks and lam-alefs among them.
_LATIN, _ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتد\u064eفگهيجكلمنوپقرسطءثشخىز"
_LETTERS = ", ".join("({})".format(", ".join([quoted(k), *(quoted(f[x]) if x in f else "null" for x in ("isolated", "final", "initial", "medial"))])) for k, f in arabic.FORMS.items() if len(k) == 1)
_LIGATURES = ", ".join(f"({quoted(k[1])}, {quoted(f['isolated'])}, {quoted(f['final'])})" for k, f in arabic.FORMS.items() if len(k) == 2)


@query(f"""
with texts as (select p_partkey, translate(lower(p_name), '{_LATIN}', '{_ARABIC}') as s from part),
chars as (select p_partkey, i, substr(s, i, 1) as c from (select *, unnest(range(1, length(s) + 1)) as i from texts)),
base as (select *, lag(c) over w as p, lead(c) over w as n from chars where c <> chr(1614) window w as (partition by p_partkey order by i)),
forms(letter, iso, fin, ini, med) as (values {_LETTERS}), ligatures(alef, liso, lfin) as (values {_LIGATURES}),
met as (
  select b.*, f.iso, f.fin, f.ini, f.med, g.ini is not null as joined, h.fin is not null as reached, l.liso, l.lfin, k.alef is not null as swallowed
  from base b left join forms f on f.letter = b.c left join forms g on g.letter = b.p left join forms h on h.letter = b.n
  left join ligatures l on b.c = 'ل' and l.alef = b.n left join ligatures k on b.p = 'ل' and k.alef = b.c),
glyphs as (
  select p_partkey, i, case when swallowed then '' when liso is not null then case when joined then lfin else liso end
    when ini is not null and reached and joined and fin is not null then med when ini is not null and reached then ini when joined and fin is not null then fin else coalesce(iso, c) end as g from met
  union all select p_partkey, i, c from chars where c = chr(1614))
select p_partkey, string_agg(g, '' order by i) as shaped from glyphs group by p_partkey
""")
def arabic_shaped(spark, sf_dir):
    """Letters joined as their neighbours ask for."""
    text = F.translate(F.lower("p_name"), _LATIN, _ARABIC)
    return table(spark, sf_dir, "part").select("p_partkey", arabic.shaped(text).alias("shaped"))


_NAMED = "doc_id, coalesce(text, '') as t from documents"


@query(f"""
select doc_id, substr(regexp_replace(regexp_replace(strip_accents(t), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9_\\s\x0b\x1c-\x1f-]', '', 'g'), 1, 200) as name from (select {_NAMED})
""")
def ascii_names(spark, sf_dir):
    """Names without marks, of every document."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", naming.ascii_name(text).alias("name"))


@query(f"""
select doc_id, substr(regexp_replace(nfc_normalize(replace(replace(t, 'é', 'e' || chr(769)), 'ç', 'c' || chr(807))), '{naming.FORBIDDEN}', '', 'g'), 1, 200) as name from (select {_NAMED})
""")
def composed_names(spark, sf_dir):
    """Names whose letters and marks, given apart, are brought together."""
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    apart = F.replace(F.replace(text, F.lit("é"), F.lit("e\u0301")), F.lit("ç"), F.lit("c\u0327"))
    return table(spark, sf_dir, "documents").select("doc_id", naming.safe_name(apart, True).alias("name"))
