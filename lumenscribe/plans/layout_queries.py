"""Queries of layout, boxes, masks, COCO annotations and backgrounds, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.functions import geometry, glyphs, naming
from lumenscribe.functions.draws import sql_u32
from lumenscribe.operators import coco, frontend, layout, masks, raster, render
from lumenscribe.plans.text_queries import DOC_LINES, SEED, document_lines, quoted
from lumenscribe.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIZE, MARGINS = 32, (5, 5, 5, 5)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# Layout under the rule-drawn face; {rows} gives key columns and text.
def sql_layout(rows: str, key: str, spacing: int = 0, size: int = SIZE) -> str:
    return f"""
texts as ({rows}),
chars as (select {key}, i, c, unicode(c) as code, regexp_matches(c, '^[\\t\\n\\x0b\\f\\r ]$') as blank
          from (select {key}, unnest(range(1, len(p) + 1)) as i, unnest(p) as c from (select {key}, list_filter(string_split(text, ''), lambda x: x <> '') as p from texts))),
metered as (select *, case when blank then 4 else code % 5 + 4 end + {spacing} as advance, code % 3 - 1 as y1, 3 + code % 5 as x2, code % 3 + 4 + code % 4 as y2 from chars),
placed as (select *, sum(advance) over (partition by {key} order by i) - advance as x from metered),
extents as (
  select {key}, min(case when blank then x else x + 1 end) as x1, max(case when blank then x + advance else x + x2 end) as x2,
         min(case when blank then 0 else y1 end) as y1, max(case when blank then {size * layout.INKLESS_HEIGHT} else y2 end) as y2 from placed group by {key}),
glyphs as (
  select p.{key.replace(', ', ', p.')}, row_number() over (partition by p.{key.replace(', ', ', p.')} order by i) as k, c, code, p.x::double as x, p.advance::double as advance,
         trunc(p.x - e.x1 + 1)::bigint as bx1, trunc(e.y2 - p.y2)::bigint as by1, trunc(p.x - e.x1 + p.x2)::bigint as bx2, trunc(e.y2 - p.y1)::bigint as by2,
         ceil(e.x2 - e.x1)::bigint as width, ceil(e.y2 - e.y1)::bigint as height
  from placed p join extents e using ({key}) where not blank)"""


_PARTS = sql_layout("select p_partkey, p_name as text from part", "p_partkey", 2)
_LINES = sql_layout("select * from lines", "doc_id, line")


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and names over tasks: they are little to read, a file or two, and much is made of each."""
    return frontend.spread(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text")), "p_partkey")


def part_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.laid_out(part_names(spark, sf_dir), "text", SIZE, 2)


@query(f"with {_PARTS} select p_partkey, k::int as k, c as char, x, advance, bx1 as x1, by1 as y1, bx2 as x2, by2 as y2, width, height from glyphs")
def layout_prefix_sum(spark, sf_dir):
    """Place and box of every glyph of a name, with spacing."""
    rows = part_layout(spark, sf_dir).select("p_partkey", "layout.width", "layout.height", F.explode("layout.glyphs").alias("g"))
    return rows.select("p_partkey", "g.k", "g.char", "g.x", "g.advance", "g.box.*", "width", "height")


@query(f"""
with {DOC_LINES}, {_LINES}
select doc_id, line::int as line, count(*)::int as n_glyphs, max(width) as width, max(height) as height, min(bx1) as x1, min(by1) as y1, max(bx2) as x2, max(by2) as y2
from glyphs group by doc_id, line
""")
def word_polygons(spark, sf_dir):
    """Canvas and the polygon around the glyphs of every line of every document; no shuffle."""
    rows = layout.laid_out(document_lines(spark, sf_dir), "text", SIZE, glyphs=False).where("layout.n_glyphs > 0")
    return rows.select("doc_id", "line", "layout.n_glyphs", "layout.width", "layout.height", "layout.hull.*")


@query("""
with heights as (
  select p_partkey, i, c, case when c = ' ' then 8 else unicode(c) % 4 + 6 end as h
  from (select p_partkey, unnest(range(1, length(p_name) + 1)) as i, unnest(string_split(p_name, '')) as c from part))
select p_partkey, (i - 1)::int as k, c as grapheme, (sum(h + 3) over (partition by p_partkey order by i) - h - 3)::double as top, h::int as height from heights
""")
def vertical_layout(spark, sf_dir):
    """Tops of stacked graphemes, three pixels apart."""
    height = lambda c: F.when(c == " ", 8).otherwise(F.ascii(c) % 4 + 6)
    rows = table(spark, sf_dir, "part").select("p_partkey", layout.chars(F.col("p_name")).alias("g"))
    rows = rows.withColumn("h", F.transform("g", height)).withColumn("top", layout.stacked(F.col("h"), 3))
    return rows.select("p_partkey", F.posexplode(F.arrays_zip("g", "h", "top")).alias("k", "e")).select("p_partkey", "k", F.col("e.g").alias("grapheme"), "e.top", F.col("e.h").alias("height"))


_SEGMENT_WIDTH = "(length(s) * 7 + 3)"


@query(f"""
with {DOC_LINES}, runs as (select doc_id, line, regexp_extract_all(text, '(?s)[A-Za-z.,!?; ]+|[^A-Za-z.,!?; ]+') as r from lines),
each as (select doc_id, line, k, r[k] as s from (select doc_id, line, r, unnest(range(1, len(r) + 1)) as k from runs))
select doc_id, line::int as line, (k - 1)::int as k, (sum({_SEGMENT_WIDTH}) over (partition by doc_id, line order by k) - {_SEGMENT_WIDTH})::double as x, {_SEGMENT_WIDTH}::int as width from each
""")
def fallback_layout(spark, sf_dir):
    """Where each run of a line begins when its runs are set side by side."""
    runs = layout.support_segments(F.col("text"), "A-Za-z.,!?;")
    rows = document_lines(spark, sf_dir).withColumn("w", F.transform(runs, lambda r: F.char_length(r["segment"]) * 7 + 3))
    rows = rows.withColumn("x", layout.stacked(F.col("w")))
    return rows.select("doc_id", "line", F.posexplode(F.arrays_zip("w", "x")).alias("k", "e")).select("doc_id", "line", "k", "e.x", F.col("e.w").alias("width"))


# Boxes derived from orders' lines, on canvases of 100 x 20 to 499 x 79.
_BOXES = """
boxes as (
  select row_number() over () as rid, l_orderkey, l_linenumber, l_partkey, l_orderkey % 400 + 100 as w, l_partkey % 60 + 20 as h, l_partkey % 90 as x1, l_suppkey % 15 as y1,
         l_partkey % 90 + 1 + l_quantity::bigint as x2, l_suppkey % 15 + 1 + l_linenumber * 3 as y2 from lineitem)"""


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lambda c: F.col(c).cast("bigint")
    x, y = i("l_partkey") % 90, i("l_suppkey") % 15
    b = geometry.box(x, y, x + 1 + i("l_quantity"), y + 1 + i("l_linenumber") * 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (i("l_orderkey") % 400 + 100).alias("w"), (i("l_partkey") % 60 + 20).alias("h"), b.alias("b"))


def _out(df: DataFrame, b, *more, digits: int | None = None) -> DataFrame:
    sides = [F.round(b[k], digits).alias(k) if digits is not None else b[k].cast("bigint").alias(k) for k in geometry.SIDES]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *sides, *more)


_C, _S = repr(math.cos(math.radians(15.0))), repr(math.sin(math.radians(15.0)))


@query(f"""
with {_BOXES}, sized as (select *, ceil(round(w * {_C} + h * {_S}, 6))::bigint as nw, ceil(round(w * {_S} + h * {_C}, 6))::bigint as nh from boxes),
corners as (select s.*, unnest([x1, x2, x2, x1]) as x, unnest([y1, y1, y2, y2]) as y from sized s),
turned as (select *, (x - w / 2) * {_C} + (y - h / 2) * {_S} + nw / 2 as tx, (y - h / 2) * {_C} - (x - w / 2) * {_S} + nh / 2 as ty from corners)
select l_orderkey, l_linenumber, l_partkey, round(min(tx), 6) as x1, round(min(ty), 6) as y1, round(max(tx), 6) as x2, round(max(ty), 6) as y2, any_value(nw) as width, any_value(nh) as height
from turned group by rid, l_orderkey, l_linenumber, l_partkey
""")
def rotate_boxes(spark, sf_dir):
    """Boxes turned by 15 degrees with their canvas, which grows to hold all of it."""
    boxes = line_boxes(spark, sf_dir)
    nw, nh = geometry.rotated_size(F.col("w"), F.col("h"), 15)
    return _out(boxes, geometry.rotate_box(F.col("b"), 15, F.col("w"), F.col("h")), nw.alias("width"), nh.alias("height"), digits=6)


@query(f"""
with {_BOXES}, drawn as (select *, {sql_u32(SEED, "'curve'", "l_orderkey")} % 16 + 5 as a from boxes),
shifted as (select *, trunc(a * sin(greatest(0, least(w - 1, trunc((x1 + x2) / 2))) * pi() / w))::bigint as off from drawn)
select l_orderkey, l_linenumber, l_partkey, x1, y1 + off as y1, x2, y2 + off as y2, h + a as height from shifted
""")
def curve_boxes(spark, sf_dir):
    """Boxes on an arch of a drawn height of 5 to 20."""
    from lumenscribe.functions.draws import between

    boxes = line_boxes(spark, sf_dir).withColumn("a", between(SEED, "curve", F.col("l_orderkey"), 5, 20))
    return _out(boxes, geometry.curve_box(F.col("b"), F.col("a"), F.col("w")), (F.col("h") + F.col("a")).alias("height"))


def _wave_sql(kind: str, vertical: bool, horizontal: bool) -> str:
    off = lambda at, axis="down": f"trunc(round({kind}(radians(({at})::double)) * m, 9))::bigint" if kind != "jitter" else f"({sql_u32(SEED, repr(f'jitter-{axis}'), f'l_orderkey || chr(46) || ({at})')} % (m + 1))"
    span = {"sin": f"case when w >= 91 then m else {off('w - 1')} end - case when w >= 271 then -m when w >= 181 then {off('w - 1')} else 0 end", "cos": f"m - case when w >= 181 then -m else least({off('w - 1')}, 0) end", "jitter": "m"}[kind]
    rows = f"h + {span}" if vertical else "h"
    ny = f"case when x >= 0 and x < w then y + m + {off('x')} else y end" if vertical else "y"
    nx = "case when x >= 0 and x < w then x + m else x end" if vertical and horizontal else "x"
    last = f"case when ny >= 0 and ny < rows then nx + {off('ny', 'right')} else nx end" if horizontal else "nx"
    return f"""
with {_BOXES}, reach as (select *, trunc({'sqrt(h)' if kind != 'jitter' else 'pow(h, 0.4)'})::bigint as m from boxes),
corners as (select r.*, {rows} as rows, unnest([x1, x2, x2, x1]) as x, unnest([y1, y1, y2, y2]) as y from reach r),
first as (select *, {nx} as nx, {ny} as ny from corners), second as (select *, {last} as fx from first)
select l_orderkey, l_linenumber, l_partkey, min(fx)::bigint as x1, min(ny)::bigint as y1, max(fx)::bigint as x2, max(ny)::bigint as y2
from second group by rid, l_orderkey, l_linenumber, l_partkey"""


def _wave_query(kind: str, vertical: bool, horizontal: bool):
    def run(spark, sf_dir):
        boxes = line_boxes(spark, sf_dir)
        return _out(boxes, geometry.wave_box(F.col("b"), kind, vertical, horizontal, F.col("w"), F.col("h"), SEED, F.col("l_orderkey")))

    run.__doc__ = f"Boxes under a {kind} wave, vertical: {vertical}, horizontal: {horizontal}."
    return run


for _kind in ("sin", "cos", "jitter"):
    for _name, _v, _h in (("vertical", True, False), ("horizontal", False, True), ("both", True, True)):
        QUERIES[f"wave_boxes_{_kind}_{_name}"] = _wave_query(_kind, _v, _h)
        SQL[f"wave_boxes_{_kind}_{_name}"] = _wave_sql(_kind, _v, _h)


@query(f"""
with {_BOXES}, scaled as (select *, 22.0::double / h as r, trunc(w * (22.0::double / h))::bigint as tw from boxes),
moved as (select *, [5, trunc(600 / 2 - tw / 2)::bigint, 600 - tw - 5] as dxs from scaled)
select l_orderkey, l_linenumber, l_partkey, (a - 1)::int as alignment, trunc(x1 * r)::bigint + dxs[a] as x1, trunc(y1 * r)::bigint + 5 as y1, trunc(x2 * r)::bigint + dxs[a] as x2, trunc(y2 * r)::bigint + 5 as y2, tw as text_width
from (select *, unnest([1, 2, 3]) as a from moved)
""")
def scale_offset_align(spark, sf_dir):
    """Boxes on a canvas of 600 x 32: left, centred, right."""
    sizes = geometry.resize(F.col("w"), F.col("h"), SIZE, MARGINS, 0, 600)
    each = F.array(*(geometry.align(a, sizes["canvas_width"], sizes["text_width"], MARGINS, 600).cast("bigint") for a in range(3)))
    rows = line_boxes(spark, sf_dir).select("*", sizes["ratio"].alias("r"), sizes["text_width"].alias("text_width"), F.posexplode(each).alias("alignment", "dx"))
    b = geometry.move_box(geometry.scale_box(F.col("b"), F.col("r")), F.col("dx"), F.lit(MARGINS[0]))
    return _out(rows, b, "alignment", "text_width")


@query(f"""
with {_BOXES}
select l_orderkey, l_linenumber, l_partkey, trunc(w * (22.0::double / h))::bigint as text_width, 22 as text_height, trunc(w * (22.0::double / h))::bigint + 10 as canvas_width, 32 as canvas_height,
       22 as v_text_width, trunc(h * (22.0::double / w))::bigint as v_text_height, 32 as v_canvas_width, trunc(h * (22.0::double / w))::bigint + 10 as v_canvas_height from boxes
""")
def resize_dimensions(spark, sf_dir):
    """Sizes of text and canvas, horizontal and vertical."""
    h, v = (geometry.resize(F.col("w"), F.col("h"), SIZE, MARGINS, o) for o in (0, 1))
    keys = ("text_width", "text_height", "canvas_width", "canvas_height")
    return line_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", *(h[k].alias(k) for k in keys), *(v[k].alias(f"v_{k}") for k in keys))


def _mask_sql(tess: bool) -> str:
    grown = "greatest(0, h - maxy - 1) as y1, least(h - 1, h - miny + 1) as y2" if tess else "greatest(0, miny - 1) as y1, least(h - 1, maxy + 1) as y2"
    gap = "least(h - miny + 2, py1 - 1) as y1, greatest(h - miny + 2, py1 - 1) as y2" if tess else "least(py2 + 1, miny - 1) as y1, greatest(py2 + 1, miny - 2) as y2"
    return f"""
{_PARTS},
letters as (select p_partkey, i as k, c, unicode(c) % 3 as j, trunc(x)::bigint as minx, trunc(x + x2)::bigint as maxx, 20 + unicode(c) % 3 as miny, 40 + unicode(c) % 5 as maxy, 64 as h, 400 as w from placed where not blank),
sized as (select *, greatest(0, minx - 1) as x1, {grown}, least(w - 1, maxx + 1) as x2 from letters),
chained as (select *, lag(k) over o as pk, lag(x2) over o as px2, lag(y1) over o as py1, lag(y2) over o as py2 from sized window o as (partition by p_partkey order by k)),
stopped as (select *, sum(case when (pk is null and k <> 1) or k - pk > 2 then 1 else 0 end) over (partition by p_partkey order by k) as stops from chained),
boxed as (
  select p_partkey, k * 2 as ord, x1, y1, x2, y2 from stopped where stops = 0
  union all
  select p_partkey, k * 2 - 1, least(px2 + 1, minx - 1) as x1, {gap.split(', greatest')[0].replace(' as y1', '')} as y1, greatest(px2 + 1, minx - 2) as x2, greatest{gap.split(', greatest')[1].replace(' as y2', '')} as y2
  from stopped where stops = 0 and k - pk = 2)"""


def _mask_boxes(spark: SparkSession, sf_dir: str, *tess: bool) -> DataFrame:
    rows = part_layout(spark, sf_dir)
    # extents by place in the text: a blank has none
    place = F.filter(F.transform(layout.chars(F.col("text")), lambda c, i: F.when(~F.lit(" \t\n\x0b\f\r").contains(c), i + 1)), lambda k: k.isNotNull())

    def extent(k, g):
        code, right = F.ascii(g["char"]), 3 + F.ascii(g["char"]) % 5
        return F.struct(k.alias("k"), g["x"].cast("bigint").alias("minx"), (20 + code % 3).alias("miny"), (g["x"] + right).cast("bigint").alias("maxx"), (40 + code % 5).alias("maxy"))

    extents = F.zip_with(place, F.col("layout.glyphs"), extent)
    return rows.select("p_partkey", "text", *(masks.boxes(extents, F.lit(400), F.lit(64), t).alias(f"boxes{k}") for k, t in enumerate(tess)))


def _mask_query(name: str, tess: bool):
    def run(spark, sf_dir):
        rows = _mask_boxes(spark, sf_dir, tess).select("p_partkey", F.posexplode("boxes0").alias("k", "b"))
        return rows.select("p_partkey", "k", *(F.col(f"b.{s}").cast("bigint").alias(s) for s in geometry.SIDES))

    QUERIES[name] = run
    SQL[name] = f"with {_mask_sql(tess)} select p_partkey, (row_number() over (partition by p_partkey order by ord) - 1)::int as k, x1::bigint as x1, y1::bigint as y1, x2::bigint as x2, y2::bigint as y2 from boxed"


_mask_query("mask_gap_boxes", False)
_mask_query("tess_boxes", True)


@query(f"""
with plain as (with {_mask_sql(False)} select p_partkey, string_agg(x1 || ' ' || y1 || ' ' || x2 || ' ' || y2 || chr(10), '' order by ord) as boxes_txt from boxed group by p_partkey),
numbered as (with {_mask_sql(True)} select *, row_number() over (partition by p_partkey order by ord) as n from boxed),
tess as (select p_partkey, string_agg(substr(p_name, n, 1) || ' ' || x1 || ' ' || y1 || ' ' || x2 || ' ' || y2 || ' 0' || chr(10), '' order by n) as tess_box from numbered join part using (p_partkey) where n <= length(p_name) group by p_partkey)
select p_partkey, boxes_txt, tess_box from plain join tess using (p_partkey)
""")
def boxes_text(spark, sf_dir):
    """Contents of the box files of every name."""
    rows = _mask_boxes(spark, sf_dir, False, True)
    return rows.select("p_partkey", naming.box_file(F.col("boxes0")).alias("boxes_txt"), naming.tess_file(F.col("boxes1"), F.col("text")).alias("tess_box")).where("size(boxes0) > 0")


_META = f"""
{_PARTS.replace("p_name as text from part", "p_name as text from part")},
parts as (select p_partkey, k, code % 7 as f, bx1, by1, bx2, by2, width, height from glyphs)"""


def part_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata documents of all names: a glyph's box goes to one field or another by its code."""
    return _metadata(part_names(spark, sf_dir))


def _split_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in train and val: keys and names are shuffled, and laid out where they came to lie."""
    return _metadata(coco.split(part_names(spark, sf_dir), SEED, key="p_partkey"), "ord", "split")


def _metadata(names: DataFrame, *more: str) -> DataFrame:
    rows = layout.laid_out(names, "text", SIZE, 2)
    array = lambda b: F.array(*(b[k].cast("int") for k in geometry.SIDES))

    def position(g):
        fields = [F.when(F.ascii(g["char"]) % 7 == k, array(g["box"])).alias(f"{f}_bbox") for k, f in enumerate(glyphs.FIELDS)]
        return F.struct(g["char"].alias("glyph_name"), array(g["box"]).alias("bbox"), *fields)

    rows = rows.withColumn("char_positions", F.transform("layout.glyphs", position))
    return rows.select(F.col("p_partkey").alias("image_id"), naming.bucket(F.col("p_partkey")).alias("bucket"), F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.col("layout.width").cast("int").alias("width"), F.col("layout.height").cast("int").alias("height"), "text", "char_positions", coco.component_boxes(F.col("char_positions")).alias("char_bboxes"), *more)


_SPLIT = f"""
splits as (
  select p_partkey, ord, case when ord < (select trunc(count(*) * 0.8)::bigint from part) then 'train' else 'val' end as split
  from (select p_partkey, row_number() over (order by {sql_u32(SEED, "'split'", "p_partkey")}, p_partkey) - 1 as ord from part))"""


@query(f"with {_SPLIT} select p_partkey as image_id, ord, split from splits")
def coco_split(spark, sf_dir):
    """Train and validation images, of exact sizes."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"))
    return coco.split(rows, SEED).select("image_id", "ord", "split")


@query(f"""
with {_META}, {_SPLIT}
select split, ord, p_partkey as id, 'base/' || format('{{:04d}}', p_partkey // 5000) || '/' || p_partkey || '.jpg' as file_name, any_value(width)::int as width, any_value(height)::int as height
from parts join splits using (p_partkey) group by split, ord, p_partkey
""")
def coco_images(spark, sf_dir):
    return coco.images(coco.with_annotations(_split_metadata(spark, sf_dir)))


@query(f"""
with {_META}, {_SPLIT},
anns as (
  select p_partkey, -1 as k, 1 as category_id, min(bx1) as x1, min(by1) as y1, max(bx2) as x2, max(by2) as y2 from parts group by p_partkey
  union all select p_partkey, k, 2, bx1, by1, bx2, by2 from parts where bx2 > bx1 and by2 > by1)
select split, row_number() over (order by ord, k) as id, p_partkey as image_id, category_id, [[x1, y1, x2, y1, x2, y2, x1, y2]] as segmentation, [x1, y1, x2 - x1, y2 - y1] as bbox, ((x2 - x1) * (y2 - y1))::bigint as area, 0 as iscrowd
from anns join splits using (p_partkey)
""")
def coco_annotations(spark, sf_dir):
    """Words and their parts with dense ids, train first."""
    return coco.annotations(coco.with_annotations(_split_metadata(spark, sf_dir)))


@query(f"""
with {_META}
select p_partkey as image_id, '{{"image_id":' || p_partkey || ',"width":' || any_value(width) || ',"char_bboxes":[' || string_agg('[' || bx1 || ',' || by1 || ',' || bx2 || ',' || by2 || ']', ',' order by k) || ']}}' as document
from parts group by p_partkey
""")
def metadata_json(spark, sf_dir):
    """Metadata documents as JSON."""
    return part_metadata(spark, sf_dir).select("image_id", F.to_json(F.struct("image_id", "width", "char_bboxes"), {"ignoreNullFields": "false"}).alias("document"))


@query(f"""
with {_META}
select p_partkey as image_id, k::int as k, f::int as field, bx1 as x1, by1 as y1, bx2 as x2, by2 as y2 from parts
""")
def component_boxes(spark, sf_dir):
    """The flattened boxes of the parts, with the field each came from."""
    rows = part_metadata(spark, sf_dir).select("image_id", "char_positions", F.posexplode("char_bboxes").alias("p", "b"))
    of = F.get("char_positions", F.col("p"))
    field = F.coalesce(*(F.when(of[f"{f}_bbox"].isNotNull(), k) for k, f in enumerate(glyphs.FIELDS)))
    return rows.select("image_id", (F.col("p") + 1).alias("k"), field.alias("field"), *(F.get("b", F.lit(k)).cast("bigint").alias(s) for k, s in enumerate(geometry.SIDES)))


# Tone lift over fixed items: (sample, order, y, bottom, top, base, upper, tone).
_ITEMS = [(s, i, 0.0, float((s * 7 + i * 5) % 11), float((s * 7 + i * 5) % 11 + 4 + s % 3), i % 5 == 0, (s + i) % 3 == 1, (s + i) % 3 == 2) for s in range(60) for i in range(9)]


@query(f"""
with recursive items as (select * from (values {", ".join(str(x).replace("True", "true").replace("False", "false") for x in _ITEMS)}) v(sid, i, y, bottom, top, base, upper, tone)),
steps as (
  select sid, -1 as i, '-inf'::double as reach, 0.0::double as out from (select distinct sid from items)
  union all
  select sid, i, case when upper or tone then greatest(start, out + top) else start end, out from (
    select *, y + case when tone and start > '-inf'::double and y + bottom < start + {layout.OVERLAP * SIZE} then start + {layout.OVERLAP * SIZE} - (y + bottom) else 0 end as out from (
      select items.*, case when base then '-inf'::double else reach end as start from steps join items on items.sid = steps.sid and items.i = steps.i + 1)))
select sid::bigint as sid, i::int as i, round(out, 6) as y from steps where i >= 0
""")
def tone_lift(spark, sf_dir):
    """Tone marks raised above what is under them."""
    rows = spark.createDataFrame(_ITEMS, "sid bigint, i int, y double, bottom double, top double, base boolean, upper boolean, tone boolean")
    lists = rows.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("i", "y", "bottom", "top", "base", "upper", "tone"))).alias("items"))
    return lists.select("sid", F.posexplode(layout.tone_lift(F.col("items"), SIZE)).alias("i", "y")).withColumn("y", F.round("y", 6))


_EM = 1000
_PLAIN = [("A", 350), ("quotesingle", 650), ("comma", -20), ("uni0E34", 700), ("uni0E38", -150), ("uni0E01", 300), ("uni0E48", 800), ("hyphen", 420), ("nikhahit", 700)]


@query(f"""
select name, middle::double as middle, case when role <> 'BASE' then role when middle > 600 then 'TONE' when middle > 400 then 'UPPER_VOWEL' when middle < 0 then 'LOWER_VOWEL' else 'BASE' end as role
from (select *, {glyphs.sql_role_of_name('name')} as role from (values {", ".join(f"({quoted(n)}, {m})" for n, m in _PLAIN)}) v(name, middle))
""")
def plain_glyph_roles(spark, sf_dir):
    rows = spark.createDataFrame([(n, float(m)) for n, m in _PLAIN], "name string, middle double")
    return rows.select("name", "middle", glyphs.simple_role(F.col("name"), F.col("middle"), F.lit(float(_EM))).alias("role"))


_COMPOSITES = [(s, float((s * 313 + i * 470) % 1100 - 150), ("BASE", "TONE", "UPPER_VOWEL")[(s + i) % 3]) for s in range(30) for i in range(1 + s % 3)]


@query(f"""
with parts as (select *, row_number() over (partition by sid order by middle, role) as k, count(*) over (partition by sid) >= 2 and min(middle) over (partition by sid) > 300 as stacked from (values {", ".join(map(str, _COMPOSITES))}) v(sid, middle, role))
select sid::bigint as sid, (k - 1)::int as k, middle::double as middle, case when stacked then case k when 1 then 'NIKHAHIT' else 'TONE' end when role = 'BASE' and middle > 500 then 'TONE' when role = 'BASE' and middle < 0 then 'LOWER_VOWEL' else role end as role from parts
""")
def ligature_roles(spark, sf_dir):
    rows = spark.createDataFrame(_COMPOSITES, "sid bigint, middle double, role string").groupBy("sid").agg(F.collect_list(F.struct("middle", "role")).alias("parts"))
    return rows.select("sid", F.posexplode(glyphs.ligature_roles(F.col("parts"), F.lit(float(_EM)))).alias("k", "p")).select("sid", "k", "p.middle", "p.role")


_CONTOURS = [(s, float(s * 13 % 40), float(y := (s * 171 + i * i * 137) % 900), float(s * 13 % 40 + 50 + i), float(y + 60)) for s in range(40) for i in range(1 + s % 4)]


@query(f"""
with c as (select *, (y1 + y2) / 2 as m from (values {", ".join(map(str, _CONTOURS))}) v(sid, x1, y1, x2, y2)),
am as (select sid, 'sara_am' as kind, case when m > 400 then 'NIKHAHIT' else 'SARA_AA' end as role, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from c group by all),
ordered as (select *, row_number() over (partition by sid order by m, x1, y1, x2, y2) as k, count(*) over (partition by sid) as n, m - lag(m) over (partition by sid order by m, x1, y1, x2, y2) as gap from c),
cuts as (select sid, coalesce(arg_max(k - 1, gap) filter (where gap = g and gap > 0), 1) as cut from (select *, max(gap) over (partition by sid) as g from ordered) group by sid),
stack as (select sid, 'stacked' as kind, case when n = 1 or k > cut then 'TONE' else 'NIKHAHIT' end as role, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from ordered join cuts using (sid) group by all)
select sid::bigint as sid, kind, role, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2 from am union all select sid, kind, role, x1, y1, x2, y2 from stack
""")
def contour_splits(spark, sf_dir):
    """Outlines split by height (SARA AM) and at the widest gap (a mark on a mark)."""
    rows = spark.createDataFrame(_CONTOURS, "sid bigint, x1 double, y1 double, x2 double, y2 double").groupBy("sid").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("c"))
    am = rows.select("sid", F.lit("sara_am").alias("kind"), F.explode(glyphs.sara_am_parts(F.col("c"), F.lit(float(_EM)))).alias("p"))
    stack = rows.select("sid", F.lit("stacked").alias("kind"), F.explode(glyphs.stacked_parts(F.col("c"))).alias("p"))
    return am.unionByName(stack).select("sid", "kind", "p.role", "p.box.*")


_GRID = (64, 96, 33.5, 1.25, 12)


@query(f"""
with g as (select kh, kw, kh / {_GRID[0] - 1}::double * 4 * pi() - 2 * pi() as x, kw / {_GRID[1] - 1}::double * 4 * pi() - 2 * pi() as y from (select range as kh from range({_GRID[0]})), (select range as kw from range({_GRID[1]})))
select kh::int as kh, kw::int as kw, round(sum(cos(sqrt(x * x + y * y) * sin(atan2(y, x) + i * pi() * 2.0 / {_GRID[4]}) * {_GRID[2]} + {_GRID[3]})) / {_GRID[4]}, 6) as z
from g, (select range as i from range({_GRID[4]})) group by kh, kw
""")
def quasicrystal_grid(spark, sf_dir):
    """The waves' mean at every pixel of a quasicrystal background."""
    h, w, frequency, phase, turns = _GRID
    grid = spark.range(h * w).select((F.col("id") / w).cast("int").alias("kh"), (F.col("id") % w).cast("int").alias("kw"))
    x, y = F.col("kh") / (h - 1) * 4 * math.pi - 2 * math.pi, F.col("kw") / (w - 1) * 4 * math.pi - 2 * math.pi
    wave = lambda i: F.cos(F.sqrt(x * x + y * y) * F.sin(F.atan2(y, x) + i * math.pi * 2 / turns) * frequency + phase)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), wave), F.lit(0.0), lambda a, v: a + v)
    return grid.select("kh", "kw", F.round(total / turns, 6).alias("z"))


@query()
def render_samples(spark, sf_dir):
    """Every name drawn on noise, slightly turned and blurred: one pass, no shuffle."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"))
    params = render.Params(skewing_angle=5, random_skew=True, blur=1, background_type=0, output_mask=1)
    return render.rendered(rows, params, SEED).select("idx", "text", "file_name", "width", "height", F.length("image").alias("image_bytes"), F.length("mask").alias("mask_bytes"), F.size("char_positions").alias("n_positions"))


@query()
def render_distorted(spark, sf_dir):
    """Every supplier's name under a sine wave both ways on a quasicrystal."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("text"))
    params = render.Params(distorsion_type=1, distorsion_orientation=2, background_type=2)
    return render.rendered(rows, params, SEED).select("idx", "file_name", "width", "height", F.sha1("image").alias("digest"))


@query()
def background_noise(spark, sf_dir):
    """Mean and spread of the paper-like noise of each customer's background."""
    rows = frontend.spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx")), "idx", 2000)

    def run(batches):
        for pdf in batches:
            stats = [raster.gaussian_noise(SIZE, 200, raster.draw(SEED, int(i), "noise")) for i in pdf["idx"]]
            yield pdf.assign(mean=[float(s.mean()) for s in stats], spread=[float(s.std()) for s in stats])

    return rows.mapInPandas(run, "idx bigint, mean double, spread double")
