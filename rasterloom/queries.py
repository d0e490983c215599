"""Queries over the plain tables that exercise the engine's operators, each with the DuckDB SQL that gives the same rows.

Doubles are rounded to at most six decimals on both sides, as engines differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import color, text
from rasterloom.kernel.color import GREYS, HUES, KNEE, TO_XYZ, WHITE
from rasterloom.operators import editing, geometry, labels, pixels, presets, scoring, tracing
from rasterloom.plans import report, settings
from rasterloom.plans.options import DEFAULT_PRESET, PRESETS
from rasterloom.sinks import pdf
from rasterloom.sinks.dxf import ACI
from rasterloom.sources import images, virtual
from rasterloom.streaming import requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WIDTH = 100


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the virtual raster, from the table's own statistics."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").count() // WIDTH


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- SQL of the colour formulas -------------------------------------------------------------------


def _linear(c: str) -> str:
    return f"CAST(CAST(CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92 ELSE pow(({c}/255.0::DOUBLE+0.055)/1.055, 2.4) END AS FLOAT) AS DOUBLE)"


def _f(row, white: float, cols: tuple[str, str, str]) -> str:
    t = "((" + " + ".join(f"{float(k)!r}::DOUBLE*{c}" for k, c in zip(row, cols)) + f")/{float(white)!r}::DOUBLE)"
    return f"(CASE WHEN {t} > {KNEE**3!r} THEN cbrt({t}) ELSE {t}/{3 * KNEE**2!r} + {4 / 29!r} END)"


def _lab_cte(source: str, out: str = "lab") -> str:
    """Adds L, a_, b_ to a relation with r, g, b."""
    cols = ("lr", "lg", "lb")
    fs = [_f(row, w, cols) for row, w in zip(TO_XYZ, WHITE)]
    return (
        f"{out}_lin AS (SELECT *, {_linear('r')} AS lr, {_linear('g')} AS lg, {_linear('b')} AS lb FROM {source}), "
        f"{out}_f AS (SELECT *, {fs[0]} AS fx, {fs[1]} AS fy, {fs[2]} AS fz FROM {out}_lin), "
        f"{out} AS (SELECT *, 116*fy-16 AS \"L\", 500*(fx-fy) AS a_, 200*(fy-fz) AS b_ FROM {out}_f)"
    )


_DELTA_STEPS = """
d1 AS (SELECT *, 0.5*(1 - sqrt(pow((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2,7)/(pow((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2,7)+6103515625.0))) AS g FROM d0),
d2 AS (SELECT *, (1+g)*a1 AS p1, (1+g)*a2 AS p2 FROM d1),
d3 AS (SELECT *, sqrt(p1*p1+b1*b1) AS c1, sqrt(p2*p2+b2*b2) AS c2,
  CASE WHEN p1=0 AND b1=0 THEN 0 WHEN degrees(atan2(b1,p1))<0 THEN degrees(atan2(b1,p1))+360 ELSE degrees(atan2(b1,p1)) END AS h1,
  CASE WHEN p2=0 AND b2=0 THEN 0 WHEN degrees(atan2(b2,p2))<0 THEN degrees(atan2(b2,p2))+360 ELSE degrees(atan2(b2,p2)) END AS h2 FROM d2),
d4 AS (SELECT *, CASE WHEN c1*c2=0 THEN 0 WHEN h2-h1>180 THEN h2-h1-360 WHEN h2-h1<-180 THEN h2-h1+360 ELSE h2-h1 END AS dh,
  CASE WHEN c1*c2=0 THEN h1+h2 WHEN abs(h2-h1)<=180 THEN (h1+h2)/2 WHEN h1+h2<360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS hm,
  (l1+l2)/2 AS lm, (c1+c2)/2 AS cm FROM d3),
d5 AS (SELECT *, 1-0.17*cos(radians(hm-30))+0.24*cos(radians(2*hm))+0.32*cos(radians(3*hm+6))-0.2*cos(radians(4*hm-63)) AS t FROM d4),
d6 AS (SELECT *, (l2-l1)/(1+0.015*(lm-50)*(lm-50)/sqrt(20+(lm-50)*(lm-50))) AS ea, (c2-c1)/(1+0.045*cm) AS eb,
  2*sqrt(c1*c2)*sin(radians(dh)/2)/(1+0.015*cm*t) AS ec,
  -2*sqrt(pow(cm,7)/(pow(cm,7)+6103515625.0))*sin(radians(60*exp(-((hm-275)/25)*((hm-275)/25)))) AS rt FROM d5),
de AS (SELECT *, sqrt(greatest(0, ea*ea+eb*eb+ec*ec+rt*eb*ec)) AS delta FROM d6)"""


def _name_sql() -> str:
    light, chroma = "((greatest(r,g,b)+least(r,g,b))/2.0::DOUBLE/255.0::DOUBLE)", "((greatest(r,g,b)-least(r,g,b))/255.0::DOUBLE)"
    hue = "(CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END)"
    grey = "CASE " + " ".join(f"WHEN {light} > {least} THEN '{n}'" for least, n in GREYS) + " ELSE 'Black' END"
    base = "CASE " + " ".join(f"WHEN {hue} < {limit} THEN '{n}'" for limit, n in HUES) + " ELSE 'Red' END"
    kind = f"CASE WHEN {light}>0.82 THEN 'Pale ' WHEN {light}>0.62 THEN 'Light ' WHEN {light}<0.2 THEN 'Deep ' WHEN {light}<0.38 THEN 'Dark ' WHEN {chroma}>0.7 THEN 'Vivid ' ELSE '' END"
    return f"CASE WHEN {chroma} < 0.08 THEN {grey} ELSE {kind} || {base} END"


_HUE = """60*CASE WHEN greatest(r,g,b)=least(r,g,b) THEN 0 WHEN greatest(r,g,b)=r THEN (g-b)/(greatest(r,g,b)-least(r,g,b))::DOUBLE
  WHEN greatest(r,g,b)=g THEN 2+(b-r)/(greatest(r,g,b)-least(r,g,b))::DOUBLE ELSE 4+(r-g)/(greatest(r,g,b)-least(r,g,b))::DOUBLE END"""


@query(
    f"""WITH {virtual.COLORS_SQL}, hued AS (SELECT *, {_HUE} AS h0 FROM c), {_lab_cte('hued')}
    SELECT id, round("L", 6) AS l, round(a_, 6) AS a, round(b_, 6) AS b, '#' || printf('%06x', r*65536+g*256+b) AS hex, {_name_sql()} AS name,
      round(0.2126*lr+0.7152*lg+0.0722*lb, 6) AS luminance, round(0.299*r+0.587*g+0.114*b, 6) AS luma,
      CAST(r*65536+g*256+b AS INT) AS rgb24, CAST((r//8)*1024+(g//8)*32+b//8 AS INT) AS rgb15, r AS back_r, g AS back_g, b AS back_b
    FROM lab"""
)
def color_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar colour function on a table of colours; Lab and back gives the same RGB."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    lab = color.rgb_to_lab(r, g, b)
    c = virtual.colors(spark, sf_dir).withColumn("lab", lab).withColumn("back", color.lab_to_rgb(F.col("lab")))
    return c.select(
        "id", F.round("lab.L", 6).alias("l"), F.round("lab.a", 6).alias("a"), F.round("lab.b", 6).alias("b"), color.to_hex(r, g, b).alias("hex"), color.color_name(r, g, b).alias("name"),
        F.round(color.luminance(r, g, b), 6).alias("luminance"), F.round(color.luma(r, g, b), 6).alias("luma"), color.pack24(r, g, b).alias("rgb24"), color.pack15(r, g, b).alias("rgb15"),
        F.col("back.r").alias("back_r"), F.col("back.g").alias("back_g"), F.col("back.b").alias("back_b"),
    )


@query(
    f"""WITH {virtual.PALETTE_SQL}, {_lab_cte('pal')},
    d0 AS (SELECT p.idx AS i, q.idx AS j, p.weight AS wi, q.weight AS wj, p."L" AS l1, p.a_ AS a1, p.b_ AS b1, q."L" AS l2, q.a_ AS a2, q.b_ AS b2 FROM lab p JOIN lab q ON p.idx < q.idx), {_DELTA_STEPS}
    SELECT CASE WHEN wi >= wj THEN i ELSE j END AS keep, CASE WHEN wi >= wj THEN j ELSE i END AS absorb, round(delta, 2) AS delta_e FROM de WHERE delta < 12"""
)
def suggest_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a palette nearer than a CIEDE2000 threshold."""
    return editing.suggest_merges(virtual.palette(spark, sf_dir), 12.0)


_ACI_VALUES = ", ".join(f"({i}, {aci}, {c[0]}, {c[1]}, {c[2]})" for i, (aci, c) in enumerate(ACI))


@query(
    f"""WITH {virtual.COLORS_SQL}, aci(o, aci, cr, cg, cb) AS (VALUES {_ACI_VALUES})
    SELECT id, CAST(arg_min(aci, ((r-cr)*(r-cr)+(g-cg)*(g-cg)+(b-cb)*(b-cb))*100+o) AS INT) AS aci FROM c, aci GROUP BY id"""
)
def nearest_aci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest entry of the drawing-exchange colour index."""
    return virtual.colors(spark, sf_dir).select("id", color.nearest_aci(F.col("r"), F.col("g"), F.col("b")).cast("int").alias("aci"))


@query(
    f"""WITH {virtual.RGBA_SQL}, h AS (SELECT CAST(r*65536+g*256+b AS INT) AS rgb, count(*) AS n, min(p) AS first_p FROM px WHERE a >= 128 GROUP BY 1)
    SELECT rgb, n, first_p, CAST(row_number() OVER (ORDER BY n DESC, first_p) AS INT) AS rank FROM h"""
)
def exact_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct opaque colours by frequency, ties by first pixel."""
    return pixels.exact_histogram(virtual.rgba_pixels(spark, sf_dir)).select("rgb", "n", "first_p", "rank")


@query(
    f"""WITH {virtual.RGBA_SQL}, d AS (SELECT r, g, b, count(*) AS n FROM px WHERE a >= 128 GROUP BY 1, 2, 3), {_lab_cte('d')}
    SELECT CAST((r//8)*1024+(g//8)*32+b//8 AS INT) AS bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(r*n) AS BIGINT) AS sum_r, CAST(sum(g*n) AS BIGINT) AS sum_g, CAST(sum(b*n) AS BIGINT) AS sum_b,
      round(sum("L"*n), 4) AS sum_lab_l, round(sum(a_*n), 4) AS sum_lab_a, round(sum(b_*n), 4) AS sum_lab_b FROM lab GROUP BY 1"""
)
def coarse_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over 15-bit colour bins, Lab computed once for each distinct colour."""
    h = pixels.coarse_histogram(virtual.rgba_pixels(spark, sf_dir))
    return h.select("bin", "n", "sum_r", "sum_g", "sum_b", *(F.round(f"sum_lab_{c}", 4).alias(f"sum_lab_{c}") for c in "lab"))


@query(
    f"""WITH {virtual.RGBA_SQL} SELECT CASE WHEN a >= 100 THEN 255 ELSE 0 END AS a, count(*) AS n, CAST(count_if(a >= 128) AS BIGINT) AS opaque, CAST(sum(r) AS BIGINT) AS red FROM px GROUP BY 1"""
)
def harden_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha made all or nothing."""
    px = virtual.rgba_pixels(spark, sf_dir).withColumn("was", F.col("a"))
    return pixels.harden_alpha(px, 100).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("was") >= 128).alias("opaque"), F.sum("r").alias("red"))


@query(
    f"""WITH {virtual.RGBA_SQL}, dims AS (SELECT count(*) // 100 AS h FROM events), s AS (SELECT h, greatest(100, h) AS m, 30.0::DOUBLE / greatest(100, h) AS f FROM dims),
    o AS (SELECT h, CAST(floor(100*f+0.5) AS INT) AS ow, greatest(1, CAST(floor(h*f+0.5) AS INT)) AS oh FROM s),
    cells AS (SELECT ox, oy, CAST(floor(ox*(100.0::DOUBLE/ow)) AS INT) AS x0, least(100, greatest(CAST(floor(ox*(100.0::DOUBLE/ow)) AS INT)+1, CAST(ceil((ox+1)*(100.0::DOUBLE/ow)) AS INT))) AS x1,
      CAST(floor(oy*(h::DOUBLE/oh)) AS INT) AS y0, least(h, greatest(CAST(floor(oy*(h::DOUBLE/oh)) AS INT)+1, CAST(ceil((oy+1)*(h::DOUBLE/oh)) AS INT))) AS y1
      FROM o, (SELECT unnest(range(0, 100)) AS ox) xs, (SELECT unnest(range(0, 1000)) AS oy) ys WHERE ox < ow AND oy < oh),
    t AS (SELECT ox, oy, sum(r*a) AS sr, sum(g*a) AS sg, sum(b*a) AS sb, sum(a) AS sa, count(*) AS n FROM cells JOIN px ON px.x >= x0 AND px.x < x1 AND px.y >= y0 AND px.y < y1 GROUP BY 1, 2)
    SELECT CAST(ox AS INT) AS x, CAST(oy AS INT) AS y, CASE WHEN sa=0 THEN 0 ELSE CAST(floor(sr/sa::DOUBLE+0.5) AS INT) END AS r, CASE WHEN sa=0 THEN 0 ELSE CAST(floor(sg/sa::DOUBLE+0.5) AS INT) END AS g,
      CASE WHEN sa=0 THEN 0 ELSE CAST(floor(sb/sa::DOUBLE+0.5) AS INT) END AS b, CAST(floor(sa/n::DOUBLE+0.5) AS INT) AS a FROM t"""
)
def downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area average with alpha-weighted colours."""
    return pixels.downscale(virtual.rgba_pixels(spark, sf_dir), WIDTH, _height(spark, sf_dir), 30).drop("image_id")


@query(
    f"""WITH {virtual.RGBA_SQL}, o AS (SELECT unnest([-1,0,1]) AS dx), o2 AS (SELECT unnest([-1,0,1]) AS dy),
    w AS (SELECT c.p, c.x, c.y, c.a, c.r AS r0, c.g AS g0, c.b AS b0, n.r, n.g, n.b FROM px c, o, o2, px n WHERE n.x = c.x+dx AND n.y = c.y+dy AND n.a > 0),
    m AS (SELECT p, list_sort(list(r)) AS rs, list_sort(list(g)) AS gs, list_sort(list(b)) AS bs FROM w GROUP BY p)
    SELECT x, y, CASE WHEN a=0 THEN px.r ELSE rs[len(rs)//2+1] END AS r, CASE WHEN a=0 THEN px.g ELSE gs[len(gs)//2+1] END AS g, CASE WHEN a=0 THEN px.b ELSE bs[len(bs)//2+1] END AS b, a FROM px LEFT JOIN m USING (p)"""
)
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of a 3x3 window over visible pixels."""
    return pixels.median(virtual.rgba_pixels(spark, sf_dir), WIDTH, _height(spark, sf_dir)).drop("image_id")


@query(
    f"""WITH {virtual.RGBA_SQL}, o AS (SELECT unnest([-1,0,1]) AS dx), o2 AS (SELECT unnest([-1,0,1]) AS dy), dims AS (SELECT count(*)//100 AS h FROM events),
    w AS (SELECT c.p, c.r, c.g, c.b, dx, dy, n.a AS na, n.r AS nr, n.g AS ng, n.b AS nb FROM px c, dims, o, o2, px n WHERE c.x BETWEEN 1 AND 98 AND c.y BETWEEN 1 AND h-2 AND n.x=c.x+dx AND n.y=c.y+dy),
    s AS (SELECT p, min(na) AS la, min(least(nr,ng,nb)) AS low, max(greatest(nr,ng,nb)) AS high,
      min(CASE WHEN dx<>0 OR dy<>0 THEN 0.299*nr+0.587*ng+0.114*nb END) AS ll, max(CASE WHEN dx<>0 OR dy<>0 THEN 0.299*nr+0.587*ng+0.114*nb END) AS lh, any_value(0.299*r+0.587*g+0.114*b) AS lc,
      abs(any_value(r)-median(CASE WHEN dy=0 THEN nr END))+abs(any_value(g)-median(CASE WHEN dy=0 THEN ng END))+abs(any_value(b)-median(CASE WHEN dy=0 THEN nb END)) AS dev FROM w GROUP BY p HAVING min(na)>=250),
    t AS (SELECT count(*) AS os, CAST(count_if(lc > lh+4 OR lc < ll-4) AS BIGINT) AS oc, CAST(sum(CASE WHEN high-low<=24 THEN 3 ELSE 0 END) AS BIGINT) AS fs, CAST(sum(CASE WHEN high-low<=24 THEN dev ELSE 0 END) AS BIGINT) AS d FROM s)
    SELECT fs AS flat_samples, os AS overshoot_samples, oc AS overshoots, d AS deviation, round(least(1.0, greatest(CASE WHEN fs>0 THEN d/fs::DOUBLE/12/0.02 ELSE 0 END, oc/os::DOUBLE/0.006)), 6) AS noise FROM t"""
)
def noise_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation in flat windows and overshoot of neighbours."""
    n = pixels.noise(virtual.rgba_pixels(spark, sf_dir), WIDTH, _height(spark, sf_dir))
    return n.select("flat_samples", "overshoot_samples", "overshoots", "deviation", F.round("noise", 6).alias("noise"))


_EDGE_SQL = f"""WITH {virtual.RGBA_SQL}, e AS (SELECT *, lead(r) OVER xr AS r1, lead(g) OVER xr AS g1, lead(b) OVER xr AS b1, lead(r) OVER yd AS r2, lead(g) OVER yd AS g2, lead(b) OVER yd AS b2 FROM px
      WINDOW xr AS (PARTITION BY y ORDER BY x), yd AS (PARTITION BY x ORDER BY y)),
    d AS (SELECT *, greatest(coalesce(greatest(abs(r-r1),abs(g-g1),abs(b-b1)),0), coalesce(greatest(abs(r-r2),abs(g-g2),abs(b-b2)),0)) AS d FROM e),
    m AS (SELECT CAST(count_if(a>=128) AS BIGINT) AS opaque, CAST(count_if(a<128) AS BIGINT) AS transparent, CAST(count_if(a>=128 AND d=0) AS BIGINT) AS flat, CAST(count_if(a>=128 AND d>0 AND d<=10) AS BIGINT) AS soft, CAST(count_if(a>=128 AND d>=40) AS BIGINT) AS hard,
      count(DISTINCT CASE WHEN a>=128 THEN r*65536+g*256+b END) AS colors FROM d)"""


@query(f"{_EDGE_SQL} SELECT * FROM m")
def edge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat, soft and hard transitions and distinct colours, whose shares the analyzer reports."""
    return pixels.edges(virtual.rgba_pixels(spark, sf_dir)).drop("image_id")


@query(
    f"""{_EDGE_SQL}, q AS (SELECT flat/greatest(1,opaque)::DOUBLE AS f, soft/greatest(1,opaque)::DOUBLE AS s, hard/greatest(1,opaque)::DOUBLE AS hd, transparent/(opaque+transparent)::DOUBLE AS t, colors, (SELECT count(*)//100 FROM events) AS h FROM m),
    c AS (SELECT *, CASE WHEN f<0.2 AND s>0.55 OR colors>=20000 AND f<0.35 THEN 'photo' WHEN f>=0.6 THEN CASE WHEN colors<=8 THEN 'line-art' ELSE 'flat-art' END
      WHEN f>=0.3 THEN CASE WHEN s>0.45 OR colors>4000 THEN 'gradient-art' ELSE 'flat-art' END WHEN s>0.4 THEN 'gradient-art' ELSE 'unknown' END AS k FROM q),
    p AS (SELECT *, CAST(greatest(0, least(100, CASE k WHEN 'line-art' THEN 92 WHEN 'flat-art' THEN 70+floor(f*25+0.5) WHEN 'gradient-art' THEN 45+floor(f*25+0.5)-floor(s*15+0.5) WHEN 'photo' THEN 12 ELSE 45 END
      - CASE WHEN least(100,h)<64 THEN 25 WHEN least(100,h)<128 THEN 12 WHEN least(100,h)<200 THEN 5 ELSE 0 END - CASE WHEN colors>=20000 AND k<>'photo' THEN 8 ELSE 0 END)) AS INT) AS score FROM c)
    SELECT round(f,4) AS flat_ratio, round(s,4) AS soft_ratio, round(hd,4) AS hard_ratio, round(t,4) AS transparent_ratio, colors, k AS classification, score,
      CASE WHEN score>=80 THEN 'excellent' WHEN score>=62 THEN 'good' WHEN score>=35 THEN 'fair' ELSE 'poor' END AS suitability FROM p"""
)
def analyze_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the raster suits tracing: ratios, class, score, verdict."""
    m = scoring.ratios(pixels.edges(virtual.rgba_pixels(spark, sf_dir)))
    out = scoring.classified(m, F.lit(WIDTH), F.lit(_height(spark, sf_dir)))
    return out.select(*(F.round(c, 4).alias(c) for c in ("flat_ratio", "soft_ratio", "hard_ratio", "transparent_ratio")), "colors", "classification", "score", "suitability")


def _four(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(virtual.COLORS)], "idx int, r int, g int, b int")


_FOUR = "four(idx, r, g, b) AS (VALUES " + ", ".join(f"({i}, {c[0]}, {c[1]}, {c[2]})" for i, c in enumerate(virtual.COLORS)) + ")"


@query(
    f"""WITH {virtual.RGBA_SQL}, {_FOUR}, {_lab_cte('four', 'fl')}, op AS (SELECT *, r*65536+g*256+b AS rgb, (r//8)*1024+(g//8)*32+b//8 AS bin FROM px WHERE a >= 128),
    ex AS (SELECT r*65536+g*256+b AS rgb, max(idx) AS e FROM four GROUP BY 1), k AS (SELECT op.*, e FROM op LEFT JOIN ex USING (rgb)),
    fst AS (SELECT bin, arg_min(r, p) AS r, arg_min(g, p) AS g, arg_min(b, p) AS b FROM k WHERE e IS NULL GROUP BY bin), {_lab_cte('fst', 'sl')},
    nn AS (SELECT sl.bin, arg_min(fl.idx, round((sl."L"-fl."L")*(sl."L"-fl."L")+(sl.a_-fl.a_)*(sl.a_-fl.a_)+(sl.b_-fl.b_)*(sl.b_-fl.b_), 9)*10+fl.idx*1e-9) AS idx FROM sl, fl GROUP BY 1)
    SELECT CAST(coalesce(e, nn.idx) AS INT) AS label, count(*) AS n, min(p) AS first_p, CAST(sum(p) AS BIGINT) AS sum_p FROM k LEFT JOIN nn USING (bin) GROUP BY 1"""
)
def assign_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact entries by an equi-join, the rest by the nearest entry for each 15-bit key."""
    got = pixels.assign_palette(virtual.rgba_pixels(spark, sf_dir), _four(spark))
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("first_p"), F.sum("p").alias("sum_p"))


_RUNS = """s AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY y ORDER BY x) IS DISTINCT FROM k THEN 1 ELSE 0 END AS st FROM {px}),
  r AS (SELECT *, sum(st) OVER (PARTITION BY y ORDER BY x) AS rn FROM s),
  runs AS (SELECT y, rn, min(x) AS x0, max(x) AS x1, any_value(k) AS k, min(p) AS p0 FROM r GROUP BY y, rn),
  te AS (SELECT a.p0 AS a, b.p0 AS b FROM runs a JOIN runs b ON b.y = a.y+1 AND a.k = b.k AND a.x0 <= b.x1 AND b.x0 <= a.x1),
  ed AS (SELECT a, b FROM te UNION SELECT b, a FROM te),
  reach(a, root) AS (SELECT p0, p0 FROM runs UNION SELECT ed.b, reach.root FROM reach JOIN ed ON ed.a = reach.a),
  roots AS (SELECT a AS p0, min(root) AS root FROM reach GROUP BY a),
  rr AS (SELECT runs.*, root FROM runs JOIN roots USING (p0))"""


def _regions_sql(px: str) -> str:
    return _RUNS.format(px=px) + ", reg AS (SELECT root, any_value(k) AS k, CAST(sum(x1-x0+1) AS BIGINT) AS area, min(x0) AS min_x, min(y) AS min_y, max(x1) AS max_x, max(y) AS max_y FROM rr GROUP BY root)"


_REGION_COLUMNS = "SELECT CAST(row_number() OVER (ORDER BY root) - 1 AS INT) AS region_id, root, k, area, min_x, min_y, max_x, max_y FROM reg"


@query(f"WITH RECURSIVE {virtual.NOISE_SQL}, {_regions_sql('noise')} {_REGION_COLUMNS}")
def region_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of a label map from its row runs, with area and bounds."""
    return labels.regions(labels.run_roots(virtual.noise_map(spark, sf_dir))).drop("image_id")


@query(f"WITH RECURSIVE {virtual.ART_SQL}, {_regions_sql('art')} {_REGION_COLUMNS}")
def region_components_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one image spread over all tasks: least roots with pointer jumping."""
    return labels.regions(labels.run_roots_distributed(virtual.art(spark, sf_dir).drop("user_id"))).drop("image_id")


_DESPECKLED = """ar AS (SELECT root, sum(x1-x0+1) AS area FROM rr GROUP BY root), px2 AS (SELECT q.p, q.x, q.y, q.k, rr.root FROM {px} q JOIN rr ON rr.y = q.y AND q.x BETWEEN rr.x0 AND rr.x1),
  nb AS (SELECT a.root, b.k AS nk, a.p*4+o.side AS seen FROM px2 a, (VALUES (0,-1,0),(1,1,0),(2,0,-1),(3,0,1)) o(side, dx, dy), px2 b WHERE b.x = a.x+dx AND b.y = a.y+dy AND b.root <> a.root),
  bl AS (SELECT root, nk, count(*) AS len, min(seen) AS seen FROM nb GROUP BY 1, 2),
  win AS (SELECT root, nk FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY len DESC, seen) AS rk FROM bl) WHERE rk = 1)"""


@query(
    f"""WITH RECURSIVE {virtual.NOISE_SQL}, {_RUNS.format(px='noise')}, {_DESPECKLED.format(px='noise')}
    SELECT x, y, CASE WHEN ar.area < 4 THEN coalesce(win.nk, px2.k) ELSE px2.k END AS k FROM px2 JOIN ar USING (root) LEFT JOIN win USING (root)"""
)
def despeckle_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of speck removal: small regions take the label they border longest."""
    px = virtual.noise_map(spark, sf_dir)
    return labels.despeckle_once(px, labels.run_roots(px), 4).select("x", "y", "k")


@query(
    f"""WITH {virtual.ART_SQL}, nb AS (SELECT a.p, b.k, count(*) AS n FROM art a, (VALUES (-1,-1),(0,-1),(1,-1),(-1,0),(1,0),(-1,1),(0,1),(1,1)) o(dx, dy), art b WHERE b.x = a.x+dx AND b.y = a.y+dy GROUP BY 1, 2),
    w AS (SELECT p, k FROM nb WHERE n >= 6) SELECT x, y, coalesce(w.k, art.k) AS k FROM art LEFT JOIN w USING (p)"""
)
def smooth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority of the 8 neighbours."""
    return labels.smooth_once(virtual.art(spark, sf_dir), WIDTH, _height(spark, sf_dir)).select("x", "y", "k")


_BORDER = "bc AS (SELECT k, count(*) AS n FROM art, (SELECT count(*)//100 AS h FROM events) WHERE x IN (0, 99) OR y = 0 OR y = h-1 GROUP BY k)"
_BACKDROP = f"""{_BORDER}, bt AS (SELECT arg_max(k, n*10-k) AS k, max(n) AS n FROM bc WHERE k >= 0),
  wh AS (SELECT k, max(area)::DOUBLE/sum(area) AS ws FROM reg GROUP BY k),
  bd AS (SELECT bt.k, bt.n::DOUBLE/(SELECT sum(n) FROM bc) AS bs, ws FROM bt JOIN wh USING (k))"""


@query(
    f"""WITH RECURSIVE {virtual.ART_SQL}, {_regions_sql('art')}, {_BACKDROP} SELECT k, round(bs, 6) AS border_share, round(ws, 6) AS whole_share, bs >= 0.7 AND ws >= 0.6 AS is_backdrop FROM bd"""
)
def detect_backdrop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest border label, its share of the border and of itself."""
    px = virtual.art(spark, sf_dir)
    found = labels.backdrop(px, labels.run_roots(px), WIDTH, _height(spark, sf_dir))
    return found.select("k", F.round("border_share", 6).alias("border_share"), F.round("whole_share", 6).alias("whole_share"), "is_backdrop")


@query(
    f"""WITH {virtual.ART_SQL}, h AS (SELECT count(*)//100 AS h FROM events) SELECT k, CAST(sum(CAST(x=0 AS INT)+CAST(x=99 AS INT)+CAST(y=0 AS INT)+CAST(y=h-1 AS INT)) AS BIGINT) AS n FROM art, h WHERE x IN (0,99) OR y=0 OR y=h-1 GROUP BY k"""
)
def border_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels along the border with corners counted for both sides."""
    return labels.border_counts(virtual.art(spark, sf_dir), WIDTH, _height(spark, sf_dir), True).select("k", "n")


_LAYERS = f"""WITH RECURSIVE {virtual.ART_SQL}, {_regions_sql('art')}, {_BACKDROP}, hh AS (SELECT count(*)//100 AS h FROM events),
  tb AS (SELECT DISTINCT root FROM rr, hh WHERE x0 = 0 OR x1 = 99 OR y = 0 OR y = h-1),
  kept AS (SELECT reg.* FROM reg WHERE k >= 0 AND NOT (k IN (SELECT k FROM bd WHERE bs >= 0.7 AND ws >= 0.6) AND root IN (SELECT root FROM tb))),
  lay AS (SELECT k, count(*) AS pieces, CAST(sum(area) AS BIGINT) AS area FROM kept GROUP BY k), {_FOUR},
  c AS (SELECT lay.*, r, g, b FROM lay JOIN four ON idx = k), hued AS (SELECT *, {_HUE} AS h0 FROM c), nm AS (SELECT *, {_name_sql()} AS nm FROM hued)
  SELECT CAST(row_number() OVER (ORDER BY area DESC, k) AS INT) AS rank, '#' || printf('%06x', r*65536+g*256+b) AS hex,
    CASE WHEN count(*) OVER (PARTITION BY nm) > 1 THEN nm || ' ' || row_number() OVER (PARTITION BY nm ORDER BY area DESC, k) ELSE nm END AS name,
    pieces, area, round(area::DOUBLE/sum(area) OVER (), 4) AS area_share FROM nm"""


@query(_LAYERS)
def color_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What colour layers the raster has without its backdrop, with pieces, area and names."""
    px, h = virtual.art(spark, sf_dir), _height(spark, sf_dir)
    rooted = labels.run_roots(px)
    clean = labels.remove_backdrop(rooted, labels.backdrop(px, rooted, WIDTH, h), WIDTH, h).where("k >= 0")
    return editing.layers(labels.regions(clean), _four(spark)).drop("image_id")


_CRACKS = """q AS (SELECT x, y, k FROM art UNION ALL SELECT x, -1, -1 FROM (SELECT DISTINCT x FROM art) UNION ALL SELECT x, h, -1 FROM (SELECT DISTINCT x FROM art), hh
    UNION ALL SELECT -1, y, -1 FROM (SELECT DISTINCT y FROM art) UNION ALL SELECT 100, y, -1 FROM (SELECT DISTINCT y FROM art)),
  cr AS (SELECT b.x AS x, b.y AS y, 'h' AS kind, a.k AS a, b.k AS b FROM q a JOIN q b ON b.x = a.x AND b.y = a.y+1 WHERE a.k <> b.k AND a.x BETWEEN 0 AND 99
    UNION ALL SELECT b.x, b.y, 'v', a.k, b.k FROM q a JOIN q b ON b.y = a.y AND b.x = a.x+1, hh WHERE a.k <> b.k AND a.y BETWEEN 0 AND h-1)"""


@query(
    f"""WITH {virtual.ART_SQL}, hh AS (SELECT count(*)//100 AS h FROM events), {_CRACKS} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, kind, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM cr"""
)
def crack_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice edges between cells of different labels."""
    return labels.cracks(virtual.art(spark, sf_dir), WIDTH, _height(spark, sf_dir)).drop("image_id")


@query(
    f"""WITH {virtual.ART_SQL}, hh AS (SELECT count(*)//100 AS h FROM events), {_CRACKS},
    v AS (SELECT x, y FROM cr UNION ALL SELECT CASE WHEN kind='h' THEN x+1 ELSE x END, CASE WHEN kind='h' THEN y ELSE y+1 END FROM cr)
    SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, count(*) AS degree, count(*) > 2 AS is_node FROM v GROUP BY 1, 2"""
)
def boundary_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice points on boundaries and which of them are junctions."""
    return labels.vertices(labels.cracks(virtual.art(spark, sf_dir), WIDTH, _height(spark, sf_dir))).drop("image_id")


@query(
    f"""WITH RECURSIVE {virtual.ART_SQL}, {_regions_sql('art')}, o AS (SELECT CAST(row_number() OVER (ORDER BY root) - 1 AS INT) AS region_id, * FROM reg)
    SELECT region_id, k, CAST(area AS DOUBLE) AS signed_area, CAST(1 AS BIGINT) AS outlines FROM o WHERE k >= 0"""
)
def loop_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary loops of every region: one outline each, and signed areas that add up to the region's pixels."""
    found = tracing.loops(virtual.art(spark, sf_dir))
    return found.groupBy("region_id", "k").agg(F.sum("signed_area").alias("signed_area"), F.count_if(~F.col("is_hole")).alias("outlines"))


@query(
    f"""WITH {virtual.ART_SQL}, i AS (SELECT x, y FROM art WHERE k = 2), o AS (SELECT x, y FROM art WHERE k <> 2)
    SELECT i.x, i.y, CAST(min((i.x-o.x)*(i.x-o.x)+(i.y-o.y)*(i.y-o.y)) AS DOUBLE) AS distance_squared FROM i, o GROUP BY i.x, i.y"""
)
def distance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact squared distances inside the bars."""
    return tracing.distance_field(virtual.art(spark, sf_dir), 2).drop("image_id")


@query()
def fitted_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains fitted once and joined to both regions that share them."""
    px = virtual.art(spark, sf_dir)
    return tracing.loop_nodes(tracing.loops(px), tracing.fit_chains(tracing.chains(px))).drop("image_id")


@query()
def skeleton_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre lines of the bars."""
    b = tracing.skeleton(virtual.art(spark, sf_dir), 2)
    return b.select("branch_id", F.size("points").alias("points"), "closed", "free_ends", F.round("length", 6).alias("length"))


@query(
    f"""WITH {virtual.COLORS_SQL}, u AS (SELECT CAST((r*7+g*3) % 256 AS INT) AS idx, r % 5 AS n FROM c), t AS (SELECT idx, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cnt FROM u GROUP BY idx)
    SELECT idx, cnt, CAST(row_number() OVER (ORDER BY idx) - 1 AS INT) AS dense FROM t WHERE cnt > 0"""
)
def prune_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette rows without pixels dropped, the rest numbered densely."""
    u = virtual.colors(spark, sf_dir).selectExpr("CAST((r*7+g*3) % 256 AS INT) AS idx", "r % 5 AS n")
    counts = u.groupBy(F.lit("v").alias("image_id"), "idx").agg(F.count_if(F.col("n") == 0).alias("cnt"))
    return editing.prune_palette(counts).drop("image_id")


_AROUND = f"""WITH {virtual.POINTS_SQL}, w AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n, max(i) OVER (PARTITION BY line_id) AS li,
    coalesce(lag(x) OVER o, last_value(x) OVER f) AS px_, coalesce(lag(y) OVER o, last_value(y) OVER f) AS py_, coalesce(lead(x) OVER o, first_value(x) OVER f) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER f) AS ny
    FROM pts WINDOW o AS (PARTITION BY line_id ORDER BY i), f AS (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(
    f"""{_AROUND}, t AS (SELECT *, abs((x-px_)*(ny-y)-(y-py_)*(nx-x)) > 1e-9 AS tu FROM w), c AS (SELECT *, count_if(tu) OVER (PARTITION BY line_id) AS kept FROM t) SELECT line_id, i, x, y FROM c WHERE tu OR kept < 3"""
)
def remove_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices at which closed polylines turn."""
    return geometry.remove_collinear(virtual.polylines(spark, sf_dir), "line_id")


@query(
    f"""{_AROUND} SELECT line_id, any_value(n) AS n, sum(x*ny-nx*y)/2.0::DOUBLE AS signed_area, round(sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))), 6) AS perimeter,
      round(coalesce(sum(CASE WHEN i<>li THEN sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) END), 0), 6) AS open_length, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM w GROUP BY line_id"""
)
def polyline_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed area, lengths and bounds of polylines."""
    m = geometry.measures(virtual.polylines(spark, sf_dir), "line_id")
    return m.withColumn("perimeter", F.round("perimeter", 6)).withColumn("open_length", F.round("open_length", 6))


@query(
    f"""WITH {virtual.POINTS_SQL}, s AS (SELECT *, lead(x) OVER o - x AS dx, lead(y) OVER o - y AS dy FROM pts WINDOW o AS (PARTITION BY line_id ORDER BY i)),
    t AS (SELECT *, lag(dx) OVER o AS bx, lag(dy) OVER o AS by_, lag(i) OVER o AS bi FROM s WINDOW o AS (PARTITION BY line_id ORDER BY i)) SELECT line_id, i, x, y FROM t WHERE bi IS NULL OR dx IS NULL OR dx <> bx OR dy <> by_"""
)
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of straight runs."""
    return geometry.collapse_runs(virtual.polylines(spark, sf_dir), "line_id")


@query(
    f"""WITH {virtual.POINTS_SQL}, s AS (SELECT *, coalesce(sqrt((x-lag(x) OVER o)*(x-lag(x) OVER o)+(y-lag(y) OVER o)*(y-lag(y) OVER o)), 0) AS st FROM pts WINDOW o AS (PARTITION BY line_id ORDER BY i)),
    t AS (SELECT *, sum(st) OVER (PARTITION BY line_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run, sum(st) OVER (PARTITION BY line_id) AS tot, count(*) OVER (PARTITION BY line_id) AS n FROM s),
    u AS (SELECT *, CASE WHEN tot > 0 THEN run/tot WHEN n > 1 THEN i/(n-1)::DOUBLE ELSE 0 END AS u FROM t) SELECT line_id, i, round(u, 6) AS u, round(max(u) OVER (PARTITION BY line_id ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS u_monotone FROM u"""
)
def chord_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised arc length at each vertex."""
    c = geometry.chord_parameters(virtual.polylines(spark, sf_dir), "line_id")
    return c.select("line_id", "i", F.round("u", 6).alias("u"), F.round("u_monotone", 6).alias("u_monotone"))


@query(
    f"""WITH {virtual.POINTS_SQL}, c AS (SELECT line_id, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy FROM pts GROUP BY 1),
    a AS (SELECT line_id, i AS a, x AS ax, y AS ay FROM (SELECT pts.*, row_number() OVER (PARTITION BY line_id ORDER BY (x-cx)*(x-cx)+(y-cy)*(y-cy) DESC, i) AS rk FROM pts JOIN c USING (line_id)) WHERE rk = 1),
    b AS (SELECT line_id, i AS b FROM (SELECT pts.*, row_number() OVER (PARTITION BY line_id ORDER BY (x-ax)*(x-ax)+(y-ay)*(y-ay) DESC, i) AS rk FROM pts JOIN a USING (line_id)) WHERE rk = 1)
    SELECT line_id, a, b FROM a JOIN b USING (line_id)"""
)
def farthest_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two anchors at which a closed polyline is split for simplification."""
    return geometry.farthest_anchors(virtual.polylines(spark, sf_dir), "line_id")


_BOXES = f"""{_AROUND}, m AS (SELECT line_id, line_id % 40 AS group_id, sum(x*ny-nx*y)/2.0::DOUBLE AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, arg_min(x, i) AS hx, arg_min(y, i) AS hy FROM w GROUP BY line_id)"""


@query(
    f"""{_BOXES} SELECT group_id, hole_id, outline_id FROM (SELECT h.group_id, h.line_id AS hole_id, o.line_id AS outline_id, row_number() OVER (PARTITION BY h.line_id ORDER BY abs(o.area), o.line_id) AS rk
      FROM m h JOIN m o ON h.group_id = o.group_id AND h.area < 0 AND o.area > 0 AND h.hx BETWEEN o.min_x AND o.max_x AND h.hy BETWEEN o.min_y AND o.max_y) WHERE rk = 1"""
)
def holes_in_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hole with the tightest outline that holds it: a join on bounds within a region."""
    pts = virtual.polylines(spark, sf_dir)
    starts = pts.groupBy("line_id").agg(F.min_by("x", "i").alias("hx"), F.min_by("y", "i").alias("hy"))
    m = geometry.measures(pts, "line_id").join(starts, "line_id").withColumn("group_id", F.col("line_id") % 40)
    holes = m.where("signed_area < 0").select("group_id", F.col("line_id").alias("hole_id"), "hx", "hy")
    outlines = m.where("signed_area > 0").select("group_id", F.col("line_id").alias("outline_id"), F.col("signed_area").alias("area"), "min_x", "min_y", "max_x", "max_y")
    return geometry.enclosing(holes, outlines)


_EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"


@query(
    f"""WITH {virtual.FILES_SQL}, d AS (SELECT path, bytes FROM f WHERE {_EXT} IN ('.png','.jpg','.jpeg','.webp','.gif') AND NOT regexp_matches(path, '/\\.[^/]+/') ORDER BY path LIMIT 500)
    SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS id, path, bytes, regexp_replace(path, '\\.[^./]*$', '.svg') AS output_path,
      CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', bytes/1024.0::DOUBLE) ELSE printf('%.1f MB', bytes/1048576.0::DOUBLE) END AS size FROM d"""
)
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files of a folder by path, without dot folders, at most 500, with output paths and sizes."""
    found = images.image_files(virtual.files(spark, sf_dir).withColumnRenamed("bytes", "byte_length"), "/in")
    return found.select("id", "path", F.col("byte_length").alias("bytes"), images.output_paths(F.col("path"), "/in", "/in", "svg").alias("output_path"), text.format_bytes(F.col("byte_length")).alias("size"))


@query(
    f"""WITH {virtual.FILES_SQL}, t AS (SELECT path, bytes, CAST(bytes % 101 AS INT) AS score FROM f), done AS (SELECT path FROM f WHERE bytes % 3 = 0),
    r AS (SELECT CASE WHEN done.path IS NOT NULL THEN 'skipped' WHEN {_EXT} = '.webp' THEN 'failed' WHEN score < 35 THEN 'skipped' ELSE 'converted' END AS status,
      CASE WHEN done.path IS NOT NULL THEN 'exists' WHEN {_EXT} = '.webp' THEN 'no codec' WHEN score < 35 THEN 'score' END AS reason, bytes FROM t LEFT JOIN done USING (path))
    SELECT status, reason, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY ROLLUP (status, reason)"""
)
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a conversion by status and reason: existing outputs by anti-join, low scores skipped, undecodable files failed."""
    tasks = virtual.files(spark, sf_dir).select(F.col("path").alias("output_path"), F.col("bytes").alias("output_bytes"))
    known, rest = report.existing(tasks, tasks.where("output_bytes % 3 = 0"), "exists")
    webp, low = text.extension(F.col("output_path")) == ".webp", F.col("output_bytes") % 101 < 35
    tried = rest.withColumns({"status": F.when(webp, "failed").when(low, "skipped").otherwise("converted"), "reason": F.when(webp, "no codec").when(low, "score")})
    return report.by_reason(known.unionByName(tried)).withColumnRenamed("output_bytes", "bytes")


_PRESET_ROWS = [(i, p[0], p[1]["max_colors"], p[1]["detail"], p[1]["smoothing"], p[1]["denoise"], float(p[1]["color_merge_threshold"]), p[1].get("stroke_mode", "off"), float(p[1].get("max_dimension", 1400.0))) for i, p in PRESETS.items()]
_PRESET_VALUES = ", ".join(f"('{r[0]}', '{r[1]}', {r[2]}, {r[3]}, {r[4]}, {r[5]}, {r[6]}::DOUBLE, '{r[7]}', {r[8]}::DOUBLE)" for r in _PRESET_ROWS)


@query(
    f"""WITH pr(id, label, max_colors, detail, smoothing, denoise, merge, stroke_mode, max_dimension) AS (VALUES {_PRESET_VALUES}),
    rq AS (SELECT event_id, list_extract(['logo','sticker','apparel','lineart','centerline','ai-art','pixel-art','poster'], CAST(event_id % 8 + 1 AS INT)) AS id,
      CASE WHEN user_id % 2 = 0 THEN value / 3 END AS o_colors, CASE WHEN user_id % 3 = 0 THEN value - 20 END AS o_detail FROM events)
    SELECT event_id, id, label, CAST(greatest(1, least(256, floor(coalesce(o_colors, max_colors) + 0.5))) AS INT) AS max_colors, CAST(greatest(0, least(100, floor(coalesce(o_detail, detail) + 0.5))) AS INT) AS detail,
      denoise, round(CASE WHEN greatest(0, least(100, floor(coalesce(o_detail, detail) + 0.5))) >= 99.5 THEN 0 ELSE 0.55 + 2.6*pow((100-greatest(0, least(100, floor(coalesce(o_detail, detail) + 0.5))))/100.0::DOUBLE, 1.3) END, 6) AS epsilon,
      round(8 + 92*pow(smoothing/100.0::DOUBLE, 0.9), 6) AS corner_degrees, round(0.04 + 0.16*(1 - denoise/100.0::DOUBLE), 6) AS noise_gate,
      CASE WHEN denoise <= 10 THEN 0 WHEN denoise >= 75 THEN 2 ELSE 1 END AS radius, CAST(greatest(2, floor(640*480*0.00002*(0.4+denoise/100.0::DOUBLE*1.6)+0.5)) AS INT) AS least_area FROM rq JOIN pr USING (id)"""
)
def resolve_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of requests: preset under overrides, clamped, with the numbers that follow from them."""
    e = _read(spark, sf_dir, "events")
    asked = e.select(
        "event_id", F.element_at(F.array(*(F.lit(r[0]) for r in _PRESET_ROWS)), (F.col("event_id") % 8 + 1).cast("int")).alias("id"),
        F.when(F.col("user_id") % 2 == 0, F.col("value") / 3).alias("o_max_colors"), F.when(F.col("user_id") % 3 == 0, F.col("value") - 20).alias("o_detail"),
    )
    s, denoise = settings.resolve_rows(asked), F.col("denoise")
    return s.select(
        "event_id", "id", "label", "max_colors", "detail", "denoise", F.round(settings.epsilon(F.col("detail")), 6).alias("epsilon"), F.round(settings.corner_degrees(F.col("smoothing")), 6).alias("corner_degrees"),
        F.round(settings.noise_gate(denoise), 6).alias("noise_gate"), settings.median_radius(denoise).alias("radius"), settings.least_area(denoise, 640, 480).alias("least_area"),
    )


@query(
    "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'iVBORw0K' ELSE '' END AS body, CAST(octet_length(encode(event_type)) AS INT) AS bytes, event_type AS back FROM events"
)
def base64_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 payloads with and without a data URL's head, decoded to bytes."""
    from rasterloom.sources.images import decode_base64

    e = _read(spark, sf_dir, "events")
    head = F.when(F.col("user_id") % 2 == 0, "data:image/png;base64,").otherwise("")
    d = decode_base64(e.withColumn("payload", F.concat(head, F.base64(F.col("event_type").cast("binary")))), "payload")
    mark = F.when(F.col("user_id") % 2 == 0, F.base64(F.unhex(F.lit("89504E470D0A")))).otherwise("")
    return d.select("event_id", mark.alias("body"), F.octet_length("content").alias("bytes"), F.col("content").cast("string").alias("back"))


@query(
    """SELECT o_orderkey, CASE WHEN v = '-0' OR v = '' THEN '0' WHEN starts_with(v, '0.') THEN substr(v, 2) WHEN starts_with(v, '-0.') THEN '-' || substr(v, 3) ELSE v END AS short,
      format('{:,}', o_orderkey) AS count_text, printf('%.1f%%', (o_orderkey % 1000) / 1000.0::DOUBLE * 100) AS percent, CASE WHEN length(o_orderpriority) <= 6 THEN o_orderpriority ELSE '…' || right(o_orderpriority, 5) END AS short_name,
      replace(replace(replace(replace('<' || o_orderstatus || '&"' , '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped
    FROM (SELECT *, regexp_replace(regexp_replace(CAST(CAST((o_orderkey % 4001 - 2000) / 1000.0 AS DECIMAL(20, 3)) AS VARCHAR), '0+$', ''), '\\.$', '') AS v FROM orders)"""
)
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short numbers, counts, percentages, shortened names and escaped attributes."""
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        k, text.short_number(((k % 4001 - 2000) / 1000.0), 3).alias("short"), text.format_count(k).alias("count_text"), text.format_percent((k % 1000) / 1000.0).alias("percent"),
        text.truncate_head(F.col("o_orderpriority"), 6).alias("short_name"), text.escape_attribute(F.concat(F.lit("<"), F.col("o_orderstatus"), F.lit('&"'))).alias("escaped"),
    )


@query(
    """WITH o AS (SELECT c_mktsegment AS doc, c_custkey AS obj, length(c_name) AS len FROM customer) SELECT doc, obj, CAST(coalesce(sum(len) OVER (PARTITION BY doc ORDER BY obj ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM o"""
)
def object_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of a document's objects: the running sum of the lengths before."""
    o = _read(spark, sf_dir, "customer").selectExpr("c_mktsegment AS doc", "c_custkey AS obj", "length(c_name) AS len")
    return pdf.object_offsets(o, "doc", "obj", "len").select("doc", "obj", "start")


_LAYER_SQL = f"""{virtual.PALETTE_SQL}, lay AS (SELECT '#' || printf('%06x', r*65536+g*256+b) AS hex, CAST(sum(weight) AS BIGINT) AS pixels, count(*) AS pieces FROM pal GROUP BY 1)"""


def _palette_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = virtual.palette(spark, sf_dir)
    return p.groupBy(color.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex")).agg(F.sum("weight").alias("pixels"), F.count(F.lit(1)).alias("pieces"))


@query(
    f"""WITH {_LAYER_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY hex) - 1 AS i FROM lay), mg AS (SELECT b.hex AS absorb, a.hex AS keep FROM n a JOIN n b ON b.i = a.i+1 AND a.i % 4 = 0), rm AS (SELECT hex FROM n WHERE i % 7 = 6),
    l AS (SELECT coalesce(keep, lay.hex) AS hex, CAST(sum(pixels) AS BIGINT) AS pixels, CAST(sum(pieces) AS BIGINT) AS pieces FROM lay LEFT JOIN mg ON absorb = lay.hex WHERE lay.hex NOT IN (SELECT hex FROM rm) GROUP BY 1)
    SELECT hex, pixels, pieces, CAST(row_number() OVER (ORDER BY pixels DESC, hex) AS INT) AS rank FROM l"""
)
def merge_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers after a plan of merges and removals."""
    lay = _palette_layers(spark, sf_dir)
    n = lay.selectExpr("hex", "row_number() OVER (ORDER BY hex) - 1 AS i")
    merges = n.where("i % 4 = 0").selectExpr("hex AS keep", "i + 1 AS i").join(n.selectExpr("hex AS absorb", "i"), "i").select("absorb", "keep")
    return editing.apply_merges(lay, merges, n.where("i % 7 = 6").select("hex"))


@query(
    f"""WITH {_LAYER_SQL}, plan AS (SELECT hex FROM lay UNION ALL SELECT '#00' || right(hex, 4) FROM lay UNION ALL SELECT 'nothex') SELECT DISTINCT hex FROM plan WHERE hex NOT IN (SELECT hex FROM lay)"""
)
def unknown_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of an edit plan that the palette lacks."""
    lay = _palette_layers(spark, sf_dir)
    plan = lay.select("hex").unionAll(lay.select(F.concat(F.lit("#00"), F.right("hex", F.lit(4))))).unionAll(spark.createDataFrame([("nothex",)], "hex string"))
    return editing.unknown_colors(plan, lay)


@query(
    f"""WITH {virtual.COLORS_SQL}, hued AS (SELECT *, {_HUE} AS h0 FROM c), nm AS (SELECT id, {_name_sql()} AS nm FROM hued)
    SELECT id, CASE WHEN count(*) OVER (PARTITION BY nm) > 1 THEN nm || ' ' || row_number() OVER (PARTITION BY nm ORDER BY id) ELSE nm END AS label FROM nm"""
)
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour names numbered where they repeat."""
    c = virtual.colors(spark, sf_dir).select(F.lit("v").alias("image_id"), F.col("id").alias("idx"), color.color_name(F.col("r"), F.col("g"), F.col("b")).alias("name"))
    return editing.uniquify(c, "image_id").select(F.col("idx").alias("id"), "label")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("request"))


@query(
    """SELECT user_id AS session, event_type AS kind, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS request, count(*) - 1 AS superseded FROM events GROUP BY 1, 2"""
)
def superseded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest request of each session and kind."""
    return requests.latest(_requests(spark, sf_dir))


@query(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 60 MINUTE > ts THEN 0 ELSE 1 END AS st FROM events),
    s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS b FROM g)
    SELECT user_id AS session, min(ts) AS fired_from, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS request, count(*) AS n FROM s GROUP BY user_id, b"""
)
def debounced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last request of each burst (here: requests less than an hour apart)."""
    return requests.debounce(_requests(spark, sf_dir), "60 minutes")


@query(
    f"""WITH {virtual.RGBA_SQL}, {_FOUR}, d AS (SELECT r, g, b, count(*) AS n FROM px WHERE a >= 128 GROUP BY 1,2,3), {_lab_cte('d', 'dl')}, {_lab_cte('four', 'fl')},
    asg AS (SELECT dl.r, dl.g, dl.b, any_value(dl.n) AS n, any_value(dl."L") AS l, any_value(dl.a_) AS a, any_value(dl.b_) AS bb, arg_min(fl.idx, round((dl."L"-fl."L")*(dl."L"-fl."L")+(dl.a_-fl.a_)*(dl.a_-fl.a_)+(dl.b_-fl.b_)*(dl.b_-fl.b_), 9)*10+fl.idx*1e-9) AS idx FROM dl, fl GROUP BY 1,2,3)
    SELECT CAST(idx AS INT) AS cluster, CAST(sum(n) AS BIGINT) AS weight, round(sum(l*n)/sum(n), 6) AS l, round(sum(a*n)/sum(n), 6) AS a, round(sum(bb*n)/sum(n), 6) AS b,
      CAST(floor(sum(r*n)/sum(n)::DOUBLE+0.5) AS INT) AS red, CAST(floor(sum(g*n)/sum(n)::DOUBLE+0.5) AS INT) AS green, CAST(floor(sum(asg.b*n)/sum(n)::DOUBLE+0.5) AS INT) AS blue FROM asg GROUP BY idx"""
)
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of weighted k-means in Lab from given centres: nearest centre, weighted means, rounded colours."""
    d = pixels.opaque(virtual.rgba_pixels(spark, sf_dir)).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    means = pixels.cluster_means(pixels.nearest_entry(d, _four(spark), "r", "g", "b", "n"))
    return means.select("cluster", "weight", *(F.round(f"lab.{c}", 6).alias(c.lower()) for c in "Lab"), "red", "green", "blue")


@query(
    """SELECT event_id, CAST(0 AS INT) AS position, 'custom:' || event_id AS id, event_type AS label, greatest(0.0, least(100.0, CAST(event_id % 300 - 100 AS DOUBLE))) AS detail,
      CASE WHEN event_id % 2 = 0 THEN greatest(1.0, least(256.0, CAST(user_id AS DOUBLE))) END AS max_colors, CASE WHEN event_id % 3 = 0 THEN 'force' END AS stroke_mode
    FROM events WHERE event_id % 7 > 0"""
)
def sanitize_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON presets: numbers clamped, texts that should be numbers and unknown choices dropped, as are entries with a foreign id."""
    e, k = _read(spark, sf_dir, "events"), F.col("event_id")
    colors = F.when(k % 2 == 0, F.col("user_id").cast("string")).otherwise(F.lit('"12"'))  # a number, or a text
    mode = F.when(k % 3 == 0, "force").otherwise("sometimes")
    body = F.format_string(
        '[{"id":"%s%d","label":"  %s ","options":{"detail":%d,"maxColors":%s,"strokeMode":"%s"}}]',
        F.when(k % 7 > 0, "custom:").otherwise("foreign:"), k, F.col("event_type"), k % 300 - 100, colors, mode,
    )
    got = presets.load(e.select("event_id", body.alias("json")), "json", "event_id")
    return got.select("event_id", "position", "id", "label", F.col("options.detail").alias("detail"), F.col("options.maxColors").alias("max_colors"), F.col("options.strokeMode").alias("stroke_mode"))


# --- what SQL can't express -----------------------------------------------------------------------


def _virtual_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour raster as compact images of 100 x 100 pixels, one row each."""
    return _compact(virtual.rgba_pixels(spark, sf_dir).withColumn("image_id", F.concat(F.lit("tile-"), F.expr("y div 100").cast("string"))))


def _compact(px: DataFrame) -> DataFrame:
    """Pixels of images of 100 x 100 as compact images, one row each."""
    from rasterloom.session import ship_package
    from rasterloom.sources.images import from_pixels

    ship_package(px.sparkSession)

    def compact(table):
        import numpy as np
        import pyarrow as pa

        x, y = table.column("x").to_numpy(), table.column("y").to_numpy() % 100
        data = np.zeros((int(y.max()) + 1, WIDTH, 4), np.uint8)
        for i, c in enumerate("rgba"):
            data[y, x, i] = table.column(c).to_numpy()
        return pa.table({"image_id": table.column("image_id")[:1], "width": pa.array([WIDTH], pa.int32()), "height": pa.array([data.shape[0]], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    rows = px.select("image_id", "x", "y", "r", "g", "b", "a").groupBy("image_id").applyInArrow(compact, "image_id string, width int, height int, data binary")
    return from_pixels(rows)


@query()
def vectorize_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage from pixels to layers and SVG."""
    from rasterloom.plans import studio

    out = studio.vectorize(_virtual_images(spark, sf_dir), "sticker")
    return out.select("image_id", "status", "reason", "width", "height", "colors", "pieces", "strokes", "nodes", "dropped_regions", "repaired_regions", "output_bytes")


@query()
def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each layer of each traced image."""
    from rasterloom.plans import studio

    out = studio.vectorize(_virtual_images(spark, sf_dir), "sticker", format=None)
    total = F.sum("l.pixel_count").over(Window.partitionBy("image_id"))
    rows = out.select("image_id", F.explode("layers").alias("l"))
    return rows.select("image_id", "l.index", "l.hex", "l.name", F.size("l.shapes").alias("pieces"), F.size("l.strokes").alias("strokes"), "l.nodes", F.round(F.col("l.pixel_count") / total, 4).alias("area_share"))


@query()
def analyze_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and recommendation of every image."""
    from rasterloom.plans import studio

    out = studio.analyze(_virtual_images(spark, sf_dir))
    return out.select("image_id", "status", "width", "height", "unique_colors", "flat_ratio", "noise_estimate", "classification", "suitability", "score", F.size("findings").alias("findings"), "recommended_preset")


@query()
def compare_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image under every preset."""
    from rasterloom.plans import studio

    return studio.compare_presets(_virtual_images(spark, sf_dir)).drop("elapsed_ms")


@query()
def render_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every image in every format."""
    from functools import reduce

    from rasterloom.plans import studio

    images = _virtual_images(spark, sf_dir)
    parts = [studio.vectorize(images, DEFAULT_PRESET, format=k, layers=False).select("image_id", F.lit(k).alias("format"), "status", "output_bytes", F.md5("output").alias("digest")) for k in ("svg", "pdf", "eps", "dxf", "png")]
    return reduce(DataFrame.unionByName, parts)


@query()
def refine_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal colours merged by tracing again."""
    from rasterloom.plans import studio

    out = studio.refine(_virtual_images(spark, sf_dir), auto_merge_below=30.0, preset="poster")
    return out.select("image_id", "status", "reason", "colors", "pieces", "nodes")


# --- what SQL can say of whole traces ---------------------------------------------------------------

_SHADES = "shade(k, hex) AS (VALUES " + ", ".join(f"({k}, '#{c[0]:02x}{c[1]:02x}{c[2]:02x}')" for k, c in enumerate(virtual.COLORS)) + ")"
#: Settings under which a trace of flat cells is literal.
_LITERAL = {"background": "keep", "denoise": 0, "detail": 100, "smoothing": 0, "color_merge_threshold": 0}


def _layer_areas(traced: DataFrame) -> DataFrame:
    """``image_id, hex, pixels, outline_area, area_share`` of the layers of traces; holes count as negative area."""
    rows = traced.select("image_id", F.explode("layers").alias("l"))
    contours = F.flatten(F.transform("l.shapes", lambda s: s["contours"]))
    area = F.aggregate(F.transform(contours, lambda c: c["signed_area"]), F.lit(0.0), lambda t, a: t + a)
    share = F.col("l.pixel_count") / F.sum("l.pixel_count").over(Window.partitionBy("image_id"))
    return rows.select("image_id", "l.hex", F.col("l.pixel_count").alias("pixels"), F.round(area, 4).alias("outline_area"), F.round(share, 4).alias("area_share"))


@query(
    f"""WITH {virtual.MOSAIC_SQL}, {_SHADES} SELECT image_id, hex, count(*) AS pixels, count(*)::DOUBLE AS outline_area,
      round(count(*) / sum(count(*)) OVER (PARTITION BY image_id)::DOUBLE, 4) AS area_share FROM mosaic JOIN shade USING (k) WHERE k < 3 GROUP BY image_id, hex"""
)
def traced_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of traced flat images: the fitted outlines enclose as much as the pixels of their colour."""
    from rasterloom.plans import studio

    return _layer_areas(studio.vectorize(_compact(virtual.mosaic(spark, sf_dir)), "pixel-art", _LITERAL, format=None))


@query(
    f"""WITH {virtual.MOSAIC_SQL}, {_SHADES} SELECT image_id, hex, count(*) AS pixels, count(*)::DOUBLE AS outline_area,
      round(count(*) / sum(count(*)) OVER (PARTITION BY image_id)::DOUBLE, 4) AS area_share FROM mosaic JOIN shade ON shade.k = 0
      WHERE mosaic.k IN (0, 2) GROUP BY image_id, hex"""
)
def refined_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One colour merged into the nearest of the rest and one removed: the kept layer encloses the pixels of both."""
    from rasterloom.plans import studio

    keep, gone, absorb = (f"#{c[0]:02x}{c[1]:02x}{c[2]:02x}" for c in virtual.COLORS[:3])
    return _layer_areas(studio.refine(_compact(virtual.mosaic(spark, sf_dir)), [(keep, [absorb])], [gone], preset="pixel-art", overrides=_LITERAL, format=None))


@query(
    f"""WITH {virtual.RGBA_SQL}, e AS (SELECT *, y//100 AS t, lead(r) OVER xr AS r1, lead(g) OVER xr AS g1, lead(b) OVER xr AS b1, lead(r) OVER yd AS r2, lead(g) OVER yd AS g2, lead(b) OVER yd AS b2 FROM px
      WINDOW xr AS (PARTITION BY y ORDER BY x), yd AS (PARTITION BY x, y//100 ORDER BY y)),
    d AS (SELECT *, greatest(coalesce(greatest(abs(r-r1),abs(g-g1),abs(b-b1)),0), coalesce(greatest(abs(r-r2),abs(g-g2),abs(b-b2)),0)) AS d FROM e),
    q AS (SELECT t, max(y)-min(y)+1 AS h, greatest(1, count_if(a>=128))::DOUBLE AS n, count_if(a>=128 AND d=0)/n AS f, count_if(a>=128 AND d>0 AND d<=10)/n AS s, count_if(a>=128 AND d>=40)/n AS hd,
      1-count_if(a>=128)/count(*)::DOUBLE AS tr, count(DISTINCT CASE WHEN a>=128 THEN r*65536+g*256+b END) AS colors FROM d GROUP BY t),
    c AS (SELECT *, CASE WHEN f<0.2 AND s>0.55 OR colors>=20000 AND f<0.35 THEN 'photo' WHEN f>=0.6 THEN CASE WHEN colors<=8 THEN 'line-art' ELSE 'flat-art' END
      WHEN f>=0.3 THEN CASE WHEN s>0.45 OR colors>4000 THEN 'gradient-art' ELSE 'flat-art' END WHEN s>0.4 THEN 'gradient-art' ELSE 'unknown' END AS k FROM q),
    p AS (SELECT *, CAST(greatest(0, least(100, CASE k WHEN 'line-art' THEN 92 WHEN 'flat-art' THEN 70+floor(f*25+0.5) WHEN 'gradient-art' THEN 45+floor(f*25+0.5)-floor(s*15+0.5) WHEN 'photo' THEN 12 ELSE 45 END
      - CASE WHEN least(100,h)<64 THEN 25 WHEN least(100,h)<128 THEN 12 ELSE 5 END - CASE WHEN colors>=20000 AND k<>'photo' THEN 8 ELSE 0 END)) AS INT) AS score FROM c)
    SELECT 'tile-' || t AS image_id, CAST(100 AS INT) AS width, CAST(h AS INT) AS height, tr>0.001 AS has_alpha, floor(tr*10000+0.5)/10000 AS transparent_ratio, CAST(colors AS INT) AS unique_colors,
      floor(f*10000+0.5)/10000 AS flat_ratio, floor(s*10000+0.5)/10000 AS soft_edge_ratio, floor(hd*10000+0.5)/10000 AS hard_edge_ratio, k AS classification, score,
      CASE WHEN score>=80 THEN 'excellent' WHEN score>=62 THEN 'good' WHEN score>=35 THEN 'fair' ELSE 'poor' END AS suitability,
      CASE WHEN colors<=32 THEN 'pixel-art' WHEN k='line-art' THEN 'lineart' WHEN k='flat-art' THEN CASE WHEN colors<=24 THEN 'logo' ELSE 'ai-art' END WHEN k IN ('gradient-art','photo') THEN 'poster' ELSE 'logo' END AS recommended_preset
    FROM p"""
)
def analyze_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analyzer says of each image, but for its noise."""
    from rasterloom.plans import studio

    names = "image_id width height has_alpha transparent_ratio unique_colors flat_ratio soft_edge_ratio hard_edge_ratio classification score suitability recommended_preset"
    return studio.analyze(_virtual_images(spark, sf_dir)).select(*names.split())


@query(
    f"""WITH {virtual.ART_SQL}, hh AS (SELECT count(*)//100 AS h FROM events), {_CRACKS}
    SELECT kind, CAST(CASE kind WHEN 'h' THEN y ELSE x END AS INT) AS line, count(*)::DOUBLE AS length FROM cr GROUP BY 1, 2"""
)
def boundary_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the boundary chains along each lattice line: every crack between two labels is in one chain."""
    back = F.when(F.col("closed"), F.slice("points", 1, 1)).otherwise(F.slice("points", 1, 0))  # a closed chain doesn't repeat its first point
    found = tracing.chains(virtual.art(spark, sf_dir)).select("points", F.concat(F.expr("slice(points, 2, size(points))"), back).alias("after"))
    steps = found.select(F.explode(F.expr("transform(after, (q, i) -> struct(points[i] AS p, q AS q))")).alias("s")).select("s.p", "s.q")
    flat = F.col("p.y") == F.col("q.y")
    line = F.when(flat, F.col("p.y")).otherwise(F.col("p.x")).cast("int")
    length = F.abs(F.col("p.x") - F.col("q.x")) + F.abs(F.col("p.y") - F.col("q.y"))
    return steps.groupBy(F.when(flat, "h").otherwise("v").alias("kind"), line.alias("line")).agg(F.sum(length).alias("length"))


@query(
    """SELECT DISTINCT 'tile-' || (event_id // 10000) AS image_id, f.format, 'ok' AS status, f.magic FROM events,
      (VALUES ('svg', '<svg'), ('pdf', '%PDF'), ('eps', '%!PS'), ('png', chr(137) || 'PNG'), ('jpeg', chr(255) || chr(216) || chr(255) || chr(224))) AS f(format, magic)"""
)
def format_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the file of every image in every format begins."""
    from functools import reduce

    from rasterloom.plans import studio

    images = _compact(virtual.mosaic(spark, sf_dir))
    begins = F.decode(F.substring("output", 1, 4), "ISO-8859-1").alias("magic")
    parts = [studio.vectorize(images, DEFAULT_PRESET, format=k, layers=False).select("image_id", F.lit(k).alias("format"), "status", begins) for k in ("svg", "pdf", "eps", "png", "jpeg")]
    return reduce(DataFrame.unionByName, parts)
