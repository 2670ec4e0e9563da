"""Queries of the registry, text and fact operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.functions import text as T
from sitecast.functions.columns import flat_distance_m
from sitecast.operators import extract as X
from sitecast.operators import registry as R
from sitecast.plans.fixtures import dealt, r6, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def part(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Registry entries: the name is dressed up so that the key has something to undo; ``spread`` deals them over tasks first."""
    name = F.expr("concat(case p_partkey % 4 when 0 then 'Jezioro ' when 1 then 'j. ' when 2 then '0.10 Stawy ' else '' end, initcap(p_name), case when p_partkey % 5 = 0 then ' Żółw nr 3' else '' end)")
    parts = table(spark, sf_dir, "part")
    rows = (dealt(parts, "p_partkey") if spread else parts).select(F.col("p_partkey").alias("entry_id"), name.alias("name"), F.expr("case when p_size % 3 > 0 then p_brand else '' end").alias("place"), F.expr("case when p_size % 4 > 0 then p_type end").alias("section"), F.expr("case when p_size > 5 then cast(p_size as double) end").alias("area_ha"), (F.col("p_partkey") % 3).alias("src_ord"))
    return rows.withColumn("key", T.name_key(F.col("name")))


KEY_BARE = "lower(regexp_replace(trim(name), '^\\d+(?:\\.\\d+)*\\s+', ''))"
KEY_FOLD = f"replace(strip_accents({KEY_BARE}), 'ł', 'l')"
KEY = f"trim(regexp_replace(trim(regexp_replace({KEY_FOLD}, '[^a-z0-9]+', ' ', 'g')), '^(?:(?:jeziora|jezioro|zbiornik|zbiorniki|zalew|staw|stawy|glinianki|glinianka|rzeki|rzeka|kanal|j|rz|zb)(?:\\s+|$))*', ''))"
PART = f"""p0 AS (SELECT p_partkey AS entry_id, CASE p_partkey % 4 WHEN 0 THEN 'Jezioro ' WHEN 1 THEN 'j. ' WHEN 2 THEN '0.10 Stawy ' ELSE '' END || upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || CASE WHEN p_partkey % 5 = 0 THEN ' Żółw nr 3' ELSE '' END AS name,
  CASE WHEN p_size % 3 > 0 THEN p_brand ELSE '' END AS place, CASE WHEN p_size % 4 > 0 THEN p_type END AS section, CASE WHEN p_size > 5 THEN p_size::double END AS area_ha, p_partkey % 3 AS src_ord FROM part), reg AS (SELECT *, {KEY} AS key FROM p0)"""


#: Spellings that follow the names of entries in turn: marks of their own, ligatures, compatibility letters, letters without a plain form.
SPELLINGS = ("", " Zegrzyński", " ﬁlip–Dół", " K²", " Straße", " Ⅷ ½", "™ ŁÓDŹ", " ＡＢ①", " Ȩ́té", " Öа")


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's names with the spellings at their ends."""
    ends = F.array(*map(F.lit, SPELLINGS))
    return part(spark, sf_dir).select("entry_id", F.concat("name", F.element_at(ends, (F.col("entry_id") % len(SPELLINGS) + 1).cast("int"))).alias("name"))


SPELLED = f"""{PART}, sp AS (SELECT entry_id, name || [{", ".join(f"'{x}'" for x in SPELLINGS)}][entry_id % {len(SPELLINGS)} + 1] AS name FROM reg)"""
#: What the twins write for the letters that the other engine's accents leave: in keys and in slugs.
_WRITTEN = (("ﬁ", "fi", "fi"), ("–", " ", ""), ("²", "2", "2"), ("ß", " ", ""), ("Ⅷ", "viii", "viii"), ("ⅷ", "viii", "viii"), ("½", "1 2", "12"), ("™", " ", "tm"), ("Ａ", "a", "a"), ("Ｂ", "b", "b"), ("ａ", "a", "a"), ("ｂ", "b", "b"), ("①", "1", "1"), (" ", " ", " "), ("а", " ", ""))


def _plain_sql(x: str, slug: bool) -> str:
    for letter, key, short in _WRITTEN:
        x = f"replace({x}, '{letter}', '{short if slug else key}')"
    return f"replace(strip_accents({x}), 'ł', 'l')"


@query(f"WITH {SPELLED} SELECT entry_id, name, {KEY.replace(KEY_FOLD, _plain_sql(KEY_BARE, False))} AS key FROM sp")
def str1_name_key(spark, sf_dir):
    return spelled(spark, sf_dir).withColumn("key", T.name_key(F.col("name")))


@query(f"WITH {SPELLED}, b AS (SELECT entry_id, trim(regexp_replace({_plain_sql('lower(name)', True)}, '[^a-z0-9]+', '-', 'g'), '-') AS base FROM sp), w AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY entry_id) AS r FROM b) SELECT entry_id, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS slug FROM w")
def str2_unique_slug(spark, sf_dir):
    return R.unique_slugs(spelled(spark, sf_dir), "entry_id").select("entry_id", "slug")


@query()
def str3_suggest_names(spark, sf_dir):
    rows = part(spark, sf_dir)
    queries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.expr("concat(element_at(array('smal rinng', 'red widgt', 'green bolt', 'larg gear', 'blu'), cast(s_suppkey % 5 as int) + 1), '')").alias("key"))
    return r6(R.suggest(queries, rows))


@query("SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, TRY_CAST(regexp_extract(url, '[?&]page=(\\d+)', 1) AS integer) AS page, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages")
def str4_page_records(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("links"), F.regexp_extract("url", r"[?&]page=(\d+)", 1).try_cast("int").alias("page"), F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"))


def _pages(spark, sf_dir):
    """The pages, each with three cards, an embedded map and two drawn objects after its own text."""
    p, k = "page_id", "k"
    card = f"""concat('<article><a href="/waters/w', {p}, '-', {k}, '?from=list"><img src="x"></a><span class="etiquette ">Kind ', {k}, '</span><h3>', if({p} % 5 = 0 and {k} = 2, ' ', concat(' Water\u00a0', {p}, '  no ', {k})), '</h3><p class="item_category place">Town ', {p} % 7, if({k} = 0, '', concat(', Region ', {k})), '</p><p>Przynależność: Club ', {p} % 3, '<br>Gospodarz: Host ', {k}, '<br></article>')"""
    at = f"concat('5', {p} % 9, '.', 1000 + {p} % 9000)"
    drawn = f"""concat('objectsData[0] = {{"nazwa": "Lake ', {p}, ' \\\\"x\\\\"", "kind": "', if({p} % 2 = 0, 'closed', 'open'), '", "tresc": "note {{}}"}} objectPoints[0] = [new google.maps.LatLng(', {at}, ', 20.5), new google.maps.LatLng(51.5, 20.5), new google.maps.LatLng( 51.5,21.5), new google.maps.LatLng(50.5, 21.25)]; objectsData[1] = {{"nazwa": "Spot ', {p}, '", "kind": "closed"}} objectPoints[1] = [new google.maps.LatLng(', {at}, ', 20.5)];')"""
    html = f"concat(html, array_join(transform(sequence(0, 2), k -> {card}), ''), '<iframe src=\"https://m.example/maps/embed/v1/place?key=a&q=', {at}, ',20.', 10000 + {p} % 9000, '\"></iframe><script>', {drawn}, '</script>')"
    return table(spark, sf_dir, "pages").select("page_id", F.expr(html).alias("html"))


@query("SELECT page_id, CAST(k.k AS integer) AS pos, 'w' || page_id || '-' || k.k AS slug, 'Water ' || page_id || ' no ' || k.k AS name, 'Kind ' || k.k AS kind, 'Town ' || page_id % 7 AS place, CASE WHEN k.k > 0 THEN 'Region ' || k.k ELSE '' END AS region, 'Club ' || page_id % 3 AS belongs, 'Host ' || k.k AS host FROM pages CROSS JOIN range(0, 3) k(k) WHERE NOT (page_id % 5 = 0 AND k.k = 2)")
def str4_page_cards(spark, sf_dir):
    return X.page_cards(_pages(spark, sf_dir))


POINT = "CAST('5' || page_id % 9 || '.' || (1000 + page_id % 9000) AS double)"


@query(f"SELECT page_id, {POINT} AS lat, CAST('20.' || (10000 + page_id % 9000) AS double) AS lon FROM pages")
def str4_embedded_positions(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", X.embedded_position(F.col("html")).alias("at")).select("page_id", "at.lat", "at.lon")


@query(f"""SELECT page_id, 0 AS index, 'Lake ' || page_id || ' "x"' AS name, CASE WHEN page_id % 2 = 0 THEN 'closed' ELSE 'open' END AS kind, 'note {{}}' AS note, CASE WHEN page_id % 2 = 0 THEN 4 ELSE 0 END AS n_ring, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 4 END AS n_line, round_even(({POINT} + 51.5 + 51.5 + 50.5) / 4, 6) AS lat, 20.9375::double AS lon FROM pages
  UNION ALL SELECT page_id, 1, 'Spot ' || page_id, 'closed', '', 0, 0, {POINT}, 20.5 FROM pages""")
def str4_map_records(spark, sf_dir):
    found = X.map_records(_pages(spark, sf_dir))
    points = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}")
    return found.select("page_id", "index", "name", "kind", "note", *(F.when(F.col(c).isNull(), 0).otherwise(points(c)).alias(f"n_{c}") for c in ("ring", "line")), "point.lat", "point.lon")


def _reports(spark, sf_dir):
    """A catch report for each part: contents, then two sections with figures made of its number."""
    n = "p_partkey"
    text = f"""concat('Spis treści\n1. Jezioro Inne (Tabela nr 9) 12 wędkarzy ..... 5\nII. Łowiska wędkarskie\n1.2. Jezioro Żół-\nwie ', {n}, ' (Tabela nr ', {n} % 900 + 1, ')\n1 ', 100 + {n} % 900, ' wędkarzy złożyło rejestry. Roczne odłowy wyniosły ', {n} % 5000, ',5 kg. Jeden łowił 2,', {n} % 10, ' kg rocznie. ',
      'Średni dzienny odłów to 0,', {n} % 10, ' kg. Wędkowano 12,5 dni. Łowiono karpia (', {n} % 60, ',5%) i ryby karpiowate 99%. leszcz o średniej masie 1,', {n} % 10, ' kg stanowił ', {n} % 40, '%. Największym udziałem (', {n} % 30, '%) zaznaczył się sum. Płoć, jaź i lin stanowiące odpowiednio 7%, 6% i 5%.\n',
      '2. Rzeka Mała (Tabela nr ', {n} % 7, ')\nWędkarze łowili średnio 1,', {n} % 10, ' kg ryb na dzień. Złowiono średnio 3,36-kilogramowy karp.')"""
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("report_id"), F.expr(text).alias("text"))


@query("""SELECT p_partkey AS report_id, p_partkey % 900 + 1 AS table_no, 'Jezioro Żółwie ' || p_partkey AS name, 1100 + p_partkey % 900 AS anglers, p_partkey % 5000 + 0.5::double AS total_kg, 2 + (p_partkey % 10) / 10.0::double AS kg_per_angler_year, (p_partkey % 10) / 10.0::double AS kg_per_angler_day, 12.5::double AS days_per_angler, p_partkey % 60 + 0.5::double AS carp, (p_partkey % 40)::double AS bream, (p_partkey % 30)::double AS catfish, 3 AS n_species, 1 + (p_partkey % 10) / 10.0::double AS bream_kg, NULL::double AS carp_kg FROM part
  UNION ALL SELECT p_partkey, p_partkey % 7, 'Rzeka Mała', NULL, NULL, NULL, 1 + (p_partkey % 10) / 10.0::double, NULL, NULL, NULL, NULL, 0, NULL, 3.36 FROM part""")
def str5_report_figures(spark, sf_dir):
    found = X.report_figures(_reports(spark, sf_dir))
    share = lambda s: F.try_element_at("species_pct", F.lit(s)).alias(s)
    weight = lambda s: F.try_element_at("species_mean_kg", F.lit(s)).alias(f"{s}_kg")
    return found.select("report_id", F.col("table_no").cast("long").alias("table_no"), "name", *X.FIGURES, share("carp"), share("bream"), share("catfish"), F.size("species_pct").alias("n_species"), weight("bream"), weight("carp"))


@query("SELECT doc_id, TRY_CAST(replace(nullif(regexp_extract(text, '([0-9]+(?:,[0-9]+)?)', 1), ''), ',', '.') AS double) AS first_number, len(regexp_extract_all(text, '[0-9]+(?:,[0-9]+)?')) AS n_numbers FROM documents")
def str5_prose_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.number(T.first_of(F.col("text"), [r"([0-9]+(?:,[0-9]+)?)"])).alias("first_number"), F.size(F.regexp_extract_all("text", F.lit("[0-9]+(?:,[0-9]+)?"), F.lit(0))).alias("n_numbers"))


@query("""WITH l AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
  m AS (SELECT *, CASE WHEN regexp_matches(line, '[0-9]') THEN line_no END AS head FROM l) SELECT doc_id, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head_line, line_no, len(string_split(line, '  ')) AS cells FROM m""")
def str6_table_lines(spark, sf_dir):
    """Lines of a text as table rows: cells apart by two blanks; a line without a figure belongs to the row above."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("line").rlike("[0-9]"), F.col("line_no")), ignorenulls=True).over(w)
    return lines.select("doc_id", head.alias("head_line"), "line_no", F.size(F.split("line", "  ", -1)).alias("cells"))


@query("""SELECT p_partkey % 25 AS doc_id, p_partkey * 3 AS line_no, CASE WHEN p_partkey % 7 = 0 THEN 'Rzeka Nazwa' ELSE 'Jezioro ' || split_part(p_name, ' ', 1) END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'Town X' ELSE 'Town ' || p_size END || CASE WHEN p_partkey % 4 = 0 THEN ' and more' ELSE '' END AS place, CASE WHEN p_partkey % 7 = 0 THEN 10.5 ELSE p_size + 0.25 END::double AS area_ha FROM part""")
def str6_table_rows(spark, sf_dir):
    """A printed row for each part, some with a wrapped rest below, page numbers and headings between."""
    line = """element_at(array(
        if(p_partkey % 7 = 0, ' rz. Nazwa12   , 3  Town X    10,50', concat('j. ', split_part(p_name, ' ', 1), '14  Town ', p_size, '  ', p_size, ',25')),
        if(p_partkey % 4 = 0, '   and more', ' '),
        element_at(array('12', '3. Nagłówek', 'II. Wody', 'Nazwa akwenu  Miejsce  Area'), cast(p_partkey % 4 as int) + 1)), k + 1)"""
    lines = table(spark, sf_dir, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((F.col("p_partkey") % 25).alias("doc_id"), (F.col("p_partkey") * 3 + F.col("k")).alias("line_no"), F.expr(line).alias("line"))
    return X.table_rows(lines)


@query("""SELECT p_partkey AS entry_id, CASE p_partkey % 5 WHEN 0 THEN 'Jezioro ' || split_part(p_name, ' ', 1) WHEN 1 THEN 'Rzeka ' || split_part(p_name, ' ', 2) WHEN 2 THEN 'Zbiornik Zegrzyńskie' WHEN 3 THEN 'Rzeka Narew' ELSE 'rzeki Rakutowka' END AS name FROM part""")
def str6_tidy_names(spark, sf_dir):
    cell = """element_at(array(concat('j. ', split_part(p_name, ' ', 1), '4 w zlewni rzeki Wkra Nr ', p_size), concat('rz. ', split_part(p_name, ' ', 2), '   ', p_size), concat('zb. Zegrzyńs-  kie na rzece Narew Nr 7, ', p_size), concat('- rz. Narew ', p_size, ', Nr 8'), 'rzeki Rakutowka Nr 2 j.Toczylowo'), cast(p_partkey % 5 as int) + 1)"""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), X.tidy_name(F.expr(cell)).alias("name"))


TAGS = "SELECT p_partkey AS tag_id, (['water', 'natural', 'waterway', 'landuse', 'leisure', 'highway'])[p_partkey % 6 + 1] AS category, (['lake', 'water', 'weir', 'reservoir', 'marina', 'river', 'Wood ', 'pitch', 'bay', 'canal', 'basin'])[p_partkey % 11 + 1] AS kind FROM part"


@query(f"SELECT tag_id, CASE WHEN category = 'highway' OR lower(trim(kind)) IN ('weir', 'wood', 'pitch') THEN false WHEN category = 'leisure' THEN kind = 'marina' WHEN category = 'landuse' THEN kind IN ('reservoir', 'basin') WHEN category = 'natural' THEN kind IN ('water', 'bay') ELSE true END AS is_water FROM ({TAGS})")
def flt2_water_tags(spark, sf_dir):
    pick = lambda xs, n: F.expr(f"element_at(array({', '.join(repr(x) for x in xs)}), cast(p_partkey % {n} as int) + 1)")
    category = pick(["water", "natural", "waterway", "landuse", "leisure", "highway"], 6)
    kind = pick(["lake", "water", "weir", "reservoir", "marina", "river", "Wood ", "pitch", "bay", "canal", "basin"], 11)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag_id"), T.is_water_tag(category, kind).alias("is_water"))


@query(f"WITH {PART}, n AS (SELECT entry_id, name || CASE WHEN entry_id % 10 = 0 THEN ' (ob. ryb. Narew)' ELSE '' END AS name FROM reg) SELECT entry_id, name LIKE '%nr 3%' AND entry_id % 10 <> 0 AS is_district FROM n")
def flt4_districts(spark, sf_dir):
    name = F.concat("name", F.when(F.col("entry_id") % 10 == 0, " (ob. ryb. Narew)").otherwise(""))
    return part(spark, sf_dir).select("entry_id", T.is_district(name).alias("is_district"))


@query("SELECT page_id, u.u AS variant, CASE u.u WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true WHEN 5 THEN false END AS usable FROM pages CROSS JOIN range(0, 6) u(u)")
def flt7_usable_sources(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("variant"), "url")
    v = F.col("variant")
    url = F.when(v == 0, F.col("url")).when(v == 1, F.regexp_replace("url", "^http", "ftp")).when(v == 2, F.regexp_replace("url", r"://[^/]*", "://host")).when(v == 3, F.regexp_replace("url", "://", "://me:x@")).when(v == 4, F.upper("url")).otherwise(F.regexp_replace(F.upper("url"), r"://[^/]*", "://HOST."))
    return pages.select("page_id", F.col("variant").cast("long").alias("variant"), T.usable_source(url).alias("usable"))


@query(f"WITH {PART} SELECT entry_id, src_ord FROM reg WHERE trim(name) <> '' AND key <> ''")
def src5_load_registry(spark, sf_dir):
    rows = part(spark, sf_dir)
    return R.load_union([rows.where(F.col("src_ord") == i).drop("src_ord") for i in range(3)]).select("entry_id", F.col("src_ord").cast("long").alias("src_ord"))


REPORTS = f"{PART}, rep AS (SELECT key, 2018 + entry_id % 4 AS year, area_ha / 10 AS kg_per_angler_day, entry_id FROM reg WHERE key <> '' AND area_ha IS NOT NULL)"


def reports(spark, sf_dir):
    rows = part(spark, sf_dir).select("key", (2018 + F.col("entry_id") % 4).alias("year"), (F.col("area_ha") / 10).alias("kg_per_angler_day"), "entry_id", F.col("section").alias("label"))
    return rows.where("key <> '' and kg_per_angler_day is not null")


@query(f"WITH {REPORTS} SELECT key, year, round(kg_per_angler_day, 6) AS kg_per_angler_day, entry_id FROM rep")
def src6_load_reports(spark, sf_dir):
    return r6(reports(spark, sf_dir).drop("label"))


@query("""WITH s AS (SELECT n_name AS slug, n_regionkey AS a, n_nationkey % 4 AS b FROM nation WHERE n_nationkey % 5 <> 0), t AS (SELECT n_name AS slug, n_regionkey AS a, n_nationkey % 3 AS b FROM nation WHERE n_nationkey % 7 <> 0)
  SELECT slug, CASE WHEN s.slug IS NOT NULL THEN s.a ELSE t.a END AS a, CASE WHEN s.slug IS NOT NULL THEN s.b ELSE t.b END AS b, CASE WHEN t.slug IS NULL THEN 'insert' WHEN s.slug IS NULL THEN 'kept' WHEN s.a = t.a AND s.b = t.b THEN 'same' ELSE 'update' END AS action FROM s FULL JOIN t USING (slug)""")
def src9_reference_sync(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    row = lambda m: nation.where(F.col("n_nationkey") % (5 if m == 4 else 7) != 0).select(F.col("n_name").alias("slug"), F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % m).alias("b"))
    return R.sync_reference(row(4), row(3), ["a", "b"])


@query(f"""WITH {PART}, pl AS (SELECT *, lower(trim(place)) AS pl FROM reg WHERE key <> ''), many AS (SELECT key, count(DISTINCT pl) AS n FROM pl WHERE pl <> '' GROUP BY 1), g AS (SELECT pl.*, CASE WHEN coalesce(n, 0) > 1 THEN pl ELSE '' END AS grp FROM pl LEFT JOIN many USING (key) WHERE coalesce(n, 0) <= 1 OR pl <> '')
  SELECT key, arg_max(name, (length(name), -src_ord * 1000000 - entry_id)) AS name, arg_min(nullif(place, ''), src_ord * 1000000 + entry_id) FILTER (place <> '') AS place, arg_min(section, src_ord * 1000000 + entry_id) FILTER (section IS NOT NULL) AS section, arg_min(area_ha, src_ord * 1000000 + entry_id) FILTER (area_ha IS NOT NULL) AS area_ha, count(*) AS n_records FROM g GROUP BY key, grp""")
def agg13_registry_merge(spark, sf_dir):
    rows = part(spark, sf_dir).where("key <> ''").withColumn("src_ord", F.col("src_ord") * 1000000 + F.col("entry_id"))
    return R.merge(rows, ["place", "section", "area_ha"])


@query(f"WITH {PART} SELECT key, count(*) AS waters FROM reg GROUP BY 1 HAVING count(*) > 1")
def agg16_shared_keys(spark, sf_dir):
    return R.shared_keys(part(spark, sf_dir))


@query("""WITH m AS (SELECT l_orderkey AS report_id, l_returnflag AS species, sum(l_quantity) AS share FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY share DESC, species) AS place FROM m)
  SELECT report_id, CAST(place - 1 AS integer) AS place, CASE species WHEN 'A' THEN 'Bream' WHEN 'N' THEN 'Roach' ELSE species END AS species, round(share, 6) AS share FROM r WHERE place <= 2""")
def agg15_top_species(spark, sf_dir):
    shares = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("report_id"), "l_returnflag").agg(F.sum("l_quantity").alias("share"))
    maps = shares.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "share"))).alias("species_pct"))
    return r6(R.top_species(maps, {"A": "Bream", "N": "Roach"}, 2))


#: Every third entry has a word of its own, so that some keys are unique; half the queries ask for one, whole or cut short.
QUERIES_SQL = """listed AS (SELECT entry_id, name, key || CASE WHEN entry_id % 3 = 0 THEN ' ' || translate(CAST(entry_id AS varchar), '0123456789', 'abcdefghij') || 'own' ELSE '' END AS key FROM reg),
  q AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 4 = 1 AND key IS NOT NULL THEN key WHEN s_suppkey % 4 = 3 AND key IS NOT NULL THEN left(key, length(key) - 1) ELSE (['ring small', 'widget red', 'small', 'green bolt zolw nr 3', 'large gearing', 'red widg', 'blue zzz'])[s_suppkey % 7 + 1] END AS key FROM supplier LEFT JOIN listed ON entry_id = 3 * s_suppkey)"""


def listed(spark, sf_dir):
    own = F.when(F.col("entry_id") % 3 == 0, F.concat(F.lit(" "), F.translate(F.col("entry_id").cast("string"), "0123456789", "abcdefghij"), F.lit("own"))).otherwise("")
    return part(spark, sf_dir, spread=True).withColumn("key", F.concat("key", own))


def asked(spark, sf_dir):
    names = ["ring small", "widget red", "small", "green bolt zolw nr 3", "large gearing", "red widg", "blue zzz"]
    common = F.expr(f"element_at(array({', '.join(map(repr, names))}), cast(query_id % 7 as int) + 1)")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") * 3).alias("entry_id")).join(listed(spark, sf_dir).select("entry_id", "key"), "entry_id", "left")
    turn = F.when(F.col("key").isNotNull(), F.col("query_id") % 4)
    return rows.select("query_id", F.when(turn == 1, F.col("key")).when(turn == 3, F.left("key", F.length("key") - 1)).otherwise(common).alias("key"))


@query(f"WITH {PART}, {QUERIES_SQL} SELECT query_id, count(entry_id) AS hits, CASE WHEN count(entry_id) = 1 THEN min(entry_id) END AS entry_id FROM q LEFT JOIN (SELECT key, entry_id FROM listed) r USING (key) GROUP BY 1")
def jn5_exact_match(spark, sf_dir):
    return R.match_exact(asked(spark, sf_dir), listed(spark, sf_dir))


FUZZY = """tk AS (SELECT entry_id, list_filter(string_split(key, ' '), lambda t: length(t) >= 3) AS k FROM listed), tq AS (SELECT query_id, list_filter(string_split(key, ' '), lambda t: length(t) >= 3) AS q FROM q),
  uq AS (SELECT query_id, q[1] AS head, unnest(q) AS t FROM tq), uk AS (SELECT entry_id, unnest(k) AS o FROM tk), tm AS (SELECT DISTINCT query_id, entry_id, t FROM uq JOIN uk ON t = o OR (length(t) >= greatest(4, (7 * greatest(length(t), length(o)) + 9) // 10) AND length(o) >= greatest(4, (7 * greatest(length(t), length(o)) + 9) // 10) AND left(t, CAST(greatest(4, (7 * greatest(length(t), length(o)) + 9) // 10) AS bigint)) = left(o, CAST(greatest(4, (7 * greatest(length(t), length(o)) + 9) // 10) AS bigint)))),
  full_ AS (SELECT tm.query_id, entry_id FROM tm JOIN (SELECT query_id, count(DISTINCT t) AS n FROM uq GROUP BY 1) n ON n.query_id = tm.query_id GROUP BY 1, 2, n.n HAVING count(DISTINCT t) = n.n), fz AS (SELECT q.query_id, count(entry_id) AS hits, CASE WHEN count(entry_id) = 1 THEN min(entry_id) END AS entry_id FROM q LEFT JOIN full_ USING (query_id) GROUP BY 1)"""


@query(f"WITH {PART}, {QUERIES_SQL}, {FUZZY} SELECT query_id, hits, entry_id FROM fz")
def jn6_fuzzy_match(spark, sf_dir):
    return R.match_fuzzy(asked(spark, sf_dir), listed(spark, sf_dir))


@query(f"""WITH {PART}, {QUERIES_SQL}, {FUZZY}, ex AS (SELECT query_id, count(entry_id) AS hits, CASE WHEN count(entry_id) = 1 THEN min(entry_id) END AS entry_id FROM q LEFT JOIN (SELECT key, entry_id FROM listed) r USING (key) GROUP BY 1), ins AS (SELECT query_id, query_id + 1000 AS entry_id FROM q WHERE query_id % 9 = 0)
  SELECT q.query_id, CASE WHEN ins.entry_id IS NOT NULL THEN 'inside' WHEN ex.entry_id IS NOT NULL THEN 'exact' WHEN ex.hits = 0 AND fz.entry_id IS NOT NULL THEN 'fuzzy' END AS how, CASE WHEN ins.entry_id IS NOT NULL THEN ins.entry_id WHEN ex.entry_id IS NOT NULL THEN ex.entry_id WHEN ex.hits = 0 THEN fz.entry_id END AS entry_id
  FROM q LEFT JOIN ins USING (query_id) LEFT JOIN ex USING (query_id) LEFT JOIN fz USING (query_id)""")
def jn8_match_cascade(spark, sf_dir):
    queries, entries = asked(spark, sf_dir), listed(spark, sf_dir)
    inside = queries.where("query_id % 9 = 0").select("query_id", (F.col("query_id") + 1000).alias("entry_id"))
    return R.cascade(queries, inside, R.match_exact(queries, entries), R.match_fuzzy(queries, entries))


POSITIONS = "49 + (s_suppkey % 60) / 10.0 AS lat, 14 + (s_suppkey % 90) / 10.0 AS lon"


@query(f"""WITH c AS (SELECT s_suppkey AS cand_id, 'Name ' || s_suppkey % 13 AS name, 'way' AS osm_type, s_suppkey AS osm_id, {POSITIONS} FROM supplier), s AS (SELECT s_suppkey AS site_id, 'name ' || s_suppkey % 13 AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'NAME ' || s_suppkey % 17 END AS name_alt, 'way' AS osm_type, s_suppkey + 50 AS osm_id, 49 + ((s_suppkey + 1) % 60) / 10.0 AS lat, 14 + ((s_suppkey + 1) % 90) / 10.0 AS lon FROM supplier),
  bi AS (SELECT cand_id, min(site_id) AS site_id FROM c JOIN s USING (osm_type, osm_id) GROUP BY 1), d AS (SELECT cand_id, site_id, sqrt(pow((s.lat - c.lat) * 111320, 2) + pow((s.lon - c.lon) * 111320 * cos(radians((s.lat + c.lat) / 2)), 2)) AS d FROM c JOIN s ON lower(c.name) = lower(s.name) OR lower(c.name) = lower(s.name_alt)),
  bn AS (SELECT cand_id, arg_min(site_id, (d, site_id)) AS site_id FROM d WHERE d <= 60000 GROUP BY 1) SELECT c.cand_id, coalesce(bi.site_id, bn.site_id) AS site_id, CASE WHEN bi.site_id IS NOT NULL THEN 'id' WHEN bn.site_id IS NOT NULL THEN 'name' END AS how FROM c LEFT JOIN bi USING (cand_id) LEFT JOIN bn USING (cand_id)""")
def jn10_find_existing(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    at = lambda k: (F.expr(f"49 + ((s_suppkey + {k}) % 60) / 10").alias("lat"), F.expr(f"14 + ((s_suppkey + {k}) % 90) / 10").alias("lon"))
    candidates = s.select(F.col("s_suppkey").alias("cand_id"), F.expr("concat('Name ', s_suppkey % 13)").alias("name"), F.lit("way").alias("osm_type"), F.col("s_suppkey").alias("osm_id"), *at(0))
    stored = s.select(F.col("s_suppkey").alias("site_id"), F.expr("concat('name ', s_suppkey % 13)").alias("name"), F.expr("case when s_suppkey % 2 = 0 then concat('NAME ', s_suppkey % 17) end").alias("name_alt"), F.lit("way").alias("osm_type"), (F.col("s_suppkey") + 50).alias("osm_id"), *at(1))
    return R.find_existing(candidates, stored, 60_000.0)


@query(f"WITH {REPORTS}, s AS (SELECT n_nationkey AS site_id, unnest((SELECT list(k ORDER BY k) FROM (SELECT DISTINCT key AS k FROM reg WHERE entry_id % 25 = n_nationkey))) AS key FROM nation), m AS (SELECT site_id, year, count(*) AS n, min(kg_per_angler_day) AS rate FROM s JOIN rep USING (key) WHERE rep.entry_id < 60 GROUP BY 1, 2) SELECT site_id, max(year) AS year, round(arg_max(rate, year), 6) AS rate FROM m WHERE n = 1 GROUP BY 1")
def jn11_newest_for_keys(spark, sf_dir):
    rows = part(spark, sf_dir)
    sites = rows.groupBy((F.col("entry_id") % 25).alias("site_id")).agg(F.collect_set("key").alias("keys"))
    return r6(R.newest_for_keys(sites, reports(spark, sf_dir).where("entry_id < 60")))


@query("""WITH s AS (SELECT n_nationkey AS site_id, n_name AS name, CASE WHEN n_regionkey > 2 THEN 'pzw' END AS water_type, CASE WHEN n_regionkey = 1 THEN 'k' END AS registry_key FROM nation), m AS (SELECT n_nationkey AS site_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'X' || n_name END AS m_name, 'commercial' AS m_type, 'key' || n_nationkey AS m_key FROM nation WHERE n_nationkey % 3 > 0)
  SELECT s.site_id, coalesce(m_name, name) AS name, CASE WHEN m_name <> name THEN name END AS name_alt, coalesce(water_type, m_type) AS water_type, coalesce(registry_key, m_key) AS registry_key, concat_ws(',', CASE WHEN water_type IS NULL AND m_type IS NOT NULL THEN 'type' END, CASE WHEN registry_key IS NULL AND m_key IS NOT NULL THEN 'key' END, CASE WHEN m_name <> name THEN 'name' END) AS changes, m_key IS NULL AS unresolved FROM s LEFT JOIN m USING (site_id)""")
def jn14_back_fill(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    sites = n.select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("name"), F.expr("case when n_regionkey > 2 then 'pzw' end").alias("water_type"), F.expr("case when n_regionkey = 1 then 'k' end").alias("registry_key"))
    matches = n.where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("site_id"), F.expr("case when n_nationkey % 2 = 0 then n_name else concat('X', n_name) end").alias("m_name"), F.lit("commercial").alias("m_type"), F.expr("concat('key', n_nationkey)").alias("m_key"))
    return R.back_fill(sites, matches)


@query()
def set3_collapse_duplicates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("cand_id"), F.col("s_suppkey").alias("pos"), F.expr("concat('Jezioro ', s_suppkey % 11)").alias("name"), F.expr("element_at(array('lake', 'river', 'pond'), cast(s_suppkey % 3 as int) + 1)").alias("kind"), F.expr("element_at(array('way', 'relation', 'node'), cast(s_suppkey % 7 % 3 as int) + 1)").alias("osm_type"), F.abs("s_acctbal").alias("area_ha"), F.expr("52 + (s_suppkey % 5) / 100").alias("lat"), F.lit(21.0).alias("lon"))
    return R.collapse(rows)


@query(f"WITH {PART}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src_ord, entry_id) AS r FROM reg) SELECT key, entry_id FROM w WHERE r = 1")
def set4_first_by_key(spark, sf_dir):
    return R.first_of_each(part(spark, sf_dir), ["key"], ["src_ord", "entry_id"]).select("key", "entry_id")


@query(f"WITH {PART} SELECT * FROM (SELECT entry_id, row_number() OVER (ORDER BY coalesce(area_ha, 0) DESC, entry_id) AS place FROM reg) WHERE place <= 100")
def top1_by_area(spark, sf_dir):
    """The report keeps the hundred largest; the place needs one order over all, so only they are numbered."""
    from pyspark.sql import Window

    top = part(spark, sf_dir).orderBy(F.desc(F.coalesce("area_ha", F.lit(0.0))), "entry_id").limit(100)
    return top.select("entry_id", F.row_number().over(Window.orderBy(F.desc(F.coalesce("area_ha", F.lit(0.0))), "entry_id")).alias("place"))


@query()
def top2_district_suggestions(spark, sf_dir):
    rows = part(spark, sf_dir, spread=True).select("entry_id", "name", "key", F.when(F.col("entry_id") % 3 > 0, F.col("area_ha")).alias("lat"), F.when(F.col("entry_id") % 6 == 0, F.array(F.lit(1.0))).alias("line"))
    queries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.expr("element_at(array('small ring', 'red', 'zolw', 'green bolt', 'widget zolw nr', 'ed'), cast(s_suppkey % 6 as int) + 1)").alias("key"))
    return r6(R.districts(queries, rows))


# Facts


def _items(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    topics = ["species", "depth", "bottom", "access", "rules", "stocking", "weather", "gossip"]
    return c.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("pos"), F.expr(f"element_at(array({', '.join(map(repr, topics))}), cast((turn + conv_id) % 8 as int) + 1)").alias("topic"), F.expr("case when turn % 5 = 4 then ' ' else concat('Key', turn % 3) end").alias("key"), F.expr("left(text, 40)").alias("value"), F.expr("case when conv_id % 4 = 3 then 'nowhere' else concat('https://www', turn, '.example.com/a') end").alias("source_url"), F.expr("case when turn % 2 = 0 then 'T' end").alias("source_title"), F.expr("case turn % 3 when 0 then 'HIGH' when 1 then 'sure' end").alias("confidence"))


ITEMS = "i AS (SELECT conv_id AS answer_id, turn AS pos, (['species', 'depth', 'bottom', 'access', 'rules', 'stocking', 'weather', 'gossip'])[(turn + conv_id) % 8 + 1] AS topic, CASE WHEN turn % 5 = 4 THEN '' ELSE 'Key' || turn % 3 END AS key, left(text, 40) AS value, CASE WHEN conv_id % 4 = 3 THEN 'nowhere' ELSE 'https://www' || turn || '.example.com/a' END AS source_url, CASE WHEN turn % 2 = 0 THEN 'T' ELSE CASE WHEN conv_id % 4 = 3 THEN '' ELSE 'www' || turn || '.example.com' END END AS source_title, CASE WHEN turn % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM conversations), v AS (SELECT *, CASE WHEN topic IN ('weather', 'gossip') THEN 'unknown topic' WHEN key = '' OR trim(value, ' ') = '' OR value IS NULL THEN 'empty key or value' WHEN source_url = 'nowhere' THEN 'no usable source' END AS r0 FROM i), jf AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY answer_id, topic, lower(key), r0 IS NULL ORDER BY pos) > 1 THEN 'duplicate' ELSE r0 END AS reason FROM v)"


@query(f"WITH {ITEMS} SELECT answer_id, pos, topic, key, confidence, source_title, reason FROM jf")
def jsn1_validate_facts(spark, sf_dir):
    return R.parse_facts(_items(spark, sf_dir)).select("answer_id", "pos", "topic", "key", "confidence", "source_title", "reason")


@query(f"WITH {ITEMS} SELECT answer_id, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason = 'duplicate') AS duplicates FROM jf GROUP BY 1")
def jsn2_keep_first(spark, sf_dir):
    rows = R.parse_facts(_items(spark, sf_dir))
    return rows.groupBy("answer_id").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_if(F.col("reason") == "duplicate").alias("duplicates"))


FACTS = f"{ITEMS}, fa AS (SELECT answer_id % 25 AS site_id, answer_id AS pass_at, pos, topic, key, CASE WHEN pos % 3 = 1 THEN 'pl' WHEN pos % 3 = 2 THEN 'en' END AS lang FROM jf WHERE reason IS NULL), ps AS (SELECT site_id, pass_at, lead(pass_at) OVER (PARTITION BY site_id ORDER BY pass_at) AS superseded_at FROM (SELECT DISTINCT conv_id % 25 AS site_id, conv_id AS pass_at FROM conversations)), sf AS (SELECT fa.*, superseded_at FROM fa JOIN ps USING (site_id, pass_at))"


def _facts(spark, sf_dir):
    kept = R.parse_facts(_items(spark, sf_dir)).where("reason is null")
    facts = kept.select((F.col("answer_id") % 25).alias("site_id"), F.col("answer_id").alias("pass_at"), "pos", "topic", "key", F.expr("case pos % 3 when 1 then 'pl' when 2 then 'en' end").alias("lang"))
    passes = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 25).alias("site_id"), F.col("conv_id").alias("pass_at"))
    return R.supersede(passes, facts)


@query(f"WITH {FACTS} SELECT site_id, pass_at, pos, superseded_at FROM sf")
def jsn3_supersede(spark, sf_dir):
    return _facts(spark, sf_dir).select("site_id", "pass_at", "pos", "superseded_at")


@query(f"WITH {FACTS}, st AS (SELECT site_id, pos, topic, coalesce(lang, 'en') AS lang FROM sf WHERE superseded_at IS NULL), h AS (SELECT *, max(CASE WHEN lang = 'pl' THEN 1 ELSE 0 END) OVER (PARTITION BY site_id) AS has FROM st) SELECT site_id, pos, topic, list_position(['species', 'depth', 'bottom', 'access', 'rules', 'stocking'], topic) AS topic_order FROM h WHERE lang = CASE WHEN has = 1 THEN 'pl' ELSE 'en' END")
def jsn4_standing_facts(spark, sf_dir):
    return R.standing(_facts(spark, sf_dir), "pl").select("site_id", "pos", "topic", "topic_order")


@query("SELECT event_id, CAST(props->>'k' AS integer) AS k, strftime(ts + INTERVAL 1 HOUR, '%H:%M') AS local_time FROM events")
def jsn5_payload_columns(spark, sf_dir):
    from sitecast.plans.fixtures import EPOCH

    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.from_utc_timestamp(F.timestamp_seconds(F.expr(EPOCH) + F.expr("minute(ts) * 60L")), "Europe/Warsaw").alias("local"))
    return rows.select("event_id", "k", F.date_format("local", "HH:mm").alias("local_time"))


@query(f"WITH c AS (SELECT s_suppkey AS site_id, {POSITIONS} FROM supplier) SELECT site_id, round(sqrt(pow((52.2 - lat) * 111320, 2) + pow((21.0 - lon) * 111320 * cos(radians((52.2 + lat) / 2)), 2)), 3) AS metres FROM c")
def geo1_flat_distance(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.expr("49 + (s_suppkey % 60) / 10").alias("lat"), F.expr("14 + (s_suppkey % 90) / 10").alias("lon"))
    return s.select("site_id", F.round(flat_distance_m(F.col("lat"), F.col("lon"), F.lit(52.2), F.lit(21.0)), 3).alias("metres"))
