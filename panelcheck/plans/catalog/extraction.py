"""Catalog: declaration extraction and recognition results."""

from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.operators import ocr as OC
from panelcheck.operators.extract import dates as D
from panelcheck.operators.extract import run as X
from panelcheck.operators.extract import simple as S
from panelcheck.operators.extract.care import extract_consumer_care
from panelcheck.operators.extract.tabular import extract_mrp_tabular
from panelcheck.plans.catalog.registry import query
from panelcheck.plans.catalog.views import view, with_views

# Label texts that reach more branches than the plain fixture lines: one of forty per image.
SAMPLES = [
    "NET WT. 500 g", "4N x 100g = 400g", "Energy 250 kcal per 100 g", "WEIGHT", "750 ML", "M.R.P.", "Rs. 130.00", "45.00",
    "UNIT SALE PRICE Rs. 1.89/g", "Incl. of all taxes", "Product of India", "MADE IN CHINA", "Origin THAILAND", "10 cm x 15 cm x 5 cm",
    "Size: 100 x 50 mm", "Pack of 12 pieces", "Contents 20 tablets", "IMPORTED BY: Globe Traders, Mumbai", "PACKED AT: Unit 4, Pune",
    "Marketed by: Best Brands Ltd", "RSP Rs. 12.5 incl taxes", "Retail Sale Price: 40", "Name of Commodity: Basmati Rice",
    "BISCUITS NET WEIGHT", "TOTAL NET WT. 240 g", "PKD.", "12/08/2026", "05/2027", "MFG DATE 3/26", "Packed on AUG 2026", "Exp 11/2027",
    "Toll Free 1800-123-4567", "write to care@brand.co.in", "Call 9876543210", "Fssai Lic.No 10012345678901", "AMUL", "Golden Butter",
    "FRESH PREMIUM Tea", "7", "20.00",
]


def samples(f):
    """Nine lines per part as in the fixture, with texts drawn from the list above."""
    p, n = F.col("source_image_id"), F.col("line_number")
    pick = ((p * 17 + n * n * 5 + n * p) % len(SAMPLES)).cast("int")
    text = F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), pick + 1)
    return f.ocr_lines().withColumn("text", text).withColumn("x", 10.0 + (p * 7 + n * 90) % 700)


def _quote(t):
    return "'" + t.replace("'", "''") + "'"


view("samples", ("ocr_lines",), "SELECT * REPLACE (([" + ", ".join(_quote(s) for s in SAMPLES)
     + f"])[CAST((source_image_id * 17 + line_number * line_number * 5 + line_number * source_image_id) % {len(SAMPLES)} AS INT) + 1] AS text,"
     " 10.0e0 + (source_image_id * 7 + line_number * 90) % 700 AS x) FROM ocr_lines")
# fixture lines and sample lines together, under different image ids
view("lines", ("ocr_lines", "samples"), """SELECT source_image_id * 2 AS source_image_id, line_number, text, confidence, x, y, w, h FROM ocr_lines
 UNION ALL SELECT source_image_id * 2 + 1, line_number, text, confidence, x, y, w, h FROM samples""")
view("near_lines", ("lines",), """SELECT *, lag(text) OVER g AS prev_text, lead(text) OVER g AS next1, lead(text, 2) OVER g AS next2
 FROM lines WINDOW g AS (PARTITION BY source_image_id ORDER BY line_number)""")


def lines(f):
    i = F.col("source_image_id")
    cols = ["source_image_id", "line_number", "text", "confidence", "x", "y", "w", "h"]
    a = f.ocr_lines().withColumn("source_image_id", i * 2).select(*cols)
    return a.unionByName(samples(f).withColumn("source_image_id", i * 2 + 1).select(*cols))


def rx(col, pattern, group=1, flags="i"):
    return f"nullif(regexp_extract({col}, {_quote(pattern)}, {group}, '{flags}'), '')"


def hit(col, pattern, flags="i"):
    return f"coalesce(regexp_matches({col}, {_quote(pattern)}, '{flags}'), FALSE)"


def any_word(col, words):
    return "(" + " OR ".join(f"contains({col}, {_quote(w)})" for w in words) + ")"


RAISED = "round(CASE WHEN {c} THEN least(1.0e0, confidence + 0.05e0) ELSE confidence END, 4)"
_TAX = lambda c: hit(c, V.TAX_INCLUSIVE)
view("mrp_direct", ("near_lines",), f"""SELECT source_image_id, line_number, concat_ws(' ', text, tax_text) AS raw_text,
 concat('{{"amount": ', CAST(round(price, 2) AS VARCHAR), ', "currency": "INR", "inclusive_of_all_taxes": ', CASE WHEN taxed THEN 'true' ELSE 'false' END, '}}') AS parsed_value,
 {RAISED.format(c='taxed')} AS confidence, CASE WHEN taxed THEN 'pass' ELSE 'needs_review' END AS verdict
 FROM (SELECT *, {_TAX('text')} OR tax_text IS NOT NULL AS taxed FROM (SELECT *, CAST(replace({rx('text', V.MRP_DIRECT)}, ',', '.') AS DOUBLE) AS price,
  CASE WHEN {_TAX('next1')} THEN next1 WHEN {_TAX('prev_text')} THEN prev_text WHEN {_TAX('next2')} THEN next2 END AS tax_text FROM near_lines) a) b WHERE price > 0""")


@query("x2_extract_mrp_direct", with_views("mrp_direct") + "SELECT * FROM mrp_direct")
def _(f):
    return S.extract_mrp_direct(lines(f)).select("source_image_id", "line_number", "raw_text", "parsed_value", "confidence", "verdict")


@query("x3_extract_mrp_tabular")
def _(f):
    rows = lines(f)
    return extract_mrp_tabular(rows, S.extract_mrp_direct(rows))


@query("x5_split_digit_repair")
def _(f):
    """Tabular prices whose raw text has a lone digit between header and value."""
    rows = lines(f)
    return extract_mrp_tabular(rows, S.extract_mrp_direct(rows)).filter(F.col("raw_text").rlike(r" [0-9] "))


@query(
    "x4_extract_usp",
    with_views("lines")
    + f"""SELECT source_image_id, arg_max(v, line_number) AS unit_sale_price, arg_max(u, line_number) AS unit_sale_unit
 FROM (SELECT *, CAST({rx('text', V.USP_VALUE)} AS DOUBLE) AS v, lower({rx('text', V.USP_VALUE, 2)}) AS u FROM lines WHERE {hit('text', V.USP_HEADER)}) q
 WHERE v IS NOT NULL GROUP BY 1""",
)
def _(f):
    return S.extract_usp(lines(f))


_UNIT = "CASE lower({u}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.UNIT_NAMES.items()) + " ELSE lower({u}) END"
_M = lambda i: rx("text", V.QUANTITY_MULTIPACK, i)
view("multipack", ("near_lines",), f"""SELECT source_image_id, line_number,
 CASE WHEN {any_word("lower(coalesce(prev_text, ''))", V.MULTIPACK_PREVIOUS)} THEN concat_ws(' ', prev_text, text) ELSE text END AS raw_text,
 concat('{{"value": ', CAST(CAST({_M(4)} AS DOUBLE) AS VARCHAR), ', "unit": "', {_UNIT.format(u=_M(5))}, '", "raw_unit": "', {_M(5)},
 '", "is_multipack": true, "units_count": ', {_M(1)}, ', "unit_quantity": ', CAST(CAST({_M(2)} AS DOUBLE) AS VARCHAR), '}}') AS parsed_value,
 {RAISED.format(c='TRUE')} AS confidence FROM near_lines WHERE {_M(1)} IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY source_image_id ORDER BY line_number) = 1""")
_NUT = lambda c: any_word(f"lower({c})", V.NUTRITION_WORDS)
view("standard_qty", ("near_lines", "multipack"), f"""SELECT source_image_id, line_number, CASE WHEN below THEN concat_ws(' ', text, next1) ELSE text END AS raw_text,
 concat('{{"value": ', CAST(v AS VARCHAR), ', "unit": "', {_UNIT.format(u='u')}, '", "raw_unit": "', u, '"}}') AS parsed_value,
 {RAISED.format(c='prefixed')} AS confidence
 FROM (SELECT *, CAST(CASE WHEN prefixed THEN {rx('text', V.QUANTITY_PREFIXED)} WHEN alone THEN {rx('text', V.QUANTITY_STANDALONE)} WHEN below THEN {rx('next1', V.QUANTITY_STANDALONE)} END AS DOUBLE) AS v,
   CASE WHEN prefixed THEN {rx('text', V.QUANTITY_PREFIXED, 2)} WHEN alone THEN {rx('text', V.QUANTITY_STANDALONE, 2)} WHEN below THEN {rx('next1', V.QUANTITY_STANDALONE, 2)} END AS u
  FROM (SELECT *, kw AND NOT alone AND next1 IS NOT NULL AND NOT {_NUT('next1')} AND {rx('next1', V.QUANTITY_STANDALONE)} IS NOT NULL AS below
   FROM (SELECT *, kw AND {rx('text', V.QUANTITY_STANDALONE)} IS NOT NULL AS alone
    FROM (SELECT *, NOT prefixed AND {any_word('lower(text)', V.QUANTITY_KEYWORDS)} AS kw
     FROM (SELECT *, {rx('text', V.QUANTITY_PREFIXED)} IS NOT NULL AS prefixed FROM near_lines WHERE NOT {_NUT('text')}) a) b) c) d) e
 WHERE v > 0 AND source_image_id NOT IN (SELECT source_image_id FROM multipack)""")
_Q = "SELECT source_image_id, line_number, raw_text, parsed_value, confidence FROM"


@query("x6_extract_multipack", with_views("multipack") + f"{_Q} multipack")
def _(f):
    rows = S.extract_net_quantity(lines(f)).filter("stage = 0")
    return rows.select("source_image_id", "line_number", "raw_text", "parsed_value", "confidence")


@query("x7_extract_net_quantity", with_views("multipack", "standard_qty") + f"{_Q} multipack UNION ALL {_Q} standard_qty")
def _(f):
    return S.extract_net_quantity(lines(f)).select("source_image_id", "line_number", "raw_text", "parsed_value", "confidence")


@query(
    "x8_extract_manufacturer",
    with_views("ocr_lines")
    + """SELECT source_image_id, line_number, address AS raw_text, concat('{"role": "manufacturer", "name_and_address": "', address, '", "pincode": "',
 CAST(122000 + source_image_id % 900 AS VARCHAR), '", "has_valid_pincode": true}') AS parsed_value,
 round(least(1.0e0, confidence + 0.05e0), 4) AS confidence, 10.0e0 AS x, 150.0e0 AS y, 200.0e0 AS w, 115.0e0 AS h, 'pass' AS verdict
 FROM (SELECT *, concat_ws(', ', text, lead(text) OVER g, lead(text, 2) OVER g, lead(text, 3) OVER g) AS address FROM ocr_lines
  WINDOW g AS (PARTITION BY source_image_id ORDER BY line_number)) q WHERE line_number = 5""",
)
def _(f):
    return S.extract_manufacturer(f.ocr_lines()).select(
        "source_image_id", "line_number", "raw_text", "parsed_value", "confidence", "x", "y", "w", "h", "verdict"
    )


@query("x8_extract_manufacturer_samples")
def _(f):
    return S.extract_manufacturer(lines(f))


@query("x9_extract_mfg_date")
def _(f):
    return D.extract_mfg_date(lines(f))


@query(
    "x9_extract_mfg_date_headed",
    with_views("ocr_lines")
    + """SELECT source_image_id, line_number, text AS raw_text, concat('{"month": "', m, '", "year": "2026", "day": null, "formatted": "', m, '/2026"}') AS parsed_value,
 round(confidence, 4) AS confidence FROM (SELECT *, concat('0', CAST(1 + source_image_id % 9 AS VARCHAR)) AS m FROM ocr_lines WHERE line_number = 4) q""",
)
def _(f):
    return D.extract_mfg_date(f.ocr_lines()).select("source_image_id", "line_number", "raw_text", "parsed_value", "confidence")


@query(
    "x10_normalize_date",
    """SELECT o_orderkey AS id, lpad(m, 2, '0') AS month, CASE WHEN k = 1 THEN concat('20', right(y, 2)) ELSE y END AS year, CASE WHEN k = 2 THEN lpad(d, 2, '0') ELSE '' END AS day
 FROM (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(month(o_orderdate) AS VARCHAR) AS m, CAST(year(o_orderdate) + 26 AS VARCHAR) AS y, CAST(day(o_orderdate) AS VARCHAR) AS d FROM orders) q""",
)
def _(f):
    d = F.col("o_orderdate")
    y = (F.year(d) + 26).cast("string")
    m, day = F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat_ws("/", m, y)).when(k == 1, F.concat_ws("-", m, F.substring(y, 3, 2)))
        .when(k == 2, F.concat_ws(".", day, m, y)).otherwise(F.concat_ws(" ", F.date_format(d, "MMM"), y))
    )
    return f.base("orders").select(F.col("o_orderkey").alias("id"), D.normalize_date(text).alias("d")).select("id", "d.*")


@query("x11_extract_consumer_care_samples")
def _(f):
    return extract_consumer_care(lines(f))


@query(
    "x11_extract_consumer_care",
    with_views("ocr_lines")
    + """SELECT source_image_id, line_number, text AS raw_text, concat('{"email": "care', CAST(source_image_id AS VARCHAR), '@acme.in", "phone": null, "has_email": true, "has_phone": false}') AS parsed_value,
 round(confidence, 4) AS confidence, 'pass' AS verdict FROM ocr_lines WHERE line_number = 7""",
)
def _(f):
    rows = extract_consumer_care(f.ocr_lines())
    return rows.select("source_image_id", "line_number", "raw_text", "parsed_value", "confidence", "verdict")


_SQUEEZED = "replace(lower(text), ' ', '')"
_CN = f"trim(coalesce({rx('text', V.ORIGIN_PHRASE)}, CASE WHEN {any_word(_SQUEEZED, V.ORIGIN_KEYWORDS)} THEN {rx('text', V.ORIGIN_COUNTRY)} END))"


@query(
    "x12_extract_country",
    with_views("lines")
    + f"""SELECT source_image_id, line_number, concat('{{"country": "', upper(n), '", "raw_country": "', n, '"}}') AS parsed_value, round(confidence, 4) AS confidence
 FROM (SELECT *, nullif({_CN}, '') AS n FROM lines) q WHERE n IS NOT NULL""",
)
def _(f):
    return S.extract_country(lines(f)).select("source_image_id", "line_number", "parsed_value", "confidence")


_NAME = lambda method: "concat('{\"commodity_name\": \"', n, '\", \"detection_method\": \"" + method + "\"}')"
view("named_explicit", ("lines",), f"""SELECT source_image_id, line_number, text AS raw_text, {_NAME('explicit_header')} AS parsed_value, round(confidence, 4) AS confidence
 FROM (SELECT *, regexp_replace(trim({rx('text', V.NAME_EXPLICIT)}), {_quote(V.NAME_TRIM_MARK)}, '', 'i') AS n FROM lines) q
 WHERE n <> '' AND NOT {hit('n', V.NAME_INSTRUCTION)} AND NOT {hit('n', V.NAME_BUSINESS)}
 QUALIFY row_number() OVER (PARTITION BY source_image_id ORDER BY line_number) = 1""")
view("named_prefix", ("lines", "named_explicit"), f"""SELECT source_image_id, line_number, text AS raw_text, {_NAME('net_weight_prefix')} AS parsed_value, round(confidence, 4) AS confidence
 FROM (SELECT *, upper({rx('text', V.NAME_BEFORE_NET)}) AS n FROM lines) q
 WHERE n IS NOT NULL AND lower(n) NOT IN ({", ".join(_quote(w) for w in V.NAME_STOP_WORDS)}) AND source_image_id NOT IN (SELECT source_image_id FROM named_explicit)
 QUALIFY row_number() OVER (PARTITION BY source_image_id ORDER BY line_number) = 1""")


@query("x13_commodity_explicit", with_views("named_explicit") + f"{_Q} named_explicit")
def _(f):
    rows = S.extract_commodity_name(lines(f)).filter("stage = 0")
    return rows.select("source_image_id", "line_number", "raw_text", "parsed_value", "confidence")


@query("x14_commodity_before_net", with_views("named_prefix") + f"{_Q} named_prefix")
def _(f):
    rows = S.extract_commodity_name(lines(f)).filter("stage = 1")
    return rows.select("source_image_id", "line_number", "raw_text", "parsed_value", "confidence")


@query("x15_commodity_headline")
def _(f):
    return S.extract_commodity_name(lines(f)).filter("stage = 2")


_D = lambda i: rx("trim(text)", V.DIMENSIONS, i)
view("dims", ("lines",), f"""SELECT source_image_id, line_number, concat(concat_ws(' x ', {_D(1)}, {_D(3)}, {_D(5)}), ' ', lower(coalesce({_D(6)}, {_D(4)}, {_D(2)}, 'cm'))) AS parsed_value,
 least(confidence, 0.95e0) AS confidence FROM lines WHERE {_D(1)} IS NOT NULL AND {_D(3)} IS NOT NULL""")


@query("x16_extract_dimensions", with_views("dims") + "SELECT source_image_id, line_number, parsed_value, confidence FROM dims")
def _(f):
    rows = S.extract_dimensions(lines(f)).filter("field_type = 'dimensions'")
    return rows.select("source_image_id", "line_number", "parsed_value", "confidence")


@query(
    "x17_extract_item_count",
    with_views("lines")
    + f"""SELECT source_image_id, line_number, concat({rx('trim(text)', V.ITEM_COUNT)}, ' N') AS parsed_value, least(confidence, 0.94e0) AS confidence
 FROM lines WHERE {rx('trim(text)', V.ITEM_COUNT)} IS NOT NULL AND {_D(1)} IS NULL""",
)
def _(f):
    rows = S.extract_dimensions(lines(f)).filter("field_type = 'item_count'")
    return rows.select("source_image_id", "line_number", "parsed_value", "confidence")


_IP = [("importer_address", V.IMPORTER, 0.93), ("packer_address", V.PACKER, 0.92), ("marketer_address", V.MARKETER, 0.90)]


@query(
    "x18_extract_importer_packer",
    with_views("lines")
    + "SELECT source_image_id, line_number, field_type, parsed_value, least(confidence, cap) AS confidence FROM (SELECT *, CASE "
    + " ".join(f"WHEN length(trim({rx('text', p)})) >= 3 THEN '{t}'" for t, p, _c in _IP) + " END AS field_type, CASE "
    + " ".join(f"WHEN length(trim({rx('text', p)})) >= 3 THEN trim({rx('text', p)})" for _t, p, _c in _IP) + " END AS parsed_value, CASE "
    + " ".join(f"WHEN length(trim({rx('text', p)})) >= 3 THEN {c}e0" for _t, p, c in _IP)
    + " END AS cap FROM lines WHERE length(trim(text)) >= 6) q WHERE field_type IS NOT NULL",
)
def _(f):
    return S.extract_importer_packer(lines(f)).select("source_image_id", "line_number", "field_type", "parsed_value", "confidence")


@query(
    "x19_extract_rsp",
    with_views("lines")
    + f"""SELECT source_image_id, line_number, printf('Rs. %.2f', CAST(v AS DOUBLE)) AS parsed_value, least(confidence, 0.95e0) AS confidence
 FROM (SELECT *, {rx('text', V.RETAIL_SALE_PRICE)} AS v FROM lines) q WHERE v IS NOT NULL""",
)
def _(f):
    return S.extract_rsp(lines(f)).select("source_image_id", "line_number", "parsed_value", "confidence")


def label_images(f):
    return f.base("part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("inspection_id"))


view("x1", ("ocr_lines",), """
SELECT source_image_id, 'mrp' AS field_type, round(CASE WHEN source_image_id % 4 <> 0 THEN least(1.0e0, confidence + 0.05e0) ELSE confidence END, 4) AS confidence,
  CASE WHEN source_image_id % 4 <> 0 THEN 'pass' ELSE 'needs_review' END AS verdict FROM ocr_lines WHERE line_number = 2
UNION ALL SELECT source_image_id, 'net_quantity', max(round(CASE WHEN line_number = 1 THEN least(1.0e0, confidence + 0.05e0) ELSE confidence END, 4)), 'pass'
  FROM ocr_lines WHERE line_number < 2 GROUP BY 1
UNION ALL SELECT source_image_id, 'item_count', least(confidence, 0.94e0), 'pass' FROM ocr_lines WHERE line_number = 1 AND source_image_id % 3 = 2
UNION ALL SELECT source_image_id, 'mfg_date', round(confidence, 4), 'pass' FROM ocr_lines WHERE line_number = 4
UNION ALL SELECT source_image_id, 'manufacturer_address', round(least(1.0e0, confidence + 0.05e0), 4), 'pass' FROM ocr_lines WHERE line_number = 5
UNION ALL SELECT source_image_id, 'consumer_care', round(confidence, 4), 'pass' FROM ocr_lines WHERE line_number = 7
UNION ALL SELECT source_image_id, 'country_of_origin', round(confidence, 4), 'pass' FROM ocr_lines WHERE line_number = 8
UNION ALL SELECT source_image_id, 'commodity_name', round(confidence, 4), 'pass' FROM ocr_lines WHERE line_number = 0""")


@query("x1_extract_declarations", with_views("x1") + "SELECT source_image_id, source_image_id // 3 AS inspection_id, field_type, confidence, verdict FROM x1")
def _(f):
    rows = X.extract_declarations(f.ocr_lines(), label_images(f))
    return rows.select("source_image_id", "inspection_id", "field_type", "confidence", "verdict")


@query("x1_extract_declarations_samples")
def _(f):
    images = label_images(f).select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("id"), "inspection_id")
    return X.extract_declarations(lines(f), images)


@query(
    "x20_route_by_confidence",
    with_views("x1", "thresholds")
    + """SELECT source_image_id, field_type, CASE WHEN verdict = 'pass' AND confidence < coalesce(threshold, 0.85e0) THEN 'needs_review' ELSE verdict END AS verdict
 FROM x1 LEFT JOIN thresholds ON threshold_type = field_type""",
)
def _(f):
    rows = X.extract_declarations(f.ocr_lines(), label_images(f))
    return X.route_by_confidence(rows).select("source_image_id", "field_type", "verdict")


# ------------------------------------------------------------------ recognition results


def words(f):
    """The words of the fixture lines as a recogniser gives them, with blanks and separators mixed in."""
    i, n, k = F.col("source_image_id"), F.col("line_number"), F.col("k")
    split = f.ocr_lines().select("source_image_id", "line_number", F.posexplode(F.split("text", " ")).alias("k", "text"))
    return split.select(
        "source_image_id", F.lit(1).alias("block_num"), F.floor(n / 3).alias("par_num"), n.alias("line_num"),
        (n * 100 + k).cast("bigint").alias("word_seq"), F.when((i + n + k) % 11 == 0, " ").otherwise(F.col("text")).alias("text"),
        F.when((i + n + k) % 13 == 0, -1.0).otherwise(60.0 + (i * 3 + n + k * 7) % 40).alias("confidence"),
        (10 + 40 * k).alias("left"), (30 * n + k % 3).alias("top"), F.lit(35).alias("width"), (20 + k % 4).alias("height"),
    )


view("words", ("ocr_lines",), """SELECT source_image_id, line_number AS n, CAST(k - 1 AS INT) AS k, w,
 CASE WHEN (source_image_id + line_number + k - 1) % 13 = 0 THEN -1.0e0 ELSE 60.0e0 + (source_image_id * 3 + line_number + (k - 1) * 7) % 40 END AS conf
 FROM (SELECT source_image_id, line_number, generate_subscripts(string_split(text, ' '), 1) AS k, unnest(string_split(text, ' ')) AS w FROM ocr_lines) q""")


@query(
    "x21_words_to_lines",
    with_views("words")
    + """SELECT source_image_id, row_number() OVER (PARTITION BY source_image_id ORDER BY n) AS line_number, text, confidence, x, y, w, h
 FROM (SELECT source_image_id, n, string_agg(w, ' ' ORDER BY k) AS text, round(avg(conf / 100.0e0), 4) AS confidence, CAST(min(10 + 40 * k) AS DOUBLE) AS x,
  CAST(min(30 * n + k % 3) AS DOUBLE) AS y, CAST(max(45 + 40 * k) - min(10 + 40 * k) AS DOUBLE) AS w, CAST(max(30 * n + k % 3 + 20 + k % 4) - min(30 * n + k % 3) AS DOUBLE) AS h
  FROM words WHERE (source_image_id + n + k) % 11 <> 0 AND conf >= 0 GROUP BY 1, 2) q""",
)
def _(f):
    return OC.words_to_lines(words(f))


_SUM = "SELECT source_image_id, round(avg(confidence), 4) AS average_confidence, count(*) AS line_count, string_agg(text, chr(10) ORDER BY line_number) AS full_text FROM lines GROUP BY 1"


@query("x22_ocr_summary", with_views("lines") + _SUM)
def _(f):
    return OC.ocr_summary(lines(f))


@query(
    "x23_choose_ocr_result",
    with_views("ocr_lines")
    + """, p AS (SELECT source_image_id, line_number, confidence - 0.30e0 AS confidence FROM ocr_lines WHERE source_image_id % 5 <> 0),
 q AS (SELECT source_image_id, line_number, confidence - 0.15e0 - (source_image_id % 3) / 8.0e0 AS confidence FROM ocr_lines WHERE source_image_id % 7 <> 0),
 c AS (SELECT coalesce(a.i, b.i) AS i, CASE WHEN p >= 0.60e0 OR f IS NULL OR p > f THEN 'primary' ELSE 'fallback' END AS choice
  FROM (SELECT source_image_id AS i, round(avg(confidence), 4) AS p FROM p GROUP BY 1) a FULL JOIN (SELECT source_image_id AS i, round(avg(confidence), 4) AS f FROM q GROUP BY 1) b ON a.i = b.i)
 SELECT p.*, 'primary' AS chosen FROM p JOIN c ON c.i = p.source_image_id AND choice = 'primary'
 UNION ALL SELECT q.*, 'fallback' FROM q JOIN c ON c.i = q.source_image_id AND choice = 'fallback'""",
)
def _(f):
    i = F.col("source_image_id")
    rows = f.ocr_lines().select("source_image_id", "line_number", "confidence")
    primary = rows.filter(i % 5 != 0).withColumn("confidence", F.col("confidence") - 0.30)
    fallback = rows.filter(i % 7 != 0).withColumn("confidence", F.col("confidence") - 0.15 - (i % 3) / 8.0)
    return OC.choose_ocr_result(primary, fallback)
