"""Extractors that read one line and its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcheck import fixed_values as V
from panelcheck.functions.expr import any_of, case_map, contains_any, extract, float_text, json_bool, json_object, json_text
from panelcheck.operators.extract.lines import (
    BOX, LineExtractor, context, declaration, dense_lines, group1, has, near, per_line, raised, rx, rx_cased, settle_stages, strip,
)


def T() -> Column:
    return F.col("text")


# ------------------------------------------------------------------ price


def money_json(amount: Column, taxes: Column, extra: list[tuple[str, Column]] = ()) -> Column:
    return json_object(
        [("amount", float_text(F.round(amount, 2))), ("currency", F.lit('"INR"')), ("inclusive_of_all_taxes", json_bool(taxes)), *extra]
    )


def c(name: str) -> Column:
    return F.col(name)


def on(condition: Column, value: Column) -> Column:
    """The value where the condition holds, else null without evaluating it."""
    return F.when(condition, value)


def mrp_direct(where: tuple[str, ...] = ("next1_text", "prev_text", "next2_text")) -> LineExtractor:
    """A price right behind its header; the tax phrase may be on this, the next, the previous or the second next line."""
    return LineExtractor(
        [
            lambda: {"mrp_price": F.replace(group1(T(), V.MRP_DIRECT), F.lit(","), F.lit(".")).cast("double")},
            lambda: {
                "mrp_here": on(c("mrp_price") > 0, has(T(), V.TAX_INCLUSIVE)),
                "mrp_other": on(c("mrp_price") > 0, F.coalesce(*[F.when(has(c(t), V.TAX_INCLUSIVE), c(t)) for t in where])),
            },
            lambda: {"mrp_taxed": c("mrp_here") | c("mrp_other").isNotNull()},
        ],
        lambda: declaration(
            c("mrp_price") > 0, "mrp", F.concat_ws(" ", T(), c("mrp_other")), money_json(c("mrp_price"), c("mrp_taxed")),
            raised(c("confidence"), c("mrp_taxed")), F.when(c("mrp_taxed"), "pass").otherwise("needs_review"),
        ),
    )


def extract_mrp_direct(lines: DataFrame, group: str = "source_image_id", dense: bool = False) -> DataFrame:
    wanted = {"next1_text": ("text", 1), "prev_text": ("text", -1), "next2_text": ("text", 2)}
    keys = list(dict.fromkeys([group, "source_image_id"]))
    return per_line(context(lines, group, wanted, dense), keys, [mrp_direct()])


def extract_usp(lines: DataFrame, group: str = "source_image_id") -> DataFrame:
    """Unit sale price per group: the last line that names one and gives a value."""
    value, unit = group1(T(), V.USP_VALUE).cast("double"), F.lower(group1(T(), V.USP_VALUE, 2))
    found = lines.filter(has(T(), V.USP_HEADER)).select(
        group, "line_number", value.alias("unit_sale_price"), unit.alias("unit_sale_unit")
    ).filter("unit_sale_price IS NOT NULL")
    return found.groupBy(group).agg(
        F.max_by(F.struct("unit_sale_price", "unit_sale_unit"), "line_number").alias("u")
    ).select(group, "u.*")


# ------------------------------------------------------------------ quantity


def _unit(raw: Column) -> Column:
    low = strip(F.lower(raw))
    return case_map(low, V.UNIT_NAMES, low)


def net_quantity_multipack() -> LineExtractor:
    def parts():
        values = {f"mp_{i}": on(c("mp_hit"), group1(T(), V.QUANTITY_MULTIPACK, i)) for i in (1, 2, 4, 5)}
        above = contains_any(F.lower(F.coalesce("prev_text", F.lit(""))), V.MULTIPACK_PREVIOUS)
        return {**values, "mp_above": on(c("mp_hit") & above, c("prev_text"))}

    def make():
        parsed = json_object(
            [
                ("value", float_text(c("mp_4").cast("double"))), ("unit", json_text(_unit(c("mp_5")))), ("raw_unit", json_text(c("mp_5"))),
                ("is_multipack", F.lit("true")), ("units_count", c("mp_1").cast("bigint").cast("string")),
                ("unit_quantity", float_text(c("mp_2").cast("double"))),
            ]
        )
        return declaration(
            c("mp_hit"), "net_quantity", F.concat_ws(" ", c("mp_above"), T()), parsed, raised(c("confidence"), F.lit(True)),
            "pass", stage=0, by_confidence=False,
        )

    return LineExtractor([lambda: {"mp_hit": has(T(), V.QUANTITY_MULTIPACK)}, parts], make)


def net_quantity_standard() -> LineExtractor:
    nxt = "next1_text"

    def first():
        low = F.lower(T())
        free = ~contains_any(low, V.NUTRITION_WORDS)
        return {
            "sq_prefixed": free & has(T(), V.QUANTITY_PREFIXED),
            "sq_keyword": free & contains_any(low, V.QUANTITY_KEYWORDS),
        }

    def alone():
        return {"sq_alone": F.coalesce(on(c("sq_keyword") & ~c("sq_prefixed"), has(T(), V.QUANTITY_STANDALONE)), F.lit(False))}

    def below():
        asks = c("sq_keyword") & ~c("sq_prefixed") & ~c("sq_alone") & c(nxt).isNotNull()
        good = ~contains_any(F.lower(c(nxt)), V.NUTRITION_WORDS) & has(c(nxt), V.QUANTITY_STANDALONE)
        return {"sq_below": F.coalesce(on(asks, good), F.lit(False))}

    def values():
        part = lambda i: (
            F.when(c("sq_prefixed"), group1(T(), V.QUANTITY_PREFIXED, i))
            .when(c("sq_alone"), group1(T(), V.QUANTITY_STANDALONE, i))
            .when(c("sq_below"), group1(c(nxt), V.QUANTITY_STANDALONE, i))
        )
        return {"sq_amount": part(1).cast("double"), "sq_unit": part(2)}

    def make():
        parsed = json_object(
            [("value", float_text(c("sq_amount"))), ("unit", json_text(_unit(c("sq_unit")))), ("raw_unit", json_text(c("sq_unit")))]
        )
        return declaration(
            c("sq_amount") > 0, "net_quantity", F.when(c("sq_below"), F.concat_ws(" ", T(), c(nxt))).otherwise(T()), parsed,
            raised(c("confidence"), c("sq_prefixed")), "pass", stage=1,
        )

    return LineExtractor([first, alone, below, values], make)


def extract_net_quantity(lines: DataFrame, group: str = "source_image_id") -> DataFrame:
    """The first multipack of a group ends its search; otherwise every standard declaration."""
    ctx = context(lines, group, {"prev_text": ("text", -1), "next1_text": ("text", 1)})
    return settle_stages(per_line(ctx, [group], [net_quantity_multipack(), net_quantity_standard()]), group)


# ------------------------------------------------------------------ maker and address


def manufacturer() -> LineExtractor:
    """Role word plus up to three near lines, stopping at the next major header."""
    ahead = (1, 2, 3)

    def role():
        return {"mk_role": strip(F.lower(group1(T(), V.MAKER_ROLE)))}

    def taken():
        clear = c("mk_role").isNotNull() & ~(c("mk_role").isin(*V.MAKER_NEEDS_BY) & ~has(T(), V.MAKER_BY_OR_AT))
        out, stopped = {"mk_clear": clear}, F.lit(False)
        for k in ahead:
            t = c(f"next{k}_text")
            stopped = stopped | t.isNull() | F.coalesce(contains_any(F.lower(t), V.MAKER_STOP_HEADERS), F.lit(False))
            close = near(*[c(b) for b in BOX], *[c(f"next{k}_{b}") for b in BOX], V.MAKER_NEAR_PX)
            out[f"mk_take{k}"] = F.coalesce(on(c("mk_role").isNotNull(), ~stopped & F.coalesce(close, F.lit(False))), F.lit(False))
        return out

    def whole():
        parts = [T()] + [on(c(f"mk_take{k}"), c(f"next{k}_text")) for k in ahead]
        pin = F.coalesce(*[F.replace(extract(p, rx_cased(V.PIN_CODE_CASED)), F.lit(" "), F.lit("")) for p in parts])
        return {"mk_address": on(c("mk_clear"), F.concat_ws(", ", *parts)), "mk_pin": on(c("mk_clear"), pin)}

    def make():
        part = lambda b, k: on(c(f"mk_take{k}"), c(f"next{k}_{b}"))
        left = F.least("x", *[part("x", k) for k in ahead])
        top = F.least("y", *[part("y", k) for k in ahead])
        right = F.greatest(c("x") + c("w"), *[part("x", k) + part("w", k) for k in ahead])
        bottom = F.greatest(c("y") + c("h"), *[part("y", k) + part("h", k) for k in ahead])
        address, found = c("mk_address"), c("mk_pin").isNotNull()
        tail = F.substring(address, F.length("mk_role") + 1, F.length(address))
        worded = (F.length(strip(address)) > 6) & tail.rlike(r"\p{L}")
        parsed = json_object(
            [
                ("role", json_text(case_map(c("mk_role"), V.MAKER_ROLES, F.lit("manufacturer")))),
                ("name_and_address", json_text(address)), ("pincode", json_text(c("mk_pin"))), ("has_valid_pincode", json_bool(found)),
            ]
        )
        return declaration(
            c("mk_clear") & worded, "manufacturer_address", address, parsed, raised(c("confidence"), found),
            F.when(found, "pass").otherwise("needs_review"), box=[left, top, right - left, bottom - top],
        )

    return LineExtractor([role, taken, whole], make)


def extract_manufacturer(lines: DataFrame, group: str = "source_image_id") -> DataFrame:
    wanted = {f"next{k}_{c}": (c, k) for k in (1, 2, 3) for c in ("text", *BOX)}
    return per_line(context(lines, group, wanted), [group], [manufacturer()])


def importer_packer() -> LineExtractor:
    """Importer before packer before marketer; a name shorter than three letters does not count."""
    kinds = (("importer_address", V.IMPORTER), ("packer_address", V.PACKER), ("marketer_address", V.MARKETER))

    def values():
        long = F.length("ip_text") >= 6
        return {f"ip_{kind}": on(long, strip(group1(c("ip_text"), pattern))) for kind, pattern in kinds}

    def make():
        return F.coalesce(
            *[
                declaration(
                    F.length(f"ip_{kind}") >= 3, kind, c("ip_text"), c(f"ip_{kind}"),
                    F.least(c("confidence"), F.lit(V.CONFIDENCE_CAPS[kind])), "pass",
                )
                for kind, _ in kinds
            ]
        )

    return LineExtractor([lambda: {"ip_text": strip(T())}, values], make)


def extract_importer_packer(lines: DataFrame, group: str = "source_image_id") -> DataFrame:
    return per_line(lines, [group], [importer_packer()])


# ------------------------------------------------------------------ country, dimensions, counts, retail sale price


def country() -> LineExtractor:
    def known():
        squeezed = F.replace(F.lower(T()), F.lit(" "), F.lit(""))
        other = on(c("co_phrase").isNull() & contains_any(squeezed, V.ORIGIN_KEYWORDS), group1(T(), V.ORIGIN_COUNTRY))
        return {"co_name": F.nullif(strip(F.coalesce(c("co_phrase"), other)), F.lit(""))}

    def make():
        parsed = json_object([("country", json_text(F.upper("co_name"))), ("raw_country", json_text(c("co_name")))])
        return declaration(c("co_name").isNotNull(), "country_of_origin", T(), parsed, F.round("confidence", 4), "pass")

    return LineExtractor([lambda: {"co_phrase": group1(T(), V.ORIGIN_PHRASE)}, known], make)


def extract_country(lines: DataFrame, group: str = "source_image_id") -> DataFrame:
    return per_line(lines, [group], [country()])


def dimensions() -> LineExtractor:
    def make():
        unit = F.lower(F.coalesce("dm_6", "dm_4", "dm_2", F.lit("cm")))
        value = F.concat(F.concat_ws(" x ", "dm_1", "dm_3", "dm_5"), F.lit(" "), unit)
        return declaration(
            c("dm_hit"), "dimensions", c("dm_text"), value, F.least(c("confidence"), F.lit(V.CONFIDENCE_CAPS["dimensions"])), "pass"
        )

    return LineExtractor(
        [
            lambda: {"dm_text": strip(T())},
            lambda: {"dm_hit": has(c("dm_text"), V.DIMENSIONS)},
            lambda: {f"dm_{i}": on(c("dm_hit"), group1(c("dm_text"), V.DIMENSIONS, i)) for i in range(1, 7)},
        ],
        make,
    )


def item_count() -> LineExtractor:
    """A count, unless the line gives dimensions."""
    return LineExtractor(
        [
            lambda: {"ic_text": strip(T())},
            lambda: {"ic_n": group1(c("ic_text"), V.ITEM_COUNT)},
            lambda: {"ic_free": F.coalesce(on(c("ic_n").isNotNull(), ~has(c("ic_text"), V.DIMENSIONS)), F.lit(False))},
        ],
        lambda: declaration(
            c("ic_free"), "item_count", c("ic_text"), F.concat("ic_n", F.lit(" N")),
            F.least(c("confidence"), F.lit(V.CONFIDENCE_CAPS["item_count"])), "pass",
        ),
    )


def extract_dimensions(lines: DataFrame, group: str = "source_image_id") -> DataFrame:
    return per_line(lines, [group], [dimensions(), item_count()])


def retail_sale_price() -> LineExtractor:
    return LineExtractor(
        [lambda: {"rs_price": group1(T(), V.RETAIL_SALE_PRICE).cast("double")}],
        lambda: declaration(
            c("rs_price").isNotNull(), "rsp", strip(T()), F.format_string("Rs. %.2f", "rs_price"),
            F.least(c("confidence"), F.lit(V.CONFIDENCE_CAPS["rsp"])), "pass",
        ),
    )


def extract_rsp(lines: DataFrame, group: str = "source_image_id") -> DataFrame:
    return per_line(lines, [group], [retail_sale_price()])


# ------------------------------------------------------------------ commodity name


def _name_json(name: Column, method: str) -> Column:
    return json_object([("commodity_name", json_text(name)), ("detection_method", F.lit(f'"{method}"'))])


def name_explicit() -> LineExtractor:
    def good():
        n = c("ne_name")
        return {"ne_ok": F.coalesce(on(n != "", ~has(n, V.NAME_INSTRUCTION) & ~has(n, V.NAME_BUSINESS)), F.lit(False))}

    return LineExtractor(
        [lambda: {"ne_name": F.regexp_replace(strip(group1(T(), V.NAME_EXPLICIT)), rx(V.NAME_TRIM_MARK), "")}, good],
        lambda: declaration(
            c("ne_ok"), "commodity_name", T(), _name_json(c("ne_name"), "explicit_header"), F.round("confidence", 4), "pass",
            stage=0, by_confidence=False,
        ),
    )


def name_before_net() -> LineExtractor:
    return LineExtractor(
        [lambda: {"nb_word": group1(T(), V.NAME_BEFORE_NET)}],
        lambda: declaration(
            ~F.lower("nb_word").isin(*V.NAME_STOP_WORDS), "commodity_name", T(), _name_json(F.upper("nb_word"), "net_weight_prefix"),
            F.round("confidence", 4), "pass", stage=1, by_confidence=False,
        ),
    )


def headlines(lines: DataFrame, group: str = "source_image_id", keys: list[str] | None = None, placed: bool = False) -> DataFrame:
    """A name put together from up to four title fragments of the first ten lines by position.

    Ten lines bound what a group collects.  ``placed``: dense lines whose place in their group, from 1, is a column.
    """
    keys = keys or [group]
    if placed:
        top = lines.filter("place <= 10")
    else:
        lines = dense_lines(lines, group)
        first = lines.groupBy(group).agg(F.min("line_number").alias("_start"))
        top = lines.join(first, group).filter(F.col("line_number") < F.col("_start") + 10)
    tidy = lambda raw: strip(F.regexp_replace(F.regexp_replace(strip(raw), rx(V.NAME_TRIM_MARK), ""), rx(V.NAME_PROMOTION), ""))
    # tidied inside the generator: a filter on its output does not tidy again for each of its conditions
    split = F.split("text", r"\r\n|[\n\r\u000b\u000c\u0085  ]")
    pieces = top.select(*keys, "line_number", "confidence", *BOX, F.posexplode(F.transform(split, tidy)).alias("pos", "token"))
    t = F.col("token")
    low = F.lower(t)
    good = (
        (F.length(t) > 2) & (F.length(t) <= 60) & t.rlike(r"[A-Za-z]{3,}")
        & ~contains_any(low, V.NAME_OTHER_FIELDS) & ~contains_any(low, V.NAME_MARKETING)
        & ~any_of([has(t, p) for p in (V.NAME_INSTRUCTION, V.NAME_BUSINESS, V.NAME_PRICE_OR_DATE)])
    )
    kept = pieces.filter(good).withColumn("token", case_map(F.upper("token"), V.NAME_MISREAD, F.col("token")))
    is_brand = lambda e: F.upper(e["token"]).isin(*V.NAME_BRANDS)
    listed = kept.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("line_number", "pos", "token", "confidence", *BOX))).alias("all")
    )
    # the last brand leads, earlier brands drop out
    chosen = F.slice(
        F.concat(F.slice(F.reverse(F.filter("all", is_brand)), 1, 1), F.filter("all", lambda e: ~is_brand(e))), 1, 4
    )
    rows = listed.select(*keys, chosen.alias("c"), F.col("all")[0]["line_number"].alias("line_number"))
    edge = lambda fn: F.transform("c", fn)
    left, top_ = F.array_min(edge(lambda e: e["x"])), F.array_min(edge(lambda e: e["y"]))
    right, bottom = F.array_max(edge(lambda e: e["x"] + e["w"])), F.array_max(edge(lambda e: e["y"] + e["h"]))
    name = F.array_join(edge(lambda e: e["token"]), " ")
    conf = F.aggregate("c", F.lit(0.0), lambda a, e: a + e["confidence"]) / F.size("c")
    r1 = lambda v: F.round(v, 1)
    return per_line(
        rows, keys,
        [declaration(F.size("c") > 0, "commodity_name", name, _name_json(name, "headline_heuristic"), F.round(conf, 4), "pass",
                     stage=2, by_confidence=False, box=[r1(left), r1(top_), r1(right - left), r1(bottom - top_)])],
    )


def extract_commodity_name(lines: DataFrame, group: str = "source_image_id") -> DataFrame:
    found = per_line(lines, [group], [name_explicit(), name_before_net()])
    return settle_stages(found.unionByName(headlines(lines, group)), group)
